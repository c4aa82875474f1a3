"""The same results as plain SQL for another engine, written the direct way.

Whatever the Spark side rewrites for scale (bounds, histograms, hash cuts) is stated here
as the plain definition: full products, full sorts, row-by-row thresholds.
"""

from __future__ import annotations

from replyloom.functions.lexicon import INTENT_LEXICON, RISK_LEXICON, Lexicon
from replyloom.functions.text import WS_CHARS
from replyloom.operators.judging import PROMPT
from replyloom.operators.metrics import CONFIDENCE_GRID, SIMILARITY_GRID
from replyloom.operators.triage import NO_REPLY
from replyloom.plans.views import HIGH_RISK_LANGUAGES, LANGUAGE_LEXICON, LANGUAGES, PROSE_RISKS

WS = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1C-\x20\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def swap(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def normalize(x: str) -> str:
    x = swap(f"lower({x})", f"https?://{NOT_WS}+", " ")
    return strip(swap(swap(x, f"@{W}+", " "), f"{WS}+", " "))


def clean(x: str) -> str:
    x = swap(x, r"@\p{Nd}+", "")
    x = swap(x, rf"https?://t\.co/{NOT_WS}+", "")
    x = swap(x, rf"\^?[A-Z]{{2}}{WS}*\z", "")
    x = swap(x, rf"(?i){WS}*(?:You can check here|Check here|See here):?{WS}*\.?", "")
    return swap(strip(swap(x, f"{WS}+", " ")), rf"{WS}+([.!?,])", r"\1")


def words(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), {lit(W + '{2,}')})"


def ids(names: list[str]) -> str:
    return ", ".join(lit(n) for n in names)


def risk(x: str, lexicon: Lexicon) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {lit(t)})" for t in terms) + f" THEN {lit(name)}"
        for name, terms in lexicon.entries
    )
    return f"CASE {arms} END"


def weak(source: str, text: str, lexicon: Lexicon, fallback: str, keep: str) -> str:
    """CTEs ``scored`` and ``weak`` over ``source``."""
    scores = ", ".join(
        "(" + " + ".join(f"contains(x, {lit(t)})::INT" for t in dict.fromkeys(terms)) + f") AS s{i}"
        for i, (_, terms) in enumerate(lexicon.entries)
    )
    cols = [f"s{i}" for i in range(len(lexicon.entries))]
    best = f"greatest({', '.join(cols)})"
    arms = " ".join(f"WHEN {c} = {best} THEN {lit(n)}" for c, n in zip(cols, lexicon.categories))
    ties = " + ".join(f"({c} = {best})::INT" for c in cols)
    return f"""scored AS (SELECT {keep}, {scores}
      FROM (SELECT *, {normalize(f"coalesce({text}, '')")} AS x FROM {source})),
    weak AS (SELECT {keep}, CASE WHEN {best} = 0 THEN {lit(fallback)} WHEN {ties} > 1 THEN 'ambiguous'
      ELSE CASE {arms} END END AS suggested_intent, {best} AS suggestion_score,
      CASE WHEN {best} = 0 THEN 0.0::DOUBLE ELSE {best}::DOUBLE / ({" + ".join(cols)}) END AS suggestion_share
      FROM scored)"""


MSG = """msg AS (SELECT conv_id * 1000 + turn AS tweet_id, role AS author_id,
      CASE WHEN role = 'system' THEN NULL ELSE role = 'user' END AS inbound,
      CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id,
      text, 'turn ' || turn AS created_at FROM conversations)"""

PAIRS = f"""{MSG},
    pairs AS (SELECT p.tweet_id::VARCHAR AS customer_tweet_id, r.tweet_id::VARCHAR AS brand_tweet_id,
      p.author_id AS customer_author_id, 'Assistant' AS brand, p.created_at AS customer_created_at,
      r.created_at AS brand_created_at, {strip("p.text")} AS customer_text,
      {strip("r.text")} AS brand_response, r.tweet_id AS src_ord
      FROM msg r JOIN msg p ON p.tweet_id = r.parent_id
      WHERE lower(r.author_id) = 'assistant' AND {strip("p.text")} <> '' AND {strip("r.text")} <> '')"""

WAITING = """waiting AS (SELECT tweet_id AS query_id, text AS customer_text FROM msg
      WHERE inbound AND tweet_id NOT IN (SELECT parent_id FROM msg WHERE author_id = 'assistant' AND parent_id IS NOT NULL))"""

PAIR_CORPUS = f"""{PAIRS}, {WAITING},
    corpus AS (SELECT * FROM pairs
      WHERE {strip("customer_text")} NOT IN (SELECT {strip("customer_text")} FROM waiting)
      QUALIFY row_number() OVER (PARTITION BY customer_text ORDER BY src_ord) = 1)"""

DOCS = f"""docs AS (SELECT doc_id AS src_ord, doc_id AS sample_id, text AS customer_text, source AS brand_response,
      lang AS final_intent, 'd' || doc_id AS customer_tweet_id, source AS brand_tweet_id FROM documents)"""


def golden(n: int) -> str:
    """CTE ``golden``: quota per language, topped up."""
    quota = max(10, n // len(LANGUAGES))
    return f"""pool AS (SELECT *, md5('42:' || sample_id) AS o FROM docs
      WHERE final_intent IN ({ids(LANGUAGES)}) AND {strip("customer_text")} <> ''),
    chosen AS (SELECT * FROM pool
      QUALIFY row_number() OVER (PARTITION BY final_intent ORDER BY o, sample_id) <= {quota}),
    rest AS (SELECT *, row_number() OVER (ORDER BY o, sample_id) AS place FROM pool
      WHERE sample_id NOT IN (SELECT sample_id FROM chosen)),
    golden AS (SELECT * FROM (SELECT * FROM chosen UNION ALL
        SELECT * EXCLUDE place FROM rest WHERE place <= {n} - (SELECT count(*) FROM chosen))
      QUALIFY row_number() OVER (ORDER BY o, sample_id) <= {n})"""


def split(extra: str = "") -> str:
    """CTE ``split`` over docs."""
    return f"""once AS (SELECT * FROM docs
      WHERE final_intent IN ({ids(LANGUAGES)}) AND {strip("customer_text")} <> '' {extra}
      QUALIFY row_number() OVER (PARTITION BY customer_text ORDER BY src_ord) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY final_intent ORDER BY md5('42:' || src_ord), src_ord) AS r,
      count(*) OVER (PARTITION BY final_intent) AS n FROM once),
    split AS (SELECT *, CASE WHEN r <= (70 * n + 50) // 100 THEN 'train'
      WHEN r <= (85 * n + 50) // 100 THEN 'validation' ELSE 'test' END AS split FROM placed)"""


FULL_CORPUS = f"""{DOCS},
    corpus AS (SELECT * FROM docs
      WHERE {strip("customer_text")} <> '' AND {strip("brand_response")} <> ''
      QUALIFY row_number() OVER (PARTITION BY customer_text, brand_response ORDER BY src_ord) = 1)"""

DOC_CORPUS = f"""{DOCS}, {golden(200)},
    corpus AS (SELECT * FROM docs
      WHERE {strip("customer_text")} NOT IN (SELECT {strip("customer_text")} FROM golden)
        AND {strip("customer_text")} <> '' AND {strip("brand_response")} <> ''
      QUALIFY row_number() OVER (PARTITION BY customer_text ORDER BY src_ord) = 1)"""


def term_ctes(prefix: str, source: str, key: str, text: str) -> str:
    """CTE ``{prefix}_tf`` (id, term, tf) with one- and two-word terms."""
    return f"""{prefix}_tok AS (SELECT {key} AS id, {words(text)} AS t FROM {source}),
    {prefix}_tf AS (SELECT id, term, count(*) AS tf FROM (
        SELECT id, unnest(t) AS term FROM {prefix}_tok
        UNION ALL
        SELECT id, t[i] || ' ' || t[i + 1] FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM {prefix}_tok))
      GROUP BY id, term)"""


def vocabulary(source: str, cap: int) -> str:
    return f"""stats AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM d_tf GROUP BY term),
    vocab AS (SELECT *, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) + 1.0 AS idf
      FROM stats WHERE df >= 2 ORDER BY cf DESC, term LIMIT {cap})"""


def weights(prefix: str) -> str:
    return f"""{prefix}_raw AS (SELECT id, term, (1.0 + ln(tf)) * idf AS w FROM {prefix}_tf JOIN vocab USING (term)),
    {prefix}_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {prefix}_raw)"""


def matches(corpus: str, source: str, key: str, k: int) -> str:
    """CTE ``found``: the k best documents of every query, one empty row when none."""
    return f"""{term_ctes("d", "corpus", "src_ord", "customer_text")}, {vocabulary("corpus", 200000)}, {weights("d")},
    {term_ctes("q", source, key, "customer_text")}, {weights("q")},
    sims AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS similarity
      FROM q_w q JOIN d_w d USING (term) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM sims),
    found AS (SELECT s.{key} AS query_id, coalesce(r.rank, 1) AS rank, r.doc_id,
      coalesce(r.similarity, 0.0) AS similarity, c.customer_text AS retrieved_customer_text,
      c.brand_response AS retrieved_brand_response
      FROM {source} s LEFT JOIN (SELECT * FROM ranked WHERE rank <= {k}) r ON r.query_id = s.{key}
      LEFT JOIN corpus c ON c.src_ord = r.doc_id)"""


def reason(text: str, intent: str, confidence: str, similarity: str) -> str:
    return f"""CASE WHEN {risk(text, PROSE_RISKS)} IS NOT NULL THEN {risk(text, PROSE_RISKS)}
      WHEN {intent} IN ({ids(HIGH_RISK_LANGUAGES)}) THEN 'high_risk_intent'
      WHEN {confidence} < 0.2e0 THEN 'low_intent_confidence'
      WHEN {similarity} < 0.2e0 THEN 'low_historical_similarity' ELSE 'safe_to_auto_handle' END"""


TRIAGE = f"""{PAIR_CORPUS}, {matches("corpus", "waiting", "query_id", 1)},
    {weak("waiting", "customer_text", LANGUAGE_LEXICON, "none", "query_id, customer_text")},
    decided AS (SELECT w.query_id, w.customer_text, w.suggested_intent AS predicted_intent,
      w.suggestion_share AS intent_confidence, f.similarity AS retrieval_similarity,
      f.retrieved_customer_text, f.retrieved_brand_response,
      {reason("w.customer_text", "w.suggested_intent", "w.suggestion_share", "f.similarity")} AS escalation_reason
      FROM weak w JOIN found f USING (query_id)),
    triaged AS (SELECT *, escalation_reason <> 'safe_to_auto_handle' AS predicted_escalate,
      CASE WHEN escalation_reason <> 'safe_to_auto_handle' THEN 'HUMAN REVIEW' ELSE 'AUTO-HANDLE' END AS action,
      {clean("retrieved_brand_response")} AS cleaned FROM decided),
    drafted AS (SELECT *, CASE WHEN retrieval_similarity >= 0.2e0 AND cleaned <> '' THEN cleaned
      ELSE {lit(NO_REPLY)} END AS draft_reply FROM triaged)"""

GOLD = f"""{PAIR_CORPUS},
    gold AS (SELECT d.doc_id AS sample_id, d.text AS customer_text, d.lang AS gold_intent,
      (l.toxic = 1 OR l.quality = 0) AS gold_escalate,
      CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'quality' ELSE 'not_applicable' END AS gold_escalation_reason
      FROM documents d JOIN labels l USING (doc_id)),
    {matches("corpus", "gold", "sample_id", 1)},
    {weak("gold", "customer_text", LANGUAGE_LEXICON, "none",
          "sample_id, customer_text, gold_intent, gold_escalate, gold_escalation_reason")},
    decided AS (SELECT w.*, w.suggested_intent AS predicted_intent, w.suggestion_share AS intent_confidence,
      f.similarity AS retrieval_similarity, f.retrieved_customer_text,
      {clean("f.retrieved_brand_response")} AS draft_reply,
      {reason("w.customer_text", "w.suggested_intent", "w.suggestion_share", "f.similarity")} AS escalation_reason
      FROM weak w JOIN found f ON f.query_id = w.sample_id),
    evaluated AS (SELECT *, escalation_reason <> 'safe_to_auto_handle' AS predicted_escalate FROM decided)"""

FAILED = f"""{GOLD},
    failed AS (SELECT *, 'intent_misclassification' AS error_type FROM evaluated WHERE gold_intent <> predicted_intent
      UNION ALL SELECT *, 'escalation_error' FROM evaluated WHERE gold_escalate <> predicted_escalate),
    failures AS (SELECT sample_id, gold_intent, predicted_intent, round(intent_confidence, 6) AS intent_confidence,
      retrieval_similarity, gold_escalate, predicted_escalate, gold_escalation_reason, error_type,
      intent_confidence AS c FROM failed)"""

WEAK_DOCS = f"""{DOCS}, {weak("docs", "customer_text", LANGUAGE_LEXICON, "none", "sample_id, final_intent")}"""


def report(source: str, gold: str, predicted: str) -> str:
    """CTE ``report``: rates per label of the union."""
    return f"""names AS (SELECT {gold} AS label FROM {source} UNION SELECT {predicted} FROM {source}),
    tally AS (SELECT label,
      (SELECT count(*) FROM {source} WHERE {gold} = label AND {predicted} = label) AS tp,
      (SELECT count(*) FROM {source} WHERE {predicted} = label) AS named,
      (SELECT count(*) FROM {source} WHERE {gold} = label) AS support FROM names),
    rates AS (SELECT label, tp, support, CASE WHEN named = 0 THEN 0.0 ELSE tp::DOUBLE / named END AS precision,
      CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall FROM tally),
    report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
      ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM rates)"""


CLASS_METRICS = f"""{WEAK_DOCS}, {report("weak", "final_intent", "suggested_intent")},
    lines AS (SELECT label, precision, recall, f1, support FROM report
      UNION ALL SELECT 'accuracy', sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support),
        sum(tp)::DOUBLE / sum(support), sum(support) FROM report
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM report
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
        sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM report),
    class_metrics AS (SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, support::BIGINT AS support FROM lines)"""


def binary(source: str, gold: str, predicted: str) -> str:
    return f"""counted AS (SELECT count(*) FILTER (WHERE {gold} AND {predicted}) AS tp,
      count(*) FILTER (WHERE NOT ({gold}) AND {predicted}) AS fp,
      count(*) FILTER (WHERE {gold} AND NOT ({predicted})) AS fn, count(*) AS n FROM {source}),
    pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p,
      CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM counted)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall,
      round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END, 6) AS f1,
      round((tp + fp)::DOUBLE / n, 6) AS escalation_rate,
      round(1.0 - (tp + fp)::DOUBLE / n, 6) AS auto_handle_rate FROM pr"""


def doubles(grid: list[float]) -> str:
    return ", ".join(f"({x!r}e0)" for x in grid)


SWEEP = f"""scored AS (SELECT value / 500.0::DOUBLE AS c,
      regexp_extract(props, '[0-9]+')::DOUBLE / 100.0::DOUBLE AS s,
      event_type = 'signup' AS always, event_type = 'error' AS gold FROM events),
    grid AS (SELECT ct, st FROM (VALUES {doubles(CONFIDENCE_GRID)}) a(ct), (VALUES {doubles(SIMILARITY_GRID)}) b(st)),
    flagged AS (SELECT ct, st, gold, always OR c < ct OR s < st AS p FROM scored, grid),
    counted AS (SELECT ct, st, count(*) FILTER (WHERE gold AND p) AS tp, count(*) FILTER (WHERE NOT gold AND p) AS fp,
      count(*) FILTER (WHERE gold AND NOT p) AS fn, count(*) AS n FROM flagged GROUP BY ct, st),
    pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p,
      CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM counted),
    sweep AS (SELECT round_even(ct, 2) AS intent_confidence_threshold, round_even(st, 2) AS retrieval_similarity_threshold,
      round_even(p, 4) AS precision, round_even(r, 4) AS recall,
      round_even(CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END, 4) AS f1,
      round_even((tp + fp)::DOUBLE / n, 4) AS escalation_rate FROM pr)"""
BEST_ORDER = "ORDER BY f1 DESC, precision DESC, intent_confidence_threshold, retrieval_similarity_threshold LIMIT 10"

JUDGED = """answers AS (SELECT event_id AS sample_id, regexp_extract(props, '[0-9]+')::INT AS k FROM events),
    judged AS (SELECT sample_id,
      CASE WHEN k NOT IN (11, 12) THEN k % 5 + 1 END AS grounded,
      CASE WHEN k NOT IN (11, 12) THEN (k // 5) % 5 + 1 END AS relevant,
      CASE WHEN k NOT IN (11, 12) THEN (k // 25) % 5 + 1 END AS helpful,
      CASE WHEN k NOT IN (11, 12) THEN k % 2 END AS unsupported_claim,
      CASE WHEN k = 13 THEN 9 WHEN k NOT IN (11, 12) THEN (k // 3) % 5 + 1 END AS overall,
      CASE WHEN k NOT IN (11, 12, 17) THEN 'said {so}' END AS reason,
      CASE k WHEN 11 THEN 'no_json' WHEN 12 THEN 'malformed' WHEN 17 THEN 'missing_field'
        WHEN 13 THEN 'out_of_range' ELSE 'ok' END AS status FROM answers)"""
USABLE = "FILTER (WHERE status = 'ok')"

PROMPT_SQL = " || ".join(
    part
    for pair in zip(
        [lit(p) for p in PROMPT.split("%s")],
        [f"coalesce({c}, '')" for c in ("customer_text", "retrieved_customer_text", "retrieved_brand_response", "draft_reply")]
        + ["''"],
    )
    for part in pair
)

DECORATED = """'@115712 ' || brand_response || ' , really ! You can check here: https://t.co/Ab12 .'
      || CASE WHEN src_ord % 2 = 0 THEN ' ^JB ' ELSE '  See here:. XY' END"""

SHEET_BLANKS = "'' AS candidate_intent, '' AS final_intent, '' AS label_confidence, '' AS label_notes"

MODEL_ROWS = f"""{DOCS}, {split()}, {PAIR_CORPUS},
    test AS (SELECT sample_id, customer_text, final_intent AS gold_intent,
      final_intent IN ({ids(HIGH_RISK_LANGUAGES)}) AS gold_escalate FROM split WHERE split = 'test'),
    {matches("corpus", "test", "sample_id", 1)},
    {weak("test", "customer_text", LANGUAGE_LEXICON, "none", "sample_id, customer_text, gold_intent, gold_escalate")},
    evaluated AS (SELECT w.*, w.suggested_intent AS predicted_intent, f.similarity AS retrieval_similarity,
      {reason("w.customer_text", "w.suggested_intent", "w.suggestion_share", "f.similarity")} AS escalation_reason
      FROM weak w JOIN found f ON f.query_id = w.sample_id),
    flagged AS (SELECT *, escalation_reason <> 'safe_to_auto_handle' AS predicted_escalate FROM evaluated)"""

DOC_PAIRS = f"""pairs AS (SELECT 'd' || doc_id AS customer_tweet_id, source AS brand_tweet_id, {strip("text")} AS customer_text,
      {strip("'source: ' || source")} AS brand_response, doc_id AS src_ord FROM documents)"""

INTENT_SAMPLE = f"""fit AS (SELECT *, {normalize("customer_text")} AS x FROM pairs
        WHERE length(customer_text) >= 10 AND length(brand_response) >= 10),
      once AS (SELECT *, customer_tweet_id || '-' || brand_tweet_id AS k,
        CASE WHEN length(customer_text) <= 80 THEN 0 WHEN length(customer_text) <= 200 THEN 1 ELSE 2 END AS b
        FROM fit WHERE length(x) >= 10 QUALIFY row_number() OVER (PARTITION BY x ORDER BY src_ord) = 1),
      drawn AS (SELECT * FROM once
        QUALIFY row_number() OVER (PARTITION BY b ORDER BY md5((42 + b) || ':' || k), k)
          <= CASE b WHEN 2 THEN 160 ELSE 170 END)
      SELECT row_number() OVER (ORDER BY md5('42:' || k), k) AS sample_id, customer_tweet_id, brand_tweet_id,
        customer_text, brand_response, {SHEET_BLANKS} FROM drawn QUALIFY sample_id <= 500"""

# The design matrix of the fit: one-word terms of the training rows, no floor and no cap.
TRAIN_TERMS = f"""{DOCS}, {split()}, fit AS (SELECT * FROM split WHERE split = 'train'),
    t_tok AS (SELECT src_ord AS id, {words("customer_text")} AS t FROM fit),
    t_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM t_tok) GROUP BY id, term),
    vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM fit)) / (1.0 + count(*))) + 1.0 AS idf,
      row_number() OVER (ORDER BY term) - 1 AS idx FROM t_tf GROUP BY term),
    t_raw AS (SELECT id, term, idx, (1.0 + ln(tf)) * idf AS w FROM t_tf JOIN vocab USING (term))"""

ORACLE: dict[str, str] = {
    "message_scan": f"""WITH {MSG} SELECT tweet_id, author_id, inbound,
      parent_id::VARCHAR AS in_response_to_tweet_id, text, created_at FROM msg""",
    "inbound_counts": f"""WITH {MSG} SELECT count(*) AS total, count(*) FILTER (WHERE inbound) AS inbound,
      count(*) FILTER (WHERE NOT inbound) AS outbound FROM msg""",
    "top_accounts": """WITH counts AS (SELECT event_type || '-' || user_id AS author_id, count(*) AS messages
      FROM events WHERE event_type <> 'error' GROUP BY 1)
      SELECT row_number() OVER (ORDER BY messages DESC, author_id) AS rank, author_id, messages
      FROM counts QUALIFY rank <= 30""",
    "pair_counts": f"""WITH {PAIRS}, own AS (SELECT * FROM msg WHERE author_id = 'assistant')
      SELECT 'messages' AS stage, count(*) AS n FROM msg
      UNION ALL SELECT 'brand_messages', count(*) FROM own
      UNION ALL SELECT 'brand_ids', count(DISTINCT tweet_id) FROM own
      UNION ALL SELECT 'parent_ids', count(DISTINCT parent_id) FROM own
      UNION ALL SELECT 'pairs', count(*) FROM pairs""",
    "parent_semi": f"""WITH {MSG} SELECT tweet_id, author_id, text FROM msg
      WHERE tweet_id IN (SELECT parent_id FROM msg WHERE author_id = 'assistant')""",
    "extracted_pairs": f"WITH {PAIRS} SELECT * EXCLUDE src_ord FROM pairs",
    "csv_landing": f"""WITH {MSG}, dump AS (SELECT tweet_id, author_id, inbound, parent_id, text FROM msg
        UNION ALL SELECT tweet_id, author_id, inbound, parent_id, text || ' "again",' || chr(10) || 'said' FROM msg WHERE tweet_id % 5 = 0)
      SELECT tweet_id, author_id, inbound, parent_id::VARCHAR AS in_response_to_tweet_id, nullif(text, '') AS text, 'landed' AS status
      FROM dump WHERE tweet_id % 17 <> 0
      UNION ALL SELECT tweet_id, NULL, NULL, NULL, NULL, 'rejected' FROM dump WHERE tweet_id % 17 = 0""",
    "reply_pairs": f"WITH {PAIRS} SELECT * EXCLUDE src_ord FROM pairs",
    "dedup_keep_first": """SELECT * FROM documents
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "normalize_text": f"""SELECT doc_id, {normalize("chr(9) || ' https://t.example/A?b=1 @User_9 ' || text || ' @x '")}
      AS normalized, length(text) AS n_text FROM documents""",
    "clean_response": f"WITH {PAIRS} SELECT brand_tweet_id, {clean(DECORATED)} AS cleaned FROM pairs",
    "fold_accents": "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents",
    "tokens": f"""SELECT doc_id, len({words("text")}) AS n_tokens,
      array_to_string({words("text")}, ' ') AS tokens FROM documents""",
    "ngrams": f"""WITH {term_ctes("d", "documents", "doc_id", "text")} SELECT id AS doc_id, term, tf FROM d_tf""",
    "risk_flag_rows": f"SELECT doc_id, {risk('text', RISK_LEXICON)} AS risk FROM documents",
    "weak_label_rows": f"""WITH {WEAK_DOCS} SELECT sample_id, suggested_intent, suggestion_score,
      round(suggestion_share, 6) AS suggestion_share FROM weak""",
    "weak_label_joined": f"""WITH {WEAK_DOCS} SELECT sample_id, suggested_intent, suggestion_score,
      round(suggestion_share, 6) AS suggestion_share FROM weak""",
    "risk_flag_joined": f"SELECT doc_id, {risk('text', RISK_LEXICON)} AS risk FROM documents",
    "weak_label_words": f"""WITH terms AS (SELECT DISTINCT substr(t, 1, 1) AS category, t AS term
        FROM (SELECT unnest({words("text")}) AS t FROM benchmark) WHERE length(t) >= 4),
      shown AS (SELECT doc_id AS sample_id, {normalize("coalesce(text, '')")} AS x FROM documents),
      hits AS (SELECT sample_id, category, count(*) AS score FROM shown JOIN terms ON contains(x, term) GROUP BY ALL),
      top AS (SELECT *, max(score) OVER (PARTITION BY sample_id) AS best FROM hits),
      named AS (SELECT sample_id, CASE WHEN count(*) FILTER (score = best) > 1 THEN 'ambiguous'
        ELSE any_value(category) FILTER (score = best) END AS name, any_value(best) AS best,
        any_value(best)::DOUBLE / sum(score) AS share FROM top GROUP BY sample_id)
      SELECT sample_id, coalesce(name, 'none') AS suggested_intent, coalesce(best, 0)::INT AS suggestion_score,
        round(coalesce(share, 0.0), 6) AS suggestion_share FROM shown LEFT JOIN named USING (sample_id)""",
    "weak_intent_rows": f"""WITH {MSG}, {weak("msg", "text", INTENT_LEXICON, "other_non_actionable", "tweet_id")}
      SELECT tweet_id, suggested_intent, suggestion_score FROM weak""",
    "weak_label_dist": f"WITH {WEAK_DOCS} SELECT suggested_intent, count(*) AS n FROM weak GROUP BY 1",
    "intent_sample": f"WITH {PAIRS}, {INTENT_SAMPLE}",
    "intent_sample_documents": f"WITH {DOC_PAIRS}, {INTENT_SAMPLE}",
    "golden_quota": f"""WITH {DOCS}, {golden(500)} SELECT sample_id, customer_tweet_id, brand_tweet_id,
      customer_text, brand_response, final_intent AS gold_intent, '' AS gold_escalate,
      '' AS gold_escalation_reason, '' AS gold_label_confidence, '' AS gold_label_notes,
      'pending' AS human_review_status FROM golden""",
    "review_template": f"""WITH {PAIRS} SELECT row_number() OVER (ORDER BY src_ord) AS sample_id,
      customer_text, brand_response, '' AS gold_intent, '' AS gold_escalate, '' AS gold_escalation_reason,
      '' AS review_notes, 'pending' AS review_status FROM pairs""",
    "model_triage": f"""WITH {MODEL_ROWS} SELECT sample_id, predicted_intent, retrieval_similarity, predicted_escalate,
      escalation_reason, gold_intent = predicted_intent AS intent_correct FROM flagged""",
    "model_eval_summary": f"""WITH {MODEL_ROWS}, {report("flagged", "gold_intent", "predicted_intent")},
      binary_rates AS ({"WITH " + binary("flagged", "gold_escalate", "predicted_escalate")})
      SELECT 'accuracy' AS metric, '' AS label, round(avg((gold_intent = predicted_intent)::INT), 6) AS value FROM flagged
      UNION ALL SELECT 'macro_f1', '', round(avg(f1), 6) FROM report
      UNION ALL SELECT 'precision', '', precision FROM binary_rates UNION ALL SELECT 'recall', '', recall FROM binary_rates
      UNION ALL SELECT 'f1', '', f1 FROM binary_rates UNION ALL SELECT 'escalation_rate', '', escalation_rate FROM binary_rates
      UNION ALL SELECT 'auto_handle_rate', '', auto_handle_rate FROM binary_rates
      UNION ALL SELECT 'reason', escalation_reason, count(*)::DOUBLE FROM flagged GROUP BY 2
      UNION ALL SELECT 'pair', gold_intent || '>' || predicted_intent, count(*)::DOUBLE FROM flagged GROUP BY 2""",
    "train_features": f"""WITH {TRAIN_TERMS} SELECT id AS src_ord, term, idx,
      round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM t_raw""",
    "class_weights": f"""WITH {DOCS}, {split()}, fit AS (SELECT final_intent, count(*) AS n FROM split
      WHERE split = 'train' GROUP BY 1) SELECT final_intent, n,
      round((SELECT sum(n) FROM fit)::DOUBLE / ((SELECT count(*) FROM fit) * n), 6) AS weight FROM fit""",
    "stratified_split": f"WITH {DOCS}, {split()} SELECT sample_id, final_intent, split FROM split",
    "split_without_golden": f"""WITH {DOCS}, {golden(200)},
      {split(f"AND {strip('customer_text')} NOT IN (SELECT {strip('customer_text')} FROM golden)")}
      SELECT final_intent, split, count(*) AS n FROM split GROUP BY ALL""",
    "split_overlap": f"""WITH {DOCS}, {golden(200)}, {split()}
      SELECT count(*) AS overlap FROM (SELECT {strip("customer_text")} FROM split
        INTERSECT SELECT {strip("customer_text")} FROM golden)""",
    "corpus_full": f"WITH {FULL_CORPUS} SELECT sample_id, customer_text, brand_response FROM corpus",
    "corpus_leakage_free": f"WITH {DOC_CORPUS} SELECT sample_id, customer_text FROM corpus",
    "exclusion_counts": f"""WITH {DOC_CORPUS} SELECT 'golden_texts' AS stage,
      count(DISTINCT {strip("customer_text")}) AS n FROM golden
      UNION ALL SELECT 'documents', count(*) FROM corpus""",
    "term_stats": f"""WITH {PAIR_CORPUS}, {term_ctes("d", "corpus", "src_ord", "customer_text")}
      SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM d_tf GROUP BY term""",
    "vocab_select": f"""WITH {DOC_CORPUS}, {term_ctes("d", "corpus", "src_ord", "customer_text")},
      {vocabulary("corpus", 5000)} SELECT term, cf, df FROM vocab""",
    "tfidf_weights": f"""WITH {FULL_CORPUS}, {term_ctes("d", "corpus", "src_ord", "customer_text")},
      {vocabulary("corpus", 200000)}, {weights("d")} SELECT id AS doc_id, term, round(w, 6) AS weight FROM d_w""",
    "index_counts": f"""WITH {FULL_CORPUS}, {term_ctes("d", "corpus", "src_ord", "customer_text")},
      {vocabulary("corpus", 200000)} SELECT 'documents' AS stage, count(*) AS n FROM corpus
      UNION ALL SELECT 'features', count(*) FROM vocab""",
    "cosine_top1": f"""WITH {PAIR_CORPUS}, {matches("corpus", "waiting", "query_id", 1)}
      SELECT query_id, doc_id, similarity, retrieved_customer_text, retrieved_brand_response FROM found""",
    "cosine_topk": f"""WITH {DOC_CORPUS}, bench AS (SELECT item_id AS query_id, text AS customer_text FROM benchmark),
      {matches("corpus", "bench", "query_id", 5)} SELECT query_id, rank, doc_id, similarity FROM found""",
    "saved_index_topk": f"""WITH {DOC_CORPUS}, bench AS (SELECT item_id AS query_id, text AS customer_text FROM benchmark),
      {matches("corpus", "bench", "query_id", 3)} SELECT query_id, rank, doc_id, similarity FROM found""",
    "topk_cleaned": f"""WITH {PAIR_CORPUS}, {matches("corpus", "waiting", "query_id", 5)}
      SELECT query_id, rank, doc_id, similarity, retrieved_customer_text,
        {clean("retrieved_brand_response")} AS retrieved_brand_response FROM found""",
    "cosine_full": f"""WITH {FULL_CORPUS}, bench AS (SELECT item_id AS query_id, text AS customer_text FROM benchmark),
      {matches("corpus", "bench", "query_id", 3)}
      SELECT query_id, rank, doc_id, similarity, retrieved_brand_response FROM found""",
    "retrieval_stats": f"""WITH {DOC_CORPUS}, bench AS (SELECT item_id AS query_id, text AS customer_text FROM benchmark),
      {matches("corpus", "bench", "query_id", 1)} SELECT count(*) AS queries, round(avg(similarity), 6) AS mean_similarity,
      max(similarity) AS max_similarity, min(similarity) AS min_similarity,
      round(median(similarity), 6) AS median_similarity FROM found""",
    "retrieval_top10": f"""WITH {DOC_CORPUS}, bench AS (SELECT item_id AS query_id, text AS customer_text FROM benchmark),
      {matches("corpus", "bench", "query_id", 1)} SELECT query_id, doc_id, similarity FROM found
      ORDER BY similarity DESC, query_id LIMIT 10""",
    "triage_rows": f"""WITH {TRIAGE} SELECT query_id, predicted_intent, round(intent_confidence, 6) AS intent_confidence,
      retrieval_similarity, predicted_escalate, escalation_reason, action FROM drafted""",
    "draft_reply": f"WITH {TRIAGE} SELECT query_id, draft_reply FROM drafted",
    "eval_examples": f"""WITH {GOLD} SELECT sample_id, gold_intent, gold_escalate, predicted_intent,
      round(intent_confidence, 6) AS intent_confidence, retrieved_customer_text,
      draft_reply AS retrieved_brand_response, retrieval_similarity, predicted_escalate, escalation_reason,
      draft_reply, gold_intent = predicted_intent AS intent_correct,
      gold_escalate = predicted_escalate AS escalation_correct FROM evaluated""",
    "escalation_reasons": f"WITH {GOLD} SELECT escalation_reason, count(*) AS n FROM evaluated GROUP BY 1",
    "eval_metrics": f"WITH {GOLD}, {binary('evaluated', 'gold_escalate', 'predicted_escalate')}",
    "failure_rows": f"WITH {FAILED} SELECT * EXCLUDE c FROM failures",
    "failure_top": f"""WITH {FAILED},
      worst AS (SELECT *, round(1 - c, 6) AS confidence_gap, 0 AS kind FROM failures
          WHERE error_type = 'intent_misclassification'
          QUALIFY row_number() OVER (ORDER BY 1 - c DESC, retrieval_similarity, sample_id) <= 20
        UNION ALL SELECT *, NULL, 1 FROM failures WHERE error_type = 'escalation_error'
          QUALIFY row_number() OVER (ORDER BY c, retrieval_similarity, sample_id) <= 20)
      SELECT * EXCLUDE (c, kind) FROM worst
      QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY kind) = 1""",
    "majority_baseline": f"""WITH {DOCS}, {split()},
      top AS (SELECT final_intent AS m FROM split WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
      test AS (SELECT final_intent AS g, (SELECT m FROM top) AS p FROM split WHERE split = 'test'),
      {report("test", "g", "p")}
      SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
        (SELECT m FROM top) AS majority, (SELECT count(*) FROM test) AS test_rows FROM report""",
    "class_metrics": f"WITH {CLASS_METRICS} SELECT * FROM class_metrics",
    "macro_f1": f"""WITH {WEAK_DOCS}, {report("weak", "final_intent", "suggested_intent")}
      SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM report""",
    "confusion_matrix": f"""WITH {WEAK_DOCS} SELECT final_intent AS gold, """
    + ", ".join(
        f"count(*) FILTER (WHERE suggested_intent = {lit(n)}) AS {n}" for n in [*LANGUAGES, "ambiguous"]
    )
    + ", count(*) FILTER (WHERE suggested_intent = 'none') AS other FROM weak GROUP BY 1",
    "confusion_pairs": f"""WITH {WEAK_DOCS} SELECT final_intent AS gold, suggested_intent AS predicted, count(*) AS n
      FROM weak WHERE final_intent <> suggested_intent GROUP BY 1, 2 ORDER BY n DESC, gold, predicted LIMIT 10""",
    "binary_metrics": f"WITH {binary('labels', 'toxic = 1', 'quality = 0')}",
    "metric_report": f"""WITH {CLASS_METRICS} SELECT 'precision' AS metric, label, precision AS value FROM class_metrics
      UNION ALL SELECT 'recall', label, recall FROM class_metrics
      UNION ALL SELECT 'f1', label, f1 FROM class_metrics
      UNION ALL SELECT 'support', label, support::DOUBLE FROM class_metrics""",
    "threshold_sweep": f"WITH {SWEEP} SELECT * FROM sweep",
    "threshold_sweep_gaps": "WITH "
    + SWEEP.replace("value / 500.0::DOUBLE AS c", "CASE WHEN event_id % 7 <> 0 THEN value / 500.0::DOUBLE END AS c")
    .replace("regexp_extract(props", "CASE WHEN event_id % 5 <> 0 THEN regexp_extract(props")
    .replace("/ 100.0::DOUBLE AS s", "/ 100.0::DOUBLE END AS s")
    .replace("c < ct OR s < st", "coalesce(c < ct, false) OR coalesce(s < st, false)")
    + " SELECT * FROM sweep",
    "threshold_best": f"WITH {SWEEP} SELECT * FROM sweep {BEST_ORDER}",
    "threshold_balanced": f"WITH {SWEEP} SELECT * FROM sweep WHERE recall >= 0.85 AND precision >= 0.2 {BEST_ORDER}",
    "judge_prompts": f"WITH {TRIAGE} SELECT query_id, {PROMPT_SQL} AS prompt FROM drafted",
    "judge_parse": f"WITH {JUDGED} SELECT * FROM judged",
    "judge_means": f"""WITH {JUDGED} SELECT count(*) {USABLE} AS judged, count(*) FILTER (WHERE status <> 'ok') AS rejected,
      round(avg(grounded) {USABLE}, 6) AS mean_grounded, round(avg(relevant) {USABLE}, 6) AS mean_relevant,
      round(avg(helpful) {USABLE}, 6) AS mean_helpful, round(avg(overall) {USABLE}, 6) AS mean_overall,
      round(avg(unsupported_claim) {USABLE}, 6) AS unsupported_claim_rate FROM judged""",
    "rater_kappa": f"""WITH {JUDGED},
      human AS (SELECT event_id AS sample_id, value FROM events),
      both_sides AS (SELECT j.*, h.value FROM judged j JOIN human h USING (sample_id) WHERE status = 'ok'),
      rated AS (
        SELECT 'grounded' AS field, floor(value)::INT % 5 + 1 AS a, grounded AS b FROM both_sides
        UNION ALL SELECT 'relevant', floor(value / 5)::INT % 5 + 1, relevant FROM both_sides
        UNION ALL SELECT 'helpful', floor(value / 25)::INT % 5 + 1, helpful FROM both_sides
        UNION ALL SELECT 'overall', floor(value / 3)::INT % 5 + 1, overall FROM both_sides),
      total AS (SELECT field, count(*) AS n, avg((a = b)::INT) AS po FROM rated GROUP BY 1),
      ra AS (SELECT field, a AS x, count(*) AS na FROM rated GROUP BY 1, 2),
      rb AS (SELECT field, b AS x, count(*) AS nb FROM rated GROUP BY 1, 2),
      chance AS (SELECT field, sum(na * nb::DOUBLE) AS s FROM ra JOIN rb USING (field, x) GROUP BY 1)
      SELECT field, n, round((po - coalesce(s, 0) / (n::DOUBLE * n)) / nullif(1 - coalesce(s, 0) / (n::DOUBLE * n), 0), 6) AS kappa
      FROM total LEFT JOIN chance USING (field)""",
    "stream_triage": f"""WITH {PAIR_CORPUS}, arriving AS (SELECT tweet_id AS query_id, text AS customer_text FROM msg WHERE inbound),
      {matches("corpus", "arriving", "query_id", 1)},
      {weak("arriving", "customer_text", LANGUAGE_LEXICON, "none", "query_id, customer_text")},
      decided AS (SELECT w.query_id, w.suggested_intent AS predicted_intent, f.similarity AS retrieval_similarity,
        {reason("w.customer_text", "w.suggested_intent", "w.suggestion_share", "f.similarity")} AS escalation_reason
        FROM weak w JOIN found f USING (query_id))
      SELECT *, CASE WHEN escalation_reason <> 'safe_to_auto_handle' THEN 'HUMAN REVIEW' ELSE 'AUTO-HANDLE' END AS action
      FROM decided""",
}

"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.functions import text as tx
from replyloom.functions.lexicon import RISK_LEXICON, risk_flag, weak_label
from replyloom.operators import classify, failures, index, judging, metrics, pairing, retrieve, rows
from replyloom.operators import lexicon_join, sampling, triage
from replyloom.plans import views
from replyloom.session import checkpoint, fresh_dir
from replyloom.sources.tables import land_csv, read_table, stored, write_csv, write_table
from replyloom.streaming import triage_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GOLDEN_ROWS = 200


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- messages and pairs ---------------------------------------------------------------


@query
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.messages(spark, sf_dir).drop("response_tweet_id", "src_ord")


@query
def inbound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.inbound_counts(views.messages(spark, sf_dir))


@query
def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as accounts; errors count as inbound."""
    events = views.table(spark, sf_dir, "events")
    flagged = events.select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("author_id"),
        (F.col("event_type") == "error").alias("inbound"),
    )
    return pairing.top_accounts(flagged)


@query
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_counts(views.messages(spark, sf_dir), views.BRAND)


@query
def parent_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.parent_messages(views.messages(spark, sf_dir), views.BRAND).select("tweet_id", "author_id", "text")


@query
def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).drop("src_ord")


@query
def extracted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as the extraction job publishes them."""
    root = fresh_dir(spark, "pairs")
    pairing.extract_pairs(views.messages(spark, sf_dir), views.BRAND, root)
    return pairing.read_pairs(spark, root).drop("src_ord")


@query
def csv_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through a CSV dump of unequal files, some records faulty and some ids repeated."""
    work = fresh_dir(spark, "landing")
    rows_ = views.messages(spark, sf_dir).drop("src_ord")
    again = rows_.where(F.col("tweet_id") % 5 == 0).withColumn("text", F.concat("text", F.lit(' "again",\nsaid')))
    id_ = F.col("tweet_id").cast("string")
    faulty = F.when(F.col("tweet_id") % 17 == 0, F.concat(F.lit("x"), id_)).otherwise(id_)
    dump = rows_.unionByName(again).withColumn("tweet_id", faulty)
    write_csv(dump.repartition(F.when(F.col("author_id") == "user", 1).otherwise(F.length("text") % 5)), f"{work}/dump")
    landed = land_csv(spark, f"{work}/dump", f"{work}/messages", rejects=f"{work}/rejects")
    columns = ["tweet_id", "author_id", "inbound", "in_response_to_tweet_id", "text"]
    fits = landed.select(*columns, F.lit("landed").alias("status"))
    bad = read_table(spark, f"{work}/rejects").select(
        F.regexp_extract("record", "^x([0-9]+)", 1).cast("long").alias("tweet_id"), F.lit("rejected").alias("status")
    )
    return fits.unionByName(bad, allowMissingColumns=True)


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return rows.keep_first(docs, ["text"], [F.col("doc_id")])


# --- text -----------------------------------------------------------------------------


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    decorated = F.concat(F.lit("\t https://t.example/A?b=1 @User_9 "), "text", F.lit(" @x "))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", tx.normalize_text(decorated).alias("normalized"), F.length("text").alias("n_text")
    )


@query
def clean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    decorated = F.concat(
        F.lit("@115712 "),
        "brand_response",
        F.lit(" , really ! You can check here: https://t.co/Ab12 ."),
        F.when(F.col("src_ord") % 2 == 0, " ^JB ").otherwise("  See here:. XY"),
    )
    return views.pairs(spark, sf_dir).select("brand_tweet_id", tx.clean_response(decorated).alias("cleaned"))


@query
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", tx.fold_accents(F.lower("text")).alias("folded")
    )


@query
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokens(F.col("text"))
    return (
        views.table(spark, sf_dir, "documents")
        .select("doc_id", words.alias("w"))
        .select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))
    )


@query
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return index.term_entries(docs, "doc_id", "text", 2)


# --- lexicons -------------------------------------------------------------------------


@query
def risk_flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", risk_flag(F.col("text")).alias("risk"))


def _weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir)
    return weak_label(docs, "customer_text", views.LANGUAGE_LEXICON, fallback="none")


@query
def weak_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weak(spark, sf_dir).select(
        "sample_id", "suggested_intent", "suggestion_score", F.round("suggestion_share", 6).alias("suggestion_share")
    )


@query
def weak_intent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in intent lexicon over all messages."""
    labelled = weak_label(views.messages(spark, sf_dir), "text")
    return labelled.select("tweet_id", "suggested_intent", "suggestion_score")


@query
def weak_label_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_counts(_weak(spark, sf_dir), "suggested_intent")


# --- samples and splits ---------------------------------------------------------------


@query
def weak_label_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels with the lexicon as a table."""
    index_ = lexicon_join.gram_index(views.LANGUAGE_LEXICON.to_table(spark))
    labelled = lexicon_join.weak_labels(views.documents(spark, sf_dir), index_, fallback="none")
    return labelled.select(
        "sample_id", "suggested_intent", "suggestion_score", F.round("suggestion_share", 6).alias("suggestion_share")
    )


@query
def weak_label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by a lexicon that grows with its table: benchmark words by initial."""
    words = views.benchmark(spark, sf_dir).select(F.explode(tx.tokens(F.col("customer_text"))).alias("term"))
    initial = F.substring("term", 1, 1)
    lexicon = words.where(F.length("term") >= 4).select(initial.alias("category"), F.ascii(initial).alias("priority"), "term")
    labelled = lexicon_join.weak_labels(views.documents(spark, sf_dir), lexicon_join.gram_index(lexicon), fallback="none")
    return labelled.select("sample_id", "suggested_intent", "suggestion_score", F.round("suggestion_share", 6).alias("suggestion_share"))


@query
def risk_flag_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of each document with the lexicon as a table."""
    index_ = lexicon_join.gram_index(RISK_LEXICON.to_table(spark))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexicon_join.risk_flags(docs, index_, "text", "risk").select("doc_id", "risk")


@query
def intent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.intent_sample(views.pairs(spark, sf_dir))


@query
def intent_sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet drawn from the documents, of which far more are fit than a stratum takes."""
    reply = F.concat(F.lit("source: "), F.col("brand_response"))
    return sampling.intent_sample(views.documents(spark, sf_dir).withColumn("brand_response", reply))


@query
def golden_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.golden_quota(views.documents(spark, sf_dir), n=500, taxonomy=views.LANGUAGES)


@query
def review_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.review_template(views.pairs(spark, sf_dir), ["src_ord"])


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(views.documents(spark, sf_dir), taxonomy=views.LANGUAGES)


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("sample_id", "final_intent", "split")


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_rows(
        views.documents(spark, sf_dir), "final_intent", GOLDEN_ROWS, taxonomy=views.LANGUAGES
    )


@query
def split_without_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sampling.stratified_split(
        views.documents(spark, sf_dir), taxonomy=views.LANGUAGES, exclude=_golden(spark, sf_dir)
    )
    return split.groupBy("final_intent", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden texts that a split without exclusion would train or test on."""
    return sampling.overlap_count(_split(spark, sf_dir), _golden(spark, sf_dir))


# --- corpus and index -----------------------------------------------------------------


@query
def corpus_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = index.corpus_full(views.documents(spark, sf_dir))
    return corpus.select("sample_id", "customer_text", "brand_response")


def _leakage_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_leakage_free(views.documents(spark, sf_dir), _golden(spark, sf_dir))


@query
def corpus_leakage_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leakage_free(spark, sf_dir).select("sample_id", "customer_text")


@query
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.exclusion_counts(_golden(spark, sf_dir), _leakage_free(spark, sf_dir))


def _pair_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = views.open_messages(spark, sf_dir)
    return index.corpus_leakage_free(views.pairs(spark, sf_dir, digest=True), waiting)


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _pair_corpus(spark, sf_dir)
    return index.term_stats(index.term_entries(corpus, "src_ord", "customer_text", 2))


@query
def vocab_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _leakage_free(spark, sf_dir)
    stats = index.term_stats(index.term_entries(corpus, "src_ord", "customer_text", 2))
    return index.select_vocabulary(stats, max_features=5000)


def _pair_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    return index.build_index(_pair_corpus(spark, sf_dir))


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.build_index(index.corpus_full(views.documents(spark, sf_dir)))
    return built.document_weights().withColumn("weight", F.round("weight", 6))


@query
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_index(index.corpus_full(views.documents(spark, sf_dir))).counts()


# --- retrieval ------------------------------------------------------------------------


@query
def cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.retrieve(views.open_messages(spark, sf_dir), _pair_index(spark, sf_dir), 1)
    return best.select("query_id", "doc_id", "similarity", "retrieved_customer_text", "retrieved_brand_response")


def _benchmark_matches(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    built = index.build_index(_leakage_free(spark, sf_dir))
    return retrieve.retrieve(views.benchmark(spark, sf_dir), built, k)


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark_matches(spark, sf_dir, 5).select("query_id", "rank", "doc_id", "similarity")


@query
def saved_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index published as a version, and looked up after it is loaded again."""
    root = fresh_dir(spark, "published")
    index.build_index(_leakage_free(spark, sf_dir)).save(root)
    loaded = index.TextIndex.load(spark, root)
    found = retrieve.retrieve(views.benchmark(spark, sf_dir), loaded, 3)
    return found.select("query_id", "rank", "doc_id", "similarity")


@query
def topk_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest answered messages of each waiting one, with their replies cleaned."""
    built = _pair_index(spark, sf_dir)
    found = retrieve.retrieve(views.open_messages(spark, sf_dir), built, 5, cleaned=("brand_response",))
    return found.select("query_id", "rank", "doc_id", "similarity", "retrieved_customer_text", "retrieved_brand_response")


@query
def cosine_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts against all documents, copies of other sources included."""
    built = index.build_index(index.corpus_full(views.documents(spark, sf_dir)))
    found = retrieve.retrieve(views.benchmark(spark, sf_dir), built, 3, payload=("brand_response",))
    return found.select("query_id", "rank", "doc_id", "similarity", "retrieved_brand_response")


@query
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.retrieval_report(_benchmark_matches(spark, sf_dir, 1))


@query
def retrieval_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _benchmark_matches(spark, sf_dir, 1)
    return retrieve.top_matches(best, "query_id").select("query_id", "doc_id", "similarity")


# --- triage and evaluation ------------------------------------------------------------

CASCADE = {"lexicon": views.PROSE_RISKS, "high_risk": views.HIGH_RISK_LANGUAGES}


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = views.classified(views.open_messages(spark, sf_dir))
    return triage.triage(waiting, _pair_index(spark, sf_dir), "query_id", **CASCADE)


@query
def triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir).select(
        "query_id",
        "predicted_intent",
        F.round("intent_confidence", 6).alias("intent_confidence"),
        "retrieval_similarity",
        "predicted_escalate",
        "escalation_reason",
        "action",
    )


@query
def draft_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir).select("query_id", "draft_reply")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = views.classified(views.gold_documents(spark, sf_dir))
    return triage.evaluate(gold, _pair_index(spark, sf_dir), **CASCADE)


@query
def eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select(
        "sample_id",
        "gold_intent",
        "gold_escalate",
        "predicted_intent",
        F.round("intent_confidence", 6).alias("intent_confidence"),
        "retrieved_customer_text",
        "retrieved_brand_response",
        "retrieval_similarity",
        "predicted_escalate",
        "escalation_reason",
        "draft_reply",
        "intent_correct",
        "escalation_correct",
    )


@query
def escalation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_counts(_evaluated(spark, sf_dir), "escalation_reason")


@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = _evaluated(spark, sf_dir)
    return metrics.binary_metrics(rows_, F.col("gold_escalate"), F.col("predicted_escalate"))


@query
def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(failures.failure_rows(_evaluated(spark, sf_dir))).drop("customer_text")


@query
def failure_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = failures.failure_top(failures.failure_rows(_evaluated(spark, sf_dir)))
    rounded = worst.withColumn("confidence_gap", F.round("confidence_gap", 6))
    return _rounded(rounded).drop("customer_text")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("intent_confidence", F.round("intent_confidence", 6))


# --- metrics --------------------------------------------------------------------------


@query
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    train, test = (split.where(F.col("split") == name) for name in ("train", "test"))
    return metrics.majority_baseline(train, test, "final_intent")


@query
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_metrics(_weak(spark, sf_dir), "final_intent", "suggested_intent")


@query
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(_weak(spark, sf_dir), "final_intent", "suggested_intent")


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = [*views.LANGUAGES, "ambiguous"]  # what is not listed counts as other
    return metrics.confusion_matrix(_weak(spark, sf_dir), "final_intent", "suggested_intent", labels)


@query
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_pairs(_weak(spark, sf_dir), "final_intent", "suggested_intent")


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = views.table(spark, sf_dir, "labels")
    return metrics.binary_metrics(marks, F.col("toxic") == 1, F.col("quality") == 0)


@query
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form that the report sink writes."""
    return metrics.metric_lines(class_metrics(spark, sf_dir), "label")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(views.scored_events(spark, sf_dir))


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query
def threshold_sweep_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep where scores are missing."""
    return metrics.threshold_sweep(views.scored_events_with_gaps(spark, sf_dir))


@query
def threshold_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_best(_sweep(spark, sf_dir))


@query
def threshold_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_balanced(_sweep(spark, sf_dir), min_recall=0.85, min_precision=0.2)


# --- judging --------------------------------------------------------------------------


@query
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_prompts(_triaged(spark, sf_dir), "query_id")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge answers derived from events, some of them faulty."""
    events = views.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")
    )

    def rating(divisor: int) -> Column:
        whole = (F.floor(F.col("k") / divisor) % 5 + 1).cast("string")
        return F.when(F.col("k") % 10 == 4, F.concat(whole, F.lit(".0"))).otherwise(whole)

    fields = F.concat(
        F.lit('{"grounded": '), rating(1),
        F.lit(', "relevant": '), rating(5),
        F.lit(', "helpful": '), rating(25),
        F.lit(', "unsupported_claim": '),
        F.when(F.col("k") % 10 > 6, (F.col("k") % 2 == 1).cast("string")).otherwise((F.col("k") % 2).cast("string")),
        F.lit(', "overall": '), F.when(F.col("k") == 13, "9").otherwise(rating(3)),
        F.when(F.col("k") == 17, "").otherwise(', "reason": "said {so}"'),
        F.lit("}"),
    )
    response = (
        F.when(F.col("k") == 11, "no verdict")
        .when(F.col("k") == 12, "{grounded? }")
        .otherwise(F.concat(F.lit("Verdict:\n"), fields, F.lit("\nend")))
    )
    return events.select(F.col("event_id").alias("sample_id"), response.alias("response"))


@query
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_parse(_responses(spark, sf_dir))


@query
def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judge_means(judging.judge_parse(_responses(spark, sf_dir)))


@query
def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judging.judge_parse(_responses(spark, sf_dir)).where(F.col("status") == "ok")
    human = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        *[
            (F.floor(F.col("value") / divisor) % 5 + 1).cast("int").alias(name)
            for name, divisor in (("grounded", 1), ("relevant", 5), ("helpful", 25), ("overall", 3))
        ],
    )
    return metrics.rater_kappa(judged, human)


# --- learning and streaming -----------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    split = _split(spark, sf_dir)
    return [split.where(F.col("split") == name) for name in ("train", "validation", "test")]


@query
def train_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design matrix of the training documents, one row per entry."""
    train, _, _ = _parts(spark, sf_dir)
    terms = classify.fit_features(train, "src_ord", "customer_text", 1, 1, None)
    entries = classify.feature_entries(train, terms, "src_ord", "customer_text", 1)
    return entries.select("src_ord", "term", "idx", F.round("weight", 6).alias("weight"))


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, _ = _parts(spark, sf_dir)
    return classify.class_weights(train, "final_intent").withColumn("weight", F.round("weight", 6))


@query
def train_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one fitted classifier on the test documents."""
    train, _, test = _parts(spark, sf_dir)
    model = classify.train_intent(train)
    predicted = model.predict(test.select("src_ord", "final_intent", "customer_text"), "src_ord")
    sure = F.round("intent_confidence", 4)
    return predicted.select("src_ord", "final_intent", "predicted_intent", sure.alias("intent_confidence"))


@query
def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the grid's winner, saved and loaded, on rows that neither fit nor selection has seen."""
    train, validation, test = _parts(spark, sf_dir)
    best, _ = classify.grid_select(train, validation)
    root = fresh_dir(spark, "classifier")
    best.save(root)
    predicted = classify.IntentModel.load(spark, root).predict(test.select("src_ord", "final_intent", "customer_text"), "src_ord")
    return metrics.class_metrics(checkpoint(predicted), "final_intent", "predicted_intent")


def _stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test documents as gold rows with predictions of which some are wrong, read from a table."""
    _, _, test = _parts(spark, sf_dir)
    gold = test.select("sample_id", "customer_text", F.col("final_intent").alias("gold_intent")).withColumn(
        "gold_escalate", F.col("gold_intent").isin(*views.HIGH_RISK_LANGUAGES)
    )
    path = fresh_dir(spark, "predictions")
    write_table(views.classified(gold), path)
    return read_table(spark, path)


def _model_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(triage.evaluate(_stored_predictions(spark, sf_dir), _pair_index(spark, sf_dir), **CASCADE), "evaluated")


@query
def model_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the test documents from stored predictions and the index."""
    return _model_evaluated(spark, sf_dir).select(
        "sample_id", "predicted_intent", "retrieval_similarity", "predicted_escalate", "escalation_reason", "intent_correct"
    )


@query
def model_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluation_summary(_model_evaluated(spark, sf_dir))


@query
def grid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grid points with their validation macro F1, on weakly labelled messages."""
    labelled = views.labelled_messages(spark, sf_dir)
    split = sampling.stratified_split(labelled, taxonomy=views.LANGUAGES)
    train, validation = (split.where(F.col("split") == name) for name in ("train", "validation"))
    _, table = classify.grid_select(train, validation)
    return table


@query
def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbound messages as a stream of files, decided per micro-batch."""
    built = _pair_index(spark, sf_dir)

    def decide(batch: DataFrame) -> DataFrame:
        inbound = views.as_messages(batch).where(F.col("inbound")).select(
            F.col("tweet_id").alias("query_id"), F.col("text").alias("customer_text")
        )
        decided = triage.triage(views.classified(inbound), built, "query_id", **CASCADE)
        return decided.select("query_id", "predicted_intent", "retrieval_similarity", "escalation_reason", "action")

    work = fresh_dir(spark, "stream")
    schema = views.table(spark, sf_dir, "conversations").schema
    # A pattern serves both a single file and a folder of files.
    path = f"{sf_dir}/conversations.{{parquet}}"
    return triage_stream.stream_triage(
        spark, path, schema, decide, f"{work}/decisions", f"{work}/state"
    )

"""Exact top-k cosine retrieval as equi-joins with score bounds.

Frequent terms say little yet have most postings. For each query a lower bound of its k-th
best score comes from its rarest terms; frequent terms whose largest possible contribution
together stays below that bound cannot bring in a document on their own. They are left out
of the join that finds candidates and added afterwards, from the vectors of the few documents
that remain. Of the other terms a block of postings is skipped when its largest weight and
everything else the query has cannot reach the bound. The result equals the full product.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom import session
from replyloom.functions.text import clean_response, signature
from replyloom.operators import product
from replyloom.operators.index import SLICE_ROWS, TextIndex, term_entries, weight_vectors
from replyloom.operators.rows import observed, top_n, unit_median
from replyloom.sources.tables import stored

# Scores are compared after rounding to this many digits; bounds leave twice that room.
DIGITS = 6
SLACK = 2.0 * 10**-DIGITS
# Query terms up to which their list goes to the scan of the blocks, in lists of this length.
FILTER_ROWS = 2_000
IN_VALUES = 10
# Documents per wanted result that the rarest terms should reach.
PROBE_FACTOR = 32
# Products of a query's and a document's weight beyond which blocks are multiplied in the tasks.
PRODUCT_ROWS = 10_000_000
# Characters of text per partition of blocks.
PART_CHARS = 16_000_000


def query_vectors(queries: DataFrame, index: TextIndex, key: str, text: str) -> DataFrame:
    """(query_id, term, weight, df, max_weight) with the index's vocabulary."""
    entries = term_entries(queries, key, text, index.ngram_max).withColumnRenamed(key, "query_id")
    return weight_vectors(entries, index.lookup_terms(), "query_id", carry=("df", "max_weight"))


def _or_in(column: str, values: Sequence) -> Column:
    """``column`` in ``values`` as a chain of short lists, each of which a Parquet scan checks exactly."""
    lists = [F.col(column).isin(list(values[i : i + IN_VALUES])) for i in range(0, len(values), IN_VALUES)]
    return reduce(lambda a, b: a | b, lists)


def _on_terms(blocks: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """Join blocks with query terms; (query_id, doc_id, part) with part = product.

    ``wanted`` may have a column ``needed``: blocks whose largest weight stays below it are
    skipped before their postings are unpacked. A bounded set of query terms is broadcast
    and the blocks stay where they are. Otherwise both sides shuffle by (term, slice): the
    blocks of a frequent term are spread over as many slices as its document frequency asks for.
    """
    if small:
        joined = blocks.join(F.broadcast(wanted), "term")
    else:
        slices = F.ceil(F.col("df") / F.lit(SLICE_ROWS)).cast("int")
        sliced = wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        spread = blocks.withColumn("slice", F.pmod(F.xxhash64("max_weight", F.col("postings")[0]), F.col("slices")).cast("int"))
        joined = spread.join(sliced, ["term", "slice"])
    if "needed" in wanted.columns:
        joined = joined.where(F.col("max_weight") >= F.col("needed"))
    parts = joined.select("query_id", "query_weight", F.explode("postings").alias("p"))
    return parts.select("query_id", "p.doc_id", (F.col("p.weight") * F.col("query_weight")).alias("part"))


def _sum_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th best score of the queries that have k documents."""
    best = Window.partitionBy("query_id").orderBy(F.col("part").desc())
    return (
        scores.withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= k)
        .groupBy("query_id")
        .agg(F.min("part").alias("kth"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == k)
        .select("query_id", "kth")
    )


def _probe_terms(vectors: DataFrame, k: int) -> DataFrame:
    """The rarest terms of each query, enough to reach some multiple of k documents."""
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    before = rarest.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.sum("df").over(before), F.lit(0))
    return vectors.withColumn("reached", reached).where(F.col("reached") < PROBE_FACTOR * k)


def top_groups(
    queries: DataFrame, index: TextIndex, k: int, key: str, text: str, n_chars: int | None = None
) -> tuple[DataFrame, bool]:
    """(query_id, doc_id, similarity) of the ``k`` best groups per query, by their first
    document, and whether that table is small enough to broadcast.

    Groups that share no term are not listed. Order: similarity rounded to six digits
    descending, then doc_id. ``text`` holds words joined with spaces, ``n_chars`` characters if that is known.
    """
    if index.bounded:
        multiplied = _multiplied(queries.select(F.col(key).alias("key"), F.col(text).alias("words")), index, k, n_chars)
        if multiplied is not None:
            return multiplied, session.is_small(multiplied)
    vectors = session.checkpoint(
        query_vectors(queries, index, key, text).withColumnRenamed("weight", "query_weight")
    )
    n = vectors.count()
    small = n <= session.BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    blocks = index.blocks
    if n <= FILTER_ROWS:
        terms = sorted({r["term"] for r in vectors.select("term").collect()})
        blocks = blocks.where(_or_in("term", terms) if terms else F.lit(False))

    probes = _probe_terms(vectors, k).select("query_id", "term", "query_weight", "df")
    floor = _kth(_sum_parts(_on_terms(blocks, probes, small)), k)
    # Terms from most to least frequent, with the most they and all before can contribute.
    whole = Window.partitionBy("query_id")
    frequent = whole.orderBy(F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = (
        vectors.withColumn("bound", F.col("query_weight") * F.col("max_weight"))
        .withColumns({"upto": F.sum("bound").over(frequent), "all": F.sum("bound").over(whole)})
        .join(hint(floor), "query_id", "left")
        .withColumn("floor", F.coalesce("kth", F.lit(0.0)) - SLACK)
        .withColumn("essential", F.col("upto") >= F.col("floor"))
        # What a block's largest weight must be for one of its documents to reach the floor.
        .withColumn("needed", (F.col("floor") - F.col("all") + F.col("bound")) / F.col("query_weight") - SLACK)
        .select("query_id", "term", "query_weight", "df", "bound", "floor", "essential", "needed")
    )
    bounded = session.checkpoint(bounded)
    essential = bounded.where("essential")
    least, has_open = bounded.agg(F.min(F.when(F.col("essential"), F.col("needed"))), F.bool_or(~F.col("essential"))).first()
    open_terms = F.collect_list(F.when(~F.col("essential"), F.struct("term", "query_weight")))
    open_bound = bounded.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))), F.lit(0.0)).alias("open"),
        F.first("floor").alias("floor"),
        F.map_from_entries(open_terms).alias("open_terms"),
    )
    blocks = blocks.where(F.col("max_weight") >= F.lit(0.0 if least is None else least))
    partial = _sum_parts(_on_terms(blocks, essential.select("query_id", "term", "query_weight", "df", "needed"), small))
    # A document of a skipped block cannot reach the floor, whatever else it holds. The others
    # stay candidates while their part plus all left-out terms reaches it.
    candidates = session.checkpoint(
        partial.join(hint(open_bound.select("query_id", "open", "floor")), "query_id").where(
            F.col("part") + F.col("open") >= F.col("floor")
        )
    )
    tighter = _kth(candidates, k)
    candidates = (
        candidates.join(hint(tighter), "query_id", "left")
        .where(F.col("part") + F.col("open") >= F.coalesce("kth", F.lit(0.0)) - SLACK)
        .join(hint(open_bound.select("query_id", "open_terms")), "query_id")
        .select("query_id", "doc_id", "part", "open_terms")
    )
    if has_open:
        candidates = _with_open_terms(session.checkpoint(candidates), index)
    scores = candidates.select("query_id", "doc_id", F.round("part", DIGITS).alias("similarity"))
    # A query with vectors has at least one row there and at most k rows here.
    return _best(scores, k).drop("rank"), small and n <= session.BROADCAST_ROWS // k


def _multiplied(queries: DataFrame, index: TextIndex, k: int, n_chars: int | None = None) -> DataFrame | None:
    """``top_groups`` of queries (key, words) from products of whole blocks; None if there are few products to form.

    Products per term would be a row each and number queries times documents, however few
    results are wanted. Here only the term counts are written down, those of the documents for the
    terms that some query has, and each pair of blocks passes on k rows per query.
    """
    spark = queries.sparkSession
    if n_chars is None:
        n_chars = queries.agg(F.sum(F.length("words"))).first()[0] or 0
    # Blocks are dealt out, not texts: they are some five times smaller.
    asked = session.checkpoint(product.packed(queries, index.vocabulary).repartition(1 + n_chars // PART_CHARS))
    if (asked.agg(F.sum("work")).first()[0] or 0) <= PRODUCT_ROWS:
        return None
    wanted = spark.sparkContext.broadcast(product.marked_terms(asked, len(index.vocabulary.value[0])))
    cores, parts = spark.sparkContext.defaultParallelism, 1 + index.n_chars // PART_CHARS
    texts = index.groups.select(F.col("doc_id").alias("key"), "words")
    if index.saved:  # counted before; their blocks are as many as those of the texts
        documents = product.narrowed(index.packed, wanted).repartition(max(parts, cores))
    elif parts > cores:
        documents = product.packed(texts, index.vocabulary, wanted, by_term=True).repartition(parts)
    else:  # so few that there may be fewer blocks than cores
        documents = product.packed(texts.repartition(cores), index.vocabulary, wanted, by_term=True)
    documents = session.checkpoint(documents)
    pairs = product.best_of_pairs(asked, documents, index.vocabulary, k)
    scores = pairs.select("query_id", "doc_id", F.round("part", DIGITS).alias("similarity"))
    return session.checkpoint(_best(scores, k).drop("rank"))


def _with_open_terms(candidates: DataFrame, index: TextIndex) -> DataFrame:
    """Add to each candidate's part what the left-out terms of its query give, from its own vector."""
    more = F.aggregate(
        "terms", F.lit(0.0), lambda s, e: s + F.coalesce(F.element_at("open_terms", e["term"]), F.lit(0.0)) * e["weight"]
    )
    joined = index.vectors.join(session.broadcast_if_small(candidates), "doc_id")
    return joined.select("query_id", "doc_id", (F.col("part") + more).alias("part"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _members(top: DataFrame, index: TextIndex, k: int, small: bool) -> DataFrame:
    """Replace each group by its documents, as far as they can be among the ``k`` best.

    Only the first k documents of one of the k best groups can be, so of a group of any
    size each task passes on k rows at most.
    """
    hint = F.broadcast if small else (lambda df: df)
    keyed = index.groups.select("doc_id", "content_key").join(hint(top), "doc_id").drop("doc_id")
    keyed = session.checkpoint(keyed)
    wanted = keyed.select("content_key").distinct()
    first = Window.partitionBy("content_key").orderBy("doc_id")
    members = (
        index.docs.select("doc_id", "content_key")
        .join(hint(wanted), "content_key", "left_semi")
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= k)
        .drop("place")
    )
    return keyed.join(members, "content_key").select("query_id", "doc_id", "similarity")


def _looked_up(worded: DataFrame, named: DataFrame) -> DataFrame:
    """(query_id, query_text): of ``worded`` (query_id, query_text, __digest) the first query of each digest.

    ``named`` holds their (__key, __digest). Only digests that several queries have are looked for in
    the queries, which stay where they are, unless these digests are too many or a key repeats.
    """
    counted = named.groupBy("__digest", "__key").agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.when(F.col("__key").isNotNull(), F.struct("__key", "__n"))).alias("__first")
    repeated = counted.groupBy("__digest").agg(first, F.sum("__n").alias("__rows")).where(F.col("__rows") > 1)
    repeated = stored(repeated.select("__digest", "__first.__key", "__first.__n"), "repeated")
    n, ties, keyless = repeated.agg(F.count(F.lit(1)), F.max("__n"), F.bool_or(F.col("__key").isNull())).first()
    if n > session.BROADCAST_ROWS or (ties or 0) > 1 or keyless:
        return worded.groupBy("__digest", "query_text").agg(F.min("query_id").alias("query_id")).select("query_id", "query_text")
    joined = worded.join(F.broadcast(repeated.select("__digest", "__key")), "__digest", "left")
    return joined.where(F.col("__key").isNull() | (F.col("query_id") == F.col("__key"))).select("query_id", "query_text")


def retrieve(
    queries: DataFrame,
    index: TextIndex,
    k: int = 5,
    key: str = "query_id",
    text: str = "customer_text",
    payload: Sequence[str] = ("customer_text", "brand_response"),
    cleaned: Sequence[str] = (),
) -> DataFrame:
    """Top-k documents with their payload as ``retrieved_*`` columns.

    Columns named in ``cleaned`` come as cleaned replies; only found documents are cleaned.

    Returns (key, rank, doc_id, similarity, retrieved_...). A query without any shared
    term keeps one row with rank 1, similarity 0.0 and NULL document columns. Queries with
    the same words are looked up once.
    """
    worded = queries.select(F.col(key).alias("query_id"), signature(F.col(text)).alias("query_text"))
    worded = worded.withColumn("__digest", F.md5("query_text"))
    seen = Observation()
    named = worded.observe(seen, F.sum(F.length("query_text")).alias("n_chars"))
    named = stored(named.select(F.col("query_id").alias("__key"), "__digest"), "queries")
    once = named.groupBy("__digest").agg(F.min("__key").alias("query_id"))
    top, small = top_groups(_looked_up(worded, named), index, k, "query_id", "query_text", observed(seen, "n_chars"))
    top = _best(_members(top, index, k, small) if index.has_copies else top, k)
    docs = index.docs.select("doc_id", *[F.col(c).alias(f"retrieved_{c}") for c in payload])
    found = docs.join(F.broadcast(top) if small else top, "doc_id")
    return (
        named.join(once, "__digest")
        .join(found, "query_id", "left")
        .select(
            F.col("__key").alias(key),
            F.coalesce("rank", F.lit(1)).alias("rank"),
            "doc_id",
            F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
            *[(clean_response(F.col(f"retrieved_{c}")) if c in cleaned else F.col(f"retrieved_{c}")).alias(f"retrieved_{c}") for c in payload],
        )
    )


def retrieval_report(best: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Mean, exact median, best and worst top-1 similarity over the queries."""
    stats = best.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(similarity), DIGITS).alias("mean_similarity"),
        F.max(similarity).alias("max_similarity"),
        F.min(similarity).alias("min_similarity"),
    )
    return stats.withColumn("median_similarity", F.round(unit_median(best, similarity).scalar(), DIGITS))


def top_matches(best: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` queries with the closest match."""
    return top_n(best, n, [F.col("similarity").desc(), F.col(key)])

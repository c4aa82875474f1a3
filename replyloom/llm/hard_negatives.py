"""Hard negatives of embeddings: rows of another label whose product with an anchor lies in a window.

Searches run on a two-level tree of split points (``gnat``). The upper one is fitted to a bounded
sample, then every row is dealt to its leaf and the ranges between siblings come from all rows.
Each query first searches one leaf; what it finds there narrows its window, and only leaves
that the narrower window still meets are searched after that. Inside a leaf a tree over its rows
repeats this. Leaves that hold many rows, or are asked by many queries, are cut into cells of
bounded size. Nothing is approximate: the results are those of a full scan.

Rules for odd input: rows with a null label or vector, or with a null or non-finite component,
take no part; shorter vectors are filled up with zeros; a null vec_id is no anchor and loses every
tie; repeated rows and ids are rows of their own, an anchor's copies among its positives; an empty
table gives no rows; extra columns are ignored. Components beyond 2^22 after scaling
(16,384 before) count as 2^22, so that products fit 64 bits up to 4,096 dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom.llm import gnat
from replyloom.llm.common import carry_along
from replyloom.operators.rows import exact_n
from replyloom.session import checkpoint

carry_along(__name__)
carry_along(gnat.__name__)

SCALE = 256
LARGEST = 1 << 22
POSITIVES = 5
NEGATIVES = 3
# Share of a positive's product that a negative's must reach, and may not pass, in percent.
SHARES = (50, 95)
# The sample to which the upper tree is fitted, and how far that tree goes.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 32 << 20
MOST_LEAVES = 1024
LEAF_ROWS = 8192
# Split points of a node, rows of a leaf inside a cell, queries that a cell takes.
FAN = 16
CELL_LEAF_ROWS = 128
CELL_QUERIES = 4096
NO_LIMIT = 1 << 61
ROW = "vec_id long, label long, vector array<int>"


@dataclass(frozen=True)
class Index:
    """Rows (vec_id, label, vector, leaf), their number per leaf, and the upper tree."""

    rows: DataFrame
    sizes: dict[int, int]
    tree: gnat.Tree
    dimensions: int


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; labels of every seventh id move on by one."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    scaled = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    wide = F.col("embedding").cast("array<double>")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(wide, bad)).select(
        "vec_id", moved.cast("long").alias("label"), F.transform(wide, scaled).alias("vector")
    )


def _vectors(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dimensions)


def _dealt(batches: Iterator[pa.RecordBatch], tree: gnat.Tree, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaf = gnat.note_ranges(tree, _vectors(batch.column("vector"), dimensions).astype(np.float64))
        yield batch.append_column("leaf", pa.array(leaf))


def _ranges(batches: Iterator[pa.RecordBatch], tree: gnat.Tree, dimensions: int) -> Iterator[pa.RecordBatch]:
    """What the rows of one task add to the ranges, one row per pair of siblings."""
    for batch in batches:
        gnat.note_ranges(tree, _vectors(batch.column(0), dimensions).astype(np.float64))
    for at, node in enumerate(tree.nodes):
        i, k = np.nonzero(node.high >= node.low)
        columns = [np.full(len(i), at), i, k, node.low[i, k], node.high[i, k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "i", "k", "low", "high"])


def build_index(rows: DataFrame, copies: int) -> Index | None:
    """Index ``rows`` (vec_id, label, vector), or None if there are none.

    Of rows with the same vector and label only the first ``copies`` by vec_id are kept: they have
    the same product with every query, so no later one can be among its first ``copies``.
    """
    dimensions = rows.agg(F.max(F.size("vector"))).first()[0]
    if dimensions is None:
        return None
    dimensions = max(dimensions, 1)
    padded = rows.withColumn("vector", _padded(F.col("vector"), dimensions)).withColumn("no_id", F.col("vec_id").isNull())
    kept = checkpoint(exact_n(padded, ["label", "vector"], copies, ["no_id", "vec_id"]).select("vec_id", "label", "vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, top = kept.agg(F.count(F.lit(1)), F.max(square)).first()
    some = min(SAMPLE_ROWS, max(SAMPLE_BYTES // (8 * dimensions), 256))
    sample = kept.select("vector").orderBy(F.xxhash64("vector", "label", "vec_id")).limit(some).toPandas()
    drawn = np.stack(sample["vector"].to_list()).astype(np.float64)
    leaves = min(-(-n // LEAF_ROWS), MOST_LEAVES)
    tree, _ = gnat.grow(drawn, float(np.sqrt(top)) or 1.0, FAN, len(drawn) if leaves == 1 else max(len(drawn) // leaves, FAN))
    spread = kept.select("vector").mapInArrow(partial(_ranges, tree=tree, dimensions=dimensions), "node long, i long, k long, low double, high double")
    # At most MOST_LEAVES nodes with FAN x FAN ranges each.
    for r in spread.groupBy("node", "i", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        tree.nodes[r.node].low[r.i, r.k], tree.nodes[r.node].high[r.i, r.k] = r.low, r.high
    dealt = checkpoint(kept.mapInArrow(partial(_dealt, tree=tree, dimensions=dimensions), ROW + ", leaf long"))
    sizes = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Index(dealt, sizes, tree, dimensions)


def _padded(vector: Column, dimensions: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(0), F.lit(dimensions) - F.size(vector)))


QUERY = "qid long, label long, vector array<int>, same boolean, low long, high long, n int"
FOUND = "qid long, vec_id long, product long, twin boolean"


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False)


def _homes(batches: Iterator[pa.RecordBatch], tree: gnat.Tree, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _vectors(batch.column("vector"), dimensions).astype(np.float64)
        leaf = gnat.home(tree, vectors, _numbers(batch, "low"), _numbers(batch, "high"))
        yield batch.append_column("leaf", pa.array(leaf))


def _others(batches: Iterator[pa.RecordBatch], tree: gnat.Tree, dimensions: int) -> Iterator[pa.RecordBatch]:
    """Each query once for every leaf but its first one that its window meets."""
    for batch in batches:
        first, vectors = _numbers(batch, "leaf"), _vectors(batch.column("vector"), dimensions).astype(np.float64)
        bare = batch.drop_columns(["leaf"])
        for leaf, some in gnat.reach(tree, vectors, _numbers(batch, "low"), _numbers(batch, "high")):
            some = some[first[some] != leaf]
            if len(some):
                yield bare.take(pa.array(some)).append_column("leaf", pa.array(np.full(len(some), leaf)))


def _search_cell(rows: pa.Table, asked: pa.Table, radius: float, dimensions: int) -> pa.Table:
    own, vectors = _vectors(rows.column("vector"), dimensions), _vectors(asked.column("vector"), dimensions)
    windows = gnat.Windows(vectors, *(_numbers(asked, c) for c in ("label", "same", "low", "high", "n")))
    parts = {"qid": [], "vec_id": [], "product": [], "twin": []}
    if len(own) and len(vectors):
        q, r, product = gnat.first_rows(own, _numbers(rows, "label"), windows, radius, FAN, CELL_LEAF_ROWS)
        ids = rows.column("vec_id").combine_chunks().take(pa.array(r))
        missing, values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        order = np.lexsort((values, missing, -product, q))
        q, r, product = q[order], r[order], product[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < windows.n[q]
        q, r, product, order = q[kept], r[kept], product[kept], order[kept]
        parts = {
            "qid": _numbers(asked, "qid")[q],
            "vec_id": ids.take(pa.array(order)),
            "product": product,
            "twin": (own[r] == vectors[q]).all(1),
        }
    kinds = {"qid": pa.int64(), "vec_id": pa.int64(), "product": pa.int64(), "twin": pa.bool_()}
    return pa.table({k: pa.array(parts[k], kind) for k, kind in kinds.items()})


def _visit(index: Index, visits: DataFrame) -> DataFrame:
    """Search each leaf for the queries dealt to it; large leaves and many queries are cut into cells."""
    spark = visits.sparkSession
    asked = {r.leaf: r.n for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most MOST_LEAVES rows.
    cuts = spark.createDataFrame(
        [(leaf, -(-n // LEAF_ROWS), -(-asked[leaf] // CELL_QUERIES)) for leaf, n in index.sizes.items() if leaf in asked],
        "leaf long, row_cells long, query_cells long",
    )
    row_cell = F.pmod(F.xxhash64("vec_id", "vector"), "row_cells").alias("row_cell")
    query_cell = F.pmod(F.xxhash64("qid"), "query_cells").alias("query_cell")
    every = lambda cells, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(cells) - 1)).alias(name)
    cell = ["leaf", "row_cell", "query_cell"]
    rows = index.rows.join(F.broadcast(cuts), "leaf").select("leaf", row_cell, every("query_cells", "query_cell"), "vec_id", "label", "vector")
    queries = visits.join(F.broadcast(cuts), "leaf").select("leaf", every("row_cells", "row_cell"), query_cell, "qid", "label", "vector", "same", "low", "high", "n")
    work = partial(_search_cell, radius=index.tree.radius, dimensions=index.dimensions)
    search = lambda rows, asked: work(rows, asked)
    return rows.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(search, FOUND)


def _first(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Of each query's rows the first ``n``, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.col("product").desc(), F.col("vec_id").asc_nulls_last())
    return found.join(queries.select("qid", "n"), "qid").withColumn("rank", F.row_number().over(order)).where("rank <= n")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, rank, vec_id, product, twin) of the first ``n`` rows of each of ``queries``.

    A query (qid, label, vector, same, low, high, n) wants rows of its own label, or of others,
    with a product from low to high; higher products come first, then smaller ids. ``twin`` says that
    the row has the query's vector. Give queries that are materialised.
    """
    work = {"tree": index.tree, "dimensions": index.dimensions}
    visits = checkpoint(queries.mapInArrow(partial(_homes, **work), QUERY + ", leaf long"))
    near = checkpoint(_visit(index, visits))
    if len(index.sizes) > 1:
        bound = _first(near, queries).where("rank = n").select("qid", F.col("product").alias("bound"))
        narrowed = visits.join(bound, "qid", "left").withColumn("low", F.greatest("low", "bound")).select(visits.columns)
        others = checkpoint(narrowed.mapInArrow(partial(_others, **work), QUERY + ", leaf long"))
        near = near.union(_visit(index, others))
    return _first(near, queries).select("qid", "rank", "vec_id", "product", "twin")


def _numbered(queries: DataFrame) -> DataFrame:
    return checkpoint(queries.withColumn("qid", F.monotonically_increasing_id()))


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, vector).

    ``anchors`` picks the anchors among the rows. Anchors with the same vector and label are
    searched for once.
    """
    spark = rows.sparkSession
    index = build_index(rows, max(positives + 1, negatives))
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = rows.where(anchors).withColumn("vector", _padded(F.col("vector"), index.dimensions))
    wide = {"same": F.lit(True), "low": F.lit(-NO_LIMIT), "high": F.lit(NO_LIMIT), "n": F.lit(positives + 1)}
    kinds = _numbered(own.select("label", "vector").distinct().withColumns(wide))
    columns = [c.split()[0] for c in QUERY.split(", ")]
    found = search(index, kinds.select(columns))
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "product", "twin"))).alias("list"))
    # The anchor itself is the first row with its vector and id; the other rows move up.
    place = F.array_position(F.transform("list", lambda x: F.coalesce(x["twin"] & (x["vec_id"] == F.col("vec_id")), F.lit(False))), True)
    pairs = (
        own.join(kinds.select("qid", "label", "vector"), ["label", "vector"])
        .join(lists, "qid")
        .withColumn("own", place)
        .select("qid", F.col("vec_id").alias("anchor_id"), F.explode(F.slice(F.filter("list", lambda x, i: i + 1 != F.col("own")), 1, positives)).alias("p"))
        .select("qid", "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.product").alias("positive_score"))
    )
    pairs = checkpoint(pairs)
    low, high = shares
    window = {
        "same": F.lit(False),
        "low": F.expr(f"({low} * positive_score + 99) div 100"),
        "high": F.expr(f"{high} * positive_score div 100"),
        "n": F.lit(negatives),
    }
    # Below zero the window is empty.
    asked = pairs.where("positive_score >= 0").select("qid", "positive_score").distinct().join(kinds.select("qid", "label", "vector"), "qid")
    asked = _numbered(asked.withColumnRenamed("qid", "kind").withColumns(window))
    hits = search(index, asked.select(columns)).join(asked.select("qid", "kind", "positive_score"), "qid")
    return pairs.withColumnRenamed("qid", "kind").join(hits, ["kind", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("product").alias("negative_score")
    )


def negative_table(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every fiftieth row of ``embeddings`` (vec_id, embedding, label)."""
    rows = checkpoint(integer_rows(embeddings))
    return mine(rows, F.col("vec_id") % 50 == 0)

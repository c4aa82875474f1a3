"""Repair of conversations: least edits that leave turns in the order (system) (user assistant)+.

Each row of a conversation becomes one symbol: its role's initial and its fault. The string of
symbols is the conversation's signature. What the rest of a conversation costs depends on the rest
of its signature only, so signatures are minimised from the end: those that end alike share the
nodes of one automaton, whatever conversation they come from, and each node holds, for each
state of the role grammar, the cost to go and the first edit of the best audit. Sorted by their
reversed text, signatures with a common end are neighbours; a task walks its range of them with
one path of nodes in memory, so a node is computed once (at a range cut: once on either side).
The four edits from a node have different initials, hence the first one settles every tie.

Rules for odd input: a null role or text counts as one blank; null conv_ids are one conversation;
null turns come first; rows with the same turn stand in order of role and of the text's digest;
a role whose initial is not s, u or a, the empty role included, can only be rewritten or deleted;
an empty table gives no rows; extra columns are ignored, whatever their names. A conversation is
read as a sorted stream: a task holds its audit and the digests of its rows, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from replyloom.llm.common import carry_along
from replyloom.session import checkpoint

carry_along(__name__)

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
# Grammar states: nothing yet, after system, after user, after assistant.
ENDS = (True, False, False, True)
TAKES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# The role that an edit writes in each state, and the state after it.
WRITES = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
BATCH_ROWS = 4096

Node = tuple[tuple[int, str], ...]


def _with_inserts(steps: list[tuple[int, str]]) -> Node:
    """Per state the better of ``steps`` (cost, first edit) and of inserting a row first."""
    best = list(steps)
    for _ in range(3):
        for state, (_, after) in enumerate(WRITES):
            best[state] = min(best[state], (COST[INSERT] + best[after][0], INSERT))
    return tuple(best)


_NEVER = 1 << 60
END: Node = _with_inserts([(0, "") if ends else (_NEVER, "") for ends in ENDS])


def node(symbol: str, rest: Node) -> Node:
    """The node of ``symbol`` followed by the suffix of ``rest``: (cost to go, first edit) per state.

    Symbols are s, u, a or o (another role), upper case where the text is cut off, and x for a row
    that has to go.
    """
    steps = []
    for state in range(4):
        options = [(COST[DELETE] + rest[state][0], DELETE)]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            after = TAKES[state].get(symbol.lower())
            if after is not None:
                options.append((COST[KEEP] + extra + rest[after][0], KEEP))
            options.append((COST[REROLE] + extra + rest[WRITES[state][1]][0], REROLE))
        steps.append(min(options))
    return _with_inserts(steps)


def walk(signature: str, path: list[Node]) -> str:
    """The best audit; ``path[k]`` is the node of the last ``k`` symbols."""
    state, left, audit = 0, len(signature), []
    while edit := path[left][state][1]:
        audit.append(edit)
        if edit == KEEP:
            state = TAKES[state][signature[-left].lower()]
        elif edit != DELETE:
            state = WRITES[state][1]
        left -= edit != INSERT
    return "".join(audit)


def _audits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    path, before = [END], ""
    for batch in batches:
        signatures, costs, audits = batch.column(0).to_pylist(), [], []
        for signature in signatures:
            back = signature[::-1]
            shared, most = 0, min(len(back), len(before))
            while shared < most and back[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for symbol in back[shared:]:
                path.append(node(symbol, path[-1]))
            before = back
            costs.append(path[-1][0][0])
            audits.append(walk(signature, path))
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], schema=schema)


def cheapest_audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) for each distinct ``signature``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    layout = StructType().add("signature", StringType()).add("cost", LongType()).add("audit", StringType())
    back = F.reverse("signature")
    ordered = signatures.select("signature").distinct().repartitionByRange(back).sortWithinPartitions(back)
    return ordered.mapInArrow(partial(_audits, schema=to_arrow_schema(layout)), layout)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: row["conv_id"])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if len(some) >= BATCH_ROWS or size > 1 << 22:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in some], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in some], schema=schema)


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def summed() -> Iterator[tuple]:
        for conv_id, rows in _groups(batches):
            seen, symbols, faults, illegal, before = set(), bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
            first = last = turn = None
            turns = 0
            for row in rows:
                if not row["present"]:
                    continue
                if row["turn"] is not None and row["turn"] != turn:
                    turn = last = row["turn"]
                    first, turns = turn if first is None else first, turns + 1
                initial, own = row["role"][:1], (row["role"], row["digest"])
                fault = "blank" if row["blank"] else "duplicate" if own in seen else "truncated" if row["cut"] else None
                seen.add(own)
                if fault:
                    faults[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                before = initial
                symbol = "x" if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
                symbols += (symbol.upper() if fault == "truncated" else symbol).encode()
            gaps = 0 if first is None else min(last - first + 1 - turns, (1 << 63) - 1)
            yield conv_id, gaps, *faults.values(), illegal, symbols.decode()

    yield from _batched(summed(), schema)


ORDER = ["turn", "role", "digest", "copy"]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with what the streams sort and judge by."""
    space = r"[\x20\x09-\x0D]"
    return rows.withColumns(
        {
            "digest": F.sha2("text", 256),
            "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
            "cut": ~F.col("text").rlike(rf"[.!?]{space}*\z"),
        }
    )


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _given(conversations: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))


def _plain(conversations: DataFrame) -> DataFrame:
    return _given(conversations).withColumns({"copy": F.lit(0), "present": F.lit(True)})


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as the checksum of ``conv_id:turn`` spoils them; a dropped one stays with ``present`` false."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        _given(conversations)
        .withColumn("kind", kind)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            (F.col("kind") != 0).alias("present"),
            F.explode(copies).alias("copy"),
        )
    )


def summaries(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit), one per conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    layout = StructType().add("conv_id", rows.schema["conv_id"].dataType)
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal"):
        layout = layout.add(name, LongType())
    layout = layout.add("signature", StringType())
    slim = _numbered(rows).select("conv_id", "turn", "role", "digest", "copy", "present", "blank", "cut")
    summed = _dealt(slim, ORDER).mapInArrow(partial(_summaries, schema=to_arrow_schema(layout)), layout)
    summed = checkpoint(summed)
    return summed.join(cheapest_audits(summed), "signature")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple]]]:
    """Per conversation its summary and its rows (place, edit, turn, role, text); deleted ones have no place."""

    def rows_of(audit: str, rows: Iterator[dict]) -> Iterator[tuple]:
        state, place = 0, 0
        for edit in audit:
            row = next(rows) if edit != INSERT else {"turn": None, "role": None, "text": ""}
            if edit == DELETE:
                yield None, edit, row["turn"], row["role"], row["text"]
                continue
            if edit == KEEP:
                role, state = row["role"], TAKES[state][row["role"][0]]
            else:
                role, state = WRITES[state]
            yield place, edit, row["turn"], role, row["text"]
            place += 1

    for _, rows in _groups(batches):
        head = next(rows)
        yield head, rows_of(head["audit"], (row for row in rows if row["present"]))


def _repaired_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from _batched(((head["conv_id"], *row) for head, rows in _edited(batches) for row in rows), schema)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def hashed() -> Iterator[tuple]:
        for head, rows in _edited(batches):
            sha = hashlib.sha256()
            for place, _, _, role, text in rows:
                if place is not None:
                    sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield *(head[name] for name in schema.names[:-1]), sha.hexdigest()

    yield from _batched(hashed(), schema)


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _stream(rows: DataFrame) -> DataFrame:
    """Each conversation's summary, then its rows in order."""
    found = summaries(rows).select("conv_id", *SUMMARY, F.lit(0).alias("follows"))
    lines = _numbered(rows).select("conv_id", *ORDER, "text", "present", F.lit(1).alias("follows"))
    return _dealt(found.unionByName(lines, allowMissingColumns=True), ["follows", *ORDER])


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired rows by ``place``, and the deleted ones without."""
    from pyspark.sql.pandas.types import to_arrow_schema

    layout = StructType().add("conv_id", conversations.schema["conv_id"].dataType).add("place", LongType())
    layout = layout.add("edit", StringType()).add("turn", LongType()).add("role", StringType()).add("text", StringType())
    return _stream(_plain(conversations)).mapInArrow(partial(_repaired_rows, schema=to_arrow_schema(layout)), layout)


def repair_table(conversations: DataFrame) -> DataFrame:
    """What repairing the damaged ``conversations`` costs, edits and leaves, one row per conv_id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    stream = _stream(damage(conversations))
    layout = StructType([stream.schema[name] for name in ("conv_id", *SUMMARY)]).add("repaired_sha256", StringType())
    return stream.mapInArrow(partial(_digests, schema=to_arrow_schema(layout)), layout)

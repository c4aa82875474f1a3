from __future__ import annotations

import random
from itertools import product

from replyloom.llm import conversations as conv
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _rows(table):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in table.collect()}


def _plain(table):
    return [(r.conv_id, r.turn, r.role, r.text) for r in table.select("conv_id", "turn", "role", "text").collect()]


def _audit(signature):
    path = [conv.END]
    for symbol in reversed(signature):
        path.append(conv.node(symbol, path[-1]))
    return path[-1][0][0], conv.walk(signature, path)


def test_every_short_signature_against_all_edits():
    for n in range(4):
        for signature in map("".join, product("suaoUAx", repeat=n)):
            assert _audit(signature) == brute.audit(signature), signature
    rng = random.Random(5)
    for _ in range(40):
        signature = "".join(rng.choices("suaoSUAOx", k=5))
        assert _audit(signature) == brute.audit(signature), signature


def test_shared_ends_do_not_change_audits(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("suaUAx", k=rng.randrange(0, 9))) for _ in range(300)] + [""]
    got = conv.cheapest_audits(spark.createDataFrame([(w,) for w in words + words], "signature string")).collect()
    assert len(got) == len(set(words))
    assert {r.signature: (r.cost, r.audit) for r in got} == {w: _audit(w) for w in set(words)}


def test_table_against_brute_force(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert _rows(conv.repair_table(given)) == brute.conversations(_plain(given))


def test_odd_conversations(spark):
    rng = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "no", "", " \t", None, "é!\n", "?", "a.\x0b"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for t in rng.sample(range(-3, 12), rng.randrange(1, 6))]
    rows += [(50, None, "user", "Hello."), (50, 3, "assistant", "Fine."), (51, None, None, None), (52, 9, "user", "One."), (52, 9, "user", "One.")]
    rows += [(60, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    given = spark.createDataFrame(rows, SCHEMA)
    short = [r for r in rows if r[0] != 60]
    got = _rows(conv.repair_table(given.repartition(5)))
    want = brute.conversations(short)
    assert {k: v for k, v in got.items() if k != 60} == want
    assert set(got) == {r[0] for r in rows} and got[60][0] > 0
    clashing = given
    for name in ("audit", "cost", "copy", "digest", "present", "kind", "signature", "follows"):
        clashing = clashing.withColumn(name, given["text"])
    assert _rows(conv.repair_table(clashing)) == got


def test_no_rows_after_damage(spark):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = _rows(conv.repair_table(spark.createDataFrame([(7, turn, "user", "Hi.")], SCHEMA)))
    import hashlib

    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conv.repair_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Anyone?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "system", "Be kind.")]
    got = conv.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = [(r.role, r.text) for r in sorted((r for r in got if r.conv_id == 1 and r.place is not None), key=lambda r: r.place)]
    assert kept == [("user", "Hi."), ("assistant", ""), ("user", "Anyone?"), ("assistant", "Yes.")]
    assert [(r.edit, r.text) for r in got if r.conv_id == 1 and r.place is None] == [("D", "Yes.")]
    assert [r.edit for r in got if r.conv_id == 2] == ["D"]

from __future__ import annotations

import glob

import pytest

from replyloom import session
from replyloom.operators import metrics, pairing
from replyloom.sources import schemas, tables

DUMP = (
    "﻿tweet_id,author_id,inbound,response_tweet_id,in_response_to_tweet_id,text,created_at\n"
    '1,ann,True,2,,"first line\nsecond ""quoted"" line",Tue\n'
    "2,BrandCo,False,,1,\"  sure, ok  \",Wed\n"
    "3,,false,,1,x,Thu\n"
    "4,bob,maybe,,,y,Fri\n"
)


def test_land_csv(spark, tmp_path):
    source = tmp_path / "dump.csv"
    source.write_text(DUMP, encoding="utf-8")
    landed = tables.land_csv(spark, str(source), str(tmp_path / "messages"))
    rows = landed.orderBy("src_ord").collect()
    assert [r.tweet_id for r in rows] == [1, 2, 3, 4]
    assert rows[0].text == 'first line\nsecond "quoted" line'
    assert [r.inbound for r in rows] == [True, False, False, None]
    assert rows[2].author_id is None
    pair = pairing.reply_pairs(landed, "brandco").first()
    assert (pair.customer_tweet_id, pair.brand_response) == ("1", "sure, ok")


def test_landing_order_follows_file_names(spark, tmp_path):
    """Small, large and small file: the scan packs them by size, the numbers do not."""
    head = DUMP.split("\n", 1)[0]
    folder = tmp_path / "dump"
    folder.mkdir()
    sizes, n = (1, 50, 5), 0
    for k, size in enumerate(sizes):
        lines = []
        for _ in range(size):
            n += 1
            lines.append(f"{n},ann,true,,,{'long text ' * 40 if size == 50 else 'x'},Mon")
        (folder / f"part-{k}.csv").write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
    landed = tables.land_csv(spark, str(folder), str(tmp_path / "messages"))
    assert [(r.src_ord, r.tweet_id) for r in landed.orderBy("src_ord").collect()] == [(i, i + 1) for i in range(n)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x"'), (" pad ", "c,d")], "customer_text string, brand_response string")
    for bom in (False, True):
        path = str(tmp_path / f"out{bom}")
        tables.write_csv(df, path, bom=bom)
        parts = glob.glob(path + "/part-*.csv")
        assert all(open(p, "rb").read().startswith(b"\xef\xbb\xbf") == bom for p in parts)
        back = tables.read_csv(spark, path, df.schema)
        assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_all_string_scan(spark, tmp_path):
    source = tmp_path / "dump.csv"
    source.write_text(DUMP, encoding="utf-8")
    df = tables.read_csv(spark, str(source), schemas.all_strings(schemas.MESSAGES))
    assert {t for _, t in df.dtypes} == {"string"}
    assert {r.tweet_id for r in df.collect()} == {"1", "2", "3", "4"}


def test_typed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3).selectExpr("id AS sample_id", "'x' AS reason"), path)
    df = tables.read_table(spark, path, schemas.JUDGE_SCORES)
    assert df.columns == schemas.JUDGE_SCORES.names and df.where("overall IS NULL").count() == 3


def test_metric_sink(spark, tmp_path):
    lines = metrics.metric_lines(spark.createDataFrame([(0.5, 2)], "accuracy double, n long"))
    tables.write_metrics(lines, str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("accuracy", "", 0.5), ("n", "", 2.0)}
    with pytest.raises(ValueError, match="value"):
        tables.write_metrics(lines.drop("value"), str(tmp_path / "m"))


def test_contracts(spark):
    df = spark.createDataFrame([], "customer_text string")
    with pytest.raises(ValueError, match="brand_response"):
        schemas.require_columns(df, ["customer_text", "brand_response"])
    with pytest.raises(RuntimeError, match="no pairs"):
        schemas.require_rows(df, "no pairs")
    assert schemas.require_rows(spark.range(1), "no pairs").count() == 1


def test_checkpoint_cuts_lineage(spark):
    df = session.checkpoint(spark.range(10).selectExpr("id * 2 AS x"))
    assert "Range" not in df._jdf.queryExecution().toString()
    assert session.shared_dir(spark)
    assert session.is_small(df, 10) and not session.is_small(df, 9)


def test_rejected_records(spark, tmp_path):
    head = DUMP.split("\n", 1)[0]
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "a.csv").write_text(head + '\n1,ann,true,,,"two\nlines",Mon\nx2,bob,true,,,y,Tue\n3,eve,perhaps,,,z,Wed\n', encoding="utf-8")
    (folder / "b.csv").write_text(head + "\n4,ann,false\n5,ann,false,,,ok,Mon\n", encoding="utf-8")
    rejects = str(tmp_path / "rejects")
    landed = tables.land_csv(spark, str(folder), str(tmp_path / "messages"), rejects=rejects)
    assert [(r.src_ord, r.tweet_id, r.text) for r in landed.orderBy("src_ord").collect()] == [(0, 1, "two\nlines"), (1, 5, "ok")]
    assert landed.columns == [*schemas.MESSAGES.names, "src_ord"]
    got = {(r.file[-5:], r.place, r.record.split(",")[0]) for r in spark.read.parquet(rejects).collect()}
    assert got == {("a.csv", 1, "x2"), ("a.csv", 2, "3"), ("b.csv", 0, "4")}
    again = tables.land_csv(spark, str(folder), str(tmp_path / "all"))
    assert again.count() == 5

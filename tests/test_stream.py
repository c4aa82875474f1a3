from __future__ import annotations

from pyspark.sql import functions as F

from replyloom.operators import index, triage
from replyloom.streaming import triage_stream


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"late parcel {i % 3} again", f"Sorry {i} ^AB") for i in range(9)],
        "src_ord long, customer_text string, brand_response string",
    )
    built = index.build_index(docs)
    messages = spark.createDataFrame(
        [(i, f"parcel {i % 3} hacked" if i % 4 == 0 else f"late parcel {i % 3}", "order_delivery", 0.9) for i in range(12)],
        "query_id long, customer_text string, predicted_intent string, intent_confidence double",
    )
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def decide(df):
        return triage.triage(df, built, "query_id").select("query_id", "retrieval_similarity", "escalation_reason", "draft_reply")

    def run():
        return triage_stream.stream_triage(spark, source, messages.schema, decide, target, state, max_files=1)

    (tmp_path / "in").mkdir()
    assert run().count() == 0
    messages.where("query_id < 6").repartition(3).write.mode("append").parquet(source)
    first = run().collect()
    assert len(first) == 6
    messages.where("query_id >= 6").repartition(2).write.mode("append").parquet(source)
    streamed = {tuple(r) for r in run().collect()}
    assert streamed == {tuple(r) for r in decide(messages).collect()}
    assert run().count() == 12
    assert decide(messages).where(F.col("escalation_reason") == "security_or_account_risk").count() == 3


def test_replayed_files_add_no_message(spark, tmp_path):
    schema = "query_id long, customer_text string, sent timestamp"
    rows = spark.createDataFrame([(i, f"text {i}", None) for i in range(6)], schema).withColumn("sent", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("query_id") * 60))
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = triage_stream.read_messages(spark, source, rows.schema, 1)
        once = triage_stream.once_each(stream, "query_id", "sent", "1 hour")
        triage_stream.start_triage(once, lambda df: df, target, state).awaitTermination()
        return triage_stream.read_decisions(spark, target).collect()

    for batch in ("query_id < 4", "query_id < 4", "query_id >= 2"):
        rows.where(batch).coalesce(1).write.mode("append").parquet(source)
        got = run()
    assert sorted(r.query_id for r in got) == [0, 1, 2, 3, 4, 5]

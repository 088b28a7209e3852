"""Streamed runs give the rows of the batch plan."""

from tributary.operators import claims
from tributary.plans.flow import MergeFlow
from tributary.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_arrivals_equal_batch(spark, tmp_path):
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    for i in range(2):
        talks.where(f"conv_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = incremental.analyse_arrivals(spark, str(tmp_path / "in"), SF, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "overall")).drop("batch")
    flow = MergeFlow(spark, SF)
    want = claims.overall(flow.base.select("merge_id"), flow.interactions, flow.verdicts)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))


def test_counters(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = incremental.attempt_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select sum(successes) s, sum(failures) f from counters").first()
    assert (got.s, got.f) == (events.where("event_type <> 'error'").count(), events.where("event_type = 'error'").count())

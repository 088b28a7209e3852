"""Step store and counters taken while a step is written."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tributary.operators import provider
from tributary.plans.flow import MergeFlow
from tributary.sources import files, steps

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.range(100).coalesce(1).write.parquet(path)
    return path


def test_a_step_is_built_once(spark, table, tmp_path):
    built, root = [], str(tmp_path / "store")

    def build():
        built.append(1)
        return spark.read.parquet(table).selectExpr("id * 2 AS x")

    for _ in range(3):
        assert steps.StepStore(spark, table, root=root).step("double", build).agg(F.sum("x")).first()[0] == 9900
    assert len(built) == 1
    assert steps.StepStore(spark, table, root=root).step("other", build).count() == 100 and len(built) == 2
    # Other files, other code: another address.
    spark.range(10).coalesce(1).write.mode("append").parquet(table)
    assert steps.StepStore(spark, table, root=root).step("double", build).count() == 110 and len(built) == 3


def test_changed_code_builds_again(spark, table, tmp_path, monkeypatch):
    one = steps.StepStore(spark, table, root=str(tmp_path)).digest
    monkeypatch.setattr(steps, "code_digest", lambda: "other")
    assert steps.StepStore(spark, table, root=str(tmp_path)).digest != one


def test_unfinished_steps_are_built_again(spark, table, tmp_path):
    store = steps.StepStore(spark, table, root=str(tmp_path / "store"))
    store.step("s", lambda: spark.range(5))
    (made,) = os.listdir(tmp_path / "store")
    (copy,) = os.listdir(tmp_path / "store" / made)
    os.remove(tmp_path / "store" / made / copy / "_SUCCESS")
    assert store.step("s", lambda: spark.range(7)).count() == 7
    shutil.rmtree(tmp_path / "store")


def test_flows_share_steps(spark):
    one, two = MergeFlow(spark, SF), MergeFlow(spark, SF)
    assert sorted(one.matches.inputFiles()) == sorted(two.matches.inputFiles())
    assert one.matches.count() == two.matches.count() > 0


def test_counters_equal_recounts_without_a_second_scan(spark, table):
    counters = steps.Counters()
    before = counters.snapshot()
    made = counters.write(spark.read.parquet(table).withColumn("odd", F.col("id") % 2), rows=F.count("*"), odd=F.sum("odd"), most=F.count_if(F.col("id") > 89))
    middle = counters.snapshot()
    assert counters.since(before) == {"rows": made.count(), "odd": made.agg(F.sum("odd")).first()[0], "most": 10}
    counters.write(made.where("odd = 1"), rows=F.count("*"))
    assert counters.since(middle) == {"rows": 50, "odd": 0, "most": 0}
    # What is read back is the written table alone.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Aggregate" not in plan and "/steps/" in plan
    empty, found = steps.counted(spark.range(0), rows=F.count("*"))
    assert found == {"rows": 0} and empty.count() == 0


def test_calls_are_counted_in_flight(spark):
    asked = spark.createDataFrame([(str(i), str(i)) for i in range(40)], "request_id string, payload string")
    counters = steps.Counters()
    replies = counters.write(provider._called(asked.withColumn("due_at", F.lit(None).cast("double")), lambda p: provider.Reply(200 if int(p) % 4 else 503, p), None), calls=F.count("*"), ok=F.count_if(F.col("status") == 200))
    usage = provider.usage(replies.withColumn("again", F.lit(False))).first()
    assert counters.values == {"calls": usage.calls, "ok": usage.successful_calls} == {"calls": 40, "ok": 30}
    assert files.checkpoint_folder(spark)

"""Incremental runs of the merge analysis over arriving conversations (an extension).

A merge can only be aligned when it is complete, so the unit of arrival is a
file of whole conversations: each micro-batch is written beside the fixed
tables and analysed by the same batch plan.  The attempt counters are a plain
watermarked aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import claims
from tributary.plans.flow import MergeFlow


class ArrivedFlow(MergeFlow):
    """The flow with a micro-batch in place of the conversations table."""

    def __init__(self, spark: SparkSession, sf_dir: str, conversations: str):
        super().__init__(spark, sf_dir)
        self.conversations = conversations

    @property
    def base(self):
        from tributary.sources import derived

        return derived.base_shots(self.spark, self.sf_dir, self.conversations)


def analyse_arrivals(spark: SparkSession, source: str, sf_dir: str, target: str, checkpoint: str):
    """A query that appends one overall row for each arriving merge to ``target``; start it with a trigger of your choice."""
    schema = "conv_id long, turn long, role string, text string"
    stream = spark.readStream.schema(schema).parquet(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folders, so results stay exactly once.
        arrived = f"{target}/_arrived/{batch_id}"
        batch.write.mode("overwrite").parquet(arrived)
        flow = ArrivedFlow(batch.sparkSession, sf_dir, arrived)
        rows = claims.overall(flow.base.select("merge_id"), flow.interactions, flow.verdicts)
        rows.write.mode("overwrite").parquet(f"{target}/overall/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def attempt_counters(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Successes and failures of each fixture in windows of event time; later rows than ``late`` are dropped by the watermark."""
    ok = F.col("event_type") != "error"
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), F.col("user_id").alias("fixture")).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))

"""Distributed scans against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        data.append((key, rng.randint(0, 400), i, rng.choice([None, rng.randint(-5, 9)])))
    return spark.createDataFrame(data, "k string, t int, id int, v int")


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_scans_equal_windows(rows, parts):
    got = ordered.scanned(rows, ["k"], ["t", "id"], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, before={"b": F.col("v"), "i": F.col("id")}, tops={"m": F.col("v")}, parts=parts)
    w = W.partitionBy("k").orderBy("t", "id")
    upto, until = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = rows.withColumns({
        "s": F.sum("v").over(upto), "l": F.last("v", ignorenulls=True).over(upto),
        "b": F.last("v", ignorenulls=True).over(until), "i": F.lag("id").over(w), "m": F.max("v").over(upto),
    })
    assert plain(got) == plain(want)


def test_descending_order_gives_the_row_after(rows):
    got = ordered.scanned(rows, ["k"], [F.desc("t"), F.desc("id")], before={"next": F.col("id")}, parts=9)
    want = rows.withColumn("next", F.lead("id").over(W.partitionBy("k").orderBy("t", "id")))
    assert plain(got) == plain(want)


def test_hot_group_fills_several_parts(rows):
    placed = ordered._placed(rows, ["k", "t", "id"], 12).withColumn("part", ordered._part(F.col("_at")))
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    assert len(sizes) > 8 and max(sizes.values()) < 1000
    assert placed.where("k = 'hot'").select("part").distinct().count() > 5


@pytest.mark.parametrize("parts", [None, 5])
def test_numbers_over_the_whole_table(rows, parts):
    got = ordered.numbered(rows, [F.desc("v"), "id"], parts=parts)
    want = rows.withColumn("number", F.row_number().over(W.orderBy(F.desc("v"), "id")).cast("long"))
    assert plain(got) == plain(want)


def test_empty_table(rows):
    assert ordered.numbered(rows.where("false"), ["id"]).count() == 0
    assert ordered.scanned(rows.where("false"), ["k"], ["t"], sums={"s": F.col("v")}).count() == 0

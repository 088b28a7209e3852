"""Running values over ordered groups of any size, a hot group spread over many tasks.

A window function puts a whole group into one task.  Here the rows are dealt by
ranges of (group, order), so a large group fills several parts; each part is
scanned alone and begins with what the parts before it left of its first group.
At most one group crosses the border of two parts, so what is carried is at
most one row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.sources.files import materialized

#: Rows of a part are numbered below this power of two by Spark's running id.
_SHIFT = 33


def _placed(df: DataFrame, order: list, parts: int | None) -> DataFrame:
    """Rows in order with ``_at``, whose high bits name the part; written, so the places hold."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return materialized(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _part(at: Column) -> Column:
    return F.shiftright(at, _SHIFT)


def numbered(df: DataFrame, order: list, name: str = "number", parts: int | None = None) -> DataFrame:
    """The rows with their number, from 1, in the given order of the whole table."""
    rows = _placed(df, order, parts).withColumn("_part", _part(F.col("_at")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    carry = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_part"), _SHIFT)
    return rows.join(F.broadcast(carry), "_part").withColumn(name, inside + F.col("_before") + 1).drop("_part", "_at", "_before")


def scanned(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    tops: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """The rows with running values of each group, in the given order.

    ``sums``: sum up to the row and with it, null where all values so far are;
    ``tops``: the largest value so far; ``lasts``: the last value so far that is
    not null; ``before``: the same without the row itself, so with a value in
    every row the one of the row before.  Null keys make a group of their own.
    Rows that ``order`` leaves level stand in any order.
    """
    sums, lasts, before, tops = sums or {}, lasts or {}, before or {}, tops or {}
    inputs = {f"_v_{n}": c for d in (sums, lasts, before, tops) for n, c in d.items()}
    rows = _placed(df.withColumns(inputs), [*keys, *order], parts).withColumn("_part", _part(F.col("_at")))
    group = [*keys, "_part"]

    # What each part leaves of each group, and from it what each part starts with.
    value = {n: F.col(f"_v_{n}") for d in (sums, lasts, before, tops) for n in d}
    left = [F.sum(value[n]).alias(f"_c_{n}") for n in sums] + [F.max(value[n]).alias(f"_c_{n}") for n in tops]
    left += [F.max_by(value[n], F.when(value[n].isNotNull(), F.col("_at"))).alias(f"_c_{n}") for n in (*lasts, *before)]
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy(*group).agg(*left).withColumn("_seen", F.count("*").over(earlier))
    for n in value:
        fold = F.sum(f"_c_{n}") if n in sums else F.max(f"_c_{n}") if n in tops else F.last(f"_c_{n}", ignorenulls=True)
        carry = carry.withColumn(f"_k_{n}", fold.over(earlier))
    carry = carry.where("_seen > 0").select(*[F.col(c).alias(f"_g_{c}") for c in group], *[f"_k_{n}" for n in value])

    upto = W.partitionBy(*group).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    until = W.partitionBy(*group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    inside = {n: F.sum(value[n]).over(upto) for n in sums}
    inside |= {n: F.max(value[n]).over(upto) for n in tops}
    inside |= {n: F.last(value[n], ignorenulls=True).over(upto) for n in lasts}
    inside |= {n: F.last(value[n], ignorenulls=True).over(until) for n in before}
    same = F.col("_part") == F.col("_g__part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    # One row for each part at most.
    out = rows.withColumns({f"_i_{n}": c for n, c in inside.items()}).join(F.broadcast(carry), same, "left")
    whole = {}
    for n in value:
        here, far = F.col(f"_i_{n}"), F.col(f"_k_{n}")
        whole[n] = F.coalesce(here + far, here, far) if n in sums else F.greatest(here, far) if n in tops else F.coalesce(here, far)
    return out.withColumns(whole).select(*df.columns, *value)

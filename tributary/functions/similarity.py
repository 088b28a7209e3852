"""Similarity of two shots, component by component, null where a modality is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary import config


def _half(x: Column, at: int) -> Column:
    return F.conv(F.substring(x, at, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 0 where either is malformed."""
    well = a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$")
    bits = F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))
    return F.when(well, bits).otherwise(0)


def structure(a: Column, b: Column) -> Column:
    no_a, no_b = a == config.ZERO_HASH, b == config.ZERO_HASH
    return F.when(no_a & no_b, F.lit(None).cast("double")).when(no_a | no_b, F.lit(0.0)).otherwise(1.0 - hamming(a, b) / 64.0)


def _one_sided(a: Column, b: Column, both: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("double")).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(both)


def mean_rgb(a: Column, b: Column) -> Column:
    gap = F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2])
    return _one_sided(a, b, F.greatest(F.lit(0.0), 1.0 - gap / 2.0))


def histogram(a: Column, b: Column) -> Column:
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return _one_sided(a, b, F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(shared))


def duration(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / most))


def relative_gap(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.abs(a - b) / most)


def order_prior(base_index: Column, branch_index: Column) -> Column:
    """Falls with forward drift only; null for a negative index."""
    gap = F.greatest(F.lit(0), branch_index - base_index)
    prior = F.greatest(F.lit(0.0), 1.0 - gap / float(config.ORDER_MAX_GAP))
    return F.when((base_index < 0) | (branch_index < 0), F.lit(None).cast("double")).otherwise(prior)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null; null if none is."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    value = sum((F.when(v.isNotNull(), v * (F.lit(w) / total)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return F.when(total > 0, value)


def visual(structural: Column, rgb: Column, hist: Column, weights: dict[str, float] = config.VISUAL_WEIGHTS) -> Column:
    return weighted([(structural, weights["structure"]), (rgb, weights["rgb"]), (hist, weights["histogram"])])


def blend(vis: Column, tr: Column, dur: Column, order: Column, weights: dict[str, float] = config.WEIGHTS) -> Column:
    """Final score of a pair; 0 where nothing can be compared."""
    return F.coalesce(weighted([(vis, weights["visual"]), (tr, weights["transcript"]), (dur, weights["duration"]), (order, weights["order"])]), F.lit(0.0))


def used_components(vis: Column, tr: Column, dur: Column, order: Column) -> Column:
    names = [(vis, "visual_similarity"), (tr, "transcript_similarity"), (dur, "duration_similarity"), (order, "order_similarity")]
    return F.concat_ws(",", *[F.when(v.isNotNull(), F.lit(n)) for v, n in names])

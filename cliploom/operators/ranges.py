"""Joins of points and ranges, as equi-joins on (key, bin) followed by the exact predicate.  J03, J08 of the survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, start: str, end: str, bin_width: float | None) -> DataFrame:
    """Pairs of a point and a range of the same key with start <= t <= end."""
    within = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    if bin_width is None:
        return points.join(ranges, list(keys)).where(within)
    bin_of = lambda x: F.floor(F.col(x) / bin_width)
    left = points.withColumn("_bin", bin_of(t))
    right = ranges.withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    return left.join(right, [*keys, "_bin"]).where(within).drop("_bin")


def overlapping_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str], b_range: tuple[str, str], bin_width: float | None, margin: float = 0.0) -> DataFrame:
    """Pairs of ranges of the same key that overlap, touching included, each pair once; a's ranges are widened by margin."""
    (s1, e1), (s2, e2) = a_range, b_range
    meets = (F.col(e2) >= F.col(s1) - margin) & (F.col(s2) <= F.col(e1) + margin)
    if bin_width is None:
        return a.join(b, list(keys)).where(meets)
    floor = lambda x: F.floor(x / bin_width)
    left = a.withColumn("_lo", floor(F.col(s1) - margin)).withColumn("_bin", F.explode(F.sequence("_lo", floor(F.col(e1) + margin))))
    right = b.withColumn("_lo2", floor(F.col(s2))).withColumn("_bin", F.explode(F.sequence("_lo2", floor(F.col(e2)))))
    return left.join(right, [*keys, "_bin"]).where(meets & (F.col("_bin") == F.greatest("_lo", "_lo2"))).drop("_bin", "_lo", "_lo2")

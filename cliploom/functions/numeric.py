"""Numeric column functions.  Nulls count as 0 inside every clamp, since greatest() and least() skip them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x: Column | str | float, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    return F.greatest(col(low), F.least(col(high), F.coalesce(col(x).cast("double"), F.lit(0.0))))


def rounded(x: Column | str, places: int) -> Column:
    """Half up by scaling; both engines of the correctness check do the same arithmetic."""
    scale = float(10**places)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def average(x: Column | str) -> Column:
    """Mean of a group, 0 for an empty one."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


def divided(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def parsed_float(text: Column | str) -> Column:
    """A number or a ratio a/b; null for blanks, N/A and zero denominators."""
    parts = F.split(F.trim(col(text)), "/")
    ratio = F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))
    return F.when(F.size(parts) == 2, ratio).when(F.size(parts) == 1, F.get(parts, 0).try_cast("double"))


def rounded_metric(text: Column | str, default: float = 0.0) -> Column:
    return rounded(clamp(F.coalesce(col(text).try_cast("double"), F.lit(default))), 4)


def overlap_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over the shorter length, 0 where disjoint."""
    overlap = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    return F.when(overlap > 0, divided(overlap, F.least(end_a - start_a, end_b - start_b))).otherwise(F.lit(0.0))


def weighted_average(parts: Sequence[tuple[Column, Column | float]]) -> Column:
    """Sum of clamped values times weights over the sum of weights, 0 without weights; a null weight counts as 0."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        w = F.coalesce(col(weight), F.lit(0.0))
        top, bottom = top + clamp(value) * w, bottom + w
    return divided(top, bottom)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays, in order."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def hash_unit(token: Column) -> Column:
    """In [0, 1]: the first 8 hex digits of the MD5 over their largest value."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def padded(n: Column, width: int) -> Column:
    """A whole number with leading zeros up to the width; longer ones keep all digits."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def fixed3(x: Column) -> Column:
    """A number as text with three decimals; callers round to 3 places first."""
    return F.format_string("%.3f", x)


def evenly_inside(start: Column, length: Column, n: Column) -> Column:
    """n evenly spaced interior points of a range, 3 places."""
    step = length / (n + 1)
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: rounded(start + step * i, 3))


def sample_timestamps(duration: Column, count: Column | None = None) -> Column:
    """clamp(ceil(max(duration, 1) / 8) + 2, 4, 10) interior points unless a count is given."""
    usable = F.greatest(duration, F.lit(1.0))
    n = count if count is not None else F.greatest(F.lit(4), F.least(F.lit(10), (F.ceil(usable / 8) + 2).cast("int")))
    return evenly_inside(F.lit(0.0), usable, n)


def keyframe_timestamps(start: Column, end: Column, count: Column | None = None) -> Column:
    """3 interior points up to 8 seconds, else 4, unless a count is given."""
    length = F.greatest(end - start, F.lit(0.0))
    return evenly_inside(start, length, count if count is not None else F.when(length <= 8, F.lit(3)).otherwise(F.lit(4)))

"""Integer arithmetic in ten-thousandths, and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(n: Column, d: Column) -> Column:
    """n div d in whole numbers, toward zero; null if d is 0."""
    return F.call_function("div", n.cast("long"), d.cast("long"))


def ratio_e4(n: Column, d: Column) -> Column:
    """n / d in ten-thousandths, rounded half up, at most 10000; 0 if d <= 0."""
    return F.when(d > 0, F.least(F.lit(10000).cast("long"), whole(n.cast("long") * 20000 + d, 2 * d))).otherwise(F.lit(0).cast("long"))


def half_up(n: Column, d: Column) -> Column:
    """n / d (d > 0) to the nearest whole, halves away from zero."""
    away = whole(2 * F.abs(n) + d, 2 * d)
    return F.when(n < 0, -away).otherwise(away)


def ceiling(n: Column, d: Column) -> Column:
    """n / d (n >= 0, d > 0), up to the next whole."""
    return whole(n + d - 1, d)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(e1, e2) - F.greatest(s1, s2))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether half-open spans share more than a boundary."""
    return F.least(e1, e2) > F.greatest(s1, s2)


def iou_e4(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inner = overlap_length(s1, e1, s2, e2)
    return ratio_e4(inner, (e1 - s1) + (e2 - s2) - inner)

"""Running totals over a whole order without a task that sorts all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of equal width into which the values of a group are cut.
RANGES = 4_096


def running_totals(points: DataFrame, value: str, sums: tuple[str, ...], by: tuple[str, ...] = (), falling: bool = False) -> DataFrame:
    """``points`` with ``upto_<c>``, the sum of c up to and with the row in the order of ``value``, and ``all_<c>``.

    One row per value and group is expected. Rows are cut into ranges of
    values; a range is sorted by itself and begins with the sum of the ranges
    before it, of which there are at most ``RANGES`` + 1 a group. Group columns may be null.
    """
    whole = points.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    step = F.try_divide((F.col(value) - F.col("__low")) * RANGES, F.col("__high") - F.col("__low"))
    cut = _join(points, whole, by).withColumn("__range", F.coalesce(F.floor(step), F.lit(0).cast("bigint")))
    order = F.desc if falling else F.asc
    before = Window.partitionBy(*by).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__of_{c}") for c in sums])
    ranges = ranges.select(*by, "__range", *[F.coalesce(F.sum(f"__of_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums])
    within = Window.partitionBy(*by, "__range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.select("*", *[F.sum(c).over(within).alias(f"__in_{c}") for c in sums])
    joined = _join(totals, ranges, (*by, "__range"))
    return joined.select(*points.columns, *[(F.col(f"__before_{c}") + F.col(f"__in_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


def _join(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.withColumnsRenamed({c: f"__key_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__key_{c}"]) for c in by])
    return left.join(renamed, same).drop(*[f"__key_{c}" for c in by])

"""Trends over time and over the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import DAY_US, micros, precision, ratio, trend_arrow
from .kpi import n_findings, typed


def _anchored(rows: DataFrame, days: int, least: int) -> DataFrame:
    """Tumbling windows of ``days`` from the first timestamp on; those with fewer than ``least`` rows are left out."""
    width = days * DAY_US
    first = rows.agg(F.min("at").alias("first"))
    place = F.floor((F.col("at") - F.col("first")) / F.lit(width))
    counts = (
        rows.crossJoin(F.broadcast(first))  # one row
        .groupBy(place.cast("long").alias("window_no"))
        .agg(F.min("first").alias("first"), F.count("*").alias("n"), *[F.count_if(F.col("v") == v).alias(f"n_{v}") for v in ("tp", "partial", "fp")])
        .filter(F.col("n") >= least)
    )
    return counts.select(
        "window_no",
        (F.col("first") + F.col("window_no") * width).alias("start_us"),
        "n",
        (F.col("n_tp") + F.col("n_partial") + F.col("n_fp")).alias("denominator"),
        F.round(precision(F.col("n_tp"), F.col("n_partial"), F.col("n_fp")), 6).alias("precision"),
    )


def precision_trend(feedback: DataFrame, days: int = 7, least: int = 10) -> DataFrame:
    return _anchored(typed(feedback).filter("ts IS NOT NULL").withColumn("at", micros(F.col("ts"))), days, least)


def precision_trend_per_finding(feedback: DataFrame, days: int = 7, least: int = 10) -> DataFrame:
    """One row per finding: human before post-fix, then the earliest, then the first seen; rows of other tiers are left out."""
    rows = typed(feedback).filter("fid IS NOT NULL AND ts IS NOT NULL AND tier IN ('human', 'post_fix')").withColumn("at", micros(F.col("ts")))
    order = F.struct((F.col("tier") != "human").alias("later"), "at", "seq")
    one = rows.groupBy("fid").agg(F.min_by(F.struct("v", "at"), order).alias("x")).select("x.v", "x.at")
    return _anchored(one, days, least)


def rolling_windows(reviews: DataFrame, n: int = 50) -> DataFrame:
    """Windows of the last ``n`` reviews, the ``n`` before them, and so on; the oldest may be shorter.

    The order is (reviewed_at, run_id, received_at). Ranks come from sorted
    partitions of one day each and a running count over days, so no task sorts the log.
    """
    day = F.floor(micros(F.col("reviewed_at")) / DAY_US)
    rows = reviews.select(day.alias("day"), "reviewed_at", "run_id", "received_at", n_findings().alias("found"), "files_reviewed", "duration_ms")
    newest = Window.partitionBy("day").orderBy(F.desc("reviewed_at"), F.desc("run_id"), F.desc("received_at"))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    before = rows.groupBy("day").agg(F.count("*").alias("of_day")).select("day", F.coalesce(F.sum("of_day").over(later), F.lit(0)).alias("newer"))
    placed = rows.withColumn("rn", F.row_number().over(newest)).join(before, "day").withColumn("w", F.floor((F.col("newer") + F.col("rn") - 1) / n))
    label = F.when(F.col("w") == 0, F.format_string("last %d", F.lit(n))).when(F.col("w") == 1, F.format_string("prev %d", F.lit(n))).otherwise(F.format_string("prev %d", F.col("w") * n))
    return placed.groupBy("w").agg(
        F.count("*").alias("n_reviews"), F.sum("found").alias("n_findings"), F.round(ratio(F.sum("found"), F.sum(F.col("files_reviewed").cast("long"))), 6).alias("findings_per_file"),
        F.min(micros(F.col("reviewed_at"))).alias("from_us"), F.max(micros(F.col("reviewed_at"))).alias("to_us"),
    ).select(F.col("w").cast("long").alias("window_no"), label.alias("label"), "n_reviews", "n_findings", "findings_per_file", "from_us", "to_us")


def _ranked(reviews: DataFrame, key: str, *columns: Column) -> DataFrame:
    """``columns`` with ``i``, the rank from 1 of each review of its group in time, and the group's ``total``.

    Ranks come from sorted partitions of one day of one group and a running
    count over its days, so no task sorts a group.
    """
    rows = reviews.select(key, F.floor(micros(F.col("reviewed_at")) / DAY_US).alias("__day"), "reviewed_at", "run_id", "received_at", *columns)
    days = rows.groupBy(key, "__day").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col(key).alias("__key"), F.col("__day").alias("__on"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(key)).alias("total"))
    of_day = Window.partitionBy(key, "__day").orderBy("reviewed_at", "run_id", "received_at")
    same = rows[key].eqNullSafe(days["__key"]) & rows["__day"].eqNullSafe(days["__on"])
    placed = rows.withColumn("__rank", F.row_number().over(of_day)).join(days, same)
    return placed.withColumn("i", F.col("__before") + F.col("__rank")).drop("__day", "__rank", "__key", "__on", "__before")


def last_n(reviews: DataFrame, n: int) -> DataFrame:
    """The last ``n`` reviews by (reviewed_at, run_id, received_at); all if there are no more."""
    return reviews.orderBy(F.desc("reviewed_at"), F.desc("run_id"), F.desc("received_at")).limit(n)


def context_sparklines(records: DataFrame, key: str, value: str, buckets: int = 5) -> DataFrame:
    """Mean of ``value`` in ``buckets`` buckets of each group's records in time: ``key, bucket, n_reviews, value``.

    Bucket b holds the records from b * total / buckets, at least one where there is any left.
    """
    rows = _ranked(records, key, F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("x"))
    ranges = F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda b: F.struct(
            b.alias("bucket"),
            F.floor(b * F.col("total") / buckets).alias("first"),
            F.least(F.col("total"), F.greatest(F.floor((b + 1) * F.col("total") / buckets), F.floor(b * F.col("total") / buckets) + 1)).alias("end"),
        ),
    )
    inside = F.filter(ranges, lambda r: (F.col("i") > r["first"]) & (F.col("i") <= r["end"]))
    return rows.select(key, "x", F.explode(inside).alias("r")).groupBy(key, F.col("r.bucket").alias("bucket")).agg(F.count("*").alias("n_reviews"), F.round(F.avg("x"), 6).alias("value"))


def sparklines(reviews: DataFrame, key: str = "repo", buckets: int = 5, least: int = 5) -> DataFrame:
    """Findings per file in ``buckets`` proportional buckets of each group's reviews, in order; groups under ``least`` have none."""
    rows = _ranked(reviews, key, n_findings().alias("found"), F.col("files_reviewed").cast("long").alias("files"))
    bucket = F.floor((F.lit(buckets) * F.col("i") - 1) / F.col("total"))
    return (
        rows.filter(F.col("total") >= least)
        .groupBy(key, bucket.cast("int").alias("bucket"))
        .agg(F.count("*").alias("n_reviews"), F.round(ratio(F.sum("found"), F.sum("files")), 6).alias("value"))
    )


def trend_arrows(reviews: DataFrame, key: str = "repo") -> DataFrame:
    """up, down or flat for each group's sparkline."""
    series = sparklines(reviews, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "value"))), lambda x: x["value"]).alias("series"))  # five values
    return series.select(key, trend_arrow(F.col("series")).alias("arrow"))


def precision_gate(feedback: DataFrame, baseline: float, least: int = 20) -> DataFrame:
    """Precision of the latest week with ``least`` rows, else of all, and how far it lies under ``baseline``."""
    weeks = precision_trend(feedback, 7, least).agg(F.max_by("precision", "window_no").alias("latest"))
    all_rows = typed(feedback).agg(*[F.count_if(F.col("v") == v).alias(f"n_{v}") for v in ("tp", "partial", "fp")])
    both = weeks.crossJoin(all_rows)  # one row each
    value = F.coalesce("latest", F.round(precision(F.col("n_tp"), F.col("n_partial"), F.col("n_fp")), 6))
    drop = F.lit(baseline) - value
    return both.select(value.alias("precision"), F.when(drop >= 0.05, "critical").when(drop >= 0.03, "warn").otherwise("ok").alias("status"))

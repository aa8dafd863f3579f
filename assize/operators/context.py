"""Context injection: telemetry slices, leg counts, gates, rendered blocks.

The review log's ``context`` is a struct with ``injector_available,
injected_sources, injected_chunk_count, injected_tokens, retriever_errored,
adaptive_threshold_applied, rendered_prompt_hash``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.prompt import card


def _measures() -> list[Column]:
    n = F.count("*")
    flag = lambda c: F.round(ratio(F.count_if(F.coalesce(F.col(f"context.{c}"), F.lit(False))), n), 6)
    total = lambda c: F.round(ratio(F.sum(F.coalesce(F.col(f"context.{c}"), F.lit(0)).cast("long")), n), 6)
    return [
        n.alias("n_reviews"), total("injected_chunk_count").alias("avg_chunks"), total("injected_tokens").alias("avg_tokens"),
        flag("retriever_errored").alias("error_rate"), flag("adaptive_threshold_applied").alias("adaptive_rate"), (n < 5).alias("low_sample"),
    ]


def by_source(reviews: DataFrame) -> DataFrame:
    """Per injected source; a review counts once for each of its sources. Reviews without injector are left out."""
    rows = reviews.filter("context.injector_available").select("*", F.explode(F.array_distinct("context.injected_sources")).alias("source"))
    return rows.groupBy("source").agg(*_measures())


def by_repo(reviews: DataFrame) -> DataFrame:
    grouped = reviews.filter("context.injector_available").groupBy(F.col("repo").alias("k")).agg(*_measures())
    return grouped.select(F.coalesce("k", F.lit("(no repo)")).alias("repo"), F.col("k").isNull().alias("is_missing"), *grouped.columns[1:])


def misleading(reviews: DataFrame) -> DataFrame:
    """Three rows, always: total (each run once), retriever_errored, phantom_injection (a prompt without chunks)."""
    errored = F.coalesce(F.col("context.retriever_errored"), F.lit(False))
    phantom = F.col("context.rendered_prompt_hash").isNotNull() & (F.coalesce("context.injected_chunk_count", F.lit(0)) == 0)
    parts = reviews.filter(errored | phantom).dropDuplicates(["run_id"]).withColumn("cause", F.lit("total"))
    parts = parts.unionByName(reviews.filter(errored).withColumn("cause", F.lit("retriever_errored"))).unionByName(reviews.filter(phantom).withColumn("cause", F.lit("phantom_injection")))
    found = parts.groupBy("cause").agg(*_measures())
    every = reviews.sparkSession.createDataFrame([("total",), ("retriever_errored",), ("phantom_injection",)], "cause string")
    zeros = {c: False if t == "boolean" else 0 for c, t in found.dtypes if c not in ("cause", "low_sample")} | {"low_sample": True}
    return every.join(found, "cause", "left").na.fill(zeros)


def leg_counts(chunks: DataFrame) -> DataFrame:
    """Retrieval legs over chunks with ``legs array<string>``; those without any don't count. Sums stop at 2^32 - 1."""
    top = F.lit((1 << 32) - 1)
    has = lambda x: F.array_contains("legs", x)
    only = has("structural") & ~has("bm25") & ~has("vector")
    counts = {"bm25": has("bm25"), "vector": has("vector"), "structural": has("structural"), "structural_only": only, "total_unique": F.lit(True)}
    return chunks.filter(F.size("legs") > 0).agg(*[F.least(F.count_if(c), top).alias(n) for n, c in counts.items()])


def gates(candidates: DataFrame, thresholds: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, id, score) that pass, and per query what each gate removed.

    Gates in order: not a number, under the floor, under the chunk's own
    threshold (``thresholds``: id, threshold; null blocks, missing passes).
    """
    own = thresholds.select("id", "threshold", F.lit(True).alias("known"))
    rows = candidates.join(own, "id", "left")
    nan = F.col("score").isNull() | F.isnan("score")
    low = ~nan & (F.col("score") < floor)
    blocked = ~nan & ~low & F.coalesce(F.col("known") & (F.col("threshold").isNull() | (F.col("score") < F.col("threshold"))), F.lit(False))
    tagged = rows.withColumn("gate", F.when(nan, "nan").when(low, "floor").when(blocked, "chunk"))
    counts = tagged.groupBy("query_id").agg(*[F.count_if(F.col("gate") == g).alias(f"dropped_{g}") for g in ("nan", "floor", "chunk")], F.count_if(F.col("gate").isNull()).alias("kept"))
    return tagged.filter("gate IS NULL").select("query_id", "id", "score"), counts


def blocks(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """One Markdown block per query from its packed chunks (query_id, id, place), with its SHA-256.

    A query has as many chunks as were packed, so the list is short.
    """
    c = F.col
    shown = card(c("chunk_kind"), c("qualified_name"), c("lang"), c("source_path"), c("line_start"), c("line_end"), c("source"), c("commit_sha"), c("content"))
    rows = packed.join(chunks.select("id", shown.alias("card")), "id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "card"))), lambda x: x["card"])
    block = rows.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.array_join(ordered, "\n").alias("block"))
    return block.withColumn("sha256", F.sha2("block", 256))

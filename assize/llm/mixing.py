"""Mixing sources to target shares of tokens.

Sainte-Laguë apportionment: the mixture consists of blocks of equal size in
tokens, given one after the other to the source with the highest quotient
share / (2 * blocks + 1) whose texts are not used up. That gives whole numbers
of blocks per source; the blocks of a source are apportioned to its shards in
the same way. A shard's texts lie in seeded order, cut into blocks, and its
quota takes whole rounds of all blocks, then the first blocks of that order; a
text belongs to the block in which its middle lies.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Ranks of a byte-level BPE vocabulary; the same path on every node, or the name of a file given to ``SparkContext.addFile``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such a vocabulary splits a text before merging (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A table of targets is small by nature; a larger one is refused.
MOST_SOURCES = 100_000
#: Shards that are apportioned together; more form groups, which are apportioned first.
FAN_OUT = 1_000


def source_name(source: Column) -> Column:
    """Lower case, parts joined by hyphens; null stays null."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "-")


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokenizer = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(tokenizer.encode_ordinary(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["source"], batch["doc_id"], pa.array(counts, pa.int64())], ["source", "doc_id", "tokens"])

    return run


def texts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``source, doc_id, tokens`` of the distinct texts of each source; copies count as their smallest doc_id.

    Null sources and texts without a token are left out. Only one copy of a
    text is tokenized.
    """
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("source IS NOT NULL AND source != '' AND text IS NOT NULL AND text != ''")
    distinct = rows.groupBy("source", F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return distinct.select("source", "doc_id", "text").mapInArrow(_counter(tokenizer), "source string, doc_id bigint, tokens bigint").filter("tokens > 0")


def apportion(shares: dict[str, float], caps: dict[str, int], blocks: int) -> dict[str, int]:
    """Blocks per source by Sainte-Laguë with caps; ties go to the name that sorts first.

    A bisection of the divisor comes close from below, the last blocks follow by quotient.
    """
    live = {s: w for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    given = dict.fromkeys(shares, 0)
    blocks = min(blocks, sum(caps[s] for s in live))
    if not live or blocks <= 0:
        return given

    def at(divisor: float) -> dict[str, int]:
        return {s: min(caps[s], int(w / divisor + 0.5)) for s, w in live.items()}

    low, high = min(live.values()) / (2.0 * max(caps.values()) + 2.0) / 2, 2 * max(live.values()) + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if sum(at(middle).values()) > blocks:
            low = middle
        else:
            high = middle
    given.update(at(high))
    left = blocks - sum(given.values())
    heap = [(-w / (2 * given[s] + 1), s) for s, w in live.items() if given[s] < caps[s]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, s = heapq.heappop(heap)
        given[s] += 1
        left -= 1
        if given[s] < caps[s]:
            heapq.heappush(heap, (-live[s] / (2 * given[s] + 1), s))
    return given


def apportion_shards(sizes: DataFrame, quotas: DataFrame, block_tokens: int, n_shards: int) -> DataFrame:
    """``source, shard, shard_tokens, blocks``: each source's blocks over its shards, by Sainte-Laguë on their tokens.

    ``sizes`` has ``source, shard, shard_tokens``, ``quotas`` has ``source,
    blocks, repeats``. Groups of at most ``FAN_OUT`` neighbouring shards get
    their blocks first, so no task apportions more than that many.
    """
    levels, width = [sizes.select("source", "shard", "shard_tokens")], n_shards
    while width > FAN_OUT:
        width = -(-width // FAN_OUT)
        below = levels[-1].withColumn("shard", F.floor(F.col("shard") / FAN_OUT))
        levels.append(below.groupBy("source", "shard").agg(F.sum("shard_tokens").alias("shard_tokens")))

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        keys = [f"{k:020d}" for k in rows["shard"]]
        caps = {k: -(-int(t) * int(r) // block_tokens) for k, t, r in zip(keys, rows["shard_tokens"], rows["repeats"])}
        given = apportion({k: float(t) for k, t in zip(keys, rows["shard_tokens"])}, caps, int(rows["blocks"].iloc[0]))
        return pd.DataFrame({"source": rows["source"], "shard": rows["shard"], "shard_tokens": rows["shard_tokens"], "blocks": [given[k] for k in keys], "repeats": rows["repeats"]})

    given = quotas.withColumn("parent", F.lit(0).cast("long"))
    for level in reversed(levels):
        part = level.withColumn("parent", F.floor(F.col("shard") / FAN_OUT)).join(given, ["source", "parent"])
        shared = part.groupBy("source", "parent").applyInPandas(share, "source string, shard bigint, shard_tokens bigint, blocks bigint, repeats bigint")
        given = shared.select("source", F.col("shard").alias("parent"), "blocks", "repeats")
    return shared.drop("repeats")


def select(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    block_tokens: int = 512,
    shard_tokens: int = 5_000_000,
    seed: int = 17,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: ``doc_id, source, tokens, copies`` of every text used. Report: per
    row of ``targets``: ``source, target_share, max_repeats, n_texts,
    available_tokens, quota_blocks, used_tokens, most_copies, actual_share``.

    The mixture has ``total_tokens``, by default as many as all distinct texts
    of the named sources. A source without text gets nothing, and its share,
    like that of one used up, goes to the others by their quotients. Equal
    texts of a source count together, so none is used more than ``max_repeats``
    times. Null shares or repeats count as 0; a source named twice has the sum
    of its shares and the smaller repeats. Empty tables give empty results.
    """
    spark = documents.sparkSession
    stated = (
        targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
        .filter("source IS NOT NULL")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").cast("int").alias("max_repeats"))
    )
    wanted = {r["source"]: r for r in stated.limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    pool = materialize(texts(documents, tokenizer).join(F.broadcast(stated.select("source", "max_repeats")), "source"), "texts")
    have = {r["source"]: r for r in pool.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # at most one row per target
    available = {s: have[s]["tokens"] if s in have else 0 for s in wanted}
    total = total_tokens if total_tokens is not None else sum(available.values())
    # The last block of a source may be short, so a source smaller than a block has one as well.
    caps = {s: -(-available[s] * max(0, wanted[s]["max_repeats"]) // block_tokens) for s in wanted}
    quota = apportion({s: float(wanted[s]["target_share"]) for s in wanted}, caps, round(total / block_tokens))

    n_shards = max(1, -(-sum(available.values()) // shard_tokens))
    sharded = pool.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_shards)))
    sizes = sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("shard_tokens"))
    quotas = spark.createDataFrame([(s, q, max(0, wanted[s]["max_repeats"])) for s, q in quota.items()], "source string, blocks bigint, repeats bigint")
    shards = apportion_shards(sizes, quotas, block_tokens, n_shards)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    goal = F.col("blocks") * block_tokens
    passes = F.floor(goal / F.col("shard_tokens"))
    rest = goal - passes * F.col("shard_tokens")
    mixture = (
        sharded.withColumn("upto", F.sum("tokens").over(order))
        .join(shards, ["source", "shard"])
        .withColumn("copies", F.least(F.col("max_repeats"), (passes + (F.col("upto") - F.col("tokens") / 2 <= rest).cast("int")).cast("int")))
        .filter("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    mixture = materialize(mixture, "mixture")
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("used_tokens").alias("whole"))
    counts = spark.createDataFrame([(s, have[s]["n"] if s in have else 0, available[s], quota[s]) for s in wanted], "source string, n_texts bigint, available_tokens bigint, quota_blocks bigint")
    report = (
        stated.join(counts, "source")
        .join(used, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source",
            F.round("target_share", 6).alias("target_share"),
            "max_repeats",
            "n_texts",
            "available_tokens",
            "quota_blocks",
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.round(F.coalesce(F.try_divide("used_tokens", "whole"), F.lit(0.0)), 6).alias("actual_share"),
        )
    )
    return mixture, report

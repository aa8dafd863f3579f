"""Near-duplicate findings: set similarity join by chosen paths.

Every text is a set of words. A tree begins with a node for each band of line
numbers (bands overlap, so two texts close enough in line share one). A node
with few texts is compared exhaustively. A larger one branches: for a few
positions, chosen by a hash of the node, each text goes to the child named by
its minwise word at that position, so similar texts meet again and others
part. A node that hardly shrinks holds texts similar to one another; it is
compared as well, in cells of bounded size. Independent trees are repeated
until a pair at the threshold is found with the target recall.

A level is one shuffle by node. Comparing first matches one-bit minwise
sketches, a whole batch of nodes at a time, then counts shared words exactly,
so every link reported is a true one. Texts equal in words and line are one
site throughout: copies, however many, are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release
from .graph import components
from .words import word_ids, words

POSITIONS = 48
BITS = 256
B = [f"b{k}" for k in range(BITS // 64)]
#: Most texts of a node that is compared at once.
LEAF = 384
#: A node larger than this share of its parent doesn't branch again.
SHRINK = 0.5
#: Rows of one side of a cell, in which a large node or site meets itself.
CELL = 2_000
_PAIR, _LARGE, _DENSE = 0, 1, 2


def trees_for(threshold: float, branches: int, recall: float) -> int:
    """Trees needed for ``recall`` of pairs at the threshold, however deep the nodes branch."""
    lost = 0.0
    for _ in range(1000):
        lost = (1 - threshold * (1 - lost)) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, site, minwise words and sketch of each finding; empty lists for one without words or line."""
    import xxhash

    rng = np.random.default_rng(20240229)
    odd = (rng.integers(0, 1 << 31, POSITIONS + BITS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    add = rng.integers(0, 1 << 32, POSITIONS + BITS, dtype=np.uint32)

    def minima(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (ids ^ (ids >> np.uint64(32))).astype(np.uint32)[:, None] * odd
            x += add
            x ^= x >> np.uint32(15)
            return np.minimum.reduceat(x, starts, axis=0)

    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            sets = [sorted(set(words(" ".join(t for t in pair if t is not None)))) for pair in zip(part["title"].to_pylist(), part["description"].to_pylist())]
            lines = part["line"].to_pylist()
            sites = [xxhash.xxh64_intdigest(f"{line} {' '.join(ws)}") for ws, line in zip(sets, lines)]
            full = [i for i, (ws, line) in enumerate(zip(sets, lines)) if ws and line is not None]
            h = np.zeros((len(sets), POSITIONS + BITS), np.uint32)
            ids = [word_ids(sets[i]) for i in full]
            short = [k for k, x in enumerate(ids) if len(x) <= 2048]
            if short:
                h[[full[k] for k in short]] = minima(np.concatenate([ids[k] for k in short]), np.cumsum([0, *(len(ids[k]) for k in short[:-1])]))
            for k, x in enumerate(ids):
                if len(x) > 2048:
                    h[full[k]] = reduce(np.minimum, [minima(x[i : i + 2048], np.array([0]))[0] for i in range(0, len(x), 2048)])
            with np.errstate(over="ignore"):
                h = h * np.uint32(0x85EBCA6B)
            sig = np.ascontiguousarray(h[:, :POSITIONS]).view(np.int32)
            bits = np.packbits((h[:, POSITIONS:] >> np.uint32(31)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
            usable = np.zeros(len(sets), bool)
            usable[full] = True
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"],
                    part["line"],
                    pa.array(sets, pa.list_(pa.string())),
                    pa.array(np.array(sites, np.uint64).view(np.int64)),
                    pa.array(usable),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, POSITIONS, dtype=np.int32)), pa.array(sig.ravel())),
                    *(pa.array(bits[:, k]) for k in range(len(B))),
                ],
                ["id", "line", "ws", "site", "usable", "sig", *B],
            )


def _members(findings: DataFrame) -> DataFrame:
    rows = findings.select("id", F.col("line_start").cast("long").alias("line"), "title", "description")
    return rows.mapInArrow(_sketch, "id string, line bigint, ws array<string>, site bigint, usable boolean, sig array<int>, " + ", ".join(f"{b} bigint" for b in B))


def _least_bits(threshold: float) -> int:
    agree = (1 + threshold) / 2
    return math.floor(BITS * agree - 5.5 * math.sqrt(BITS * agree * (1 - agree)))


def _level(span: int, least_bits: int):
    """Compare the small nodes of a batch; pass the rows of the others on.

    Rows come node by node, by line within a node, with the node's ``size``.
    """

    def near(node: np.ndarray, site: np.ndarray, line: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, i, k = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(node)), 0
        while len(i):
            k += 1
            i = i[: np.searchsorted(i, len(node) - k)]
            i = i[(node[i] == node[i + k]) & (line[i + k] - line[i] <= span)]
            other = np.bitwise_count(bits[:, i] ^ bits[:, i + k]).sum(axis=0, dtype=np.int32)
            hit = i[BITS - other >= least_bits]
            a.append(np.minimum(site[hit], site[hit + k]))
            b.append(np.maximum(site[hit], site[hit + k]))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4 + len(B), 0), np.int64)
        for batch in batches:
            cols = np.vstack([batch[c].to_numpy() for c in ("node", "size", "site", "line", *B)])
            size, parent = cols[1], batch["parent"].to_numpy()
            small, dense = size <= LEAF, size > SHRINK * parent
            out: list[tuple] = []
            for kind, which in ((_DENSE, ~small & dense), (_LARGE, ~small & ~dense)):
                x = cols[:, which]
                out.append((np.full(x.shape[1], kind, np.int8), x[2], x[2], x[0], x[1]))
            rows = np.hstack([held, cols[:, small]])
            end = rows.shape[1]
            if end:
                others = np.flatnonzero(rows[0] != rows[0][-1])
                last = others[-1] + 1 if len(others) else 0
                if end - last < rows[1][-1]:
                    end = last  # the rest of that node is in the next batch
            held, rows = rows[:, end:], rows[:, :end]
            a, b = near(rows[0], rows[2], rows[3], rows[4:].view(np.uint64))
            out.append((np.full(len(a), _PAIR, np.int8), a, b, a, a))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["kind", "a", "b", "node", "size"])

    return run


def _cells(rows: DataFrame, key: str, one: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join by ``key``, a large group cut into cells: join them on ``key, i, j``.

    Every two rows of a group meet in exactly one cell if the join also asks
    for the first row's ``one`` to be smaller where i equals j.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    cut = rows.join(n, key).withColumn("at", F.pmod(F.xxhash64(one), F.col("blocks")).cast("int"))
    left = cut.select(key, F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"), one, *more)
    right = cut.select(key, F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), one, *more)
    return left, right


def _dense(rows: DataFrame, sites: DataFrame, span: int, least_bits: int) -> DataFrame:
    left, right = _cells(rows.join(sites.select("site", "line", *B), "site"), "node", "site", "line", *B)
    agree = F.lit(BITS) - reduce(lambda x, y: x + y, [F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in B])
    on: Column = (F.col("x.node") == F.col("y.node")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.site") < F.col("y.site"))
    near = (F.abs(F.col("x.line") - F.col("y.line")) <= span) & (agree >= least_bits)
    return left.alias("x").join(right.alias("y"), on & once & near).select(F.least("x.site", "y.site").alias("a"), F.greatest("x.site", "y.site").alias("b"))


def _candidates(sites: DataFrame, threshold: float, span: int, branches: int, depth: int, recall: float) -> DataFrame:
    least_bits = _least_bits(threshold)
    trees = trees_for(threshold, branches, recall)
    width = max(3 * span, 1)  # bands reach over the next one by ``span`` lines
    band = F.floor(F.col("line") / width)
    both = F.when(F.pmod("line", F.lit(width)) < span, F.array(band, band - 1)).otherwise(F.array(band))
    frontier = sites.select(F.explode(F.transform(both, lambda b: F.xxhash64(b))).alias("node"), F.lit(1 << 60).alias("parent"), "site", "line", *B)
    of_node = Window.partitionBy("node").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    written, dense = [], []
    for level in range(depth + 1):
        # In the last level every larger node counts as dense.
        parent = F.lit(0).cast("long") if level == depth else F.col("parent")
        sized = frontier.withColumn("size", F.count("*").over(of_node)).filter("size > 1").select("node", "size", "site", "line", *B, parent.alias("parent"))
        done = materialize(sized.mapInArrow(_level(span, least_bits), "kind tinyint, a bigint, b bigint, node bigint, size bigint"), f"level{level}")
        written.append(done)
        dense.append(done.filter(F.col("kind") == _DENSE).select(F.col("a").alias("site"), "node"))
        large = done.filter(F.col("kind") == _LARGE).select(F.col("a").alias("site"), "node", "size")
        if large.isEmpty():
            break
        seeds = F.explode(F.sequence(F.lit(0), F.lit((trees if level == 0 else 1) * branches - 1)))
        word = F.element_at("sig", (F.pmod(F.xxhash64("node", "seed"), F.lit(POSITIONS)) + 1).cast("int"))
        frontier = (
            large.join(sites.select("site", "line", "sig", *B), "site")
            .select("node", "size", "site", "line", "sig", *B, seeds.alias("seed"))
            .select(F.xxhash64("node", "seed", word).alias("node"), F.col("size").alias("parent"), "site", "line", *B)
        )
    pairs = [x.filter(F.col("kind") == _PAIR).select("a", "b") for x in written]
    pairs.append(_dense(reduce(DataFrame.unionByName, dense), sites, span, least_bits))
    found = materialize(reduce(DataFrame.unionByName, pairs).distinct(), "pairs")
    release(*written)
    return found


def links(findings: DataFrame, threshold: float = 0.6, span: int = 10, branches: int = 3, depth: int = 8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """Links between sites and membership.

    Links: ``a, b, similarity`` of different sites whose word sets share at
    least ``threshold`` of all their words and whose lines differ by at most
    ``span``. Members: ``id, site, usable``. Null title and description count as
    empty; a finding without words, or without a line, is not usable and has no link.
    """
    members = materialize(_members(findings), "members")
    firsts = [F.first(c).alias(c) for c in ("line", "ws", "sig", *B)]
    sites = materialize(members.filter("usable").groupBy("site").agg(*firsts), "sites")
    pairs = _candidates(sites, threshold, span, branches, depth, recall)
    words_of = lambda side: sites.select(F.col("site").alias(side), F.col("ws").alias(f"ws_{side}"))
    shared = F.size(F.array_intersect("ws_a", "ws_b"))
    similarity = shared / (F.size("ws_a") + F.size("ws_b") - shared)
    checked = pairs.join(words_of("a"), "a").join(words_of("b"), "b").select("a", "b", similarity.alias("similarity"))
    checked = materialize(checked.filter(F.col("similarity") >= threshold), "links")
    release(pairs, sites)
    return checked, members.select("id", "site", "usable")


def found(findings: DataFrame, threshold: float = 0.6, span: int = 10) -> DataFrame:
    """``id_a, id_b`` of all linked findings, smaller id first.

    Copies (equal words and line) are linked with one another and each with
    all that any of them is linked with, however many there are, so the result
    is quadratic in copies; ``groups`` says the same in one row per finding.
    """
    between, members = links(findings, threshold, span)
    members = members.filter("usable").select("site", "id")
    across = (
        between.select("a", "b")
        .join(members.select(F.col("site").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("site").alias("b"), F.col("id").alias("y")), "b")
        .select("x", "y")
    )
    left, right = _cells(members, "site", "id")
    within = (
        left.withColumnRenamed("id", "x")
        .join(right.withColumnRenamed("id", "y"), ["site", "i", "j"])
        .filter("i < j OR x < y")
        .select("x", "y")
    )
    every = across.unionByName(within)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(findings: DataFrame, threshold: float = 0.6, span: int = 10) -> DataFrame:
    """One row per finding: ``id, site, group, n_links`` (links of its site with other sites).

    ``group`` is the smallest site connected with the finding's site by links.
    """
    between, members = links(findings, threshold, span)
    of = components(between.select("a", "b"))
    ends = between.select(F.col("a").alias("node")).unionByName(between.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    return (
        members.join(of, F.col("site") == F.col("node"), "left")
        .drop("node")
        .join(ends, F.col("site") == F.col("node"), "left")
        .select("id", "site", F.coalesce("component", "site").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


FOUND_SQL = r"""
WITH f AS (SELECT id, line_start, list_distinct(regexp_extract_all(lower(concat_ws(' ', title, description)), '[\p{L}\p{N}_]+')) AS w FROM findings),
t AS (SELECT id, line_start, len(w) AS n, unnest(w) AS x FROM f WHERE line_start IS NOT NULL),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM t a JOIN t b ON a.x = b.x AND a.id < b.id AND abs(a.line_start - b.line_start) <= 10 GROUP BY 1, 2)
SELECT id_a, id_b FROM s WHERE k / (na + nb - k) >= 0.6
"""

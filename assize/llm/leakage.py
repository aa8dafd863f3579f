"""Evaluation passages inside training documents.

Greedy string tiling over words: for every document and every passage that
shares a seed (a run of ``min_run`` words, found by a Karp-Rabin hash), the
longest common runs that don't overlap are marked one after the other until
none of ``min_run`` words is left. The marked share of the passage is its
coverage, so passages whose parts were reordered are caught as well.

Up to ``most_words`` words of passages, which are counted first, travel to the
workers, and one pass over the documents without any shuffle finds all. Beyond
that, documents and passages meet by a join on their seeds. Documents never
meet one another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import rolling, word_array, word_ids, words

SCHEMA = "doc_id bigint, passage_id int, n_tiles int, longest int, matched_words int, coverage double"


#: Most pairs of places that are listed at once to find the common runs of one document and passage.
_LISTED = 1 << 20


def _runs(p: np.ndarray, t: np.ndarray, min_run: int) -> list[tuple[int, int, int]]:
    """Maximal common runs ``(start in p, start in t, length)`` of at least ``min_run`` ids, in time of p times t at most."""
    hp, ht = rolling(p, min_run), rolling(t, min_run)
    order = np.argsort(ht, kind="stable")
    low, high = np.searchsorted(ht[order], hp, "left"), np.searchsorted(ht[order], hp, "right")
    if (high - low).sum() <= _LISTED:
        i = np.repeat(np.arange(len(hp)), high - low)
        j = order[np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a])] if len(i) else i
        along = np.lexsort((i, j - i))
        i, j = i[along], j[along]
        new = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)]) if len(i) else i
        found = list(zip(i[new].tolist(), j[new].tolist(), (np.diff(np.r_[new, len(i)]) + min_run - 1).tolist()))
        if all((p[a : a + k] == t[b : b + k]).all() for a, b, k in found):
            return found
    found, before = [], np.zeros(len(t) + 1, np.int64)
    for a in range(len(p) + 1):
        now = np.zeros(len(t) + 1, np.int64)
        if a < len(p):
            now[1:] = (before[:-1] + 1) * (t == p[a])
        ended = np.flatnonzero((before[1:] >= min_run) & (np.r_[now[2:], 0] == 0))
        found += [(a - k, b + 1 - k, k) for b, k in zip(ended.tolist(), before[ended + 1].tolist())]
        before = now
    return found


def tile(passage: list[str], text: list[str], min_run: int) -> list[tuple[int, int, int]]:
    """Tiles ``(start in passage, start in text, length)``, longest first, earliest first among equals.

    No word of either side is in two tiles. Common runs are found once; a run
    that a tile has cut goes back with what is left of it.
    """
    return _tiled(word_ids(passage), word_ids(text), min_run)


def _tiled(p: np.ndarray, t: np.ndarray, min_run: int) -> list[tuple[int, int, int]]:
    waiting = [(-k, i, j) for i, j, k in _runs(p, t, min_run)]
    heapq.heapify(waiting)
    used_p, used_t = bytearray(len(p)), bytearray(len(t))
    tiles: list[tuple[int, int, int]] = []
    while waiting:
        k, i, j = heapq.heappop(waiting)
        k = -k
        if used_p.find(1, i, i + k) < 0 and used_t.find(1, j, j + k) < 0:
            used_p[i : i + k] = used_t[j : j + k] = b"\1" * k
            tiles.append((i, j, k))
        elif used_p.count(0, i, i + k) >= min_run and used_t.count(0, j, j + k) >= min_run:
            used = np.frombuffer(used_p, bool, k, i) | np.frombuffer(used_t, bool, k, j)
            edge = np.flatnonzero(np.diff(np.r_[True, used, True].astype(np.int8)))
            for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if end - start >= min_run:
                    heapq.heappush(waiting, (start - end, i + start, j + start))
    return tiles


class _Ids:
    """Ids of words, remembered within a task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        ws = words(text)
        if len(self.known) > 500_000:
            self.known.clear()
        new = [w for w in set(ws) if w not in self.known]
        self.known.update(zip(new, word_ids(new).tolist()))
        return np.fromiter((self.known[w] for w in ws), np.uint64, len(ws))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
        ["doc_id", "passage_id", "n_tiles", "longest", "matched_words", "coverage"],
    )


def _leak(doc_id: int, passage_id: int, p: np.ndarray, t: np.ndarray, min_run: int) -> list[tuple]:
    tiles = _tiled(p, t, min_run)
    hit = sum(k for _, _, k in tiles)
    return [(doc_id, passage_id, len(tiles), tiles[0][2], hit, round(hit / len(p), 6))] if tiles else []


def _matcher(stated: list[tuple[int, np.ndarray]], min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [rolling(p, min_run) for _, p in stated]
        seeds, owner = np.concatenate(hashes), np.repeat(np.arange(len(stated)), [len(h) for h in hashes])
        order = np.argsort(seeds, kind="stable")
        seeds, owner = seeds[order], owner[order]
        ids = _Ids()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                t = ids.of(text)
                h = np.unique(rolling(t, min_run))
                low, high = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
                for n in sorted({int(n) for a, b in zip(low, high) if b > a for n in owner[a:b]}):
                    out += _leak(doc_id, stated[n][0], stated[n][1], t, min_run)
            yield _rows(out)

    return run


def _seeds(key: str, kind: str, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            found = [np.unique(rolling(ids.of(text), min_run)).view(np.int64) for text in batch["text"].to_pylist()]
            keys = batch[key].take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([np.empty(0, np.int64), *found]))], [key, "seed"])

    return run, f"{key} {kind}, seed bigint"


def _checker(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, passage_id, text, passage in zip(*(batch[c].to_pylist() for c in ("doc_id", "passage_id", "text", "passage"))):
                out += _leak(doc_id, passage_id, ids.of(passage), ids.of(text), min_run)
            yield _rows(out)

    return run


def leaks(documents: DataFrame, passages: DataFrame, min_run: int = 13, min_coverage: float = 0.0, most_words: int = 2_000_000) -> DataFrame:
    """One row per document and passage that share a run of at least ``min_run`` words.

    Columns: ``doc_id, passage_id, n_tiles, longest, matched_words, coverage``;
    rows whose coverage is under ``min_coverage`` are left out. Null and empty
    texts, and passages shorter than ``min_run`` words, match nothing. Equal
    documents each have their rows; equal passages too. Further columns are
    ignored. Empty tables give an empty result.
    """
    stated = passages.select(F.col("passage_id").cast("int").alias("passage_id"), "text").filter("text IS NOT NULL").filter(F.size(word_array(F.col("text"))) >= min_run)
    docs = documents.select("doc_id", "text").filter("text IS NOT NULL")
    n_words = stated.agg(F.sum(F.size(word_array(F.col("text"))))).first()[0] or 0
    if n_words <= most_words:
        few = [(r[0], word_ids(words(r[1]))) for r in stated.collect()]  # no more than most_words words
        few = [(p, ids) for p, ids in few if len(ids) >= min_run]  # the JVM's words may differ in rare letters
        if not few:
            return documents.sparkSession.createDataFrame([], SCHEMA)
        found = docs.mapInArrow(_matcher(few, min_run), SCHEMA)
    else:
        near = docs.mapInArrow(*_seeds("doc_id", "bigint", min_run)).join(stated.mapInArrow(*_seeds("passage_id", "int", min_run)), "seed").select("doc_id", "passage_id").distinct()
        whole = near.join(stated.withColumnRenamed("text", "passage"), "passage_id").join(docs, "doc_id")
        found = whole.select("doc_id", "passage_id", "text", "passage").mapInArrow(_checker(min_run), SCHEMA)
    return found.filter(f"coverage >= {float(min_coverage)}")


def found(documents: DataFrame, passages: DataFrame) -> DataFrame:
    return leaks(documents, passages, min_run=13).select("doc_id", "passage_id")


FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT passage_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM bench_passages WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
pr AS (SELECT DISTINCT passage_id, array_to_string(w[i:i+12], ' ') AS r FROM (SELECT passage_id, w, unnest(range(1, len(w) - 11)) AS i FROM p))
SELECT DISTINCT doc_id, passage_id FROM dr JOIN pr USING (r)
"""

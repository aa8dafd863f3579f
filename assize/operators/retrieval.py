"""Similarity search over chunks, feedback and vectors, batched over many queries.

A stated set of queries is met with all rows in blocks: a block of queries goes
to every task, scores whole batches of rows at once, and keeps the best k of
each batch per query; only those are merged. No pair is ever shuffled, and
every row is scored. The number of queries of one call is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import DAY_US, micros
from ..functions.text import token_estimate

#: Most queries of one call; the caller splits more into several calls.
MOST_QUERIES = 20_000
#: Queries of one block, scored together in one pass over the rows.
BLOCK = 512
K1, B = 1.2, 0.75
#: Words of an index: letters, digits and _ : $ (fixed value).
TERM = r"[\p{L}\p{N}_:$]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _bounded(queries: DataFrame) -> DataFrame:
    """The queries as a broadcast, after counting that there are few."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one batch")
    return F.broadcast(queries)


def top_k(scored: DataFrame, k: int, by: str = "score", tie: str = "id", falling: bool = True) -> DataFrame:
    """The best ``k`` rows of each ``query_id`` with their ``rank``; ties go to the smaller ``tie``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by) if falling else F.asc(by), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, *columns: str) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for n, row in enumerate(queries.select("query_id", *columns).toLocalIterator()):
        if n >= MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries in one call")
        block.append(tuple(row))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


#: Makes, in the worker, a function from a batch to scores (rows x queries).
Scorer = Callable[[list[tuple]], Callable[[pa.RecordBatch], np.ndarray]]


def _search(queries: DataFrame, asked: tuple[str, ...], rows: DataFrame, scorer: Scorer, k: int, least: float | None = 0.0) -> DataFrame:
    """``query_id, id, rank, score`` of the best ``k`` rows per query with a score over ``least``.

    Scores are rounded to six places before they are ranked; ties go to the smaller id.
    """
    q_type, id_type = queries.schema["query_id"].dataType, rows.schema["id"].dataType
    schema = f"query_id {q_type.simpleString()}, id {id_type.simpleString()}, score double"

    def one(block: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = scorer(block)
            for batch in batches:
                held = batch["id"].to_pylist()
                ids = np.array(held)
                out_q, out_i, out_s = [], [], []
                if len(ids):
                    scores = np.ascontiguousarray(np.round(score(batch), 6).T)
                    for n, q in enumerate(block):
                        s = scores[n]
                        cut = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                        near = np.flatnonzero((s >= cut) & (s > least if least is not None else True))
                        for at in near[np.lexsort((ids[near], -s[near]))][:k]:
                            out_q.append(q[0])
                            out_i.append(held[at])
                            out_s.append(float(s[at]))
                yield pa.RecordBatch.from_arrays([pa.array(out_q, q_kind), pa.array(out_i, batch.schema.field("id").type), pa.array(out_s, pa.float64())], ["query_id", "id", "score"])

        q_kind = pa.string() if q_type.simpleString() == "string" else pa.int64() if q_type.simpleString() == "bigint" else pa.int32()
        return rows.mapInArrow(run, schema)

    parts = [one(block) for block in _blocks(queries, *asked)]
    found = reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], schema)
    return top_k(found, k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``query_id, id, rank, score`` of the nearest vectors; ``queries`` (query_id, vec) and ``vectors`` (id, vec).

    cosine: higher is better, 0 for a zero vector or unequal lengths. l2: the
    score is 1 - distance / 2 with the distance cut to [0, 2]. Null vectors match nothing.
    """

    def scorer(block: list[tuple]):
        dim = max((len(q[1]) for q in block if q[1]), default=0)
        asked = np.array([q[1] if q[1] is not None and len(q[1]) == dim else [0.0] * dim for q in block], np.float64).reshape(len(block), dim)
        norms = np.sqrt((asked * asked).sum(1))

        def score(batch: pa.RecordBatch) -> np.ndarray:
            vecs = batch["vec"].to_pylist()
            fits = np.array([v is not None and len(v) == dim for v in vecs])
            held = np.array([v if f else [0.0] * dim for v, f in zip(vecs, fits)], np.float64).reshape(len(fits), dim)
            dots = held @ asked.T
            own = np.sqrt((held * held).sum(1))
            if metric == "cosine":
                scale = own[:, None] * norms[None, :]
                return np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
            squared = np.maximum(0.0, own[:, None] ** 2 + norms[None, :] ** 2 - 2 * dots)
            return np.where(fits[:, None], 1 - np.minimum(2.0, np.sqrt(squared)) / 2, -1.0)

        return score

    return _search(queries, ("vec",), vectors.select("id", "vec"), scorer, k, None)


#: A term of so many queries of a block is weighed by a matrix, others query by query.
DENSE = 24


class _Terms:
    """The terms of a block of queries, each with its weight, against batches of rows."""

    def __init__(self, block: list[tuple], weigh: Callable[[str], float] = lambda term: 1.0):
        self.place: dict[str, int] = {}
        owners: list[list[int]] = []
        for n, q in enumerate(block):
            for w in dict.fromkeys(q[1] or ()):
                at = self.place.setdefault(w, len(owners))
                if at == len(owners):
                    owners.append([])
                owners[at].append(n)
        self.width = len(block)
        weights = np.array([weigh(w) for w in self.place], np.float64)
        sizes = np.fromiter(map(len, owners), np.int64, len(owners))
        dense = np.flatnonzero(sizes >= DENSE)
        self.column = np.full(len(owners), -1)
        self.column[dense] = np.arange(len(dense))
        self.table = np.zeros((len(dense), len(block)))
        for n, at in enumerate(dense):
            self.table[n, owners[at]] = weights[at]
        self.weights, self.sizes = weights, sizes
        self.begins = np.cumsum(sizes) - sizes
        self.owner = np.array([n for of in owners for n in of], np.int64)

    def of(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and number of every term of the block in each row."""
        flat = pc.list_flatten(words).dictionary_encode()
        here = np.array([self.place.get(w, -1) for w in flat.dictionary.to_pylist()], np.int64)
        at = np.asarray(pc.fill_null(flat.indices, 0))
        term = here[at] if len(at) else np.zeros(0, np.int64)
        term = np.where(np.asarray(flat.is_valid()), term, -1)
        met = term >= 0
        each, n = np.unique(np.asarray(pc.list_parent_indices(words)).astype(np.int64)[met] * max(1, len(self.place)) + term[met], return_counts=True)
        return each // max(1, len(self.place)), each % max(1, len(self.place)), n

    def sums(self, rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """rows x queries: the sum of value times weight over the terms that a row and a query share."""
        column = self.column[term]
        dense = column >= 0
        held = np.zeros((rows, len(self.table)))
        held[row[dense], column[dense]] = value[dense]
        out = held @ self.table
        row, term, value = row[~dense], term[~dense], value[~dense]
        many = self.sizes[term]
        begins = np.cumsum(many) - many
        at = np.arange(int(many.sum())) + np.repeat(self.begins[term] - begins, many)
        cell = np.repeat(row, many) * self.width + self.owner[at]
        return out + np.bincount(cell, np.repeat(value * self.weights[term], many), rows * self.width).reshape(rows, self.width)


def jaccard_search(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, rank, score`` by 0.6 title similarity + 0.4 equal category.

    ``queries``: query_id, words, cat; ``entries``: id, words, cat. Words are
    distinct. Null words count as none, a null category equals nothing.
    """

    def scorer(block: list[tuple]):
        terms = _Terms(block)
        sizes = np.array([len(q[1] or ()) for q in block], np.float64)
        cats = np.array([q[2] if q[2] is not None else "\0none" for q in block])

        def score(batch: pa.RecordBatch) -> np.ndarray:
            row, term, _ = terms.of(batch["words"])
            shared = terms.sums(len(batch), row, term, np.ones(len(row)))
            own = np.asarray(pc.fill_null(pc.list_value_length(batch["words"]), 0), np.float64)
            out = np.divide(0.6 * shared, sizes[None, :] + own[:, None] - shared, out=np.zeros_like(shared), where=shared > 0)
            for n, cat in enumerate(batch["cat"].to_pylist()):
                if cat is not None:
                    out[n] += 0.4 * (cats == cat)
            return out

        return score

    return _search(queries, ("words", "cat"), entries.select("id", "words", "cat"), scorer, k)


def bm25(queries: DataFrame, docs: DataFrame, k: int, normalize: bool = False) -> DataFrame:
    """``query_id, id, rank, score`` by BM25 (k1 1.2, b 0.75) over ``docs`` (id, terms) for ``queries`` (query_id, terms).

    Document frequencies of the queried terms and the mean length are counted
    over all documents first. With ``normalize`` scores are divided by the best of the query.
    """
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    counted = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    df = {r["term"]: r["df"] for r in counted.toLocalIterator()}  # the terms of a bounded set of queries
    n_docs, mean = docs.agg(F.count("*"), F.avg(F.size("terms"))).first()
    idf = {w: float(np.log(1 + (n_docs - d + 0.5) / (d + 0.5))) for w, d in df.items()}

    def scorer(block: list[tuple]):
        terms = _Terms(block, lambda w: idf.get(w, 0.0))

        def score(batch: pa.RecordBatch) -> np.ndarray:
            row, term, tf = terms.of(batch["terms"])
            size = np.asarray(pc.fill_null(pc.list_value_length(batch["terms"]), 0), np.float64)[row]
            return terms.sums(len(batch), row, term, tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))

        return score

    found = _search(queries, ("terms",), docs.select("id", "terms"), scorer, k)
    if normalize:
        found = found.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("score", F.max("score").over(Window.partitionBy("query_id"))))), 6))
    return found


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int) -> DataFrame:
    """Fused ranking of several (query_id, id, rank): sum of 1 / (60 + rank), divided by the best of the query."""
    joined = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        joined = joined.unionByName(r.select("query_id", "id", "rank"))
    fused = joined.groupBy("query_id", "id").agg(F.sum(1 / (60 + F.col("rank"))).alias("score"))
    best = Window.partitionBy("query_id")
    return top_k(fused.withColumn("score", F.round(F.col("score") / F.max("score").over(best), 6)), k)


def min_max(score: Column, by: Window) -> Column:
    """Score scaled to [0, 1] over the window; all 1 if equal and positive, else 0."""
    value = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high - low < 1e-12, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def rerank(candidates: DataFrame, now_us: int, k: int, halflife_days: float = 90.0, floor: float = 0.25, least: float = 0.0) -> DataFrame:
    """Hybrid score of candidates: 0.6 BM25 + 0.4 vector, each scaled per query, + 1 exact name + 0.5 language, times recency.

    ``candidates``: query_id, id, bm25, vec, exact (bool), same_lang (bool), indexed_at.
    """
    by = Window.partitionBy("query_id")
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - micros(F.col("indexed_at"))) / DAY_US)
    recency = F.greatest(F.exp(-F.log(F.lit(2.0)) * age / halflife_days), F.lit(floor))
    blended = 0.6 * min_max(F.col("bm25"), by) + 0.4 * min_max(F.col("vec"), by) + F.when(F.col("exact"), 1.0).otherwise(0.0) + F.when(F.col("same_lang"), 0.5).otherwise(0.0)
    scored = candidates.withColumn("score", F.round(blended * recency, 6)).filter(F.col("score") >= least)
    return top_k(scored, k).select("query_id", "id", "rank", "score")


def candidate_union(bm25_hits: DataFrame, vec_hits: DataFrame, name_hits: DataFrame) -> DataFrame:
    """Full outer union of the three legs: ``query_id, id, bm25, vec, exact``."""
    zero = F.lit(0.0)
    rows = (
        bm25_hits.select("query_id", "id", F.col("score").alias("bm25"), zero.alias("vec"), F.lit(False).alias("exact"))
        .unionByName(vec_hits.select("query_id", "id", zero.alias("bm25"), F.col("score").alias("vec"), F.lit(False).alias("exact")))
        .unionByName(name_hits.select("query_id", "id", zero.alias("bm25"), zero.alias("vec"), F.lit(True).alias("exact")))
    )
    return rows.groupBy("query_id", "id").agg(F.max("bm25").alias("bm25"), F.max("vec").alias("vec"), F.bool_or("exact").alias("exact"))


def filtered(chunks: DataFrame, sources: tuple[str, ...] = (), kinds: tuple[str, ...] = (), exclude_paths: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the sources and kinds (all if none is named) whose path isn't excluded; a null path never is."""
    if sources:
        chunks = chunks.filter(F.col("source").isin(*sources))
    if kinds:
        chunks = chunks.filter(F.col("chunk_kind").isin(*kinds))
    if exclude_paths:
        chunks = chunks.filter(F.coalesce(~F.col("source_path").isin(*exclude_paths), F.lit(True)))
    return chunks


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks whose id is in ``ids``, once each row."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def retrieve(queries: DataFrame, chunks: DataFrame, now_us: int, k: int, pool: int = 40, least: float = 0.0, **filters: tuple[str, ...]) -> DataFrame:
    """All three legs, blended: ``query_id, id, rank, score, legs``.

    ``queries``: query_id, terms, vec, names, lang; ``chunks``: id, terms, vec,
    qualified_name, lang, source, chunk_kind, source_path, indexed_at. The
    filters hold before each leg takes its ``pool`` best, so none is spent on
    chunks that are left out. ``legs`` lists those that found the chunk.
    """
    held = filtered(chunks, **filters)
    legs = {
        "bm25": bm25(queries.select("query_id", "terms"), held, pool),
        "vector": knn(queries.select("query_id", "vec"), held.filter("vec IS NOT NULL"), pool),
        "structural": structural(queries, held),
    }
    found = reduce(DataFrame.unionByName, [x.select("query_id", "id", F.lit(n).alias("leg")) for n, x in legs.items()])
    tags = found.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("leg")).alias("legs"))  # three at most
    asked = queries.select("query_id", "names", F.col("lang").alias("q_lang"))
    rows = candidate_union(*legs.values()).join(asked, "query_id").join(held.select("id", "qualified_name", "lang", "indexed_at"), "id")
    rows = rows.withColumns({"exact": F.coalesce(F.array_contains("names", F.col("qualified_name")), F.lit(False)), "same_lang": F.coalesce(F.col("q_lang") == F.col("lang"), F.lit(False))})
    return rerank(rows, now_us, k, least=least).join(tags, ["query_id", "id"])


def mode(has_terms: bool, has_vectors: bool) -> str:
    """Search of a feedback index by what it holds: hybrid, bm25, embedding, or jaccard with neither."""
    return {(True, True): "hybrid", (True, False): "bm25", (False, True): "embedding"}.get((has_terms, has_vectors), "jaccard")


def phrase_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, id, n_phrases``: documents (id, terms) in which terms of a query's phrase (query_id, phrases) follow one another."""
    inside = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    asked = queries.select("query_id", F.explode(F.array_distinct("phrases")).alias("phrase")).withColumn("words", terms(F.col("phrase"))).filter(F.size("words") > 0)
    asked = asked.select("query_id", "phrase", F.get("words", 0).alias("first"), inside(F.col("words")).alias("wanted"))
    held = docs.select("id", F.explode(F.array_distinct("terms")).alias("first"), inside(F.col("terms")).alias("said"))
    hits = held.join(_bounded(asked), "first").filter(F.contains("said", F.col("wanted")))
    return hits.groupBy("query_id", "id").agg(F.count("*").alias("n_phrases"))


def passing(candidates: DataFrame, threshold: float, step: float = 0.1) -> DataFrame:
    """Candidates (query_id, id, score, is_symbol) over the threshold, with ``lowered``.

    Where a query has none, its prose passes from ``step`` lower, but not from under 0.
    """
    over = F.col("score") >= threshold
    none = ~F.coalesce(F.bool_or(over).over(Window.partitionBy("query_id")), F.lit(False))
    lower = max(0.0, threshold - step)
    lowered = none & ~F.col("is_symbol") & (F.col("score") >= lower) & F.lit(lower < threshold)
    return candidates.withColumn("lowered", lowered).filter(over | F.col("lowered"))


def index_agreement(stored: DataFrame, logged: DataFrame) -> DataFrame:
    """Rows per source in the index and in its log: ``source, n_stored, n_logged, status`` (pass, or warn where they differ or one is missing)."""
    one = stored.groupBy("source").agg(F.count("*").alias("n_stored"))
    two = logged.groupBy(F.col("source").alias("other")).agg(F.count("*").alias("n_logged"))
    both = one.join(two, F.col("source").eqNullSafe(F.col("other")), "full_outer")
    return both.select(F.coalesce("source", "other").alias("source"), "n_stored", "n_logged", F.when(F.col("n_stored") == F.col("n_logged"), "pass").otherwise("warn").alias("status"))


def structural(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, id, place`` of chunks whose qualified name is one of the query's names, in the order of the names, then id."""
    asked = queries.select("query_id", F.posexplode("names").alias("pos", "name"))
    hits = chunks.join(_bounded(asked), chunks.qualified_name == F.col("name"))
    order = Window.partitionBy("query_id").orderBy("pos", "id")
    return hits.select("query_id", "id", F.row_number().over(order).alias("place"))


def precedence(chunks: DataFrame, weights: dict[str, float], query: str | None = None) -> DataFrame:
    """Chunks without those that lose to one of the same qualified name, with the reason of each winner.

    Winner: higher source weight, then later indexing, then smaller source,
    then smaller id. Chunks without name are all kept.
    """
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    keys = [c for c in (query, "qualified_name") if c]
    rank = F.struct((-weight).alias("w"), (-micros(F.col("indexed_at"))).alias("t"), "source", "id")
    named = chunks.filter("qualified_name IS NOT NULL").groupBy(*keys).agg(F.min(rank).alias("win"), F.count("*").alias("n"), F.max(weight).alias("hi"), F.min(weight).alias("lo"), F.max("indexed_at").alias("late"), F.min("indexed_at").alias("early"))
    reason = F.when(F.col("n") == 1, "only").when(F.col("hi") > F.col("lo"), "weight").when(F.col("late") > F.col("early"), "recency").otherwise("name")
    winners = named.select(*[k for k in keys], F.col("win.id").alias("id"), (F.col("n") - 1).alias("n_dropped"), reason.alias("reason"))
    free = chunks.filter("qualified_name IS NULL").select(*keys, "id", F.lit(0).cast("long").alias("n_dropped"), F.lit("unnamed").alias("reason"))
    return winners.unionByName(free)


def chunk_thresholds(chunks: DataFrame, confirmations: DataFrame, after: int = 3, floor: float = 0.2) -> DataFrame:
    """Injection threshold per chunk: the floor, raised with each confirmation, null (never) from ``after`` on."""
    n = F.coalesce("n", F.lit(0))
    raised = F.when(n >= after, F.lit(None).cast("double")).otherwise(F.lit(floor) + n * (1 - floor) / after)
    return chunks.select("id").join(confirmations.select(F.col("chunk_id").alias("id"), "n"), "id", "left").select("id", n.cast("long").alias("n"), F.round(raised, 6).alias("threshold"))


def pack(ranked: DataFrame, budget: int, most: int, floor: float = 0.0) -> DataFrame:
    """Greedy packing per query: ``query_id, id, place, tokens``.

    ``ranked``: query_id, id, rank, score, is_symbol, content. Symbols come
    before prose, each by rank; a chunk that doesn't fit is skipped and the
    walk goes on; at most ``most`` are taken. The candidates of a query are its
    top k, so the fold is short.
    """
    item = F.struct((~F.col("is_symbol")).alias("later"), "rank", "id", token_estimate(F.col("content")).alias("tokens"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:string,tokens:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["tokens"] <= budget) & (F.size(acc["taken"]) < most)
        row = F.struct(x["id"].cast("string").alias("id"), x["tokens"].alias("tokens"))
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["taken"], row)).otherwise(acc["taken"]).alias("taken"))

    packed = ranked.filter(F.col("score") >= floor).groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("p"))
    return packed.select("query_id", F.posexplode("p.taken").alias("pos", "x")).select("query_id", F.col("x.id").alias("id"), (F.col("pos") + 1).alias("place"), F.col("x.tokens").alias("tokens"))

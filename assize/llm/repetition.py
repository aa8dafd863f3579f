"""Repetition inside single documents.

Two measures per document. The share of repeated runs, 1 - distinct / all runs
of five consecutive words, is exact. Beside it stands the Jensen-Shannon
distance of the document's character-class and function-word histograms from
those of its language, summed over all documents of that language; a document
under the minimum length has no distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .words import word_array, words

RUN = 5

#: Frequent function words of each language (fixed values).
COMMON = {
    "en": "the of and a to in is that it for was on are with as be by this which or from at an not the".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
_VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})

#: Character classes, in the order of the histogram.
CLASSES = (r"\p{Lu}", r"\p{Ll}", r"[\p{L}&&[^\p{Lu}\p{Ll}]]", r"\p{N}", r"\s", r"\p{P}", r"\p{S}")


def repeated_share(text: Column, run: int = RUN) -> Column:
    """Share of runs of ``run`` words that repeat an earlier one; null under ``run`` words."""


    def of(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws) - run + 1)
        return F.when(F.size(ws) >= run, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, run))))

    # A lambda over a one-element array evaluates its words, and then its runs, only once.
    runs = F.transform(F.array(word_array(text)), of)
    return F.transform(runs, lambda r: 1 - F.size(F.array_distinct(r)) / F.size(r)).getItem(0)


def _char_histogram(text: Column) -> Column:
    return F.array(*[F.regexp_count(text, F.lit(c)).cast("double") for c in CLASSES])


def _count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = {w: i for i, w in enumerate(_VOCABULARY)}
    for batch in batches:
        counts = []
        for text in batch["text"].to_pylist():
            row = [0.0] * (len(place) + 1)
            for w in words(text):
                row[place.get(w, -1)] += 1
            counts.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.list_(pa.float64()))], [*batch.schema.names, "word_hist"])


def _scaled(h: Column) -> Column:
    total = F.array(F.aggregate(h, F.lit(0.0), lambda a, x: a + x))
    return F.flatten(F.transform(total, lambda t: F.transform(h, lambda x: F.coalesce(F.try_divide(x, t), F.lit(0.0)))))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of equal length."""


    def half(x: Column, y: Column) -> Column:
        terms = F.zip_with(x, y, lambda u, v: F.when(u > 0, u * F.log2(u * 2 / (u + v))).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    pair = F.array(F.struct(_scaled(p).alias("a"), _scaled(q).alias("b")))
    return F.transform(pair, lambda x: F.sqrt(F.greatest(F.lit(0.0), (half(x["a"], x["b"]) + half(x["b"], x["a"])) / 2))).getItem(0)


def language(lang: Column) -> Column:
    """Two-letter code of a loosely spelled language tag; ``und`` if there is none."""
    two = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})", 1))
    return F.when(two.isin(*COMMON), two).otherwise("und")


def measure(documents: DataFrame, min_words: int = 20, max_distance: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, n_words, repeated_share, char_distance, word_distance, divergent``.

    ``repeated_share`` is null under five words. The distances are null under
    ``min_words`` words. Documents of unknown language share one reference. A
    null text counts as an empty one. Equal documents each have a row, and so
    do repeated doc_ids; an empty table gives an empty result.
    """
    counted = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), language(F.col("lang")).alias("lang")).mapInArrow(
        _count_common, "doc_id bigint, text string, lang string, word_hist array<double>"
    )
    docs = materialize(
        counted.select(
            "doc_id",
            "lang",
            F.aggregate("word_hist", F.lit(0.0), lambda a, x: a + x).cast("int").alias("n_words"),
            repeated_share(F.col("text")).alias("repeated_share"),
            _char_histogram(F.col("text")).alias("chars"),
            F.col("word_hist").alias("common"),
        ),
        "histograms",
    )

    def reference(name: str) -> DataFrame:
        return (
            docs.select("lang", F.posexplode(name))
            .groupBy("lang", "pos")
            .agg(F.sum("col").alias("n"))
            .groupBy("lang")  # one row per language and class: bounded by the fixed lists
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias(f"ref_{name}"))
        )

    long_enough = F.col("n_words") >= min_words
    return (
        docs.join(F.broadcast(reference("chars").join(reference("common"), "lang")), "lang", "left")  # at most one row per listed language
        .select(
            "doc_id",
            "n_words",
            "repeated_share",
            F.when(long_enough, F.round(_distance(F.col("chars"), F.col("ref_chars")), 6)).alias("char_distance"),
            F.when(long_enough, F.round(_distance(F.col("common"), F.col("ref_common")), 6)).alias("word_distance"),
        )
        .withColumn("divergent", F.coalesce((F.col("char_distance") > max_distance) | (F.col("word_distance") > max_distance), F.lit(False)))
    )


def found(documents: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id`` of documents of five or more words whose share of repeated runs reaches ``threshold``.

    Only the share is computed: a text that repeats a normal paragraph has
    normal histograms, so no distance tells it (figures in the README).
    """
    return documents.select("doc_id", repeated_share(F.col("text")).alias("share")).filter(F.col("share") >= threshold).select("doc_id")


FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, 1 - len(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) / (len(w) - 4) AS share FROM d WHERE len(w) >= 5)
SELECT doc_id FROM g WHERE share >= 0.3
"""

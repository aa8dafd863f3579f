"""Consensus label per item, agreement and annotator reliability from disagreeing annotators.

Competence-and-spamming mixture: with probability ``competence`` an annotator
gives the true label, else a label drawn from a guess distribution of their
own. Expectation-maximisation yields the posterior of each item's label, each
competence and each guess distribution.

Items with the same votes by the same annotators have the same posterior, so
they are first counted by vote pattern: a step of the iteration reads one
weighted item per pattern, and only the end joins the patterns with the items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import VERDICTS, annotator, verdict
from ..storage import materialize
from .findings import finding_rows


def votes(feedback: DataFrame) -> DataFrame:
    """``fid, who, label``: the latest usable verdict of each annotator on each finding.

    Rows without a readable verdict or annotator are no votes. Later
    timestamps win (one after its arrival counts as the oldest), then smaller seq.
    """
    decoded = feedback.withColumns({"__who": annotator(F.col("provenance")), "__label": verdict(F.col("verdict"))})
    rows = finding_rows(decoded, "__who", "__label").withColumnsRenamed({"__who": "who", "__label": "label"})
    return (
        rows.filter(F.col("who").isNotNull() & F.col("label").isNotNull())
        .groupBy("fid", "who")
        .agg(F.max_by("label", F.struct("us", (-F.col("seq")).alias("s"))).alias("label"))
    )


#: Identify a pattern: two hashes of its votes and their number.
PATTERN = ("sign_a", "sign_b", "n_votes")
#: Most annotators of one call: their parameters, some 50 bytes each, go to every task.
MOST_ANNOTATORS = 1_000_000


def patterns(cast: DataFrame, labels: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str]]:
    """``fid`` and pattern of every item; one row per pattern with its ``weight`` (number of items) and votes; the annotators.

    A row's votes are ``whos`` (places in the list of annotators) and ``said``
    (places in ``labels``), at most one per annotator.
    """
    vote = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "who", "label"))
    signs = materialize(cast.groupBy("fid").agg(vote(0).alias("sign_a"), vote(1).alias("sign_b"), F.count("*").alias("n_votes")), "signs")
    names = sorted(r[0] for r in cast.select("who").distinct().limit(MOST_ANNOTATORS + 1).collect())
    if len(names) > MOST_ANNOTATORS:
        raise ValueError(f"more than {MOST_ANNOTATORS} annotators")
    placed = cast.sparkSession.createDataFrame(list(enumerate(names)), "place int, who string")
    kinds = signs.groupBy(*PATTERN).agg(F.count("*").alias("weight"), F.min("fid").alias("fid"))
    said = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).cast("int") - 1
    votes_of = F.array_sort(F.collect_list(F.struct("place", said.alias("said"))))
    packed = kinds.join(cast, "fid").join(F.broadcast(placed), "who").groupBy(*PATTERN, "weight").agg(votes_of.alias("v"))
    return signs, materialize(packed.select(*PATTERN, "weight", F.col("v.place").alias("whos"), F.col("v.said").alias("said")), "patterns"), names


@dataclass
class Model:
    """Competence per annotator, guess distribution per annotator, prior of the labels."""

    competence: np.ndarray
    guess: np.ndarray
    prior: np.ndarray
    n_items: np.ndarray
    converged: bool = False

    def posterior(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posterior per row and label; and per vote its row, annotator, label and chance of being truthful."""
        k = len(self.prior)
        whos, said = (batch[c].flatten().to_numpy() for c in ("whos", "said"))
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch["whos"]).to_numpy())
        able, spam = self.competence[whos], (1 - self.competence[whos]) * self.guess[whos, said]
        log = np.bincount(row, np.log(spam), len(batch))[:, None] + np.log(self.prior)
        log += np.bincount(row * k + said, np.log(able + spam) - np.log(spam), len(batch) * k).reshape(-1, k)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p, row, whos, said, p[row, said] * able / (able + spam)


def _start(n: int, k: int) -> Model:
    return Model(np.full(n, 0.5), np.full((n, k), 1.0 / k), np.full(k, 1.0 / k), np.zeros(n))


def _sums(kinds: DataFrame, model: Model | None, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of one step: per annotator ``items, truthful, guessed label 0..``, and per label the expected items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, labels = np.zeros((n, 2 + k)), np.zeros(k)
        for batch in batches:
            p, row, whos, said, r = (model or _start(n, k)).posterior(batch)
            weight = batch["weight"].to_numpy().astype(float)
            w = weight[row]
            if model is None:
                r = np.zeros(len(r))
            total[:, 0] += np.bincount(whos, w, n)
            total[:, 1] += np.bincount(whos, w * r, n)
            total[:, 2:] += np.bincount(whos * k + said, w * (1 - r), n * k).reshape(n, k)
            labels += (p * weight[:, None]).sum(axis=0)
        seen = np.flatnonzero(total[:, 0])
        rows = np.vstack([np.hstack([seen[:, None], total[seen]]), np.hstack([[-1.0, 0.0, 0.0], labels])[None]])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["place", *(f"x{i}" for i in range(2 + k))])

    columns = [f"x{i}" for i in range(2 + k)]
    parts = kinds.select("weight", "whos", "said").mapInArrow(run, "place double, " + ", ".join(f"{c} double" for c in columns))
    total, labels = np.zeros((n, 2 + k)), np.zeros(k)
    for r in parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # one row per annotator
        if r[0] < 0:
            labels = np.array(r[3:])
        else:
            total[int(r[0])] = r[1:]
    return total, labels


def fit(kinds: DataFrame, n: int, k: int, iterations: int = 200, tolerance: float = 1e-3) -> Model:
    """The model of ``n`` annotators and ``k`` labels, from the votes of the patterns.

    At first everyone is truthful half of the time and else guesses as they
    vote, so a vote that its annotator always gives says little. Ends when no
    competence moves by more than ``tolerance``; ``converged`` says whether
    that was reached. Smoothing keeps every parameter inside (0, 1), so single
    votes and unanimous annotators are safe.
    """
    total, _ = _sums(kinds, None, n, k)
    smoothed = lambda said: (said + 0.5) / (said.sum(axis=1, keepdims=True) + 0.5 * k)
    model = Model(np.full(n, 0.5), smoothed(total[:, 2:]), np.full(k, 1.0 / k), total[:, 0], n == 0)
    for _ in range(iterations if n else 0):
        total, labels = _sums(kinds, model, n, k)
        new = Model((total[:, 1] + 1) / (total[:, 0] + 2), smoothed(total[:, 2:]), (labels + 1) / (labels.sum() + k), total[:, 0])
        new.converged = bool(np.abs(new.competence - model.competence).max() < tolerance)
        model = new
        if model.converged:
            break
    return model


def _judge(model: Model, labels: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(labels)
        for batch in batches:
            p, row, _, said, _ = model.posterior(batch)
            counts = np.bincount(row * k + said, minlength=len(batch) * k).reshape(-1, k)
            n, same = counts.sum(axis=1), (counts * (counts - 1)).sum(axis=1)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in PATTERN),
                    pa.array((counts > 0).sum(axis=1).astype(np.int32)),
                    pa.array([labels[i] for i in best], pa.string()),
                    pa.array(p.max(axis=1)),
                    pa.array([a / (b * (b - 1)) if b > 1 else None for a, b in zip(same.tolist(), n.tolist())], pa.float64()),
                ],
                [*PATTERN, "n_labels", "consensus", "confidence", "agreement"],
            )

    return run


def agree(feedback: DataFrame, labels: tuple[str, ...] = VERDICTS) -> tuple[DataFrame, DataFrame]:
    """Consensus per finding and reliability per annotator.

    First table: ``finding_id, n_annotators, n_labels, consensus, confidence,
    agreement`` (share of agreeing pairs of annotators; null for one). Ties of
    the posterior go to the label that comes first in ``labels``. Second table:
    ``annotator, n_items, competence``, one ``guess_<label>`` per label, and
    ``converged``. An empty table gives two empty tables.
    """
    cast = materialize(votes(feedback), "votes")
    signs, kinds, names = patterns(cast, labels)
    model = fit(kinds, len(names), len(labels))
    schema = "sign_a bigint, sign_b bigint, n_votes bigint, n_labels int, consensus string, confidence double, agreement double"
    of_kind = kinds.select(*PATTERN, "whos", "said").mapInArrow(_judge(model, labels), schema)
    items = signs.join(of_kind, list(PATTERN)).select(
        F.col("fid").alias("finding_id"), F.col("n_votes").alias("n_annotators"), "n_labels", "consensus", F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement")
    )
    rows = [(w, int(model.n_items[i]), round(float(model.competence[i]), 6), *(round(float(g), 6) for g in model.guess[i]), model.converged) for i, w in enumerate(names)]
    guesses = ", ".join(f"guess_{v} double" for v in labels)
    reliability = feedback.sparkSession.createDataFrame(rows, f"annotator string, n_items bigint, competence double, {guesses}, converged boolean")
    return items, reliability


def found(feedback: DataFrame) -> DataFrame:
    """``finding_id, consensus`` of findings on which three or more annotators don't all agree."""
    items, _ = agree(feedback)
    return items.filter("n_annotators >= 3 and n_labels > 1").select("finding_id", "consensus")

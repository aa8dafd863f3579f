"""Word sets of one task met by an inverted index, in the worker; no pair leaves the task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def _codes(within: np.ndarray, words: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, group and word of every word of every set."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    return np.concatenate(([0], np.cumsum(sizes))), np.repeat(within, sizes), flat


class Postings:
    """Sets of distinct words asked and held; sets meet only within an equal ``group``.

    ``sizes_a`` and ``sizes_h`` count all words of a set; ``words_of`` gives those of an asked set that are held
    in its group, the rarest first.
    """

    def __init__(self, groups_a: Sequence, words_a: Sequence[Sequence[str]], groups_h: Sequence, words_h: Sequence[Sequence[str]]):
        group = pd.factorize(np.concatenate((np.asarray(groups_a, object), np.asarray(groups_h, object))))[0].astype(np.int64)
        self.off_a, in_a, flat_a = _codes(group[: len(groups_a)], words_a)
        self.off_h, in_h, flat_h = _codes(group[len(groups_a) :], words_h)
        word, names = pd.factorize(np.concatenate((flat_a, flat_h)))
        of, self.n = np.unique(np.concatenate((in_a, in_h)) * max(1, len(names)) + word, return_inverse=True)[1], 0
        tok_a, self.tok_h = of[: len(flat_a)], of[len(flat_a) :]
        self.n = int(of.max()) + 1 if len(of) else 0
        self.count = np.bincount(self.tok_h, minlength=self.n)
        self.start = np.concatenate(([0], np.cumsum(self.count)))
        self.sizes_a, self.sizes_h = np.diff(self.off_a), np.diff(self.off_h)
        self.posted = np.repeat(np.arange(len(self.sizes_h)), self.sizes_h)[np.argsort(self.tok_h, kind="stable")]
        # Asked words that are held, by set and rarity.
        row = np.repeat(np.arange(len(self.sizes_a)), self.sizes_a)
        met = self.count[tok_a] > 0
        row, tok_a = row[met], tok_a[met]
        self.tok_a = tok_a[np.lexsort((tok_a, self.count[tok_a], row))]
        self.row_a = row
        self.at_a = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(self.sizes_a)))))
        self.work = np.bincount(row, self.count[tok_a], len(self.sizes_a)).astype(np.int64)
        self.mark = np.zeros(self.n, np.int64)

    def words_of(self, a: int) -> np.ndarray:
        return self.tok_a[self.at_a[a] : self.at_a[a + 1]]

    def holders(self, word: int) -> np.ndarray:
        return self.posted[self.start[word] : self.start[word + 1]]

    def shared(self, held: np.ndarray) -> np.ndarray:
        """How many of the words in ``mark`` each of the held sets has; none of them is empty."""
        sizes = self.sizes_h[held]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        at = np.arange(ends[-1]) + np.repeat(self.off_h[held] - begins, sizes)
        return np.add.reduceat(self.mark[self.tok_h[at]], begins)

    def similar(self, a: int, held: np.ndarray) -> np.ndarray:
        """Jaccard similarity of the asked set, whose words are marked, and held ones."""
        n = self.shared(held)
        return n / (self.sizes_a[a] + self.sizes_h[held] - n)

    def pairs(self, asked: np.ndarray, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of the asked sets with a held one that share a word: asked, held, similarity; the pairs of one asked set come together."""
        n_h = max(1, len(self.sizes_h))
        part = np.cumsum(self.work[asked]) // at_once
        for p in np.unique(part):
            own = np.zeros(len(self.sizes_a), bool)
            own[asked[part == p]] = True
            tok, row = self.tok_a[own[self.row_a]], self.row_a[own[self.row_a]]
            many = self.count[tok]
            begins = np.cumsum(many) - many
            at = np.arange(int(many.sum())) + np.repeat(self.start[tok] - begins, many)
            key, n = np.unique(np.repeat(row, many) * n_h + self.posted[at], return_counts=True)
            a, h = key // n_h, key % n_h
            yield a, h, n / (self.sizes_a[a] + self.sizes_h[h] - n)

"""Words of a text: maximal runs of letters, digits and underscores, lower-cased."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: The same runs for the JVM's regular expressions.
JVM_WORD = r"[\p{L}\p{N}_]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_array(text: Column) -> Column:
    """The words of a text column; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(JVM_WORD), F.lit(0)), F.array().cast("array<string>"))


def rolling(ids: np.ndarray, run: int) -> np.ndarray:
    """Karp-Rabin hashes (polynomial, modulo 2^64) of all runs of ``run`` word ids."""
    n = len(ids) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = out * _BASE + ids[k : k + n]
    return out


def word_ids(tokens: list[str]) -> np.ndarray:
    """A 64-bit id for each word, equal in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), np.uint64, len(tokens))

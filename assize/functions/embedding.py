"""A hashing embedder: stable, untrained vectors of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of the word hash (fixed values).
START, FACTOR = 0xCBF29CE484222325, 0x1000001B3
MASK = (1 << 64) - 1


def word_hash(word: bytes) -> int:
    h = START
    for b in word:
        h = ((h ^ b) * FACTOR) & MASK
    return h


def embed(text: str | None, dim: int) -> list[float]:
    """Unit vector of a text's lower-cased words; all zero without words."""
    out = np.zeros(dim, np.float32)
    for w in (text or "").split():
        h = word_hash(w.lower().encode())
        out[h % dim] += 1.0
        out[(h // 7 + 13) % dim] += 0.5
    norm = float(np.sqrt((out * out).sum()))
    return (out / norm if norm > 0 else out).tolist()


def embedding(text: Column, dim: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed(t, dim))

    return run(text)


def model_name(dim: int) -> str:
    return f"hashembedder-{dim}-v1"

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assize.operators import retrieval


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_terms_of_a_batch_against_counting(monkeypatch, dense):
    monkeypatch.setattr(retrieval, "DENSE", dense)
    rng = random.Random(1)
    some = lambda most: [rng.choice("abcdefghijkl") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, most))]
    block = [(n, some(9)) for n in range(6)] + [(6, None), (7, [])]
    held = [None, [], [None, "a"], *[some(20) for _ in range(40)]]
    weigh = lambda w: 1.0 + len(w) + ord(w[0]) / 1000
    terms = retrieval._Terms(block, weigh)
    words = pa.array([["zz"], *held], pa.list_(pa.string())).slice(1)
    row, term, n = terms.of(words)
    found = terms.sums(len(held), row, term, n.astype(float))
    expected = [[sum(k * weigh(w) for w, k in Counter(d or []).items() if w in set(q[1] or ())) for q in block] for d in held]
    assert np.allclose(found, np.array(expected, float), atol=1e-12)

"""A very long text gives what it gives in one piece, in memory that doesn't grow with it."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import vocabulary
from trafficlens.llm import quality, simhash, toxicity, words


def some_texts():
    rng, vocab = random.Random(5), [*vocabulary(200), "A.B", "--", "ß!", "X1"]
    long = "  ".join(rng.choice(vocab) + rng.choice(["", ",", "\n", "...", "é"]) for _ in range(900))
    return [None, "", "short text here", long, "w" * 900, long[:700], " " * 900, "a b", "x " * 500 + "y" * 700 + " z", long + " end", "two " + "v" * 900]


def grams_of(column):
    out = [np.stack([t, g], 1) for t, g in quality.gram_parts(column)]
    every = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return sorted(map(tuple, every.tolist()))


@pytest.mark.parametrize("most", [16, 60, 150])
def test_stretches_change_nothing(monkeypatch, most):
    column = pa.array(some_texts(), pa.string())
    whole = simhash.fingerprints(column), [x.tolist() for x in toxicity.hashed_features(column)], grams_of(column)
    assert whole[0].tolist() == [brute.fingerprint(t) for t in some_texts()]
    plain = words.overlapping
    for module in (simhash, toxicity, quality):
        monkeypatch.setattr(module, "overlapping", lambda c, a, t, lower=False: plain(c, a, t, lower, most))
    assert any(not p.whole for p in plain(column, words.NOT_SPACE, lambda t: b"", False, most))
    assert simhash.fingerprints(column).tolist() == whole[0].tolist()
    assert [x.tolist() for x in toxicity.hashed_features(column)] == whole[1]
    assert grams_of(column) == whole[2]


@pytest.mark.parametrize("operator", [simhash.fingerprints, toxicity.hashed_features, lambda c: [(len(t), g.sum()) for t, g in quality.gram_parts(c)]])
def test_memory_is_that_of_a_stretch(operator):
    """A text of 24 MB costs at most some copies of itself, and one of twice the size no more than twice that."""
    piece = " ".join(f"word{i % 5000:x}{i % 7}" for i in range(60_000))
    for copies, most in ((40, 300e6), (80, 500e6)):
        column = pa.array([piece * copies], pa.large_string())
        tracemalloc.start()
        operator(column.cast(pa.string()))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, (len(piece) * copies, peak)

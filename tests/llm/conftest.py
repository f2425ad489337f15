from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["ta", "ri", "mo", "lé", "ku", "n", "ß", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def tricky_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    rng, vocab = random.Random(7), vocabulary()
    make = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ".", ",", ""]) for _ in range(n))
    passage, base = make(60), make(120)
    near = base.split(" ")
    near[50] = "CHANGED"
    texts = [
        None, "", "   \n\t ", "one", "One two", "a b c", make(34), make(35), base, base, " ".join(near), make(40) + " " + passage + "\n\n" + make(30), passage + make(20),
        make(10) + "  " + passage, "ab " * 200, "ab " * 90, make(9000), "THE END!! ***", "tie here   x", "\x00 odd \x7f", make(300), make(300),
    ]
    sources = ["b", None, "a", "b", "c"]
    rows = [(i * 3, t, "xx" if i % 2 else None, sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, make(50), "xx", "a", 1), (None, passage, None, None, None), (1000, None, "xx", "b", None)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(tricky_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

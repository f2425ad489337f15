"""Benchmarks whose items share their words: what a text costs must not be a product."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import SCHEMA, vocabulary
from trafficlens.llm import decontaminate


def templated(n, seed=3):
    rng, vocab = random.Random(seed), vocabulary(3000)
    template = " ".join(vocab[:25])
    return template, [(i, template + " " + " ".join(rng.choice(vocab) for _ in range(8))) for i in range(n)]


def block_of(items, texts):
    w, h, ids = decontaminate.read_block([{"item_id": i, "text": t} for i, t in items])
    vocabulary = np.unique(h)
    seen = decontaminate.split_words(pa.array(texts, pa.string()), decontaminate.ALNUM, lower=True).hashes()
    at = np.minimum(np.searchsorted(vocabulary, seen), len(vocabulary) - 1)
    return decontaminate.build_block(w, h, ids, vocabulary, np.bincount(at[vocabulary[at] == seen], minlength=len(vocabulary)), decontaminate.WIDTH)


def judged(texts, block):
    out = []
    for _, made in decontaminate.judged(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), block):
        out += zip(made["n_words"].tolist(), made["n_hit"].tolist(), made["items"].to_pylist(), made["hits"].to_pylist(), strict=True)
    return out


def test_templated_items_equal_plain(monkeypatch):
    template, items = templated(60)
    items += [(7, template), (None, template), (100, items[3][1]), (101, "two words"), (102, "word"), (103, ""), (104, None)]
    rng = random.Random(1)
    texts = [" ".join(rng.choice([template, items[i % 60][1], "filler words here", "two words", "Word", items[(i + 1) % 60][1][40:]]) for _ in range(9)) for i in range(30)] + ["", None, template]
    named = [("null" if i is None else i, t) for i, t in items]
    want = [brute.contamination(t, named) for t in texts]
    for pairs in (1 << 18, 50, 1):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        got = judged(texts, block_of(items, texts))
        assert [(n, hit, found) for n, hit, found, _ in got] == want
        for n, hit, _, ranges in got:
            assert sum(r["last"] - r["first"] for r in ranges) == hit and all(a["last"] < b["first"] for a, b in zip(ranges, ranges[1:], strict=False)) and all(0 <= r["first"] < r["last"] <= n for r in ranges)


def test_5000_templated_items_and_2000_occurrences():
    template, items = templated(5000)
    text = " ".join(f"{template} x{i}" for i in range(2000))
    block = block_of(items, [text])
    tracemalloc.start()
    began = time.perf_counter()
    ((n_words, n_hit, found, ranges),) = judged([text], block)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n_words, n_hit, len(found), len(ranges)) == (52_000, 50_000, 5000, 2000)
    assert took < 5 and peak < 300e6


def test_many_texts_with_all_items_come_in_parts():
    template, items = templated(2000)
    block = block_of(items, [template])
    batch = pa.RecordBatch.from_arrays([pa.array([template] * 1000)], ["text"])
    parts = [(p.num_rows, len(m["items"].values)) for p, m in decontaminate.judged(batch, block)]
    assert sum(n for n, _ in parts) == 1000 and max(n for _, n in parts) <= max(decontaminate.PAIRS, 13 * 2000) and len(parts) > 50


@pytest.mark.parametrize("block_bytes", [1 << 24, 4000])
def test_templated_items_on_spark(spark, block_bytes):
    template, items = templated(40)
    texts = [template, items[5][1] + " more", "none of it", None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    out = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out.collect()} == {i: brute.contamination(t, items) for i, t in enumerate(texts)}

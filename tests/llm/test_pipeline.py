"""The corpus pipeline, stage by stage, against plain versions on each stage's own input."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SCHEMA, vocabulary
from trafficlens.llm import mixture, quality
from trafficlens.llm.scratch import keep

TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """(docs before, result) of each stage."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF_DIR).cache()
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def exact_grams(text):
    """Grams as tuples: tokens, pairs (a repeated token is one pair), shapes and pairs of shapes."""
    found = TOKEN.findall(text or "")

    def shape(t):
        n, caps = len(t.encode()), sum("A" <= c <= "Z" for c in t)
        case = 0 if caps == 0 else 3 if caps == n else 1 if caps == 1 and "A" <= t[0] <= "Z" else 2
        return (bool(re.match("[0-9A-Za-z\x80-\U0010ffff]", t)), min(n, 15), case)

    shapes = [shape(t) for t in found]
    pairs = ["again" if a == b else (a, b) for a, b in zip(found, found[1:])]
    return [("t", x) for x in found] + [("p", x) for x in pairs] + [("s", x) for x in shapes] + [("q", x) for x in zip(shapes, shapes[1:])]


def test_quality(spark, stages):
    docs, kept, columns = stages["quality"]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r["quality"] == 1}
    grams = {r["doc_id"]: exact_grams(r["text"]) for r in docs}
    raw = Counter(g for v in grams.values() for g in v)
    target = Counter(g for i, v in grams.items() if i in good for g in v)
    share = sum(target.values()) / sum(raw.values())
    weight = {i: sum(math.log((target[g] + quality.PRIOR) / (raw[g] * share + quality.PRIOR)) for g in v) for i, v in grams.items()}
    docs_df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    chance = {r["doc_id"]: r["noise"] for r in docs_df.select("doc_id", quality.noise().alias("noise")).collect()}
    order = sorted(weight, key=lambda i: -weight[i] - chance[i])
    k = sum(w >= -quality.MARGIN for w in weight.values())
    ids = {r["doc_id"] for r in kept}
    edge = weight[order[k - 1]] + chance[order[k - 1]]
    # hashed grams share slots, so weights near the k-th key may differ
    wrong = [i for i in weight if (i in order[:k]) != (i in ids) and abs(weight[i] + chance[i] - edge) > 0.03 * len(grams[i]) + 0.5]
    assert abs(len(ids) - k) <= 0.02 * len(docs) and not wrong and columns == list(corpus_pipeline.COLUMNS) and 0 < len(ids) < len(docs)


def test_near_duplicates(stages):
    docs, kept, columns = stages["near_duplicates"]
    root = brute.components([brute.fingerprint(r["text"]) for r in docs])
    least = defaultdict(list)
    for r, k in zip(docs, root, strict=True):
        least[k].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept) == sorted(map(min, least.values())) and columns == list(corpus_pipeline.COLUMNS)
    assert len(kept) < len(docs) and set(kept) <= set(docs)


def test_repeated_passages(stages):
    docs, cut, columns = stages["repeated_passages"]
    want = {r["doc_id"]: k for r, k in zip(docs, brute.kept_words([r["text"] for r in docs]), strict=True)}
    before = {r["doc_id"]: r for r in docs}
    assert len(cut) == len(docs) and columns == list(corpus_pipeline.COLUMNS)
    for r in cut:
        assert brute.words(r["text"]) == want[r["doc_id"]]
        if len(want[r["doc_id"]]) == len(brute.words(before[r["doc_id"]]["text"])):
            assert r == before[r["doc_id"]]
        else:
            assert r["n_chars"] == len(r["text"])


def test_benchmark_passages(spark, stages):
    docs, kept, columns = stages["benchmark_passages"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = []
    for r in docs:
        n, hit, _ = brute.contamination(r["text"], items)
        if not (hit > 0 and 20 * hit >= n):
            clean.append(r)
    assert sorted(kept, key=str) == sorted(clean, key=str) and columns == list(corpus_pipeline.COLUMNS)


def test_mixture(stages):
    docs, mixed, _ = stages["mixture"]
    assert len(mixed) == len(docs)
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in docs}
    by = defaultdict(list)
    for r in mixed:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    names = sorted(by)
    goal = mixture.targets([sum(r["size"] for r in by[s]) for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])
    for s, g in zip(names, goal, strict=True):
        assert by[s][0]["target"] == pytest.approx(g) and abs(sum(r["taken"] for r in by[s]) - g) <= mixture.BLOCK


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(got, key=str) == sorted(stages["mixture"][1], key=str)


def test_tricky_rows_through_all_stages(spark, tricky, nothing, tmp_path):
    """Null and repeated ids, unlike texts under one id, repeated rows, and clashing columns: each stage keeps what it must."""
    rng, vocab = random.Random(12), vocabulary()
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    a, b = make(60), make(70)
    extra = [(1, a, "xx", "s", 1), (1, b, "xx", "s", 1), (0, b, "xx", "s", 1), (2, a, "xx", None, 1), (None, make(80), None, None, None), (None, make(90), "xx", "s", 2)]
    docs = tricky.unionByName(spark.createDataFrame(extra, SCHEMA))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 66, 3)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(brute.words(extra[4][1])[5:40]))], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for c in ("fp", "root", "h1", "h2", "k1", "k2", "tk", "size", "n_words", "hits", "items", "_k1", "_row", "noise", "kept", "copies"):
        now = now.withColumn(c, F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = keep(stage(spark, now, str(tmp_path)), name)
        kept[name] = now.collect()
    assert len(kept["quality"]) == docs.count()  # all weights are within the margin
    groups = brute.components([brute.fingerprint(r["text"]) for r in kept["quality"]])
    of = dict(zip(map(tuple, kept["quality"]), groups, strict=True))
    assert sorted(of[tuple(r)] for r in kept["near_duplicates"]) == sorted(set(groups))
    assert {(r["doc_id"], r["text"]) for r in kept["near_duplicates"]} >= {(1, a), (0, b)}
    assert sorted(str(r["doc_id"]) for r in kept["repeated_passages"]) == sorted(str(r["doc_id"]) for r in kept["near_duplicates"])
    assert len(kept["benchmark_passages"]) == len(kept["repeated_passages"]) - 1 and (None, 80) not in {(r["doc_id"], len(brute.words(r["text"]))) for r in kept["benchmark_passages"]}
    assert sorted((str(r["doc_id"]), r["size"]) for r in kept["mixture"]) == sorted((str(r["doc_id"]), len(brute.words(r["text"]))) for r in kept["benchmark_passages"])


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0

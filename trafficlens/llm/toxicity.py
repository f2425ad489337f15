"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the distinct hashed words, stems of words (their first bytes),
pairs of adjacent words, and pairs with one or two words between. Training follows each coordinate's own rate and its L1
penalty leaves few weights that are not zero, so the model is a small broadcast.

Labelled rows: at most ``max_labelled`` (by hash order of doc_id) are used, so the
labels' broadcast, the training texts and the model are all bounded. They are dealt to
shards of about ``SHARD_ROWS`` rows and ``SHARD_BYTES`` of text, whichever gives more shards; each
shard trains on its own, in hash order, and the weights are averaged by rows.
Scoring is a map over all texts: no shuffle.

Cases: null and wordless texts get the bias alone; null labels are not learned from;
repeated labels are averaged to 0/1 by a vote (ties: toxic); repeated documents are repeated
examples; with no labelled rows every score is 0.5; very long texts are read whole, in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append
from trafficlens.llm.scratch import keep
from trafficlens.llm.words import ALNUM, Words, last_words, mixed, overlapping, slices, split_words

BITS = 20
#: Bytes of the stems, and how far apart the words of a pair are
STEMS, GAPS = (4, 6, 8), (1, 2, 3)
MAX_LABELLED, SHARD_ROWS, SHARD_BYTES = 40_000, 10_000, 64 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 6.0, 0.1, 3
THRESHOLD = 0.3


def hashed_features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order of text; features are 1 .. 2**bits - 1. A long text's come together in a bitmap."""
    made: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
    seen, of = np.zeros(0, bool), -1
    for part in overlapping(column, ALNUM, last_words(max(GAPS), ALNUM, lower=True), lower=True):
        text, feature = _features(part.texts, bits)
        if part.whole:
            made.append((text + part.first, feature))
            continue
        if of != part.first:
            seen, of = np.zeros(1 << bits, bool), part.first
            made.append((np.empty(0, np.int64),) * 2)
        seen[feature] = True
        once = np.flatnonzero(seen)
        made[-1] = (np.full(len(once), of), once)
    text, feature = (np.concatenate(x) for x in zip(*made, strict=True))
    return text, feature


def _features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    w = split_words(column, ALNUM, lower=True)
    h, text = w.hashes(), w.text_of()
    shift = np.uint64(64 - bits)
    made = [(text, h >> shift)]
    for size in STEMS:
        long = np.flatnonzero(w.end - w.start > size)
        stem = Words(w.data, w.start[long], w.start[long] + size, w.doc).hashes()
        made.append((text[long], mixed(stem + np.uint64(size)) >> shift))
    for gap in GAPS:
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            pair = mixed(h[:-gap][same] * np.uint64(2 * gap + 1) + (h[gap:][same] >> np.uint64(1)))
            made.append((text[:-gap][same], pair >> shift))
    key = np.concatenate([t.astype(np.int64) << bits | np.maximum(f, 1).astype(np.int64) for t, f in made])
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> bits, key & ((1 << bits) - 1)


class Ftrl:
    """Per-coordinate FTRL-proximal; coordinate 0 is the bias, which has no L1 penalty."""

    def __init__(self, bits: int = BITS) -> None:
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at > 0, L1, 0.0), 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, text, label, ord) of one or more shards to (shard, rows, feature, weight)."""
    examples: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for b in slices(batches):
        text, feature = hashed_features(b.column("text"))
        cut = np.searchsorted(text, np.arange(b.num_rows + 1))
        for i, (shard, label, order) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "label", "ord")), strict=True)):
            examples.setdefault(shard, []).append((order, label, np.concatenate([[0], feature[cut[i] : cut[i + 1]]]).astype(np.int32)))
    for shard, rows in sorted(examples.items()):
        rows.sort(key=lambda x: (x[0], x[1], len(x[2])))
        model = Ftrl()
        for _ in range(EPOCHS):
            for _, label, at in rows:
                model.learn(at, label)
        every = np.arange(len(model.z))
        w = model.weights(every)
        used = np.flatnonzero((w != 0) | (every == 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), shard, np.int64)), pa.array(np.full(len(used), len(rows), np.int64)), pa.array(used.astype(np.int64)), pa.array(w[used])],
            ["shard", "n_rows", "feature", "weight"],
        )


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Dense weights (index 0: bias) from the labelled documents for which ``usable`` holds."""
    votes = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable))
    votes = votes.groupBy("doc_id").agg(F.when(F.avg(label) >= 0.5, 1).otherwise(0).alias("label"))
    picked = votes.select("doc_id", "label", F.xxhash64("doc_id").alias("ord")).orderBy("ord", "doc_id").limit(max_labelled)
    # kept, as documents are matched with it twice; two numbers a row, and rows are bounded
    picked = keep(picked, "labelled")
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not count:
        return np.zeros(1 << BITS)
    shards = max(-(-count // SHARD_ROWS), -(-size // SHARD_BYTES))
    dealt = rows.select(F.pmod(F.col("ord"), F.lit(shards)).alias("shard"), "text", "label", "ord").repartitionByRange(shards, "shard")
    trained = dealt.mapInArrow(_train, "shard long, n_rows long, feature long, weight double")
    sums = trained.groupBy("feature").agg(F.sum(F.col("weight") * F.col("n_rows")).alias("total"), F.sum("n_rows").alias("n_rows")).collect()
    out = np.zeros(1 << BITS)
    for r in sums:
        out[r["feature"]] = r["total"]
    return out / max([1, *(r["n_rows"] for r in sums if r["feature"] == 0)])  # every shard has a bias


def score(documents: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents' rows and columns with score and predicted."""
    used = np.flatnonzero(weights[1:]) + 1
    shared = documents.sparkSession.sparkContext.broadcast((used, weights[used], float(weights[0])))

    def start():
        used, value, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[used] = value

        def make(b: pa.RecordBatch) -> dict[str, object]:
            text, feature = hashed_features(b.column("text"))
            total = bias + np.bincount(text, dense[feature], minlength=b.num_rows)
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return make

    return append(documents, "score double, predicted int", start)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2

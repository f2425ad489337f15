"""Quality by importance resampling.

Two generative models over hashed n-grams are counted: one of target text (labelled
good), one of all raw text, which is also the target model's prior. A text's log weight is the
log ratio of the two over all its grams, that is, how much likelier the target model makes it.
Resampling draws texts without replacement by Gumbel top-k: the k greatest of log weight / temperature +
Gumbel noise, the noise being a hash of the row. At temperature 1 a text of which the models
are sure is in or out, and chance decides among those on the border. k is a parameter; by default
it is the number of texts of at least ``-MARGIN``, that is, which the target model doesn't
find over exp(``MARGIN``) times less likely than the raw one.

Grams are single tokens, pairs of tokens (a repeated token is one special pair), token
shapes and pairs of shapes; tokens are stretches of letters and digits or of marks.
Models are arrays of 2**BITS counts, so their broadcast is fixed. Counting and
scoring are maps over all texts; only counts are shuffled. The k-th key is found by
histograms, not by a sort.

Cases: a text without tokens (null, empty, blank) has weight 0, as if the models agreed; null labels
are not used, repeated labels vote (ties: good); without target rows all weights are 0
and all texts are drawn; rows that tie with the k-th key all stay; repeated rows have equal keys; very long texts
are read whole; columns of the documents called like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append
from trafficlens.llm.scratch import keep
from trafficlens.llm.words import Words, mixed, overlapping, slices, utf8

BITS = 16
#: Labelled rows that are read for the target model, by hash order of doc_id
MAX_LABELLED = 40_000
TEMPERATURE, MARGIN = 1.0, 5.0
#: Pseudo-counts by which a gram's target probability is drawn to its raw one, so that rare grams say little
PRIOR = 100.0
_BINS, _FEW = 1024, 4096

_CLASS = np.array([0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 2 for b in range(256)], np.uint8)
_CAPITAL = np.array([0x41 <= b <= 0x5A for b in range(256)])
_REPEATED = np.uint64(0x51ED270B)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed gram) pairs of all texts at once."""
    return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *gram_parts(column), strict=True))


def gram_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same; those of a long text come stretch by stretch."""
    for part in overlapping(column, _CLASS > 0, _last_token):
        text, gram = _grams(part.texts, part.led)
        yield text + part.first, gram


def _tokens(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Runs of bytes of one class that isn't space, and each byte's class."""
    data, at = utf8(column)
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[at[(at > 0) & (at < len(data))]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(data))[: len(start)]
    some = kind[start] > 0
    return Words(data, start[some], end[some], np.searchsorted(start[some], at)), kind


def _last_token(texts: pa.Array) -> bytes:
    w, _ = _tokens(texts)
    return w.data[w.start[-1] : w.end[-1]].tobytes() if len(w.start) else b""


def _grams(column: pa.Array, led: bool) -> tuple[np.ndarray, np.ndarray]:
    """``led``: the first token is the last one of the stretch before, so it makes pairs only."""
    w, kind = _tokens(column)
    data = w.data
    h, text, size = w.hashes(), w.text_of(), w.end - w.start
    sums = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    capitals = sums[w.end] - sums[w.start]
    case = np.select([capitals == 0, capitals == size, (capitals == 1) & _CAPITAL[data[w.start]]], [0, 3, 1], 2) if len(size) else size
    shape = (kind[w.start].astype(np.int64) * 64 + np.minimum(size, 15) * 4 + case).astype(np.uint64)
    same = text[1:] == text[:-1]
    pair = np.where(h[1:] == h[:-1], _REPEATED, h[:-1] * np.uint64(3) + h[1:])[same]
    shapes = (shape[:-1] * np.uint64(4096) + shape[1:])[same]
    later = text[1:][same]
    alone = slice(1 if led else 0, None)
    made = [(text[alone], h[alone]), (later, pair + np.uint64(7)), (text[alone], shape[alone] + np.uint64(99)), (later, shapes + np.uint64(999))]
    return np.concatenate([t for t, _ in made]), np.concatenate([mixed(g) >> np.uint64(64 - BITS) for _, g in made]).astype(np.int64)


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Log ratio of the target model to the raw model for each gram; at most ``max_labelled`` labelled rows are used."""
    votes = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable))
    votes = votes.groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("good"))
    picked = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).where("good").select("doc_id", F.lit(True).alias("target"))
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in slices(batches):
            good = b.column("target").to_numpy(zero_copy_only=False)
            for text, gram in gram_parts(b.column("text")):
                raw += np.bincount(gram, minlength=len(raw))
                target += np.bincount(gram[good[text]], minlength=len(raw))
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["gram", "raw", "target"])

    counts = rows.mapInArrow(run, "gram long, raw long, target long").groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts:
        raw[r["gram"]], target[r["gram"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(1 << BITS)
    return np.log(target + PRIOR) - np.log(raw * (target.sum() / raw.sum()) + PRIOR)


def weigh(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The documents' rows and columns with n_grams and log_weight, the log ratio."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def start():
        def make(b: pa.RecordBatch) -> dict[str, object]:
            n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for text, gram in gram_parts(b.column("text")):
                n += np.bincount(text, minlength=b.num_rows)
                weight += np.bincount(text, shared.value[gram], minlength=b.num_rows)
            return {"n_grams": n, "log_weight": weight}

        return make

    return append(documents, "n_grams long, log_weight double", start)


def kth_greatest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th greatest value of a column, from histograms of ever narrower ranges."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return low
    above = 0
    while True:
        inside = keys.where(F.col(column).between(low, high))
        step = (high - low) / _BINS
        if step == 0 or low + step == low:
            return high
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / step), F.lit(_BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if low == high:
            return low
        if r["n"] <= _FEW:
            values = sorted((x[0] for x in keys.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]


def noise(seed: int = 11) -> Column:
    """Gumbel noise of a row, from its id and text."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "text")
    return -F.log(-F.log((F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)))


def resample(keyed: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, margin: float = MARGIN) -> DataFrame:
    """Rows (with log_weight and noise) with sample_key and kept: the k greatest keys, k being the rows within the margin unless given."""
    keyed = keyed.withColumn("sample_key", F.col("log_weight") / temperature + F.col("noise"))
    if k is None:
        k = keyed.where(F.col("log_weight") >= -margin).count()
    return keyed.withColumn("kept", F.col("sample_key") >= kth_greatest(keyed, "sample_key", k))


def select(documents: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, kept for every document row."""
    scored = weigh(documents.select("doc_id", "text"), learn(documents, labels)).select("doc_id", "n_grams", "log_weight", noise().alias("noise"))
    return resample(keep(scored, "weights"), k).drop("noise")


def filtered(documents: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The documents that resampling draws, with their columns."""
    rows = documents.select(F.struct("*").alias("_row"), "doc_id", "text")
    scored = weigh(rows, learn(documents, labels)).select("_row", "log_weight", noise().alias("noise"))
    return resample(keep(scored, "weighed"), k).where("kept").select("_row.*")

"""Substring dedup: seed and extend.

A repeat is a window of ``LENGTH`` words whose sequence also starts somewhere else,
in another document or the same one. Seeds are winnowed anchors: of the ``SEED``-word
grams in a window, the least hash is its anchor, so equal windows have equal anchors at
equal places, and a run of neighbouring windows shares one.

Anchors that occur once have no repeat. A seed is a run together with its words, from the
first window's to the last one's. Seeds of one anchor that are equal as a whole are repeats as a whole. One
example of each of the others is joined with the anchor's representative, the least example, and
extended both ways from the anchor, word by word, to the first difference; what the two
share is a maximal repeat if it is a window or longer. What a seed doesn't share with the
representative can only be shared with others that don't either: where an anchor has three
kinds of seeds or more, those windows are counted by their hashes. So no pair but one for each
example is made, and no repeat is lost. Overlapping repeats of a document merge, and
every word in one is removed; windows are judged on the input.

Keys of a group are two independent 64-bit hashes. No group is gathered: groups are
counted (which combines before the shuffle), written, and joined back from one row for
each, so a common passage is split by adaptive skew handling.

Cases: null and short texts have no windows; repeated rows are repeats of each other;
a doc_id may be null or repeated, as rows are told apart by id and text; very long and
periodic texts are read whole; an empty table gives no rows; columns of the documents
called like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trafficlens.llm.arrowmap import append
from trafficlens.llm.scratch import keep
from trafficlens.llm.words import NOT_SPACE, joined_words, run_hashes, slices, split_words

LENGTH, SEED = 35, 8
#: Windows whose anchors are sought at a time
STRETCH = 1 << 14
#: A row's id and text as two hashes: never null, so joins and groups on them share one partitioning
_ID = ["k1", "k2"]
_KEYS = "k1 long, k2 long"


def _keys(*names: str) -> list[Column]:
    return [F.xxhash64(F.lit(n), F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))).alias(name) for n, name in enumerate(names or _ID)]


def winnowed(h: np.ndarray, doc: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: text, first word, number of windows, anchor hash, hash of all the run's words."""
    n = len(h)
    if n < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = run_hashes(h, np.arange(n - seed + 1), np.arange(seed, n + 1))
    at = np.arange(n - length + 1)
    seen = np.lib.stride_tricks.sliding_window_view(grams, length - seed + 1)
    for k in range(0, len(at), STRETCH):  # argmin copies the overlapping rows it is given
        at[k : k + STRETCH] += seen[k : k + STRETCH].argmin(axis=1)
    text = np.searchsorted(doc, np.arange(len(at)), "right") - 1
    inside = np.arange(len(at)) + length <= doc[text + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return winnowed(h[:0], doc, length, seed)
    at, text = at[start], text[start]
    opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(opens, len(at)))
    first = start[opens]
    return text[opens], first, size, grams[at[opens]], run_hashes(h, first, first + size - 1 + length)


def _runs(documents: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = split_words(b.column("text"), NOT_SPACE)
            text, first, size, anchor, whole = winnowed(w.hashes(), w.doc, length, seed)
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(of) for c in _ID), pa.array((first - w.doc[text]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                [*_ID, "first", "n", "anchor", "whole"],
            )

    return documents.select(*_keys(), "text").mapInArrow(run, f"{_KEYS}, first int, n int, anchor long, whole long")


def _contexts(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """One row for each run listed for a text: its place, and hashes of its words; ``at`` is the anchor's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = split_words(b.column("text"), NOT_SPACE)
            h = w.hashes()
            runs = b.column("runs")
            text = np.repeat(np.arange(b.num_rows), runs.value_lengths().to_numpy())
            first, size, anchor, once, kinds = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            at = w.doc[text] + first
            # the first window's least gram, the leftmost of equal ones
            grams = at[:, None] + np.arange(length - seed + 1)
            place = run_hashes(h, grams.ravel(), grams.ravel() + seed).reshape(grams.shape).argmin(axis=1) if len(at) else at
            words = size + length - 1
            offsets = np.concatenate([[0], np.cumsum(words)])
            of = np.repeat(at - offsets[:-1], words) + np.arange(offsets[-1])
            ids = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c).take(ids) for c in ("doc_id", *_ID)), pa.array(anchor), pa.array(first), pa.array(size), pa.array(once), pa.array(kinds), pa.array(place.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h[of].view(np.int64))),
                ],
                ["doc_id", *_ID, "anchor", "first", "n", "once", "kinds", "at", "words"],
            )

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_KEYS}, anchor long, first int, n int, once boolean, kinds long, at int, words array<long>")


def shared(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words each pair of contexts shares to the left of its anchors, and from them on to the right."""

    def equal(step: int, most: np.ndarray) -> np.ndarray:
        count, alive, k = np.zeros(len(a_at), np.int64), np.arange(len(a_at)), 0
        while len(alive := alive[most[alive] > k]):
            x, y = a_start[alive] + a_at[alive], b_start[alive] + b_at[alive]
            alive = alive[a[x + k] == b[y + k]] if step > 0 else alive[a[x - 1 - k] == b[y - 1 - k]]
            count[alive] += 1
            k += 1
        return count

    return equal(-1, np.minimum(a_at, b_at)), equal(1, np.minimum(a_end - a_start - a_at, b_end - b_start - b_at))


def _extended(pairs: DataFrame, length: int) -> DataFrame:
    """Pairs with low and high: the seed's windows that it shares with the representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = pa.Table.from_batches([batch]).combine_chunks().to_batches()[0] if batch.num_rows else batch
            at, r_at, n = (b.column(c).to_numpy().astype(np.int64) for c in ("at", "r_at", "n"))
            sides = []
            for c, place in (("words", at), ("r_words", r_at)):
                column = b.column(c)
                ends = np.cumsum(column.value_lengths().to_numpy().astype(np.int64))
                sides += [column.flatten().to_numpy(), np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends, place]
            left, right = shared(*sides)
            low = np.maximum(at - left, 0)
            high = np.maximum(np.minimum(n, at + right - length + 1), low)
            kept = [c for c in b.schema.names if c != "r_words"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], [*kept, "low", "high"])

    fields = [f for f in pairs.schema.fields if f.name != "r_words"]
    return pairs.mapInArrow(run, StructType(fields).add("low", "integer").add("high", "integer"))


def _rest(extended: DataFrame, length: int) -> DataFrame:
    """Hashes of the windows that a seed doesn't share with the representative: anchor, window, place, and whether its run occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, low, high, first = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "low", "high", "first"))
            column = b.column("words")
            words, sizes = column.flatten().to_numpy().view(np.uint64), column.value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            out = (k < low[row]) | (k >= high[row])
            row, k = row[out], k[out]
            at = start[row] + k
            ids = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(ids) for c in (*_ID, "anchor", "once")), pa.array(run_hashes(words, at, at + length).view(np.int64)), pa.array((first[row] + k).astype(np.int32))], [*_ID, "anchor", "once", "window", "first"]
            )

    return extended.mapInArrow(run, f"{_KEYS}, anchor long, once boolean, window long, first int")


def repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """k1, k2 (of id and text), runs: ranges (first window, number of windows) that are repeated."""
    runs = _runs(documents, length, seed)
    # written first, so that the join deals both sides anew and a hot anchor's rows can be split
    often = keep(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    seeds = keep(runs.join(often, "anchor"), "seeds")
    example = F.min(F.struct(*_ID, "first")).alias("example")
    kinds = keep(seeds.groupBy("anchor", "whole", "n").agg(F.count("*").alias("places"), example).select("anchor", "whole", "n", "places", "example.*"), "runs")
    whole = seeds.join(kinds.where("places > 1").select("anchor", "whole", "n"), ["anchor", "whole", "n"]).select(*_ID, "first", "n")
    mixed = keep(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    listed = (
        kinds.join(mixed, "anchor")
        .groupBy(*_ID)
        .agg(F.collect_list(F.struct("first", "n", "anchor", (F.col("places") == 1).alias("once"), "kinds")).alias("runs"))
    )
    # the join and the removal of repeated rows need the same partitioning, so texts are shuffled once
    examples = documents.select("doc_id", *_keys(), "text").join(listed, _ID).dropDuplicates(_ID)
    contexts = keep(_contexts(examples, length, seed), "contexts")
    chosen = F.min(F.struct("doc_id", *_ID, "first", "n", "once", "at", "words")).alias("r")
    least = keep(contexts.groupBy("anchor").agg(chosen).select("anchor", *(F.col(f"r.{c}").alias(f"r_{c}") for c in (*_ID, "first", "once", "at", "words"))), "representatives")
    itself = (F.col("k1") == F.col("r_k1")) & (F.col("k2") == F.col("r_k2")) & (F.col("first") == F.col("r_first"))
    extended = keep(_extended(contexts.drop("doc_id").join(least, "anchor").where(~itself), length), "extended")
    found = extended.where("high > low")
    n = (F.col("high") - F.col("low")).alias("n")
    mine = found.where("once").select(*_ID, (F.col("first") + F.col("low")).alias("first"), n)
    theirs = found.where("r_once").select(F.col("r_k1").alias("k1"), F.col("r_k2").alias("k2"), (F.col("r_first") + F.col("r_at") + F.col("low") - F.col("at")).alias("first"), n).distinct()
    windows = keep(_rest(extended.where("kinds > 2"), length), "windows")
    again = keep(windows.groupBy("anchor", "window").count().where("count > 1").select("anchor", "window"), "again")
    single = windows.where("once").join(again, ["anchor", "window"]).select(*_ID, "first", F.lit(1).alias("n"))
    return whole.unionByName(mine).unionByName(theirs).unionByName(single).groupBy(*_ID).agg(F.collect_set(F.struct("first", "n")).alias("runs"))


def remove_repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents' rows and columns; text without the removed words, n_words, n_removed, kept_sha256.

    A text that loses nothing stays as it is. Otherwise its kept stretches are joined by
    one space. ``kept_sha256`` is the digest of the kept words joined by one space.
    """
    documents = documents.drop("n_words", "n_removed", "kept_sha256", "_runs", "_k1", "_k2")
    found = repeats(documents, length, seed).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("runs").alias("_runs"))
    joined = documents.select("*", *_keys("_k1", "_k2")).join(found, ["_k1", "_k2"], "left").drop("_k1", "_k2")

    def start():
        def make(b: pa.RecordBatch) -> dict[str, object]:
            w = split_words(b.column("text"), NOT_SPACE)
            line, begin, end = joined_words(w)
            runs, texts = b.column("_runs"), b.column("text").to_pylist()
            total, removed, digest, out = np.diff(w.doc), [], [], []
            for i in range(b.num_rows):
                a, n = int(w.doc[i]), int(total[i])
                if not runs[i].is_valid:  # all words joined by one space lie in one stretch
                    removed.append(0)
                    digest.append(hashlib.sha256(line[begin[a] : end[a + n - 1]] if n else b"").hexdigest())
                    out.append(texts[i])
                    continue
                first, size = (x.to_numpy() for x in runs[i].values.flatten())
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + size - 1 + length, -1)
                kept = a + np.flatnonzero(np.cumsum(edge)[:n] == 0)
                removed.append(n - len(kept))
                opens = np.flatnonzero(np.diff(kept, prepend=-2) > 1)
                closes = kept[np.append(opens[1:], len(kept)) - 1] if len(kept) else kept
                opens = kept[opens]
                digest.append(hashlib.sha256(b" ".join([line[x:y].tobytes() for x, y in zip(begin[opens].tolist(), end[closes].tolist(), strict=True)])).hexdigest())
                if len(kept) == n:
                    out.append(texts[i])
                else:
                    out.append(b" ".join([w.data[x:y].tobytes() for x, y in zip(w.start[opens].tolist(), w.end[closes].tolist(), strict=True)]).decode("utf-8", "replace"))
            return {"text": pa.array(out, pa.string()), "n_words": total, "n_removed": np.array(removed, np.int64), "kept_sha256": pa.array(digest, pa.string())}

        return make

    return append(joined, "text string, n_words long, n_removed long, kept_sha256 string", start).drop("_runs")

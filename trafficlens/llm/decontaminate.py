"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is 13 consecutive words of an item (a shorter item is one window). Its words
are ordered by how rare they are in all documents, and as containment must be whole, the
rarest word alone is the necessary prefix. Documents are probed at words that are some
window's prefix, once for each place and length that a window with that prefix has; bounds of length and position
drop candidates that would cross the document's ends; the rest are verified, by run hash and then byte by byte. Equal
windows are one, with a list of their items, and a text meets that list once however often the window occurs in it. So what a text
costs grows with its words and with what is found in it, not with their product, and pairs are held in portions of ``PAIRS``.

The benchmark is a stated query set. It is taken in blocks of ``BLOCK_BYTES`` of text, each
broadcast in turn: a block is its texts' bytes and numbers for each window, some five times its text (26 bytes a word).
Documents are never shuffled for one block. Of several, each is a job of its own that
writes its hits only, by a hash of the text; these are merged and joined with the documents.

Cases: null or wordless texts and items have no windows; a null ``item_id`` counts as the
id "null"; repeated items give one id; every document row is judged on its own, repeated
rows and ties alike; texts of any length are judged whole; empty tables give no rows
or no hits; columns of the documents called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append, append_parts
from trafficlens.llm.scratch import keep
from trafficlens.llm.words import ALNUM, Words, joined_words, mixed, portions, run_hashes, slices, split_words

WIDTH = 13
#: Text bytes of a benchmark block
BLOCK_BYTES = 8 << 20
#: Pairs that are held at once: of words and shapes, of runs and windows, of texts and items
PAIRS = 1 << 18

FOUND = "n_words long, n_hit long, items array<string>, hits array<struct<first:long,last:long>>"


class Block(NamedTuple):
    """Distinct windows of some items, in order of their run hash: window k is text[begin[k]:end[k]], of items item[at[k]:at[k + 1]].

    ``prefix``, ``place`` and ``size`` are the distinct shapes, by prefix: a word at which windows of that size are probed, and its place in them.
    Items are numbers into ``ids``, which are sorted.
    """

    prefix: np.ndarray
    place: np.ndarray
    size: np.ndarray
    run: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    item: np.ndarray
    text: np.ndarray
    ids: list[str]


def read_block(rows: list) -> tuple[Words, np.ndarray, list[str]]:
    w = split_words(pa.array([r["text"] or "" for r in rows], pa.string()), ALNUM, lower=True)
    return w, w.hashes(), [str(r["item_id"]) if r["item_id"] is not None else "null" for r in rows]


def build_block(w: Words, h: np.ndarray, ids: list[str], vocabulary: np.ndarray, count: np.ndarray, width: int) -> Block:
    """Order each window's words by rarity and keep the rarest as its prefix; ``count`` goes with the sorted vocabulary."""
    words = np.diff(w.doc)
    many = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    item = np.repeat(np.arange(len(words)), many)
    first = w.doc[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(width, words[item])
    # rank of each word: rarer first, ties by hash; the place in a window breaks ties of equal words
    order = np.lexsort((vocabulary, count))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    of_word = np.append(rank[np.searchsorted(vocabulary, h)], np.iinfo(np.int64).max)
    place, least = np.zeros(len(first), np.int64), np.full(len(first), np.iinfo(np.int64).max)
    for k in range(width):
        now = of_word[np.where(k < size, first + k, len(h))]
        place, least = np.where(now < least, k, place), np.minimum(now, least)
    run, again = run_hashes(h, first, first + size), run_hashes(mixed(h), first, first + size)
    names, number = np.unique(np.array(ids, object), return_inverse=True)
    order = np.lexsort((number[item], again, run))
    run, again, owner = run[order], again[order], number[item][order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (again[1:] != again[:-1])]) if len(run) else np.empty(0, bool)
    once = new | np.concatenate([[True], owner[1:] != owner[:-1]]) if len(run) else new
    of_window = (np.cumsum(new) - 1)[once]
    one = order[new]
    prefix, shape = h[first[one] + place[one]], place[one] * (width + 1) + size[one]
    order = np.lexsort((shape, prefix))
    prefix, shape = prefix[order], shape[order]
    kept = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (shape[1:] != shape[:-1])])[: len(prefix)]
    text, begin, end = joined_words(w)
    return Block(
        prefix[kept], shape[kept] // (width + 1), shape[kept] % (width + 1), run[new], begin[first[one]].astype(np.int32), end[first[one] + size[one] - 1].astype(np.int32),
        np.searchsorted(of_window, np.arange(len(one) + 1)), owner[once].astype(np.int32), text, names.tolist(),
    )


def _expanded(low: np.ndarray, high: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and all numbers in low:high of each row, in portions of about ``most`` pairs."""
    many = high - low
    total, begin = np.cumsum(many), 0
    while begin < len(many):
        done = total[begin - 1] if begin else 0
        until = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        mine = many[begin:until]
        row = np.repeat(np.arange(begin, until), mine)
        yield row, np.repeat(low[begin:until] - np.cumsum(mine) + mine, mine) + np.arange(len(row))
        begin = until


def _same_bytes(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` equals that of ``b``."""
    same = a_to - a_from == b_to - b_from
    kept = np.flatnonzero(same)
    for row, at in _expanded(a_from[kept], a_to[kept], 16 * PAIRS):
        odd = a[at] != b[at - a_from[kept][row] + b_from[kept][row]]
        same[kept[row[odd]]] = False
    return same


def find(column: pa.Array, block: Block) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, and first word, size and distinct window of each occurrence.

    A word that is some window's prefix is tried once for each shape it has there, of which there are a few, however many
    windows share it.
    """
    w = split_words(column, ALNUM, lower=True)
    h = w.hashes()
    text, begin, end = joined_words(w)
    found = [(np.empty(0, np.int64),) * 3]
    if len(block.prefix):
        low = np.searchsorted(block.prefix, h)
        at = np.flatnonzero(block.prefix[np.minimum(low, len(block.prefix) - 1)] == h)
        for row, shape in _expanded(low[at], np.searchsorted(block.prefix, h[at], "right")):
            word = at[row]
            first, size = word - block.place[shape], block.size[shape]
            of_text = np.searchsorted(w.doc, word, "right") - 1
            inside = (first >= w.doc[of_text]) & (first + size <= w.doc[of_text + 1])
            first, size = first[inside], size[inside]
            run = run_hashes(h, first, first + size)
            here = np.searchsorted(block.run, run)
            hit = np.flatnonzero(block.run[np.minimum(here, len(block.run) - 1)] == run)
            for one, window in _expanded(here[hit], np.searchsorted(block.run, run[hit], "right")):
                f, n = first[hit[one]], size[hit[one]]
                same = _same_bytes(text, begin[f], end[f + n - 1], block.text, block.begin[window].astype(np.int64), block.end[window].astype(np.int64))
                found.append((f[same], n[same], window[same]))
    first, size, window = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(first, kind="stable")
    return w, first[order], size[order], window[order]


def _word_counts(documents: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a block's sorted vocabulary occurs in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for b in slices(batches):
            h = split_words(b.column("text"), ALNUM, lower=True).hashes()
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            total += np.bincount(at[known[at] == h], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        rows = documents.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        at, n = (c.to_numpy() for c in rows.columns)
        out[at] = n
    return out


_RANGE = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _ranges(first: np.ndarray, last: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges (in order of ``first``) as ranges that don't touch within a text, and their texts."""
    if not len(first):
        return first, last, text
    far = np.maximum.accumulate(last + text)  # a text's number keeps its ranges off those of the text before
    new = np.concatenate([[True], first[1:] + text[1:] > far[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(first)]]) - 1
    return first[new], (far - text)[ends], text[new]


def judged(batch: pa.RecordBatch, block: Block) -> Iterator[tuple[pa.RecordBatch, dict[str, object]]]:
    """Parts of a slice of rows, each with n_words, n_hit, items and hits of its texts against one block.

    A part's texts and the items found in them make about PAIRS pairs at most, or it is one text.
    """
    w, first, size, window = find(batch.column("text"), block)
    n_words, rows = np.diff(w.doc), batch.num_rows
    text = np.searchsorted(w.doc, first, "right") - 1
    a, e, of_range = _ranges(first, first + size, text)
    at_range = np.searchsorted(of_range, np.arange(rows + 1))
    n_hit = np.diff(np.concatenate([[0], np.cumsum(e - a)])[at_range])
    pair = np.unique(text * (len(block.run) + 1) + window)
    of_pair, window = pair // (len(block.run) + 1), pair % (len(block.run) + 1)
    at_pair = np.searchsorted(of_pair, np.arange(rows + 1))
    weight = np.diff(np.concatenate([[0], np.cumsum(block.at[window + 1] - block.at[window])])[at_pair])
    begin = 0
    for part in portions(batch, weight, PAIRS):
        until = begin + part.num_rows
        mine = slice(at_pair[begin], at_pair[until])
        named = [np.empty(0, np.int64)]
        for row, at in _expanded(block.at[window[mine]], block.at[window[mine] + 1]):
            named.append(np.unique((of_pair[mine][row] - begin) * len(block.ids) + block.item[at]))
        key = np.unique(np.concatenate(named))
        per_text = np.searchsorted(key, np.arange(part.num_rows + 1) * max(len(block.ids), 1))
        items = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(block.ids, pa.string()).take(pa.array(key % max(len(block.ids), 1))))
        r = slice(at_range[begin], at_range[until])
        base = w.doc[:-1][of_range[r]]
        ranges = pa.StructArray.from_arrays([pa.array(a[r] - base), pa.array(e[r] - base)], fields=list(_RANGE))
        hits = pa.ListArray.from_arrays(pa.array(at_range[begin : until + 1] - at_range[begin], pa.int32()), ranges)
        yield part, {"n_words": n_words[begin:until], "n_hit": n_hit[begin:until], "items": items, "hits": hits}
        begin = until


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' rows and columns with n_words, n_hit, items (sorted ids) and hits (word ranges)."""
    sc = documents.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # hashes pass over nulls; a null text has no hits
    keys = [F.xxhash64(F.lit(n), "text").alias(f"_k{n}") for n in (1, 2)]
    hits = None
    for k in range(blocks):
        w, h, ids = read_block(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())
        vocabulary = np.unique(h)
        shared = sc.broadcast(build_block(w, h, ids, vocabulary, _word_counts(documents, vocabulary), width))
        if blocks == 1:
            return append_parts(documents, FOUND, lambda: lambda b: judged(b, shared.value))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                for part, found in judged(b, shared.value):
                    some = pa.array(np.flatnonzero(found["n_hit"]))
                    yield pa.RecordBatch.from_arrays([part.column("_k1").take(some), part.column("_k2").take(some), found["items"].take(some), found["hits"].take(some)], ["_k1", "_k2", "items", "hits"])

        kinds = FOUND[FOUND.index("items") :]
        mine = keep(documents.select("text", *keys).mapInArrow(run, f"_k1 long, _k2 long, {kinds}").groupBy("_k1", "_k2").agg(F.first("items").alias("items"), F.first("hits").alias("hits")), "hits")
        hits = mine if hits is None else hits.unionByName(mine)
    merged = hits.groupBy("_k1", "_k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _union(F.flatten(F.collect_list("hits"))).alias("hits"))
    counted = append(documents, FOUND.split(",")[0], lambda: lambda b: {"n_words": np.diff(split_words(b.column("text"), ALNUM, lower=True).doc)}).drop("n_hit", "items", "hits")
    rows = counted.select(F.struct("*").alias("_row"), *keys).join(keep(merged, "merged"), ["_k1", "_k2"], "left")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return rows.select("_row.*", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("items", "array<string>"), ("hits", "array<struct<first:bigint,last:bigint>>"))))


def _union(hits: Column) -> Column:
    """Word ranges of several blocks as ranges that don't touch."""

    def add(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (r["first"] <= last["last"]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(hits), F.array().cast("array<struct<first:bigint,last:bigint>>"), add)


def contaminated() -> Column:
    """The rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

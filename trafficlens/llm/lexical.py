"""Ranked lexical search: document-sharded CSR postings with integer impacts, term-at-a-time scoring.

``build_index`` turns documents into shards of about ``SHARD_BYTES`` of text, each one row: the
shard's sorted term hashes, where each term's postings begin, and the postings (document number,
impact). A posting's impact is the integer ``1000000000 * tf div (1000 * tf + 12 * m)``, computed once;
a term's weight needs its document frequency, so it comes in at search time, from the index itself. Shards
are made by a map: nothing is shuffled.

``search`` takes a stated query set in blocks of ``BLOCK_BYTES`` of text, each broadcast in turn. In a shard each
item adds weight * impact of its terms, one after the other, to a dense array over the shard's
documents, and keeps the ``k`` greatest. Documents are numbered in order of their ids, so of equal
scores the lowest number is the least id: the selection takes all above the k-th score, then the first that equal it.
The shards' lists are cut to ``k`` for each item and group of tasks, then for each item.

Terms are told apart by a 64-bit hash: with 10^5 query terms and 10^10 different terms the odds that any two are
mixed up are one in 10^4.

Cases: null and wordless texts have no terms, count neither in N nor in L and are never found;
items without terms give no rows; equal item rows are one item, and items that share an id (a null one too) are each
searched; every document row is a document of its own, so repeated rows take a rank each; null ids
come after all others of their score; a text of any length is read whole, in stretches; empty tables give no rows;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from trafficlens.llm.scratch import keep
from trafficlens.llm.words import ALNUM, slices, split_words, stretches

TOP = 20
#: Text bytes of a shard, and of a block of queries
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Tasks whose lists are merged at first
MERGED = 64


class Index(NamedTuple):
    """Shards of postings, and the documents with terms and all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def _pairs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (term, text) pairs with their counts; a long text's come in several parts."""
    for first, _, texts in stretches(column, ALNUM, lower=True):
        w = split_words(texts, ALNUM, lower=True)
        terms, code = np.unique(w.hashes(), return_inverse=True)
        key, tf = np.unique(code * len(texts) + w.text_of(), return_counts=True)
        yield terms[key // len(texts)], first + key % len(texts), tf


def _corpus_size(documents: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in slices(batches):
            words = np.zeros(b.num_rows, np.int64)
            for first, _, texts in stretches(b.column("text"), ALNUM, lower=True):
                words[first : first + len(texts)] += np.diff(split_words(texts, ALNUM, lower=True).doc)
            n, total = n + int((words > 0).sum()), total + int(words.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    found = documents.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def _shard(ids: list[pa.Array], pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, total: int) -> dict[str, object]:
    """One row of the index; documents are numbered by id, nulls last, and only those with terms."""
    every = pa.concat_arrays(ids)
    term, doc, tf = (np.concatenate(x) for x in zip(*pairs, strict=True))
    size = np.bincount(doc, tf, minlength=len(every)).astype(np.int64)
    order = pc.sort_indices(every, null_placement="at_end").to_numpy()
    order = order[size[order] > 0]
    number = np.zeros(len(every), np.int32)
    number[order] = np.arange(len(order))
    doc = number[doc]
    by_term = np.lexsort((doc, term))
    term, doc, tf = term[by_term], doc[by_term], tf[by_term]
    new = np.flatnonzero((term[1:] != term[:-1]) | (doc[1:] != doc[:-1])) + 1
    new = np.concatenate([[0], new])
    term, doc, tf = term[new], doc[new], np.add.reduceat(tf, new).astype(np.int64)
    m = 100 - 25 + 25 * size[order] * n // total
    start = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)]])
    return {
        "docs": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), every.take(pa.array(order))),
        "terms": term[start[:-1]].tobytes(),
        "starts": start.astype(np.int64).tobytes(),
        "numbers": doc.tobytes(),
        "impacts": (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])).astype(np.int32).tobytes(),
    }


def build_index(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written to the shared folder."""
    documents = documents.select("doc_id", "text")
    n, total = _corpus_size(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = rows = 0

        def full() -> Iterator[pa.RecordBatch]:
            if sum(len(t) for t, _, _ in pairs):
                made = _shard(ids, pairs, n, total)
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v], pa.binary()) for v in made.values()], list(made))

        for b in slices(batches):
            if size >= shard_bytes:
                yield from full()
                ids, pairs, size, rows = [], [], 0, 0
            ids.append(b.column("doc_id"))
            pairs += [(term, doc + rows, tf) for term, doc, tf in _pairs(b.column("text"))]
            rows += b.num_rows
            size += b.column("text").nbytes + 16 * b.num_rows
        yield from full()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return Index(keep(documents.mapInArrow(run, f"docs array<{kind}>, terms binary, starts binary, numbers binary, impacts binary"), "postings", "zstd"), n, total)


class Block(NamedTuple):
    """Some items: their ids, and item i's terms term[begin[i]:begin[i + 1]] (places in the sorted vocabulary) with weights."""

    ids: pa.Array
    begin: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: np.ndarray


def _postings(b: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the postings of each term of the vocabulary begin and end in one shard."""
    terms, starts = np.frombuffer(b.column("terms")[row].as_buffer(), np.uint64), np.frombuffer(b.column("starts")[row].as_buffer(), np.int64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    here = terms[at] == vocabulary
    return np.where(here, starts[at], 0), np.where(here, starts[at + 1], 0)


def _document_frequency(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    shared = index.shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                begin, end = _postings(b, row, shared.value)
                df += end - begin
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    rows = index.shards.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def _read_block(index: Index, rows: pa.Table) -> Block:
    texts = rows.column("text").combine_chunks()
    w = split_words(texts, ALNUM, lower=True)
    vocabulary, code = np.unique(w.hashes(), return_inverse=True)
    key, repeats = np.unique(w.text_of() * len(vocabulary) + code, return_counts=True)
    df = _document_frequency(index, vocabulary)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    item, term = (key // len(vocabulary), key % len(vocabulary)) if len(key) else (key, key)
    return Block(rows.column("item_id").combine_chunks(), np.searchsorted(item, np.arange(len(texts) + 1)), term, weight[term] * repeats, vocabulary)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest positive scores; of those that equal the least of them, the first."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        above = np.flatnonzero(score > max(least, 0))
        return above if least <= 0 else np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    return np.flatnonzero(score > 0)


def _search_block(index: Index, block: Block, id_type: DataType, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): at most k rows for each item and shard."""
    shared = index.shards.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            for row in range(b.num_rows):
                begin, end = _postings(b, row, block.vocabulary)
                numbers, impacts = (np.frombuffer(b.column(c)[row].as_buffer(), np.int32) for c in ("numbers", "impacts"))
                docs = b.column("docs")[row].values
                total = np.zeros(len(docs), np.int64)
                found, scores = [], []
                for i in range(len(block.ids)):
                    total[:] = 0
                    mine = slice(block.begin[i], block.begin[i + 1])
                    for t, weight in zip(block.term[mine], block.weight[mine], strict=True):
                        at = slice(begin[t], end[t])
                        total[numbers[at]] += weight * impacts[at].astype(np.int64)
                    found.append(best(total, k))
                    scores.append(total[found[-1]])
                item = np.repeat(np.arange(len(found)), [len(x) for x in found])
                if len(item):
                    yield pa.RecordBatch.from_arrays([pa.array(item), block.ids.take(pa.array(item)), docs.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], ["item", "item_id", "doc_id", "score"])

    schema = StructType([StructField("item", LongType()), StructField("item_id", id_type), StructField("doc_id", index.shards.schema["docs"].dataType.elementType), StructField("score", LongType())])
    return index.shards.mapInArrow(run, schema)


def _first(hits: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for part in range(blocks):
        block = _read_block(index, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == part).toArrow())
        hits = _search_block(index, block, items.schema["item_id"].dataType, k).withColumn("tasks", F.floor(F.spark_partition_id() / MERGED))
        mine = _first(_first(hits, k, "item", "tasks"), k, "item").select("item_id", "rank", "doc_id", "score")
        mine = mine if blocks == 1 else keep(mine, "found")
        out = mine if out is None else out.unionByName(mine)
    return out

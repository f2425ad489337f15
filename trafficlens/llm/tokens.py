"""Token counts attributed to sections by offsets.

A document is encoded once, whole. Every token has a span of the text's bytes, and the
spans are joined with the spans of the document's sections (sentences and lines: a section ends
after a newline, or after a space that follows a full stop). A token that crosses
a border belongs to the section that holds most of its bytes, the earlier one if two
hold as many. So the sections' counts add up to the document's count exactly.

The vocabulary file is read on the driver and broadcast (its size is fixed); counting
is a map over rows, without a shuffle.

Cases: null and empty texts have no tokens and no sections; control strings of a
tokenizer are ordinary text; very long texts are encoded whole; repeated rows and ties
are counted alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append
from trafficlens.llm.words import utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pattern that cuts a text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ATTRIBUTED = "n_tokens long, n_crossing long, sections array<struct<start:int,chars:int,tokens:int>>"


@functools.lru_cache(2)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the number of bytes of each token."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    size = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), size


def section_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of all sections of texts at offsets ``at``; a text's first byte always starts one."""
    ends = data == 0x0A
    ends[1:] |= (data[1:] == 0x20) & (data[:-1] == 0x2E)
    first = np.zeros(len(data) + 1, bool)
    first[1:] = ends
    first[at[:-1]] = True
    first[len(data)] = False
    return np.flatnonzero(first)


def owners(begin: np.ndarray, end: np.ndarray, sections: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether the span crosses a border."""
    low = np.searchsorted(sections, begin, "right") - 1
    high = np.searchsorted(sections, end - 1, "right") - 1
    crossing = np.flatnonzero(high > low)
    owner = low.copy()
    if len(crossing):
        many = (high - low + 1)[crossing]
        token = np.repeat(crossing, many)
        section = np.repeat(low[crossing], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        until = np.append(sections[1:], total)[section]
        share = np.minimum(end[token], until) - np.maximum(begin[token], sections[section])
        best = np.lexsort((section, -share, token))
        best = best[np.searchsorted(token[best], crossing)]
        owner[crossing] = section[best]
    return owner, high > low


def attribute(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, n_crossing and the sections (first character, characters, tokens) of each document."""
    with open(vocabulary, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def start():
        encoding, size = _encoding(shared.value, pattern)

        def make(b: pa.RecordBatch) -> dict[str, object]:
            column = b.column("text")
            data, at = utf8(column)
            ids = [encoding.encode_ordinary(x or "") for x in column.to_pylist()]
            count = np.array([len(x) for x in ids], np.int64)
            end = np.cumsum(size[np.fromiter((t for x in ids for t in x), np.int64, int(count.sum()))])
            begin = np.concatenate([[0], end[:-1]]) if len(end) else end
            text_end = np.concatenate([[0], end])[np.cumsum(count)] if len(count) else at[1:]
            if (text_end != at[1:]).any():
                raise ValueError("tokens don't cover a text exactly")
            sections = section_starts(data, at)
            owner, crossing = owners(begin, end, sections, len(data))
            token_text = np.repeat(np.arange(b.num_rows), count)
            chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            section_text = np.searchsorted(at, sections, "right") - 1
            made = [chars[sections] - chars[at[section_text]], np.diff(np.append(chars[sections], chars[-1])), np.bincount(owner, minlength=len(sections))]
            of = np.searchsorted(section_text, np.arange(b.num_rows + 1))
            return {
                "n_tokens": count,
                "n_crossing": np.bincount(token_text, crossing, minlength=b.num_rows).astype(np.int64),
                "sections": pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in made], ["start", "chars", "tokens"])),
            }

        return make

    return append(documents.select("doc_id", "text"), ATTRIBUTED, start).drop("text")


def summary(attributed: DataFrame) -> DataFrame:
    """One row for each document: totals and the tokens of its sections in order."""
    counts = F.transform("sections", lambda s: s["tokens"])
    return attributed.select(
        "doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), "n_crossing", F.coalesce(F.array_max(counts), F.lit(0)).cast("long").alias("max_section_tokens"), counts.alias("section_tokens")
    )

"""Secrets in texts: three fixed patterns, and strings that look drawn at random.

Two character Markov models (each character given the two before it, falling back on one and none) are trained
from labelled samples, one on random strings and one on ordinary identifiers. Their
log-likelihood ratio is a table over three characters, so a string's ratio is a sum of look-ups; the table is
the model that is broadcast, of a fixed size (67^3 numbers). Candidates are the maximal runs of ``[A-Za-z0-9+/_=-]`` with at least
``SHORTEST`` characters which touch no span of a fixed pattern; those whose ratio is above ``MARGIN`` nats,
and above ``RATE`` nats a character, are spans of the kind ``model``. Scanning is a map over whole texts.

``labelled_samples`` makes samples of both labels from the documents themselves: what the fixed patterns
find is random, runs of 8 or more characters in texts without such finds are ordinary identifiers; distinct strings only, and of each
label the ``MAX_SAMPLES`` with the least hashes. Each task keeps no more than these of its own. To them come
``DRAWN`` strings for each of six alphabets, drawn with a fixed seed and so random by construction, as the patterns know few alphabets.

Spans are in code points, the end exclusive, in order of (start, kind as listed in ``KINDS``).

Cases: null and empty texts have no spans; repeated rows and ties have the same result; empty tables give no rows
and a model of drawn strings against a uniform prior; very long texts are read whole, for the
patterns at once, for the model in stretches; columns called ``spans`` are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append
from trafficlens.llm.words import Words, slices, split_words, stretches, utf8

# Fixed values
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
MODEL = "model"
KINDS = ("assign", "access", "hex", MODEL)

CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(1, len(CHARACTERS) + 1)
_IN_RUN = _CODE > 0
#: Code 0 stands before a string's first character
_CODES = len(CHARACTERS) + 1

PRIOR, MARGIN, RATE = 10.0, 10.0, 0.3
SHORTEST, IDENTIFIER = 20, 8
MAX_SAMPLES, DRAWN = 20_000, 1_000
#: Alphabets of the drawn strings
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", CHARACTERS[:62], CHARACTERS[:64])

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS, _HEX = re.compile(ACCESS), re.compile(HEX)
#: What every match of the patterns contains; cheap, and linear in the text
_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[0-9a-f]{32}"""


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: str


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by (start, kind); ``value`` is the secret itself."""
    out = [Span("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text)]
    out += [Span(kind, m.start(), m.end(), m[0]) for kind, pattern in (("access", _ACCESS), ("hex", _HEX)) for m in pattern.finditer(text)]
    return sorted((s for s in out if len(s.value) >= LEAST[s.kind]), key=lambda s: (s.start, KINDS.index(s.kind)))


def _hinted(column: pa.Array) -> np.ndarray:
    """Rows that a fixed pattern may match."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, _HINT), False).to_numpy(zero_copy_only=False))


def _runs(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of at least so many characters: bytes, start and end in them, row, and code points before the run in its row."""
    ahead = 0
    for first, skipped, texts in stretches(column, _IN_RUN):
        w = split_words(texts, _IN_RUN)
        row = w.text_of()
        long = np.flatnonzero(w.end - w.start >= least)
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        behind = ahead if skipped else 0  # code points of a long text's earlier stretches
        ahead = behind + int(points[-1])
        if not len(long):
            continue
        at = utf8(texts)[1]
        before = points[w.start[long]] - points[at[row[long]]]
        yield w.data, w.start[long], w.end[long], row[long] + first, before + behind


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Words(data, start, end, np.empty(0, np.int64)).hashes() >> np.uint64(1)


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character of each run: the run's number, and the place of it and the two before it in the model's table."""
    size = end - start
    run = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    code = _CODE[data[np.repeat(start, size) + inside]]
    back = [np.where(inside >= k, np.concatenate([np.zeros(k, np.int64), code])[: len(code)], 0) for k in (2, 1)]
    return run, (back[0] * _CODES + back[1]) * _CODES + code


def labelled_samples(documents: DataFrame, most: int = MAX_SAMPLES) -> DataFrame:
    """(value, random): at most ``most`` distinct strings of each label, those with the least hashes."""

    def cut(kept: dict[int, str]) -> dict[int, str]:
        return dict(sorted(kept.items())[:most])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, dict[int, str]] = {False: {}, True: {}}
        limit = 1 << 63  # no greater hash can be among the identifiers' least ones any more
        for b in slices(batches):
            column = b.column("text")
            found = {row: base_spans(column[row].as_py()) for row in _hinted(column).tolist()}
            values = [s.value for spans in found.values() for s in spans if _IN_RUN[list(s.value.encode())].all()]
            if values:
                data, at = utf8(pa.array(values, pa.string()))
                kept[True] = cut(kept[True] | dict(zip(_hashes(data, at[:-1], at[1:]).tolist(), values, strict=True)))
            dirty = np.array([row for row, spans in found.items() if spans], np.int64)
            for data, start, end, row, _ in _runs(column, IDENTIFIER):
                h = _hashes(data, start, end)
                new = np.flatnonzero((h < limit) & ~np.isin(row, dirty))
                new = new[np.unique(h[new], return_index=True)[1]]
                kept[False].update((int(h[i]), data[start[i] : end[i]].tobytes().decode()) for i in new.tolist())
                if len(kept[False]) > 2 * most:
                    kept[False] = cut(kept[False])
                    limit = max(kept[False])
        for label, values in ((k, cut(v)) for k, v in kept.items()):
            yield pa.RecordBatch.from_arrays([pa.array(list(values), pa.int64()), pa.array(list(values.values()), pa.string()), pa.array([label] * len(values), pa.bool_())], ["hash", "value", "random"])

    every = documents.select("text").mapInArrow(run, "hash long, value string, random boolean").distinct()
    one = lambda label: every.where(F.col("random") == label).orderBy("hash", "value").limit(most)
    return one(True).unionByName(one(False)).select("value", "random")


def drawn_samples(many: int = DRAWN, seed: int = 13) -> list[str]:
    """Strings of 20 to 64 characters, each drawn evenly from one alphabet."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), int(rng.integers(20, 65)))) for alphabet in ALPHABETS for _ in range(many)]


def _smoothed(seen: np.ndarray) -> np.ndarray:
    """Probabilities of a character after two others; PRIOR counts are shared out as after one, and there as after none."""
    p = (seen.sum(axis=(0, 1)) + 1.0) / (seen.sum() + _CODES)
    for counts in (seen.sum(axis=0), seen):
        p = (counts + PRIOR * p) / (counts.sum(axis=-1, keepdims=True) + PRIOR)
    return p


def train(samples: DataFrame, drawn: int = DRAWN) -> np.ndarray:
    """The table of log-likelihood ratios from samples (value, random); their number is bounded by their maker."""
    rows = samples.select("value", "random").where(F.col("value").isNotNull() & F.col("random").isNotNull()).toArrow()
    label = rows.column("random").to_numpy()
    logs = []
    for random in (True, False):
        values = rows.filter(pa.array(label == random)).column("value").to_pylist() + (drawn_samples(drawn) if random else [])
        data, at = utf8(pa.array(values, pa.string()))
        logs.append(np.log(_smoothed(np.bincount(trigrams(data, at[:-1], at[1:])[1], minlength=_CODES**3).reshape(_CODES, _CODES, _CODES))))
    return (logs[0] - logs[1]).ravel()


def scan(documents: DataFrame, model: np.ndarray, margin: float = MARGIN, rate: float = RATE) -> DataFrame:
    """The documents' rows and columns with spans (kind, start, end, score); score is null for fixed patterns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def start():
        ratio = shared.value

        def make(b: pa.RecordBatch) -> dict[str, object]:
            column = b.column("text")
            found = {row: [(s.kind, s.start, s.end, None) for s in base_spans(column[row].as_py())] for row in _hinted(column).tolist()}
            ends = {row: (np.array([s[1] for s in spans]), np.maximum.accumulate([s[2] for s in spans])) for row, spans in found.items() if spans}
            for data, begin, end, row, before in _runs(column, SHORTEST):
                run, at = trigrams(data, begin, end)
                score = np.bincount(run, ratio[at], minlength=len(begin))
                for i in np.flatnonzero((score > margin) & (score > rate * (end - begin))).tolist():
                    r, a, e = int(row[i]), int(before[i]), int(before[i] + end[i] - begin[i])
                    if r in ends:
                        ahead = int(np.searchsorted(ends[r][0], e))  # base spans that start before e
                        if ahead and ends[r][1][ahead - 1] > a:
                            continue
                    found.setdefault(r, []).append((MODEL, a, e, float(score[i])))
            names = ("kind", "start", "end", "score")
            ordered = [[dict(zip(names, s, strict=True)) for s in sorted(found.get(i, ()), key=lambda s: (s[1], KINDS.index(s[0])))] for i in range(b.num_rows)]
            return {"spans": pa.array(ordered, kind)}

        return make

    return append(documents, "spans array<struct<kind:string,start:long,end:long,score:double>>", start)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

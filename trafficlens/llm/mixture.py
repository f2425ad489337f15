"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of ``BLOCK`` words. A source's target decides how many
whole passes over its blocks the mix takes and how many blocks of one further pass,
which follows a permuted order (a hash of document, copy and block) until the target's words
are reached. These exact block quotas are split down a tree over the output shards: a node
draws its left half's share of every source from the multivariate hypergeometric
distribution, so shards are what a full shuffle would give and the quotas stay exact. Each
shard takes a stretch of every source's permuted blocks, disjoint from all others', and orders
it by another hash. ``taken`` writes the shards with their texts and counts what was written.

A stretch ends at a block's hash, so once the ends are known a map over the documents sends
every block to its shards, and texts are shuffled once. Ends are found by ranks: counts of
blocks in hash bins, then places inside those bins only that hold an end. Bins and ends are
each at most ``CELLS`` (or one for each source, if sources are more), which bounds what
the driver collects and broadcasts; a source of most rows is many bins.

A document is known by 128 bits of hashes of its id, source and text (``k1``, ``k2``) and the
number of its copy, so ids may be null, and different texts may share one.

Cases: null and wordless texts have size 0 and nothing is taken; a null source is
a source of its own, last; repeated rows are copies that are drawn apart, and are dealt to
tasks in pieces; equal hashes are ordered by a second one; very long texts are many blocks; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trafficlens.llm.arrowmap import append
from trafficlens.llm.scratch import keep
from trafficlens.llm.words import NOT_SPACE, joined_words, mixed, portions, slices, split_words, strings

BLOCK, CAP, SEED = 64, 3, 7
WEIGHTS = (1, 2, 3)
#: Words of a shard on average, and shards at least
SHARD_WORDS, LEAST_SHARDS = 1 << 20, 8
#: Blocks in a hash bin on average, and bins or ends of all sources at most
BIN, CELLS = 4096, 1 << 20
#: Blocks of a piece of repeated rows
PIECE = 1 << 16


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Words to take from each source: shares by weight, none over ``cap`` times its size, the excess reshared."""
    total, open_ = float(sum(sizes)), set(range(len(sizes)))
    out = [total * w / sum(weights) for w in weights]
    while over := [i for i in open_ if out[i] > cap * sizes[i]]:
        excess = sum(out[i] - cap * sizes[i] for i in over)
        for i in over:
            out[i] = float(cap * sizes[i])
        open_ -= set(over)
        share = sum(weights[i] for i in open_)
        for i in open_:
            out[i] += excess * weights[i] / share
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good, by inversion; the same at every size.

    Probabilities come from the ratios of neighbours. Twelve standard deviations around the mode
    hold all but what a double can tell from 0.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = 20 + math.ceil(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    low, high = max(low, mode - wide), min(high, mode + wide)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(min(np.searchsorted(below, rng.random() * below[-1], "right"), high - low))


def split_quotas(counts: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Quotas of each shard (shard, source); they add up to ``counts`` exactly."""

    def node(counts: list[int], first: int, k: int) -> list[list[int]]:
        if k == 1:
            return [counts]
        left = k // 2
        rng = np.random.default_rng([seed, first, k])
        n, rest, mine = sum(counts) * left // k, sum(counts), []
        for c in counts:
            rest -= c
            mine.append(hypergeometric(rng, c, rest, n))
            n -= mine[-1]
        return node(mine, first, left) + node([c - m for c, m in zip(counts, mine, strict=True)], first + left, k - left)

    return node(counts, 0, shards)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, source, text, k1, k2 (hashes of the three)."""
    # hashes pass over nulls, so a null is told by a flag
    values = [x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))]
    return documents.select("doc_id", "source", "text", *(F.xxhash64(F.lit(n), *values).alias(f"k{n}") for n in (1, 2)))


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, k1, k2, size (words), copies of each distinct document."""
    rows = append(keyed(documents), "size long", lambda: lambda b: {"size": np.diff(split_words(b.column("text"), NOT_SPACE).doc)})
    return rows.groupBy("doc_id", "source", "k1", "k2", "size").agg(F.count("*").alias("copies"))


class Source(NamedTuple):
    """One source: its words, blocks, goal, whole passes, words of a further pass, and hash bins (the first and how many)."""

    name: object
    size: int
    blocks: int
    target: float
    passes: int
    rest: float
    first_bin: int
    bins: int


def plan(units: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> list[Source]:
    """The sources by code point, null last."""
    blocks = F.ceil(F.col("size") / BLOCK) * F.col("copies")
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum(blocks).alias("blocks")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    out, at = [], 0
    for r, goal in zip(rows, goals, strict=True):
        passes = min(int(goal // r["size"]), CAP) if r["size"] else 0
        bins = max(1, min(-(-r["blocks"] // BIN), CELLS // len(rows)))
        out.append(Source(r["source"], r["size"], r["blocks"], goal, passes, goal - passes * r["size"] if passes < CAP else 0.0, at, bins))
        at += bins
    return out


def _local(spark: SparkSession, fields: StructType, *columns: list) -> DataFrame:
    """A local table whose size Spark knows, so that it broadcasts it only if it is small."""
    schema = to_arrow_schema(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def named(df: DataFrame, sources: list[Source]) -> DataFrame:
    """Adds s, the number of the source, and drops its name."""
    fields = StructType().add("s_name", df.schema["source"].dataType).add("s", "integer")
    table = _local(df.sparkSession, fields, [x.name for x in sources], list(range(len(sources))))
    return df.join(table, F.col("source").eqNullSafe(F.col("s_name"))).drop("s_name", "source")


def pieces(units: DataFrame) -> DataFrame:
    """Adds first (a copy) and n (copies from it on): a unit of many copies is several rows, dealt out anew."""
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"{PIECE} div greatest(1, ceil(size / {BLOCK}))"))
    few = units.where(F.col("copies") <= step).select("*", F.lit(0).cast("long").alias("first"), F.col("copies").alias("n"))
    many = units.where(F.col("copies") > step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step)))
    many = many.withColumn("n", F.least(step, F.col("copies") - F.col("first"))).repartition("k1", "k2", "first")
    return few.unionByName(many.select(few.columns))


class Blocks(NamedTuple):
    """Blocks of some rows: row, copy, block, words, and the permuted order (h, g), both of 63 bits."""

    row: np.ndarray
    copy: np.ndarray
    block: np.ndarray
    words: np.ndarray
    h: np.ndarray
    g: np.ndarray


def blocks_of(k1: np.ndarray, k2: np.ndarray, first: np.ndarray, n: np.ndarray, size: np.ndarray) -> Blocks:
    per = -(-size // BLOCK)
    many = per * n
    row = np.repeat(np.arange(len(size)), many)
    b = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    copy, block = first[row] + b // per[row], b % per[row]
    place = mixed(mixed(copy.astype(np.uint64) + np.uint64(SEED)) + block.astype(np.uint64))
    h, g = (mixed(k.view(np.uint64)[row] ^ place) >> np.uint64(1) for k in (k1, k2))
    return Blocks(row, copy, block, np.minimum(BLOCK, size[row] - block * BLOCK), h.view(np.int64), g.view(np.int64))


def bins_of(h: np.ndarray, first_bin: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Bin number of each hash, of all sources' bins."""
    return first_bin + (h >> 32) * bins // (1 << 31)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Blocks, np.ndarray]]:
    """Blocks, and the source of each row, of at most some ``PIECE`` blocks (or one row's) at a time."""
    for batch in batches:
        n, size = _columns(batch, "n", "size")
        for b in portions(batch, -(-size // BLOCK) * n, PIECE):
            *keys, s = _columns(b, "k1", "k2", "first", "n", "size", "s")
            yield blocks_of(*keys), s


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def _binned(sources: list[Source]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x.first_bin for x in sources], np.int64), np.array([x.bins for x in sources], np.int64)


def count_bins(parts: DataFrame, sources: list[Source]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and words of each bin of each source."""
    shared = parts.sparkSession.sparkContext.broadcast(_binned(sources))
    total = sources[-1].first_bin + sources[-1].bins if sources else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_bin, bins = shared.value
        n, w = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for x, s in _parts(batches):
            at, inverse = np.unique(bins_of(x.h, first_bin[s][x.row], bins[s][x.row]), return_inverse=True)
            n[at] += np.bincount(inverse, minlength=len(at))
            w[at] += np.bincount(inverse, x.words, minlength=len(at)).astype(np.int64)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(w[seen])], ["bin", "n", "w"])

    rows = parts.mapInArrow(run, "bin long, n long, w long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    n, w = np.zeros(total, np.int64), np.zeros(total, np.int64)
    at, *sums = (c.to_numpy() for c in rows.columns)
    n[at], w[at] = sums
    return n, w


def ranked(parts: DataFrame, sources: list[Source], bins: np.ndarray) -> DataFrame:
    """bin, s, h, g, words, rank (from 0), words_to (to the block's end) of the blocks in some bins."""
    shared = parts.sparkSession.sparkContext.broadcast((_binned(sources), np.unique(bins)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first_bin, bins), wanted = shared.value
        for x, s in _parts(batches):
            at = bins_of(x.h, first_bin[s][x.row], bins[s][x.row])
            some = np.flatnonzero(np.isin(at, wanted))
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (at, s[x.row].astype(np.int32), x.h, x.g, x.words)], ["bin", "s", "h", "g", "words"])

    order = Window.partitionBy("bin").orderBy("h", "g")
    rows = parts.mapInArrow(run, "bin long, s int, h long, g long, words long")
    return rows.select("*", (F.row_number().over(order) - 1).alias("rank"), F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("words_to"))


class Ends(NamedTuple):
    """Where shards end, in order of (source, pass, h, g); ``first`` holds each source's first one, ``codes`` each (source, pass)'s.

    ``passes`` whole passes and, below (cut_h, cut_g), one more are drawn of a source's blocks.
    """

    shards: int
    first: np.ndarray
    codes: np.ndarray
    h: np.ndarray
    g: np.ndarray
    passes: np.ndarray
    cut_h: np.ndarray
    cut_g: np.ndarray


#: Passes of a source: one before all (ends at the start), CAP whole ones, the further one, and one after all
_CODES = CAP + 3


def find_ends(units: DataFrame, sources: list[Source], shards: int | None = None, seed: int = SEED) -> Ends:
    """Cut the permuted blocks of each source into the shards' stretches."""
    spark = units.sparkSession
    k = len(sources)
    taken = sum(x.target for x in sources)
    shards = shards or min(max(LEAST_SHARDS, math.ceil(taken / SHARD_WORDS)), max(LEAST_SHARDS, CELLS // max(1, k)))
    parts = pieces(named(units.where("size > 0"), sources))
    n, w = count_bins(parts, sources)
    n_before, w_before = np.cumsum(n) - n, np.cumsum(w) - w
    start, _ = _binned(sources)
    n_before, w_before = (x - np.repeat(x[start], [y.bins for y in sources]) for x in (n_before, w_before))

    # blocks of the further pass: those whose middle word is within its words
    rest = np.repeat([x.rest for x in sources], [y.bins for y in sources])
    near = np.flatnonzero((rest > 0) & (w_before <= rest + BLOCK) & (w_before + w >= rest - BLOCK) & (n > 0))
    extra = np.zeros(k, np.int64)
    owner = np.searchsorted(start, near, "right") - 1
    extra[owner[::-1]] = n_before[near[::-1]]
    if len(near):
        about = spark.createDataFrame(pa.table({"bin": near, "before": w_before[near], "rest": rest[near]}))
        passed = ranked(parts, sources, near).join(about, "bin").where(F.col("before") + F.col("words_to") - F.col("words") / 2.0 <= F.col("rest"))
        for r in passed.groupBy("s").count().collect():
            extra[r["s"]] += r["count"]

    drawn = [x.passes * x.blocks + int(e) for x, e in zip(sources, extra, strict=True)]
    quotas = np.array(split_quotas(drawn, shards, seed), np.int64).reshape(shards, k)
    ends = np.cumsum(quotas, axis=0)[:-1].T  # source, shard
    size = np.array([x.blocks for x in sources], np.int64)
    over = np.maximum(size, 1)
    code = np.where(ends == 0, 0, np.where(ends >= np.array(drawn, np.int64)[:, None], _CODES - 1, 1 + ends // over[:, None]))
    rank = np.where((code > 0) & (code < _CODES - 1), ends % over[:, None], 0)

    # the hashes at those ranks and at the further passes' ends
    cut = np.where((extra > 0) & (extra < size), extra, 0)
    source = np.concatenate([np.repeat(np.arange(k), shards - 1), np.arange(k)])
    at = np.concatenate([rank.ravel(), cut])
    asked = np.flatnonzero(at > 0)
    h, g = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    if len(asked):
        offset = np.concatenate([[0], np.cumsum(size)])
        place = at[asked] + offset[source[asked]]
        every = n_before + np.repeat(offset[:-1], [y.bins for y in sources])
        bins = np.searchsorted(every, place, "right") - 1
        wanted = spark.createDataFrame(pa.table({"bin": bins, "rank": (place - every[bins]).astype(np.int32), "i": asked}))
        found = ranked(parts, sources, bins).join(wanted, ["bin", "rank"]).select("i", "h", "g").toArrow()
        i, *values = (c.to_numpy() for c in found.columns)
        h[i], g[i] = values
    m = k * (shards - 1)
    codes = np.searchsorted((np.repeat(np.arange(k), shards - 1) * _CODES + code.ravel()), np.arange(k * _CODES + 1))
    whole = np.iinfo(np.int64).max
    cut_h = np.where(cut > 0, h[m:], np.where(extra >= np.maximum(size, 1), whole, -1))
    return Ends(shards, np.arange(k) * (shards - 1), codes, h[:m], g[:m], np.array([x.passes for x in sources], np.int64), cut_h, np.where(cut > 0, g[m:], 0))


def deal(x: Blocks, s: np.ndarray, e: Ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block number, pass and shard of every draw; s: the source of each block."""
    more = (x.h < e.cut_h[s]) | ((x.h == e.cut_h[s]) & (x.g < e.cut_g[s]))
    times = e.passes[s] + more
    of = np.repeat(np.arange(len(times)), times)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    h, g, code = x.h[of], x.g[of], s[of] * _CODES + 1 + turn
    low, high = e.codes[code], e.codes[code + 1]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = np.minimum(middle, len(e.h) - 1)
        past = (e.h[at] < h) | ((e.h[at] == h) & (e.g[at] <= g))
        low, high = np.where(open_ & past, middle + 1, low), np.where(open_ & ~past, middle, high)
    return of, turn, low - e.first[s[of]]


DRAWS = "shard int, place long, {}, s int, k1 long, k2 long, copy long, block long, words long, text string"


def draw(documents: DataFrame, units: DataFrame, sources: list[Source], ends: Ends) -> DataFrame:
    """One row for each drawn block: shard, place (its order in the shard), doc_id, s, k1, k2, copy, block, words, text.

    Rows that occur once go through a map; the others first become one row for each piece of their copies.
    """
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(ends)
    rows = keyed(documents).where("text is not null")
    again = keep(units.where("copies > 1 and size > 0").select("k1", "k2", "copies", "size"), "repeated")
    once = rows
    if not again.isEmpty():
        once = rows.join(again.select("k1", "k2"), ["k1", "k2"], "left_anti")
    once = named(once, sources).withColumns({"first": F.lit(0).cast("long"), "n": F.lit(1).cast("long")})
    if not again.isEmpty():
        one = rows.join(again.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        many = pieces(named(one.join(again, ["k1", "k2"]), sources))
        once = once.unionByName(many.select(once.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        copied = (p for b in slices(batches) for p in portions(b, _columns(b, "n")[0], b.num_rows))
        for b in copied:
            k1, k2, first, n, source = _columns(b, "k1", "k2", "first", "n", "s")
            w = split_words(b.column("text"), NOT_SPACE)
            x = blocks_of(k1, k2, first, n, np.diff(w.doc))
            of, turn, shard = deal(x, source[x.row], e)
            place = mixed(x.h[of].view(np.uint64) + turn.astype(np.uint64)) >> np.uint64(1)
            # each drawn block's text once, then for every draw
            used, again = np.unique(w.doc[x.row[of]] + x.block[of] * BLOCK, return_inverse=True)
            joined, begin, end = joined_words(w)
            last = np.zeros(len(used), np.int64)
            last[again] = w.doc[x.row[of]] + x.block[of] * BLOCK + x.words[of] - 1
            text = strings(joined, begin[used], end[last]).cast(pa.string()).take(pa.array(again))
            ids = pa.array(x.row[of])
            made = [pa.array(shard.astype(np.int32)), pa.array(place.view(np.int64)), b.column("doc_id").take(ids), pa.array(source[x.row[of]].astype(np.int32)), b.column("k1").take(ids), b.column("k2").take(ids)]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(c[of]) for c in (x.copy, x.block, x.words)), text], ["shard", "place", "doc_id", "s", "k1", "k2", "copy", "block", "words", "text"])

    return once.mapInArrow(run, DRAWS.format(f"doc_id {documents.schema['doc_id'].dataType.simpleString()}"))


def shuffled(draws: DataFrame, shards: int, words: float) -> DataFrame:
    """Draws in ascending place within shards; a shard of many words is several tasks of ascending places."""
    parts = max(0, math.ceil(math.log2(max(1.0, words / shards / SHARD_WORDS))))
    return draws.repartition("shard", F.shiftright("place", 63 - parts)).sortWithinPartitions("shard", "place")


def write_mix(documents: DataFrame, units: DataFrame, sources: list[Source], shards: int | None = None) -> DataFrame:
    """The mix, written: every drawn block with its text in its shard."""
    ends = find_ends(units, sources, shards)
    return keep(shuffled(draw(documents, units, sources, ends), ends.shards, sum(x.target for x in sources)), "shards", compression="zstd")


def taken(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards (shard and words) of each document row, from the written mix."""
    units = keep(sized(documents), "units")
    sources = plan(units)
    fields = StructType().add("s_source", units.schema["source"].dataType).add("source_size", "long").add("target", "double")
    about = _local(documents.sparkSession, fields, [x.name for x in sources], [x.size for x in sources], [float(x.target) for x in sources])
    mix = write_mix(documents, units, sources).select("k1", "k2", "copy", "shard", "words")
    # one shuffle serves both sums
    each = mix.repartition("k1", "k2", "copy").groupBy("k1", "k2", "copy", "shard").agg(F.sum("words").alias("words"))
    used = each.groupBy("k1", "k2", "copy").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    rows = units.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.join(used, ["k1", "k2", "copy"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    none = F.array().cast("array<struct<shard:int,words:bigint>>")
    return rows.join(about, F.col("source").eqNullSafe(F.col("s_source"))).select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce("shards", none).alias("shards"))

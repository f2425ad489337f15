"""SimHash near-duplicates: a binary-trie self-join of the fingerprints.

Fingerprints at most ``MAX_BITS`` apart are linked. They form a binary trie, which is joined
with itself: pairs of nodes go down together, their differing bits add up, and a pair is
dropped once it has more than its budget. As four differing bits can't spread over three
thirds of the fingerprint without leaving one with at most a single bit, the trie is walked
in three rotations, each with another third on top, and with a budget of one in that third
(``TOP_BITS``) and of ``MAX_BITS`` below it.

The top of the walk is a plan: a table of node pairs, joined with the tables of existing
children ``STEP`` bits further down and pruned, until both nodes of a pair hold ``NODE``
fingerprints at most. The rest of the walk is a task for each such pair, bit by bit,
which gives a spanning star of each component it finds, not all pairs. A dense cluster
only goes further down before it is dealt out, so nothing is salted and no task holds
more than two nodes.

Exact copies are one fingerprint before any join. Copies meet their component again in a
join with one row for each fingerprint, both sides of which are written or shuffled for
the join alone, so adaptive execution can split a hot fingerprint.

Cases: null and wordless texts have fingerprint 0 and are linked like others; ties and
repeated rows share a fingerprint; a component's id is the least non-null doc_id in it
(null if there is none); very long texts are hashed whole; an empty table gives no
rows; further columns are ignored. ``survivors`` decides by row, not by id: different texts
that share an id are told apart, and a group without ids keeps one row as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append
from trafficlens.llm.components import stars
from trafficlens.llm.scratch import drop, keep
from trafficlens.llm.words import NOT_SPACE, joined_words, last_words, overlapping, split_words

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Where a rotation begins (its leading third of bits), and the least width of such a third
TURNS, TOP_BITS = (0, 22, 43), 21
#: Fingerprints of a node that a task walks at most, and bits that node pairs go down at a time
NODE, STEP = 1024, 4
#: Node pairs that a task takes a bit further at a time, and fingerprint pairs of the tasks that it walks together
PAIRS, PRODUCT = 100_000, 1_000_000


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text over shingles of so many words. A long text's bits are counted stretch by stretch."""
    out, long = np.zeros(len(column), np.uint64), {}
    for part in overlapping(column, NOT_SPACE, last_words(shingle - 1, NOT_SPACE, lower=True), lower=True):
        sums, many = _bit_counts(part.texts, shingle, part.whole)
        if part.whole:
            out[part.first : part.first + len(many)] = _majority(sums, many)
        else:
            before = long.get(part.first, (0, 0))
            long[part.first] = (before[0] + sums, before[1] + many)
    for row, (sums, many) in long.items():
        # fewer words than a shingle has, some of them very long: the whole sequence
        out[row] = _majority(sums, many)[0] if many[0] else _majority(*_bit_counts(column.slice(row, 1), shingle, True))[0]
    return out


def _majority(sums: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.packbits(2 * sums > many[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _bit_counts(column: pa.Array, shingle: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many of each text's shingles have each bit set, and how many shingles it has; ``whole``: a text of fewer words is one."""
    w = split_words(column, NOT_SPACE, lower=True)
    joined, begin, end = joined_words(w)
    count = np.diff(w.doc)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1) if whole else 0)
    text = np.repeat(np.arange(len(count)), shingles)
    first = w.doc[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + shingle, w.doc[1:][text]) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)], np.uint64)
    out = np.zeros((len(count), 64), np.int64)
    some = np.flatnonzero(shingles)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[some] = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
    return out, shingles


def fingerprinted(documents: DataFrame, *more: Column, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, further columns and fingerprint (as a signed long)."""
    rows = append(documents.select("doc_id", "text", *more), "fp long", lambda: lambda b: {"fp": fingerprints(b.column("text"), shingle).view(np.int64)})
    return rows.drop("text")


def budget(depth: int, max_bits: int) -> int:
    """Differing bits that a pair of nodes may have at a depth (bits from the top)."""
    return max_bits // len(TURNS) if depth <= TOP_BITS else max_bits


class Found(NamedTuple):
    """Index pairs of a walk, and how many node pairs it dropped as over the budget."""

    i: np.ndarray
    j: np.ndarray
    pruned: int


def walk(fp: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, max_bits: int = MAX_BITS) -> Found:
    """Join ranges a and b of ``fp``, ascending as unsigned numbers, bit by bit; a range may be paired with itself.

    Finds all pairs at most max_bits apart that keep the leading third's budget. Open
    node pairs are kept on a stack in groups of ``PAIRS``, so a dense cluster needs no more memory.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ones: dict[int, np.ndarray] = {}
    pruned = 0
    stack = [(63, np.stack([a_lo, a_hi, b_lo, b_hi, np.zeros(len(a_lo), np.int64)]))]
    while stack:
        bit, nodes = stack.pop()
        if nodes.shape[1] > PAIRS:
            # copies, as a view would keep the whole
            stack += [(bit, nodes[:, k : k + PAIRS].copy()) for k in range(0, nodes.shape[1], PAIRS)]
            continue
        # two leaves: the rest of their paths at once
        single = (nodes[1] - nodes[0] == 1) & (nodes[3] - nodes[2] == 1)
        i, j = nodes[0, single], nodes[2, single]
        near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits)
        pruned += int((~near & (i != j)).sum())
        found.append((i[near], j[near]))
        nodes = nodes[:, ~single]
        if not nodes.shape[1] or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum(fp >> np.uint64(bit) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, err = nodes
        am, bm = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0])
        own = (a0 == b0) & (a1 == b1)
        both = np.stack([am, a1, b0, bm, err + 1])[:, ~own]
        nodes = np.concatenate([np.stack([a0, am, b0, bm, err]), np.stack([am, a1, bm, b1, err]), np.stack([a0, am, bm, b1, err + 1]), both], axis=1)
        nodes = nodes[:, (nodes[0] < nodes[1]) & (nodes[2] < nodes[3])]
        fits = nodes[4] <= budget(64 - bit, max_bits)
        pruned += int((~fits).sum())
        stack.append((bit - 1, nodes[:, fits]))
    return Found(*(np.concatenate([x[k] for x in found]) for k in (0, 1)), pruned)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index in each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def _star_rows(table: pa.Table, max_bits: int) -> pa.RecordBatch:
    """Stars of whole node pairs; rows ascend by (pair, side, x as an unsigned number)."""
    x, pair, side = (table.column(c).to_numpy() for c in ("x", "pair", "side"))
    x = x.view(np.uint64)
    opens = np.concatenate([[True], (pair[1:] != pair[:-1]) | (side[1:] != side[:-1])])
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(x))
    a = np.flatnonzero(side[begin] == 0)
    b = np.minimum(a + 1, len(begin) - 1)
    b = np.where(side[begin[b]] == 1, b, a)
    root = np.arange(len(x))
    cost, at = np.cumsum((end[a] - begin[a]) * (end[b] - begin[b])), 0
    while at < len(a):
        until = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PRODUCT, "right")))
        low, high = int(begin[a[at]]), int(end[b[until - 1]])
        ranges = (v - low for v in (begin[a[at:until]], end[a[at:until]], begin[b[at:until]], end[b[at:until]]))
        got = walk(x[low:high], *ranges, max_bits)
        # a fingerprint is in one place of a pair, so components stay inside pairs
        root[low:high] = low + _roots(high - low, got.i, got.j)
        at = until
    tied = np.flatnonzero(root != np.arange(len(x)))
    left = np.array(TURNS, np.uint64)[pair[tied] % len(TURNS)]
    back = [y >> left | np.where(left > 0, y << (np.uint64(64) - left & np.uint64(63)), np.uint64(0)) for y in (x[tied], x[root[tied]])]
    return pa.RecordBatch.from_arrays([pa.array(y.view(np.int64)) for y in back], ["a", "b"])


def _unsigned(x: Column) -> Column:
    """Ascends as an unsigned number does."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def turned(distinct: DataFrame) -> DataFrame:
    """r, x: each fingerprint in each rotation."""
    of = [F.col("fp") if not n else F.shiftleft("fp", n).bitwiseOR(F.shiftrightunsigned("fp", 64 - n)) for n in TURNS]
    return distinct.select(F.posexplode(F.array(*of)).alias("r", "x"))


def _node(depth: int) -> Column:
    return F.shiftrightunsigned("x", 64 - depth) if depth else F.lit(0).cast("long")


def frontier(distinct: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[int, DataFrame]]:
    """Node pairs small enough for a task, by depth: pair (an id that leaves r when divided by the rotations), r, a, b.

    Goes down level by level: only pairs with a large node are opened, only children
    that exist are paired, and pairs over the budget are dropped in the join.
    """
    rows = turned(distinct)
    out, depth = [], 0
    sizes = rows.groupBy("r", _node(0).alias("node")).agg(F.count("*").alias("n"))
    level = keep(sizes.select("r", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("err"), F.col("n").alias("n_a"), F.col("n").alias("n_b")), "node-pairs")
    while True:
        small = (F.col("n_a") <= NODE) & (F.col("n_b") <= NODE)
        # a node alone with itself has nothing to compare
        done = level.where(small & ((F.col("a") != F.col("b")) | (F.col("n_a") > 1)))
        number = (F.monotonically_increasing_id() * 65 + depth) * len(TURNS) + F.col("r")
        out.append((depth, keep(done.select(number.alias("pair"), "r", "a", "b"), "task-pairs")))
        large = level.where(~small)
        if depth == 64 or large.isEmpty():
            return out
        step = min(STEP, TOP_BITS - depth if depth < TOP_BITS else 64 - depth)
        opened = large.select("r", F.explode(F.array("a", "b")).alias("parent")).distinct()
        kids = rows.select("r", _node(depth).alias("parent"), _node(depth + step).alias("node"))
        kids = keep(kids.join(opened, ["r", "parent"], "left_semi").groupBy("r", "parent", "node").agg(F.count("*").alias("n")), "nodes")
        ka, kb = (kids.select(F.col("r").alias(f"r_{k}"), F.col("parent").alias(f"p_{k}"), F.col("node").alias(f"k_{k}"), F.col("n").alias(f"m_{k}")) for k in "ab")
        err = F.col("err") + F.bit_count(F.col("k_a").bitwiseXOR(F.col("k_b")).bitwiseAND(F.lit((1 << step) - 1)))
        fits = (err <= budget(depth + step, max_bits)) & ((F.col("a") != F.col("b")) | (F.col("k_a") <= F.col("k_b")))
        pairs = large.select("r", "a", "b", "err").join(ka, (F.col("r") == F.col("r_a")) & (F.col("a") == F.col("p_a"))).join(kb, (F.col("r") == F.col("r_b")) & (F.col("b") == F.col("p_b")) & fits)
        last, level = level, keep(pairs.select("r", F.col("k_a").alias("a"), F.col("k_b").alias("b"), err.alias("err"), F.col("m_a").alias("n_a"), F.col("m_b").alias("n_b")), "node-pairs")
        drop(last, kids)
        depth += step


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) of spanning stars over a table of distinct fingerprints ``fp``."""
    rows, dealt = turned(distinct), None
    for depth, pairs in frontier(distinct, max_bits):
        sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")))).otherwise(
            F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))
        )
        ends = pairs.select("pair", "r", F.explode(sides).alias("e")).select("pair", "r", "e.node", "e.side")
        part = rows.withColumn("node", _node(depth)).join(ends, ["r", "node"]).select("pair", "side", "x")
        dealt = part if dealt is None else dealt.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if len(table):
                pair = table.column("pair").to_numpy()
                cut = int(np.searchsorted(pair, pair[-1]))
                rest = table.slice(cut).combine_chunks()
                if cut:
                    yield _star_rows(table.slice(0, cut).combine_chunks(), max_bits)
        if rest is not None:
            yield _star_rows(rest, max_bits)

    return dealt.repartition("pair").sortWithinPartitions("pair", "side", _unsigned(F.col("x"))).mapInArrow(run, "a long, b long")


def _rooted(first: DataFrame, max_bits: int) -> DataFrame:
    """A written table of distinct fingerprints ``fp`` with the root fingerprint of each one's component."""
    star = stars(near_links(first.select("fp"), max_bits))
    return keep(first.join(star.select(F.col("a").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def components(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of each document row."""
    prints = keep(fingerprinted(documents, shingle=shingle), "fingerprints")
    rooted = _rooted(keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), max_bits)
    ids = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = keep(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "component-ids")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(documents: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the least doc_id, nulls last; rows that share it are told apart by hashes of all columns but maps.

    Rows are joined back on 128 bits of hashes, so ids may be null, and different rows may share one.
    """
    told = [c for c, kind in documents.dtypes if "map<" not in kind]
    # hashes pass over nulls, so a null is told by a flag
    values = [x for c in told for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    h1, h2 = (F.xxhash64(F.lit(n), *values).alias(f"h{n}") for n in (1, 2))
    prints = keep(fingerprinted(documents, h1, h2, shingle=shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2"))
    rooted = _rooted(keep(prints.groupBy("fp").agg(first.alias("first")), "distinct"), max_bits)
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2")
    chosen = keep(chosen, "chosen")
    rows = documents.select(F.struct("*").alias("row"), h1, h2)
    return rows.join(chosen, ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("row.*")

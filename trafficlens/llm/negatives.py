"""Hard-negative mining: branch-and-bound over ball trees, one forest of them for each part of the rows.

``build_trees`` packs the rows of each task into trees of at most ``TREE_ROWS`` rows (one row of the index
each): nodes are balls, split by label while a node has few of them, then halved along the line between two far points. ``mine`` takes the
anchors in blocks, broadcast in turn. A tree is walked once for a whole block: at each node the inner
products of all anchors that are still alive with the ball's centre, plus and minus |anchor| * radius, bound those with its
rows both above and below. An anchor's request leaves a node whose bounds lie outside the window of scores, whose upper bound is
strictly beneath its k-th score so far (an equal score may still win by its id), or in which no row has a fitting label. At leaves one matrix
product gives all scores. The best k of a request go on from tree to tree inside a task, and the tasks' lists are merged by a window that
is cut to k before its shuffle.

Two searches run for each block: positives (same label, any score), then negatives (another label, in the window of each
positive). With more than ``SAMPLED`` trees, one in ``SAMPLED`` is searched first and what it finds raises the lower bound for
the rest: the k-th score of some rows is never above that of all, so nothing is lost and far fewer rows are shuffled.

Components become floor(256 * x) and scores whole numbers: by float64 products while no sum can exceed 2^53, by Python integers
beyond. Scores beyond 64 bits are held to the 64-bit range.

Cases: rows with a null label or vector, or with a null or non-finite component, take no part; only vectors of equal length have a
score (vectors of length 0 all score 0); repeated rows each count, and each repeated anchor has its own results; an
anchor's other rows are those with another id; a null id is no anchor and comes last among equal scores; ties go to the lesser id; empty tables give no rows;
further columns, whatever their names, are not read. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.scratch import keep

POSITIVES = NEGATIVES = 5
TREE_ROWS, LEAF = 32_768, 128
#: A node is split by label while it has so many labels at most
BY_LABEL = 64
#: Bytes of a block of anchors as float64, and the most anchors in it
BLOCK_BYTES, BLOCK_ANCHORS = 8 << 20, 4096
SAMPLED = 32
LONG = np.iinfo(np.int64)
EXACT = float(1 << 53)


def _usable(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, whole-number vectors (as float64) and labels of the rows that take part, by length of vector."""
    vectors = b.column("embedding")
    at = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = vectors.is_valid().to_numpy(zero_copy_only=False) & b.column("label").is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    size = np.diff(at)
    for dim in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == dim))
        with np.errstate(over="ignore"):
            q = np.floor(256.0 * flat[at[rows][:, None] + np.arange(dim)])
        label = b.column("label").take(pa.array(rows)).cast(pa.int64()).to_numpy()
        yield rows, np.nan_to_num(q, posinf=np.finfo(float).max, neginf=np.finfo(float).min), label


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether they are null (then the greatest number, so that they come last)."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.cast(pa.int64()).fill_null(LONG.max).to_numpy(zero_copy_only=False), null


class Tree(NamedTuple):
    """Rows in the order of the nodes' ranges; node j holds rows begin[j]:end[j], children[j] is -1 in leaves."""

    points: np.ndarray
    label: np.ndarray
    id: np.ndarray
    null: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    children: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    most: np.ndarray


def grow(points: np.ndarray, label: np.ndarray, ids: np.ndarray, null: np.ndarray, leaf: int = LEAF) -> Tree:
    """The ball tree of some rows."""
    order = np.lexsort((ids, label))
    nodes: list[list] = []
    stack = [(0, len(points), -1, 0)]
    with np.errstate(over="ignore", invalid="ignore"):
        while stack:
            a, e, parent, side = stack.pop()
            mine = points[order[a:e]]
            centre = mine.mean(axis=0)
            far = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            labels = label[order[a:e]]
            nodes.append([a, e, [-1, -1], centre, far.max(), labels.min(), labels.max()])
            if parent >= 0:
                nodes[parent][2][side] = len(nodes) - 1
            if e - a <= leaf:
                continue
            kinds, first = np.unique(labels, return_index=True)
            if 1 < len(kinds) <= BY_LABEL:  # rows of a node with several labels are still in order of label
                cut = a + int(first[1:][np.abs(first[1:] - (e - a) // 2).argmin()])
            else:
                one = mine[far.argmax()]
                line = mine[((mine - one) ** 2).sum(axis=1).argmax()] - one
                cut = (e - a) // 2
                order[a:e] = order[a:e][np.argpartition(mine @ line, cut)]
                if len(kinds) > 1:
                    for x, y in ((a, a + cut), (a + cut, e)):
                        order[x:y] = order[x:y][np.argsort(label[order[x:y]], kind="stable")]
                cut += a
            stack += [(a, cut, len(nodes) - 1, 0), (cut, e, len(nodes) - 1, 1)]
    begin, end, children, centre, radius, least, most = (np.array(x) for x in zip(*nodes, strict=True))
    return Tree(points[order], label[order], ids[order], null[order], begin, end, children, centre.reshape(len(nodes), -1), radius, least, most)


def _packed(points: np.ndarray) -> np.ndarray:
    """The narrowest type that holds all components."""
    top = np.abs(points).max(initial=0)
    return points.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)


def build_trees(rows: DataFrame, tree_rows: int = TREE_ROWS, leaf: int = LEAF) -> DataFrame:
    """The index of all usable rows (vec_id, label, embedding), written to the shared folder: one row for each tree."""
    kinds = {"points": None, "label": np.int64, "id": np.int64, "null": bool, "begin": np.int64, "end": np.int64, "children": np.int64, "centre": np.float64, "radius": np.float64, "least": np.int64, "most": np.int64}

    def packed(parts: list[tuple[np.ndarray, ...]], dim: int) -> pa.RecordBatch:
        points, label, ids, null = (np.concatenate(x) for x in zip(*parts, strict=True))
        tree = grow(points, label, ids, null, leaf)
        small = _packed(tree.points)
        made = {k: small if kind is None else getattr(tree, k).astype(kind) for k, kind in kinds.items()}
        return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([small.dtype.str]), *(pa.array([v.tobytes()], pa.binary()) for v in made.values())], ["dim", "kind", *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            ids, null = _ids(b.column("vec_id"))
            for at, points, label in _usable(b):
                dim = points.shape[1]
                for k in range(0, len(at), tree_rows):
                    some = slice(k, k + tree_rows)
                    parts = waiting.setdefault(dim, [])
                    if parts and sum(len(p[0]) for p in parts) + len(at[some]) > tree_rows:
                        yield packed(waiting.pop(dim), dim)
                        parts = waiting.setdefault(dim, [])
                    parts.append((points[some], label[some], ids[at[some]], null[at[some]]))
        for dim, parts in waiting.items():
            yield packed(parts, dim)

    names = ", ".join(f"{k} binary" for k in kinds)
    grown = rows.select("vec_id", "label", "embedding").mapInArrow(run, f"dim long, kind string, {names}")
    return keep(grown, "trees", "zstd")


def _read_tree(b: pa.RecordBatch, row: int) -> Tree:
    dim = b.column("dim")[row].as_py()
    get = lambda c, kind: np.frombuffer(b.column(c)[row].as_buffer(), kind)
    label = get("label", np.int64)
    points = get("points", np.dtype(b.column("kind")[row].as_py())).reshape(len(label), dim).astype(np.float64)
    begin = get("begin", np.int64)
    return Tree(points, label, get("id", np.int64), get("null", bool), begin, get("end", np.int64), get("children", np.int64).reshape(-1, 2), get("centre", np.float64).reshape(len(begin), dim), get("radius", np.float64), get("least", np.int64), get("most", np.int64))


class Requests(NamedTuple):
    """What is asked of the trees: for each request its anchor, window of scores, and whether labels must be equal."""

    points: np.ndarray
    id: np.ndarray
    label: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool


class Best:
    """The k best rows of each request so far, in order of (score descending, null ids last, id)."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.null = np.full((n, k), LONG.min), np.full((n, k), LONG.max), np.ones((n, k), bool)
        self.have = np.zeros(n, np.int64)

    def least(self, at: np.ndarray) -> np.ndarray:
        """The k-th score, or the least number while there are fewer."""
        return np.where(self.have[at] == self.score.shape[1], self.score[at, -1], LONG.min)

    def add(self, request: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        k = self.score.shape[1]
        old = np.unique(request)
        some = np.arange(k) < self.have[old][:, None]
        request = np.concatenate([np.repeat(old, self.have[old]), request])
        score, ids, null = (np.concatenate([mine[old][some], new]) for mine, new in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, ~score, request))  # ~score is -score - 1, without overflow
        request, score, ids, null = request[order], score[order], ids[order], null[order]
        first = np.searchsorted(request, old)
        place = np.arange(len(request)) - np.repeat(first, np.diff(np.append(first, len(request))))
        kept = place < k
        request, place = request[kept], place[kept]
        self.score[request, place], self.id[request, place], self.null[request, place] = score[kept], ids[kept], null[kept]
        self.have[old] = np.bincount(np.searchsorted(old, request), minlength=len(old))


def _products(anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit whole numbers."""
    if not anchors.size or not points.size:
        return np.zeros((len(anchors), len(points)), np.int64)
    if np.abs(anchors).max() * np.abs(points).max() * anchors.shape[1] < EXACT:
        return (anchors @ points.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object) for m in (anchors, points)]
    return np.clip(whole[0] @ whole[1].T, LONG.min, LONG.max).astype(np.int64)


def walk(tree: Tree, asked: Requests, best: Best) -> int:
    """Search one tree for all requests; returns the number of inner products at leaves."""
    norm = np.sqrt((asked.points**2).sum(axis=1))
    stack, done = [(0, np.arange(len(asked.anchor)))], 0
    with np.errstate(over="ignore", invalid="ignore"):
        while stack:
            node, alive = stack.pop()
            label = asked.label[asked.anchor[alive]]
            if asked.same:
                alive = alive[(tree.least[node] <= label) & (label <= tree.most[node])]
            elif tree.least[node] == tree.most[node]:
                alive = alive[label != tree.least[node]]
            anchor, back = np.unique(asked.anchor[alive], return_inverse=True)
            middle, reach = asked.points[anchor] @ tree.centre[node], norm[anchor] * tree.radius[node]
            slack = 1e-9 * (np.abs(middle) + reach + norm[anchor] * np.abs(tree.centre[node]).sum()) + 1e-6
            low = np.maximum(asked.low[alive], best.least(alive))
            # not (outside), so that an overflow to nan prunes nothing
            alive = alive[~(((middle + reach + slack)[back] < low) | ((middle - reach - slack)[back] > asked.high[alive]))]
            if not len(alive):
                continue
            left, right = tree.children[node]
            if left >= 0:
                ahead = (tree.centre[right] - tree.centre[left]) @ asked.points[anchor].mean(axis=0)
                near, far = (left, right) if not ahead > 0 else (right, left)
                stack += [(far, alive), (near, alive)]
                continue
            rows = slice(tree.begin[node], tree.end[node])
            anchor, back = np.unique(asked.anchor[alive], return_inverse=True)
            score = _products(asked.points[anchor], tree.points[rows])
            done += score.size
            fits = (asked.label[anchor][:, None] == tree.label[rows]) == asked.same
            if asked.same:
                fits &= (asked.id[anchor][:, None] != tree.id[rows]) | tree.null[rows]
            score, low = score[back], np.maximum(asked.low[alive], best.least(alive))
            at, row = np.nonzero(fits[back] & (score >= low[:, None]) & (score <= asked.high[alive][:, None]))
            if len(at):
                best.add(alive[at], score[at, row], tree.id[rows][row], tree.null[rows][row])
    return done


def _search(trees: DataFrame, asked: Requests, k: int) -> DataFrame:
    """(request, id, score, rank): the k best rows of each request over all trees."""
    shared = trees.sparkSession.sparkContext.broadcast(asked)
    dim = asked.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(shared.value.anchor), k)
        for b in batches:
            for row in range(b.num_rows):
                walk(_read_tree(b, row), shared.value, best)
        request, place = np.nonzero(np.arange(k) < best.have[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(request), pa.array(best.id[request, place], mask=best.null[request, place]), pa.array(best.score[request, place])], ["request", "id", "score"])

    found = trees.where(F.col("dim") == dim).mapInArrow(run, "request long, id long, score long")
    order = Window.partitionBy("request").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(trees: DataFrame, asked: Requests, k: int, sampled: int | None) -> DataFrame:
    """The same; a share of the trees is searched first if there are many, to raise the lower bounds."""
    if sampled:
        some = _search(trees.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0), asked, k).where(F.col("rank") == k).select("request", "score").toArrow()
        low = asked.low.copy()
        at = some.column("request").to_numpy()
        low[at] = np.maximum(low[at], some.column("score").to_numpy())
        asked = asked._replace(low=low)
    return _search(trees, asked, k)


def _anchor_blocks(rows: DataFrame, is_anchor: Column, block_bytes: int) -> Iterator[Requests]:
    """Anchors in blocks of bounded size, each of one length of vector."""
    rows = rows.select("vec_id", "label", "embedding").where(is_anchor & F.col("vec_id").isNotNull())
    for dim, n in sorted(rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("dim")).count().collect()):
        blocks = max(1, -(-n // max(1, min(BLOCK_ANCHORS, block_bytes // (8 * dim + 8)))))
        dealt = keep(rows.where(F.size("embedding") == dim).repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")
        for k in range(blocks):
            table = dealt.where(F.col("block") == k).toArrow()
            for b in table.combine_chunks().to_batches():
                ids = _ids(b.column("vec_id"))[0]
                for at, points, label in _usable(b):
                    order = np.lexsort((label, ids[at]))
                    n = len(order)
                    yield Requests(points[order], ids[at][order], label[order], np.arange(n), np.full(n, LONG.min), np.full(n, LONG.max), True)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block_bytes: int = BLOCK_BYTES, sampled: int = SAMPLED, tree_rows: int = TREE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, embedding)."""
    trees = build_trees(rows, tree_rows)
    sampled = sampled if trees.count() > sampled else 0
    out = None
    for asked in _anchor_blocks(rows, is_anchor, block_bytes):
        found = _nearest(trees, asked, positives, sampled).orderBy("request", "rank").toArrow()
        anchor, score, positive = found.column("request").to_numpy(), found.column("score").to_numpy(), found.column("id").combine_chunks()
        low = np.array([-(-80 * s // 100) for s in score.tolist()], np.int64)
        windows = asked._replace(anchor=anchor, low=low, high=score, same=False)
        attributes = pa.table({"request": np.arange(len(anchor)), "anchor_id": asked.id[anchor], "positive_id": positive, "positive_score": score})
        spark = rows.sparkSession
        hits = _nearest(trees, windows, negatives, sampled).join(spark.createDataFrame(attributes, "request long, anchor_id long, positive_id long, positive_score long"), "request")
        part = keep(hits.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out

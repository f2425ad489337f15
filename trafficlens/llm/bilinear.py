"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Token counts are gathered from all training texts. The model predicts the class of the
next token from the classes of the two before it: the ``LISTED`` most frequent tokens,
the text's end, and classes of all rarer tokens by their last ``SUFFIX`` bytes (the most
frequent endings have a class each, the others share one). A class's score is bilinear in
the context's and its own vectors, plus a bias that starts at the log frequency. Noise is
drawn from the class frequencies. Matrix products over all pairs of
context classes then give the exact normaliser, so token log-probabilities are
normalised. Inside a class of rarer tokens a token has its add-one share of the class's counts.

Training doesn't depend on how rows are dealt to tasks: texts become class sequences, which a hash
of id and text deals to shards of about ``SHARD_TOKENS`` tokens and to ``ROUNDS`` rounds. In
a round every shard trains, in numpy and in the order of the hash, from the parameters so
far; they are averaged (in whole numbers, so the order of adding doesn't matter)
and broadcast for the next round. Shards grow in number with the corpus, and all texts are trained on once.

Frequent tokens' counts (at most ``FREQUENT``) are broadcast; a text's other tokens
are joined with the count table, so counts are exact for every token and nothing that
is broadcast or collected grows with the corpus.

Cases: null and empty texts are one end token; a null doc_id learns like others and is not
held out; repeated rows are scored one by one, and learned from as one sequence with a count, whose
copies are dealt to shards in pieces; with nothing to learn from, the base score
is 0 and classes are equally likely; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrowmap import append
from trafficlens.llm.scratch import drop, keep
from trafficlens.llm.words import NOT_SPACE, Words, mixed, slices, split_words, strings

CLASSES, LISTED, WIDTH = 1024, 255, 16
#: The class of the text's end; later ones are of rarer tokens, the last of rare endings
END = LISTED
#: Bytes of an ending, and slots that endings are hashed to
SUFFIX, SLOT_BITS = 3, 12
FREQUENT = 1 << 17
#: Noise-contrastive training: noise samples and tokens of a step, Adagrad's rate
NOISE, STEP, RATE = 128, 2048, 0.1
#: Tokens of a training shard, rounds of averaging, and copies of a text that a piece holds
SHARD_TOKENS, ROUNDS, PIECE = 4_000_000, 4, 256
#: Parameters are averaged as whole numbers of this fraction
UNIT = 1 << 24
SEED = 5


class Counts(NamedTuple):
    """Counts of the frequent tokens (sorted by hash), classes of endings, and totals of all."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    slot_classes: np.ndarray
    total: int
    distinct: int
    ends: int
    class_counts: np.ndarray
    log_sizes: np.ndarray

    def find(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, its place among the frequent tokens, and whether it is one."""
        ids = self.slot_classes[slots(w)]
        if not len(self.hashes):
            return ids, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        frequent = self.hashes[at] == h
        return np.where(frequent, self.classes[at], ids), at, frequent


def _tokens(column: pa.Array) -> tuple[Words, np.ndarray]:
    w = split_words(column, NOT_SPACE, lower=True)
    return w, w.hashes()


def slots(w: Words) -> np.ndarray:
    """Slot of each word's last bytes."""
    key = np.zeros(len(w.start), np.uint64)
    for k in range(1, SUFFIX + 1):
        at = w.end - k
        key = key * np.uint64(256) + np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mixed(key) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def token_counts(texts: DataFrame) -> DataFrame:
    """token, n over a column of texts (lower-cased words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w, h = _tokens(b.column("text"))
            _, at, n = np.unique(h, return_index=True, return_counts=True)
            order = np.argsort(at)
            at = at[order]
            yield pa.RecordBatch.from_arrays([strings(w.data, w.start[at], w.end[at]).cast(pa.string()), pa.array(n[order])], ["token", "n"])

    return texts.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def slot_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            slot = slots(split_words(b.column("token"), NOT_SPACE))
            np.add.at(total, slot, b.column("n").to_numpy())
            np.add.at(distinct, slot, 1)
        seen = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(distinct[seen])], ["slot", "n", "tokens"])

    rows = counts.mapInArrow(run, "slot long, n long, tokens long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()
    total, distinct = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows:
        total[r["slot"]], distinct[r["slot"]] = r["n"], r["tokens"]
    return total, distinct


def gather(counts: DataFrame, n_texts: int) -> Counts:
    """The broadcast half of a count table.

    Frequent are the tokens at or over a count that a logarithmic histogram of all counts
    gives; they are FREQUENT at most, and nothing else is collected.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 64)
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken = np.cumsum([n for _, n in levels])
    fits = int(np.searchsorted(taken, FREQUENT, "right"))
    rows = counts.where(level >= (levels[fits - 1][0] if fits else 1 << 20)).toPandas().sort_values(["n", "token"], ascending=[False, True])
    w, h = _tokens(pa.array(rows["token"], pa.string()))
    n, slot = rows["n"].to_numpy(np.int64), slots(w)
    listed = min(LISTED, len(n))
    slot_total, slot_distinct = slot_counts(counts)
    np.subtract.at(slot_total, slot[:listed], n[:listed])
    np.subtract.at(slot_distinct, slot[:listed], 1)
    slot_classes = np.full(1 << SLOT_BITS, CLASSES - 1, np.int64)
    own = np.argsort(-slot_total, kind="stable")[: CLASSES - END - 2]
    slot_classes[own] = END + 1 + np.arange(len(own))
    classes = slot_classes[slot]
    classes[:listed] = np.arange(listed)
    class_counts = np.bincount(slot_classes, slot_total, minlength=CLASSES)
    log_sizes = np.log10(class_counts + np.bincount(slot_classes, slot_distinct, minlength=CLASSES) + 1)
    log_sizes[: END + 1] = 0
    class_counts[:listed], class_counts[END] = n[:listed], n_texts
    order = np.argsort(h)
    return Counts(h[order], n[order], classes[order], slot_classes, total + n_texts, distinct + (n_texts > 0), n_texts, class_counts, log_sizes)


def sequence(w: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every token and end, and of the two before it; a text starts after ends."""
    n = np.diff(w.doc)
    end = np.cumsum(n + 1) - 1
    now = np.full(int((n + 1).sum()), END, np.int64)
    inner = np.ones(len(now), bool)
    inner[end] = False
    now[inner] = ids
    one = np.concatenate([[END], now[:-1]])[: len(now)]
    two = np.concatenate([[END], one[:-1]])[: len(now)]
    two[end[:-1] + 1] = END
    return now, one, two


class Bilinear:
    """Vectors of contexts and predicted classes, a matrix for each context place, and biases."""

    def __init__(self, class_counts: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        p = (class_counts + 1) / (class_counts.sum() + len(class_counts))
        self.context = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.predicted = rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
        self.one = np.eye(WIDTH, dtype=np.float32)
        self.two = np.eye(WIDTH, dtype=np.float32) / 2
        self.bias = np.log(p).astype(np.float32)
        self.noise = p
        self.squares = [np.full_like(x, 1e-4) for x in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.predicted, self.one, self.two, self.bias]

    def flat(self) -> np.ndarray:
        """Parameters and what Adagrad divides by, which is all that a round hands on."""
        return np.concatenate([x.ravel() for x in self.parts()] + [np.sqrt(x).ravel() for x in self.squares])

    def load(self, flat: np.ndarray) -> None:
        cut = np.cumsum([x.size for x in self.parts() + self.squares])[:-1]
        values = np.split(flat, cut)
        for x, v in zip(self.parts(), values[: len(values) // 2], strict=True):
            x[...] = v.reshape(x.shape)
        for x, v in zip(self.squares, values[len(values) // 2 :], strict=True):
            x[...] = np.square(v).reshape(x.shape)

    def step(self, now: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """One noise-contrastive step: each token against noise that the step's tokens share."""
        noise = rng.choice(CLASSES, NOISE, p=self.noise)
        shift = np.log(NOISE * self.noise).astype(np.float32)
        r1, r2, q, qn = self.context[one], self.context[two], self.predicted[now], self.predicted[noise]
        hat = r1 @ self.one + r2 @ self.two
        real = np.einsum("ij,ij->i", hat, q) + self.bias[now] - shift[now]
        fake = hat @ qn.T + (self.bias[noise] - shift[noise])
        d_real = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        d_fake = -1 / (1 + np.exp(np.clip(-fake, -30, 30)))
        d_hat = d_real[:, None] * q + d_fake @ qn
        grads = [np.zeros_like(x) for x in self.parts()]
        _add_rows(grads[0], one, d_hat @ self.one.T)
        _add_rows(grads[0], two, d_hat @ self.two.T)
        _add_rows(grads[1], now, d_real[:, None] * hat)
        np.add.at(grads[1], noise, d_fake.T @ hat)
        grads[2], grads[3] = r1.T @ d_hat, r2.T @ d_hat
        grads[4] += np.bincount(now, d_real, minlength=CLASSES).astype(np.float32)
        np.add.at(grads[4], noise, d_fake.sum(axis=0))
        for x, g, s in zip(self.parts(), grads, self.squares, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by last class and by the one before (with bias), and the log normaliser of each pair."""
        context, predicted = self.context.astype(np.float64), self.predicted.T.astype(np.float64)
        a1, a2 = context @ self.one @ predicted, context @ self.two @ predicted + self.bias
        top1, top2 = a1.max(axis=1), a2.max(axis=1)
        log_z = np.log(np.exp(a2 - top2[:, None]) @ np.exp(a1 - top1[:, None]).T) + top2[:, None] + top1
        return a1.astype(np.float32), a2.astype(np.float32), log_z.astype(np.float32)


def _add_rows(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """out[ids] += rows, adding up repeated ids."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out[ids[first]] += np.add.reduceat(rows[order], first, axis=0)


def sequences(texts: DataFrame, counts: Counts, shards: int) -> DataFrame:
    """round, shard, k1, classes (two bytes for each token), copies: the training texts as class sequences."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in slices(batches):
            w, h = _tokens(b.column("text"))
            now = sequence(w, c.find(w, h)[0])[0].astype(np.uint16)
            offsets = 2 * np.concatenate([[0], np.cumsum(np.diff(w.doc) + 1)])
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(now)])
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), coded.cast(pa.binary())], ["k1", "k2", "classes"])

    # hashes pass over nulls, so a null is told by a flag
    keys = [F.xxhash64(F.lit(n), F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))).alias(f"k{n}") for n in (1, 2)]
    rows = texts.select("text", *keys).mapInArrow(run, "k1 long, k2 long, classes binary")
    each = rows.groupBy("k1", "k2").agg(F.first("classes").alias("classes"), F.count("*").alias("n"))
    pieces = each.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    place = F.xxhash64("k1", "k2", "first")
    return pieces.select(
        F.pmod(place, F.lit(ROUNDS)).cast("int").alias("round"),
        F.pmod(F.shiftright(place, 8), F.lit(shards)).cast("int").alias("shard"),
        place.alias("place"),
        "classes",
        F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("first")).alias("copies"),
    )


def train(texts: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Bilinear:
    """Rounds in which all shards train from the same parameters, which are then averaged."""
    sc = texts.sparkSession.sparkContext
    shards = max(1, -(-counts.total // SHARD_TOKENS))
    every = keep(sequences(texts, counts, shards), "sequences")
    model = Bilinear(counts.class_counts)

    for turn in range(rounds):
        shared = sc.broadcast((counts.class_counts, model.flat()))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            class_counts, flat = shared.value
            part = _Shard(class_counts, flat, turn)
            for b in batches:
                for shard, classes, copies in zip(b.column("shard").to_pylist(), b.column("classes"), b.column("copies").to_pylist(), strict=True):
                    if shard != part.shard:
                        yield from part.close()
                        part.open(shard)
                    now = np.frombuffer(classes.as_buffer(), np.uint16).astype(np.int64)
                    for _ in range(copies):
                        part.add(now)
            yield from part.close()

        mine = every.where(F.col("round") % rounds == turn).select("shard", "place", "classes", "copies")
        dealt = mine.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "place")
        rows = dealt.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v"), F.count("*").alias("n")).toArrow()
        if rows.num_rows:
            i, v, n = (c.to_numpy() for c in rows.columns)
            flat = model.flat().astype(np.float64)
            flat[i] = v / n / UNIT
            model.load(flat)
    drop(every)
    return model


class _Shard:
    """Training of one shard after the other: steps of STEP tokens, wherever batches and texts end."""

    def __init__(self, class_counts: np.ndarray, flat: np.ndarray, turn: int) -> None:
        self.class_counts, self.flat, self.turn, self.shard, self.held = class_counts, flat, turn, None, []
        self.size = 0

    def open(self, shard: int) -> None:
        self.model, self.rng, self.shard = Bilinear(self.class_counts), np.random.default_rng([SEED, self.turn, shard]), shard
        self.model.load(self.flat)

    def add(self, now: np.ndarray) -> None:
        one = np.concatenate([[END], now[:-1]])
        two = np.concatenate([[END], one[:-1]])
        self.held.append(np.stack([now, one, two]))
        self.size += len(now)
        if self.size >= STEP:
            every = np.concatenate(self.held, axis=1)
            whole = self.size // STEP * STEP
            for k in range(0, whole, STEP):
                self.model.step(*every[:, k : k + STEP], self.rng)
            self.held, self.size = [every[:, whole:]], self.size - whole

    def close(self) -> Iterator[pa.RecordBatch]:
        """Parameters of the open shard, if there is one."""
        if self.shard is None:
            return
        if self.size:
            self.model.step(*np.concatenate(self.held, axis=1), self.rng)
        flat = self.model.flat().astype(np.float64)
        self.shard, self.held, self.size = None, [], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.round(flat * UNIT).astype(np.int64))], ["i", "v"])


def score(documents: DataFrame, counts: DataFrame, known: Counts, model: Bilinear) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of each document row."""
    a1, a2, log_z = model.tables()
    shared = documents.sparkSession.sparkContext.broadcast((known, a1, a2, log_z))
    log_all = float(np.log10(known.total + known.distinct + 1))

    def start():
        c, a1, a2, log_z = shared.value
        of_count = np.log10(c.counts + 1.0)
        of_end = float(np.log10(c.ends + 1.0))

        def make(b: pa.RecordBatch) -> dict[str, object]:
            w, h = _tokens(b.column("text"))
            ids, at, frequent = c.find(w, h)
            size = np.where(frequent, of_count[at], 0.0) if len(of_count) else np.zeros(len(h))
            now, one, two = sequence(w, ids)
            logp = (a1[one, now] + a2[two, now] - log_z[two, one]) / np.log(10)
            n = np.diff(w.doc)
            rows = b.num_rows
            text, text_with_end = np.repeat(np.arange(rows), n), np.repeat(np.arange(rows), n + 1)
            rest = ~frequent
            of = np.searchsorted(text[rest], np.arange(rows + 1))
            return {
                "n_tokens": n + 1,
                "n_known": np.bincount(text, frequent, minlength=rows).astype(np.int64) + (c.ends > 0),
                "log_counts": np.bincount(text, size, minlength=rows) + of_end,
                "log_classes": np.bincount(text_with_end, logp, minlength=rows),
                "log_shares": np.bincount(text, (size - c.log_sizes[ids]) * (ids > END), minlength=rows),
                "rest": pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), strings(w.data, w.start[rest], w.end[rest]).cast(pa.string())),
            }

        return make

    fields = "n_tokens long, n_known long, log_counts double, log_classes double, log_shares double, rest array<string>"
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")
    scored = keep(append(rows, fields, start).drop("text"), "scored")
    rest = scored.select("doc_id", "tk", F.explode("rest").alias("token")).join(counts, "token", "left")
    sums = rest.groupBy("doc_id", "tk").agg(F.count("*").alias("rows"), F.count("n").alias("found"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("logs"))
    sums = sums.select(F.col("doc_id").alias("s_id"), F.col("tk").alias("s_tk"), "rows", "found", "logs")
    both = scored.join(sums, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tk") == F.col("s_tk")), "left")
    # repeated rows gave their tokens once each: every row's share
    share = F.coalesce(F.size("rest") / F.col("rows"), F.lit(0.0))
    logs = share * F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.round(share * F.coalesce("found", F.lit(0))).cast("long")).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("log_classes") + F.col("log_shares") + logs).alias("score"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_all(documents: DataFrame, held: Column | None = None) -> DataFrame:
    """Learn from the rows that aren't held out and score all rows."""
    held = held_out() if held is None else held
    learned = documents.select("doc_id", "text").where(~held)
    counts = keep(token_counts(learned), "counts")
    known = gather(counts, learned.count())
    return score(documents, counts, known, train(learned, known)).withColumn("held_out", held)

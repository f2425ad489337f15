"""Each operator against a plain version, and on nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows
from tests.llm import brute
from tests.llm.conftest import SCHEMA, tricky_rows, vocabulary
from trafficlens.llm import bilinear, chat, components, decontaminate, media, mixture, quality, queries, simhash, substrings, tokens, toxicity
from trafficlens.llm import words as W

CLASHES = ("score", "predicted", "n_words", "n_hit", "items", "hits", "n_removed", "kept_sha256", "fp", "size", "tk", "runs", "sections", "n_tokens", "log_weight", "n_grams", "_runs", "media")
SMALL = "/root/testdata/sf0.01"


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def by_id(df):
    """Rows of non-null ids; repeated ids must agree."""
    out = {}
    for r in df.collect():
        if r["doc_id"] is not None:
            assert out.setdefault(r["doc_id"], r) == r
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_words_and_hashes():
    texts = [r[1] for r in tricky_rows()]
    w = W.split_words(pa.array(texts, pa.string()), W.NOT_SPACE)
    found = [[w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.doc[i], w.doc[i + 1])] for i in range(len(texts))]
    assert found == [brute.words(t) for t in texts]
    h = w.hashes()
    assert len({*h.tolist()}) == len({x for f in found for x in f})
    names = defaultdict(set)
    for x, y in zip((x for f in found for x in f), h.tolist(), strict=True):
        names[x].add(y)
    assert all(len(v) == 1 for v in names.values())
    low = W.split_words(pa.array(texts, pa.string()), W.ALNUM, lower=True)
    assert len(low.start) == sum(len(brute.ALNUM.findall(brute.lower(t))) for t in texts)
    assert len(W.split_words(pa.array([], pa.string()), W.NOT_SPACE).start) == 0
    sliced = pa.array(["zz", *texts, "zz"], pa.string()).slice(1, len(texts))
    assert (W.split_words(sliced, W.NOT_SPACE).hashes() == h).all()


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 100, "z", ""]})
    assert [b.num_rows for b in W.slices(iter([batch]), most=20)] == [2, 1, 2]


# 1


def test_toxicity_on_held_out_rows(spark):
    scored = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, s = scored["toxic"].to_numpy(), scored["score"].rank().to_numpy()
    auc = (s[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.97
    assert scored[scored["predicted"] == 1]["toxic"].mean() > 0.95 and scored[scored["toxic"] == 1]["predicted"].mean() > 0.8


def test_ftrl_learns_sparse_weights():
    rng, model = np.random.default_rng(0), toxicity.Ftrl(10)
    for _ in range(400):
        bad = int(rng.random() < 0.5)
        model.learn(np.unique([0, *rng.integers(10, 1000, 30).tolist(), *[5] * bad]), bad)
    w = model.weights(np.arange(1 << 10))
    assert w[5] == w.max() > 1 and (w != 0).sum() < 60


def test_training_equals_plain(spark, tricky):
    """Per-coordinate FTRL in plain Python over dictionaries, on the same feature sets and order."""
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in tricky_rows() if r[0] is not None], "doc_id long, toxic int").distinct()
    learned = toxicity.learn(tricky, labels)
    order = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows_ = [r for r in tricky_rows() if r[0] is not None]
    text, feature = toxicity.hashed_features(pa.array([r[1] for r in rows_], pa.string()))
    examples = [(order[r[0]], r[0] % 2, [0, *feature[text == i].tolist()]) for i, r in enumerate(rows_)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i and abs(z[i]) <= toxicity.L1:
            return 0.0
        shrunk = z[i] - math.copysign(toxicity.L1, z[i]) if i else z[i]
        return -shrunk / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for _, label, at in sorted(examples, key=lambda x: (x[0], x[1], len(x[2]))):
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in list(z) if weight(i)}
    got = {int(i): learned[i] for i in np.flatnonzero(learned)}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    scored = by_id(toxicity.score(tricky, learned))
    for i, r in enumerate(rows_):
        p = 1 / (1 + math.exp(-want.get(0, 0.0) - sum(want.get(k, 0.0) for k in feature[text == i].tolist())))
        assert scored[r[0]]["score"] == pytest.approx(p) and scored[r[0]]["predicted"] == (p >= 0.3)


def test_features_are_the_named_grams():
    text = "One two, three FOUR"
    w = ["one", "two", "three", "four"]
    h = lambda t: int(W.split_words(pa.array([t]), W.ALNUM).hashes()[0])
    shift = 64 - toxicity.BITS
    mix = lambda x: int(W.mixed(np.array([x % 2**64], np.uint64))[0])
    want = {h(t) >> shift for t in w} | {mix(h("thre") + 4) >> shift}
    want |= {mix(h(w[i]) * 2 * gap + h(w[i]) + (h(w[i + gap]) >> 1)) >> shift for gap in (1, 2, 3) for i in range(4 - gap)}
    assert set(toxicity.hashed_features(pa.array([text]))[1].tolist()) == {max(f, 1) for f in want}


def test_toxicity_cases(spark, tricky, nothing):
    labels = spark.createDataFrame([(3, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    assert not toxicity.learn(tricky, labels.where("doc_id is null")).any()
    learned = toxicity.learn(tricky, labels)
    out = toxicity.score(clashing(tricky), learned)
    assert out.count() == len(tricky_rows()) and set(out.columns) == {*tricky.columns, *CLASHES}
    assert {r["score"] for r in by_id(out).values()} == {0.5}
    assert toxicity.score(nothing, learned).count() == 0
    both = spark.createDataFrame([(9, 1), (9, 0), (24, 0), (24, 0)], "doc_id long, toxic int")
    assert toxicity.learn(tricky, both).any()


# 2


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1919, 1920, 1921, 15360, 15361, 200_000])
def test_transport_stream_round_trip(n):
    payload = media.padded(random.Random(n).randbytes(n))
    stream = media.mux(payload)
    got = media.demux(stream)
    assert got.payload == payload and len(stream) % 188 == 0 and got.programs == {1: 0x1000} and got.continuity_errors == 0
    assert got.pts.tolist() == [3600 * i for i in range(-(-len(payload) // 1920))] and got.random_access.tolist() == [i % 8 == 0 for i in range(len(got.pts))]
    assert got.offset.tolist() == [1920 * i for i in range(len(got.pts))]


def test_damaged_streams_are_refused():
    stream = bytearray(media.mux(media.padded(b"x" * 5000)))
    for at, what in ((0, "sync"), (12, "checksum"), (188 * 4 + 3, "counter")):
        hurt = bytearray(stream)
        hurt[at] ^= 0x05
        with pytest.raises(ValueError):
            media.demux(bytes(hurt))
            pytest.fail(what)
    with pytest.raises(ValueError):
        media.demux(bytes(stream[: 188 * 4] + stream[188 * 5 :]))
    again = bytes(stream[: 188 * 4] + stream[188 * 3 : 188 * 4] + stream[188 * 4 :])
    assert media.demux(again).payload == media.padded(b"x" * 5000)  # a repeated packet is allowed


def test_media_columns(spark, tricky, nothing):
    out = by_id(media.features(media.read_media(media.store_documents(clashing(tricky)))))
    texts = {r[0]: (r[1] or "").encode() for r in tricky_rows() if r[0] is not None}
    for i, t in texts.items():
        payload = t.ljust(max(1, -(-len(t) // 192)) * 192)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert out[24]["media_sha256"] == out[27]["media_sha256"] and out[24]["feature"] == out[27]["feature"]
    same_length = spark.createDataFrame([(1, "abc", None, None, 3), (2, "abd", None, None, 3)], SCHEMA)
    pair = by_id(media.features(media.read_media(media.written(media.store_documents(same_length)))))
    assert pair[1]["feature"] != pair[2]["feature"]


def transport_stream(payload):
    """The same stream, packet by packet, from the standard's bit fields."""

    def bits(*fields):
        value = int("1" + "".join(f"{v:0{n}b}" for v, n in fields), 2)
        return value.to_bytes((value.bit_length() + 7) // 8, "big")[1:]

    def crc(data):
        c = 0xFFFFFFFF
        for b in data:
            for k in range(7, -1, -1):
                c = (c << 1 ^ (0x04C11DB7 if (c >> 31 ^ b >> k) & 1 else 0)) & 0xFFFFFFFF
        return c.to_bytes(4, "big")

    def section(table, number, body):
        head = bits((table, 8), (1, 1), (0, 1), (3, 2), (len(body) + 9, 12), (number, 16), (3, 2), (0, 5), (1, 1), (0, 8), (0, 8))
        return head + body + crc(head + body)

    pat = section(0, 1, bits((1, 16), (7, 3), (0x1000, 13)))
    pmt = section(2, 1, bits((7, 3), (0x100, 13), (15, 4), (0, 12), (6, 8), (7, 3), (0x100, 13), (15, 4), (0, 12)))
    out, counters = [], Counter()

    def packet(pid, start, field, data):
        out.append((bits((0x47, 8), (0, 1), (start, 1), (0, 1), (pid, 13), (0, 2), (field is not None, 1), (1, 1), (counters[pid] % 16, 4)) + (field or b"") + data))
        counters[pid] += 1
        assert len(out[-1]) == 188

    for n in range(0, len(payload), 1920):
        unit, number = payload[n : n + 1920], n // 1920
        if number % 8 == 0:
            for pid, x in ((0, pat), (0x1000, pmt)):
                packet(pid, 1, None, b"\x00" + x + b"\xff" * (183 - len(x)))
        pts = number * 3600
        pes = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + bits((2, 4), (pts >> 30, 3), (1, 1), (pts >> 15 & 0x7FFF, 15), (1, 1), (pts & 0x7FFF, 15), (1, 1)) + unit
        clock = bits((0, 1), (number % 8 == 0, 1), (0, 1), (1, 1), (0, 4), (pts, 33), (63, 6), (0, 9))
        room = 184 - 1 - len(clock)
        lead = pes[:room]
        field = clock + b"\xff" * (room - len(lead))
        packet(0x100, 1, bytes([len(field)]) + field, lead)
        for k in range(room, len(pes), 184):
            data = pes[k : k + 184]
            short = 184 - len(data)
            packet(0x100, 0, None if not short else bytes([short - 1]) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b""), data)
    return b"".join(out)


@pytest.mark.parametrize("n", [0, 1, 192, 193, 1920, 1921, 15360, 15361, 40_000])
def test_transport_stream_equals_plain(n):
    payload = media.padded(random.Random(n).randbytes(n))
    assert media.mux(payload) == transport_stream(payload)


def test_media_groups():
    payload = media.padded(random.Random(3).randbytes(40_000))
    rows_ = media.group_rows(media.demux(media.mux(payload)))
    assert [r["offset"] for r in rows_] == list(range(0, len(payload), 15360)) and sum(r["bytes"] for r in rows_) == len(payload)
    for r in rows_:
        part = payload[r["offset"] : r["offset"] + r["bytes"]]
        assert (r["pts"], r["crc32"], r["byte_sum"], r["distinct"]) == (r["offset"] // 1920 * 3600, zlib.crc32(part), sum(part), len({*part}))


def test_media_of_nothing(nothing):
    assert media.read_media(media.store_documents(nothing)).count() == 0


# 3


def test_targets():
    assert mixture.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    t = mixture.targets([10, 1000, 5, 0], [1, 2, 3, 1])
    assert sum(t) == pytest.approx(1015) and t[2] == 15 and t[3] == 0 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [10, 1000, 5, 0], strict=True))
    assert mixture.targets([], []) == [] and mixture.targets([0, 0], [1, 2]) == [0, 0]


def test_splitting_tree_keeps_quotas():
    counts = [1000, 1, 0, 77]
    parts = mixture.split_quotas(counts, 16)
    assert np.array(parts).sum(axis=0).tolist() == counts and (np.array(parts) >= 0).all()
    sizes = [sum(p) for p in parts]
    assert max(sizes) - min(sizes) <= 5
    assert parts == mixture.split_quotas(counts, 16)
    huge = [3 * 10**10, 10**9]
    assert np.array(mixture.split_quotas(huge, 8)).sum(axis=0).tolist() == huge


def test_mixture(spark, tricky, nothing, monkeypatch):
    monkeypatch.setattr(mixture, "BIN", 16)
    got = mixture.taken(clashing(tricky)).collect()
    order = lambda r: tuple(str(x) for x in r)
    assert len(got) == len(tricky_rows()) and sorted(got, key=order) == sorted(mixture.taken(tricky).collect(), key=order)
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        p = per[r["source"]]
        p[0] += r["size"]
        p[1] += r["taken"]
        p[2] = r["target"]
        assert r["source_size"] == sum(len(brute.words(t[1])) for t in tricky_rows() if t[3] == r["source"])
    names = sorted(per, key=lambda s: (s is None, s or ""))
    assert [per[s][2] for s in names] == pytest.approx(mixture.targets([per[s][0] for s in names], [1, 2, 3, 1][: len(names)]))
    assert all(abs(p[1] - p[2]) <= mixture.BLOCK for p in per.values())
    assert mixture.taken(nothing).count() == 0


def test_hypergeometric_draws():
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 6), (1, 3, 2), (40, 2, 30)):
        got = Counter(mixture.hypergeometric(rng, good, bad, n) for _ in range(4000))
        for x in range(max(0, n - bad), min(n, good) + 1):
            p = math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n)
            assert abs(got.pop(x, 0) / 4000 - p) < 5 * math.sqrt(p / 4000) + 1e-3
        assert not got
    assert [mixture.hypergeometric(rng, *x) for x in ((0, 9, 4), (9, 0, 4), (5, 5, 0), (5, 5, 10), (0, 0, 0))] == [0, 4, 0, 5, 0]
    good, bad, n = 10**10, 3 * 10**10, 2 * 10**10  # beyond numpy's own sampler
    got = np.array([mixture.hypergeometric(rng, good, bad, n) for _ in range(400)], np.float64)
    sd = math.sqrt(n * 0.25 * 0.75 * 0.5)
    assert abs(got.mean() - n / 4) < 5 * sd / 20 and 0.8 < got.std() / sd < 1.2


def plain_mix(units, sources, shards):
    """(shard, k1, k2, copy, block) of every draw: sort each source's blocks, draw whole passes and one more, cut by quotas."""
    lists = []
    for x in sources:
        rows = []
        for u in (u for u in units if u["source"] == x.name and u["size"]):
            b = mixture.blocks_of(*(np.array([v], np.int64) for v in (u["k1"], u["k2"], 0, u["copies"], u["size"])))
            rows += [(h, g, w, (u["k1"], u["k2"], c, k)) for h, g, w, c, k in zip(*(a.tolist() for a in (b.h, b.g, b.words, b.copy, b.block)), strict=True)]
        rows.sort()
        drawn, at = [r[3] for r in rows] * x.passes, 0
        for _, _, w, key in rows:
            if at + w / 2 <= x.rest:
                drawn.append(key)
            at += w
        lists.append(drawn)
    out, done = [], [0] * len(lists)
    for shard, quota in enumerate(mixture.split_quotas([len(x) for x in lists], shards)):
        for i, q in enumerate(quota):
            out += [(shard, *key) for key in lists[i][done[i] : done[i] + q]]
            done[i] += q
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_mix_equals_plain(spark, tricky, monkeypatch, small):
    if small:  # many bins, and copies in pieces
        monkeypatch.setattr(mixture, "BIN", 3)
        monkeypatch.setattr(mixture, "PIECE", 2)
    hot = spark.createDataFrame([(5000, "w " * 100, None, "hot", 1)] * 30 + [(5001, "v " * 900, None, "hot", 1)], SCHEMA)
    docs = tricky.unionByName(hot)
    units = mixture.sized(docs)
    sources = mixture.plan(units)
    for shards in (1, 7):
        got = mixture.draw(docs, units, sources, mixture.find_ends(units, sources, shards)).collect()
        assert Counter((r["shard"], r["k1"], r["k2"], r["copy"], r["block"]) for r in got) == plain_mix(units.collect(), sources, shards)
    monkeypatch.setattr(mixture, "split_quotas", lambda counts, shards, seed=0: [counts] + [[0] * len(counts)] * (shards - 1))
    alone = mixture.draw(docs, units, sources, mixture.find_ends(units, sources, 7))
    assert {r["shard"] for r in alone.collect()} == {0}


def test_shards_hold_disjoint_blocks(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    units = mixture.sized(docs)
    shown = mixture.write_mix(docs, units, mixture.plan(units), shards=4)
    draws = shown.toPandas()
    assert set(draws["shard"]) == {0, 1, 2, 3}
    assert draws.groupby(["doc_id", "copy", "block"]).size().max() <= 3 and not draws.duplicated(["doc_id", "block", "place"]).any()
    n = draws.groupby("shard").size()
    assert n.max() - n.min() <= 4
    texts = {r["doc_id"]: " ".join(brute.words(r["text"])) for r in docs.collect()}
    assert all(t in texts[i] for i, t in zip(draws["doc_id"], draws["text"], strict=True))
    parts = shown.withColumn("part", F.spark_partition_id()).withColumn("file", F.input_file_name()).toPandas()
    for _, rows_ in parts.groupby(["file", "part", "shard"]):
        assert rows_["place"].is_monotonic_increasing


def test_every_draw_is_written_once(spark, tricky, monkeypatch):
    """Null and repeated ids, and different texts that share an id."""
    monkeypatch.setattr(mixture, "BIN", 16)
    rng, vocab = random.Random(5), vocabulary()
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    extra = [(3000, make(200), None, "a", 1), (3000, make(200), None, "a", 1), (None, make(300), None, "c", 1), (None, make(300), None, "c", 1)]
    docs = tricky.unionByName(spark.createDataFrame(extra, SCHEMA))
    units = mixture.sized(docs)
    sources = mixture.plan(units)
    shown = [r.asDict() | {"source": sources[r["s"]].name} for r in mixture.write_mix(docs, units, sources, shards=4).collect()]
    assert Counter((r["shard"], r["k1"], r["k2"], r["copy"], r["block"]) for r in shown) == plain_mix(units.collect(), sources, 4)
    assert {r["doc_id"] for r in shown} >= {None, 3000}
    cut = Counter()
    for i, t, _, s, _ in tricky_rows() + extra:
        w = brute.words(t)
        for b in range(0, len(w), mixture.BLOCK):
            cut[i, s, " ".join(w[b : b + mixture.BLOCK])] += 1
    got = Counter((r["doc_id"], r["source"], r["text"]) for r in shown)
    assert set(got) <= set(cut) and all(n <= 3 * cut[k] for k, n in got.items())


def test_taken_is_what_the_shards_hold(spark, tricky, monkeypatch):
    written, write = [], mixture.keep
    monkeypatch.setattr(mixture, "keep", lambda df, name, **more: (written.append((name, out := write(df, name, **more))), out)[1])
    got = mixture.taken(tricky).collect()
    held, want = Counter(), Counter()
    for r in dict(written)["shards"].collect():
        held[r["doc_id"], r["shard"]] += len(brute.words(r["text"]))
    for r in got:
        assert r["taken"] == sum(x["words"] for x in r["shards"])
        for x in r["shards"]:
            want[r["doc_id"], x["shard"]] += x["words"]
    assert want == held and len({k[1] for k in held}) == mixture.LEAST_SHARDS


# 4


def test_fingerprints():
    texts = [r[1] for r in tricky_rows()] + [" ".join(random.Random(4).choices(vocabulary(), k=400_000))]  # some MB
    got = simhash.fingerprints(pa.array(texts, pa.string()))
    assert got.tolist() == [brute.fingerprint(t) for t in texts]


def clustered(n=300, seed=3):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randint(0, 12)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("salted", [False, True])
def test_trie_join_finds_every_component(spark, monkeypatch, salted):
    if salted:  # node pairs go far down in the plan
        monkeypatch.setattr(simhash, "NODE", 3)
        monkeypatch.setattr(simhash, "PAIRS", 4)
    fps = clustered()
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.near_links(df)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 64
    star = {r["a"]: r["root"] for r in components.stars(edges).collect()}
    want = brute.components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [star.get(x, x) for x in signed]
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_walk_prunes_and_finds_all(monkeypatch):
    fps = np.array(clustered(200), np.uint64)
    want = {(int(fps[a]), int(fps[b])) for b in range(len(fps)) for a in range(b) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 4}
    for most in (500_000, 7):
        monkeypatch.setattr(simhash, "PAIRS", most)
        got, visited = set(), 0
        for n in simhash.TURNS:
            x = np.sort(fps << np.uint64(n) | (fps >> np.uint64(64 - n) if n else np.uint64(0)))
            back = (x >> np.uint64(n) | (x << np.uint64(64 - n) if n else np.uint64(0))).tolist()
            lo, hi = np.array([0]), np.array([len(x)])
            found = simhash.walk(x, lo, hi, lo, hi)
            assert len({*zip(found.i.tolist(), found.j.tolist())}) == len(found.i)
            got |= {tuple(sorted((back[i], back[j]))) for i, j in zip(found.i.tolist(), found.j.tolist(), strict=True)}
            visited += len(found.i) + found.pruned
        assert got == want
        assert 0 < visited < 3 * len(fps) * (len(fps) - 1) / 4  # whole subtrees go at once


def test_frontier_prunes_node_pairs(spark, monkeypatch):
    """The plan's node pairs are those of existing nodes within the budget, and no others."""
    monkeypatch.setattr(simhash, "NODE", 12)
    fps = clustered(400, 9)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = defaultdict(set)
    for depth, pairs in simhash.frontier(spark.createDataFrame([(x,) for x in signed], "fp long")):
        for r in pairs.collect():
            got[depth].add((r["r"], r["a"], r["b"]))
    want = defaultdict(set)
    for r, n in enumerate(simhash.TURNS):
        x = [(f << n | f >> (64 - n)) & ((1 << 64) - 1) for f in fps]
        level, depth = [(0, 0)], 0
        while level:
            count = Counter(v >> (64 - depth) for v in x)
            large = [(a, b) for a, b in level if max(count[a], count[b]) > 12]
            want[depth] |= {(r, a, b) for a, b in level if (a, b) not in large and (a != b or count[a] > 1)}
            step = min(4, 21 - depth if depth < 21 else 64 - depth)
            kids = defaultdict(set)
            for v in x:
                kids[v >> (64 - depth)].add(v >> (64 - depth - step))
            depth += step
            most = 1 if depth <= 21 else 4
            level = [(c, d) for a, b in large for c in kids[a] for d in kids[b] if (a != b or c <= d) and (c ^ d).bit_count() <= most]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and len([v for v in got.values() if v]) > 1


@pytest.mark.parametrize("salted", [False, True])
def test_large_bucket_of_mixed_sign(spark, monkeypatch, salted):
    """Links whose bits differ in several thirds, the top one among them."""
    if salted:
        monkeypatch.setattr(simhash, "NODE", 100)
    rng = random.Random(11)
    first = [rng.getrandbits(42) << 22 | 0x155555 for _ in range(900)]
    fps = np.array(sorted({x ^ y for x in first for y in (0, 1 << rng.randrange(22, 33) | 1 << rng.randrange(33, 44) | 1 << rng.randrange(44, 54) | 1 << rng.randrange(54, 64))}), np.uint64)
    assert len(fps) == 1800
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"))
    unsigned = lambda x: x & ((1 << 64) - 1)
    got = {tuple(sorted((unsigned(r["a"]), unsigned(r["b"])))) for r in edges.collect()}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = {(int(fps[i]), int(fps[j])) for i, j in near}
    assert len(want) == 900 and got == want


def test_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (501, 501)], "a long, b long")
    star = {r["a"]: r["root"] for r in components.stars(chain).collect()}
    assert star == {i: 0 for i in range(1, 101)} | {501: 500}


def test_near_duplicates(spark, tricky, nothing):
    got = simhash.components(clashing(tricky)).collect()
    data = tricky_rows()
    fps = [brute.fingerprint(r[1]) for r in data]
    root = brute.components(fps)
    ids = defaultdict(list)
    for r, k in zip(data, root, strict=True):
        ids[k].append(r[0])
    want = Counter((r[0], f"{f:016x}", min((x for x in ids[k] if x is not None), default=None)) for r, f, k in zip(data, fps, root, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.survivors(tricky)
    assert kept.columns == tricky.columns
    left = [r["doc_id"] for r in kept.where("doc_id is not null").collect()]
    assert len(left) == len(set(left)) and set(left) == {r["component_id"] for r in got if r["component_id"] is not None}
    assert simhash.components(nothing).count() == 0 and simhash.survivors(nothing).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Ids that are null, or shared by different texts."""
    a, b, c, d, e = (" ".join(random.Random(n).choices(vocabulary(), k=30)) for n in range(5))
    data = [(1, a), (5, a), (5, b), (2, c), (2, d), (None, e), (None, e), (None, e + "  "), (None, a), (None, None), (None, ""), (9, c)]
    docs = spark.createDataFrame([(i, t, "xx", None if k % 2 else "s", k) for k, (i, t) in enumerate(data)], SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in simhash.survivors(docs).collect()]
    groups = brute.components([brute.fingerprint(t) for _, t in data])
    of = dict(zip(data, groups, strict=True))
    assert len(set(groups)) == 6 and sorted(of[k] for k in kept) == sorted(set(groups))
    assert {(1, a), (5, b), (2, c), (2, d)} < set(kept)


# 5


def test_repeats_are_removed(spark, tricky, nothing):
    data = tricky_rows()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]), r) for r in substrings.remove_repeats(clashing(tricky).select(*tricky.columns, "tk", "runs", "_runs", "fp")).collect())
    want = sorted(((r[0] is None, r[0] or 0, len(brute.words(r[1]))), k) for r, k in zip(data, brute.kept_words([r[1] for r in data]), strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    for (key, r), (_, kept) in zip(got, want, strict=True):
        assert (r["n_removed"], r["kept_sha256"]) == (key[2] - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()), key
        assert brute.words(r["text"]) == kept
        if not r["n_removed"]:
            assert r["text"] in {t[1] for t in data}
    assert substrings.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_mosaics(spark, seed):
    rng = random.Random(seed)
    vocab = vocabulary(40, seed)
    pieces = [[rng.choice(vocab) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(pieces)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(substrings.remove_repeats(df, 20, 6))
    for i, kept in enumerate(brute.kept_words(texts, 20)):
        assert brute.words(got[i]["text"]) == kept


def test_contexts_are_extended_to_the_first_difference():
    rng = np.random.default_rng(4)
    sides, want = [[[], [], [], []], [[], [], [], []]], []
    for _ in range(300):
        core = rng.integers(0, 3, rng.integers(1, 9)).tolist()
        pair = []
        for words, start, end, at in sides:
            left, right = rng.integers(0, 3, rng.integers(0, 6)).tolist(), rng.integers(0, 3, rng.integers(0, 6)).tolist()
            start.append(len(words))
            words += left + core + right
            end.append(len(words))
            at.append(len(left))
            pair.append((left[::-1], core + right))
        count = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        want.append(tuple(count(pair[0][k], pair[1][k]) for k in (0, 1)))
    left, right = substrings.shared(*(np.array(x, np.int64) for side in sides for x in side))
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_extension_and_the_rest_find_different_repeats(spark, monkeypatch):
    """Two of three texts share more than either shares with the representative; each step alone misses something."""
    rng, vocab = random.Random(6), vocabulary()
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    core, more, other = make(19), make(10), make(30)
    texts = [make(20) + core + make(20), make(20) + core + more + make(20), make(20) + core + more + make(20), make(5) + other + make(20), make(9) + other]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [len(t) - len(k) for t, k in zip(texts, brute.kept_words([" ".join(t) for t in texts], 20), strict=True)]
    got = lambda: [r["n_removed"] for r in substrings.remove_repeats(df, 20, 6).orderBy("doc_id").collect()]
    assert got() == want == [0, 29, 29, 30, 30]
    rest = substrings._rest
    monkeypatch.setattr(substrings, "_rest", lambda extended, length: rest(extended.where("false"), length))
    only_extended = got()
    assert only_extended != want and all(x <= y for x, y in zip(only_extended, want, strict=True)) and any(only_extended)
    monkeypatch.setattr(substrings, "_rest", lambda extended, length: rest(extended, length))
    monkeypatch.setattr(substrings, "_extended", lambda pairs, length: pairs.drop("r_words").withColumns({"low": F.lit(0), "high": F.lit(0)}))
    assert got() != want


# 6


def test_grams_stay_inside_texts():
    texts = ["ab cd!!", "ab cd!!", "", "ab ab"]
    text, gram = quality.grams(pa.array(texts))
    by = defaultdict(list)
    for t, g in zip(text.tolist(), gram.tolist(), strict=True):
        by[t].append(g)
    assert sorted(by[0]) == sorted(by[1]) and len(by[0]) == 3 + 2 + 3 + 2 and 2 not in by and len(by[3]) == 2 + 1 + 2 + 1


def test_kth_greatest(spark):
    values = [random.Random(5).gauss(0, 1) for _ in range(5000)] + [0.5] * 3000
    df = spark.createDataFrame([(v,) for v in values], "x double")
    top = sorted(values, reverse=True)
    for k in (1, 17, 2500, 6000, 8000):
        assert quality.kth_greatest(df, "x", k) == top[k - 1]
    assert quality.kth_greatest(df, "x", 0) == math.inf


def test_quality_separates(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    weighed = quality.weigh(docs, quality.learn(docs, labels, usable=learn)).withColumn("noise", quality.noise())
    scored = quality.resample(weighed).join(labels.where(~learn), "doc_id").toPandas()
    assert scored[scored["quality"] == 1]["kept"].mean() > 0.98 and scored[scored["quality"] == 0]["kept"].mean() < 0.15


def test_quality_cases(spark, tricky, nothing):
    labels = spark.createDataFrame([(24, 1), (24, 1), (30, None), (None, 1), (60, 0)], "doc_id long, quality int")
    out = quality.select(clashing(tricky), labels).collect()
    assert len(out) == len(tricky_rows()) and all(r["log_weight"] == 0 and r["kept"] for r in out if r["n_grams"] == 0)
    assert all(r["kept"] for r in quality.select(tricky, labels.where("false")).collect())
    assert quality.filtered(clashing(tricky), labels).columns == clashing(tricky).columns
    assert quality.select(nothing, labels).count() == 0
    top = quality.resample(quality.weigh(tricky, quality.learn(tricky, labels)).withColumn("noise", quality.noise()), k=5)
    assert 5 <= top.where("kept").count() <= 8


def test_inclusion_follows_the_weights(spark):
    """Gumbel top-k draws as drawing one text after the other by weight does; without noise it doesn't."""
    weight = [0.0, 1.0, 2.0, 3.0]
    rows_ = spark.range(4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.element_at(F.array(*map(F.lit, weight)), F.col("id").cast("int") + 1).alias("log_weight"))
    got = Counter()
    noises = rows_.select("doc_id", "log_weight", *(quality.noise(seed).alias(f"n{seed}") for seed in range(600))).collect()
    for seed in range(600):
        got.update(r["doc_id"] for r in sorted(noises, key=lambda r: -r["log_weight"] - r[f"n{seed}"])[:2])
    p = np.exp(weight) / np.exp(weight).sum()
    for i in range(4):
        want = p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(4) if j != i)
        assert abs(got[i] / 600 - want) < 0.07
    kept = [{r["doc_id"] for r in quality.resample(rows_.withColumn("noise", quality.noise(seed)), k=2).where("kept").collect()} for seed in range(3)]
    assert kept == [{r["doc_id"] for r in sorted(noises, key=lambda r: -r["log_weight"] - r[f"n{seed}"])[:2]} for seed in range(3)]
    assert {r["doc_id"] for r in quality.resample(rows_.withColumn("noise", quality.noise()), k=2, temperature=1e-6).where("kept").collect()} == {2, 3}


# 7


def expected_base(data, held):
    tok = [brute.words(brute.lower(t)) + [" end"] for _, t in data]
    count = Counter(x for t, h in zip(tok, held, strict=True) if not h for x in t)
    n, v = sum(count.values()), len(count)
    return [(len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) for t in tok]


def test_base_scores_and_normalisation(spark, tricky, nothing, monkeypatch):
    monkeypatch.setattr(bilinear, "FREQUENT", 40)
    data = [(r[0], r[1]) for r in tricky_rows()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in data]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]), r) for r in bilinear.score_all(clashing(tricky)).collect())
    want = sorted(((i is None, i or 0, e[0]), h, e) for (i, _), h, e in zip(data, held, expected_base(data, held), strict=True))
    for (key, r), (other, h, e) in zip(got, want, strict=True):
        assert key == other and r["held_out"] == h and (r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:3]
        assert r["base_score"] == pytest.approx(e[3]) and r["score"] < 0
    assert bilinear.score_all(nothing).count() == 0
    nobody = bilinear.score_all(tricky.limit(5), held=F.lit(True)).collect()
    assert len(nobody) == 5 and all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in nobody)


def test_model_is_normalised_and_learns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    learned = docs.where(~bilinear.held_out())
    counts = bilinear.token_counts(learned).cache()
    known = bilinear.gather(counts, learned.count())
    model = bilinear.train(learned, known)
    a1, a2, z = model.tables()
    p = np.exp(a1[:, None, :] + a2[None, :, :] - z.T[:, :, None]).sum(axis=2)  # last, one before
    assert np.allclose(p, 1, atol=1e-3)
    total = lambda m: bilinear.score(docs.where(bilinear.held_out()), counts, known, m).agg(F.sum("score")).first()[0]
    assert total(model) > total(bilinear.Bilinear(known.class_counts))


def test_scores_equal_plain(spark, tricky, monkeypatch):
    """Every token's class and share, one by one, with a softmax over all classes."""
    monkeypatch.setattr(bilinear, "FREQUENT", 40)
    docs = tricky.where("doc_id is null or length(text) < 5000 or text is null")
    counts = bilinear.token_counts(docs).cache()
    count = {r["token"]: r["n"] for r in counts.collect()}
    known = bilinear.gather(counts, docs.count())
    model = bilinear.train(docs, known)
    listed = sorted(count, key=lambda t: (-count[t], t))[: min(bilinear.LISTED, len(known.hashes))]

    def slot(token):
        return int(bilinear.slots(W.split_words(pa.array([token]), W.NOT_SPACE))[0])

    classes = {t: listed.index(t) if t in listed else int(known.slot_classes[slot(t)]) for t in count}
    members = defaultdict(list)
    for t, c in classes.items():
        if c > bilinear.END:
            members[c].append(count[t])
    context, predicted = model.context.astype(float), model.predicted.astype(float)

    def plain(text):
        tokens_ = brute.words(brute.lower(text))
        one = two = bilinear.END
        total = 0.0
        for t in [*tokens_, None]:
            c = bilinear.END if t is None else classes[t]
            scores = predicted @ (context[one] @ model.one + context[two] @ model.two) + model.bias
            total += (scores[c] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / math.log(10)
            if c > bilinear.END:
                total += math.log10((count[t] + 1) / (sum(members[c]) + len(members[c]) + 1))
            one, two = c, one
        return total

    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in bilinear.score(docs, counts, known, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"], len(brute.words(brute.lower(r["text"]))) + 1] == pytest.approx(plain(r["text"]), rel=1e-4)


def test_training_does_not_depend_on_tasks(spark, tricky, monkeypatch):
    monkeypatch.setattr(bilinear, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(bilinear, "PIECE", 2)
    docs = tricky.unionByName(spark.createDataFrame([(7, "so it goes", None, None, 1)] * 9, SCHEMA))
    counts = bilinear.token_counts(docs).cache()
    known = bilinear.gather(counts, docs.count())
    models = [bilinear.train(d, known).flat() for d in (docs.repartition(1), docs.repartition(7, "text"), docs.coalesce(2))]
    assert all((m == models[0]).all() for m in models[1:]) and (models[0] != bilinear.Bilinear(known.class_counts).flat()).any()
    parts = bilinear.sequences(docs, known, 3).collect()
    assert sum(r["copies"] for r in parts) == docs.count() and max(r["copies"] for r in parts) == 2 and {r["shard"] for r in parts} == {0, 1, 2}
    assert sum(r["copies"] * len(r["classes"]) // 2 for r in parts) == known.total


# 8


def test_token_attribution(spark, tricky, nothing):
    out = by_id(tokens.attribute(clashing(tricky)))
    encoding, size = tokens._encoding(open(tokens.VOCABULARY, "rb").read(), tokens.PATTERN)
    for i, text, *_ in tricky_rows():
        if i is None:
            continue
        text = text or ""
        data = text.encode()
        ids = encoding.encode_ordinary(text)
        starts = [k for k in range(len(data)) if k == 0 or data[k - 1 : k] == b"\n" or data[k - 2 : k] == b". "]
        ends = [*starts[1:], len(data)]
        count, at = Counter(), 0
        for t in ids:
            end = at + int(size[t])
            near = range(max(0, bisect.bisect_right(starts, at) - 1), min(len(starts), bisect.bisect_left(starts, end) + 1))
            count[max(near, key=lambda k: (min(end, ends[k]) - max(at, starts[k]), -k))] += 1
            at = end
        r = out[i]
        assert r["n_tokens"] == len(ids) and [s["tokens"] for s in r["sections"]] == [count[k] for k in range(len(starts))]
        assert sum(s["chars"] for s in r["sections"]) == len(text)
    assert tokens.summary(tokens.attribute(nothing)).count() == 0


def test_one_text_of_some_mb(spark):
    """Tokens and sections of a very long text add up, and other operators take it whole."""
    text = ". ".join(" ".join(random.Random(k).choices(vocabulary(), k=20)) for k in range(25_000))
    df = spark.createDataFrame([(1, text, None, "a", len(text)), (2, "short", None, "a", 5)], SCHEMA)
    assert len(text) > 2_000_000
    r = by_id(tokens.attribute(df))[1]
    assert sum(s["tokens"] for s in r["sections"]) == r["n_tokens"] and sum(s["chars"] for s in r["sections"]) == len(text) and len(r["sections"]) == 25_000
    assert by_id(media.features(media.read_media(media.store_documents(df))))[1]["payload_bytes"] == len(text.encode()) + -len(text.encode()) % 192
    mix = by_id(mixture.taken(df))
    assert mix[1]["size"] == 500_000 and abs(mix[1]["taken"] + mix[2]["taken"] - 500_001) <= mixture.BLOCK
    bench = spark.createDataFrame([(1, " ".join(brute.words(text)[400_000:400_020]))], "item_id long, text string")
    assert by_id(decontaminate.contamination(df, bench))[1]["n_hit"] >= 20
    assert by_id(substrings.remove_repeats(df))[2]["n_removed"] == 0


def test_crossing_tokens_go_to_the_larger_share():
    begin, end = np.array([0, 3, 8]), np.array([3, 8, 9])
    owner, crossing = tokens.owners(begin, end, np.array([0, 5, 6]), 9)
    assert owner.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, False]
    assert tokens.owners(np.array([0]), np.array([9]), np.array([0, 2, 7]), 9)[0].tolist() == [1]


# 9


def items():
    data = tricky_rows()
    w = brute.words(data[16][1])
    return [(1, " ".join(w[100:140])), (1, " ".join(w[100:140])), (2, "One, TWO"), (3, None), (4, "..."), (None, "a b c"), (5, " ".join(w[500:513]).upper()), (6, "ab ab ab")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, tricky, nothing, block_bytes):
    bench = spark.createDataFrame(items(), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    named = [("null" if i is None else i, t) for i, t in items()]
    out = by_id(decontaminate.contamination(clashing(tricky), bench, block_bytes=block_bytes))
    for i, text, *_ in tricky_rows():
        if i is not None:
            assert (out[i]["n_words"], out[i]["n_hit"], out[i]["items"]) == brute.contamination(text, named), i
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(tricky, bench.where("false")).collect())


# 10


def conversation_rows():
    return [
        (1, 0, "system", "be & <|turn|>\n"), (1, 1, "user", "a"), (1, 2, "user", "&lt;b"), (1, 3, "assistant", "c<|end|>"), (1, 4, "assistant", ""), (1, 5, "assistant", None),
        (2, 0, "assistant", "é" * 3), (2, 0, "assistant", "ß"), (None, 0, "user", "x"), (3, None, None, None), (3, 1, "we\nird&nl;", "y"), (4, 0, "user", "z"), (4, 0, "user", "z"), (5, 1, "assistant", "q" * 70_000),
    ]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_conversations(formatted).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(conversation_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss_text"] for c, r in got.items()} == {c: "".join(x for role, x in t if role == "assistant") for c, t in want.items()}
    text = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert text[1].count(chat.TURN) == 3 and text[1].count(chat.PART) == 3 and text[1].count(chat.END) == 3
    assert chat.read_conversations(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_of_many_turns_is_linear(spark):
    """40,000 turns without a conversation's id, and one of them long: seconds, not minutes."""
    text = F.concat(F.lit("é <&> \U0001f600 "), F.repeat(F.lit("word "), F.when(F.col("id") == 7, 100_000).otherwise(40)), F.col("id"))
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    began = time.monotonic()
    r = chat.read_conversations(chat.format_conversations(df)).select(F.size("turns").alias("n"), "loss_text", "formatted_chars").first()
    assert time.monotonic() - began < 60
    assert r["n"] == 40_000 and r["loss_text"] == "".join(x["text"] for x in df.where("role = 'assistant'").orderBy("turn").collect())


def test_chat_spans_point_at_their_texts(spark):
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        raw = r["formatted"].encode()
        for s in r["loss_spans"]:
            assert r["formatted"][s["start"] : s["start"] + s["len"]] == raw[s["first_byte"] : s["first_byte"] + s["bytes"]].decode()

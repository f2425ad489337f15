"""Synthetic traffic for tests and training: deterministic, made of ranges and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.schemas import FLAGS


def uniform(*seed: object) -> Column:
    """A number in [0, 1) from the row id and a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.col("id"), *map(F.lit, seed)), 11).cast("double") / float(1 << 53)


def _packet(df: DataFrame, flags: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    base = {
        "protocol": F.lit(6), "packet_len": F.lit(60), "payload_len": F.lit(20).cast("long"), "dns_query": F.lit(None).cast("string"),
        **{f: F.lit(f in flags) for f in FLAGS},
    }
    out = df.select(*(c.alias(n) for n, c in (base | columns).items()))
    return out.withColumn("seq", F.xxhash64(*out.columns))


def flood(spark: SparkSession, n: int = 2500, victim: str = "10.9.9.9", start_us: int = 0, span_us: int = 9_000_000, port: int = 80) -> DataFrame:
    """SYNs to one victim and port, each from a port of its own."""
    i = F.col("id")
    src = F.concat(F.lit("10.8."), (i % 200 + 1).cast("string"), F.lit(".7"))
    at = (F.lit(start_us) + F.floor(i * span_us / n)).cast("long")
    return _packet(spark.range(n), ("syn",), src_ip=src, dst_ip=F.lit(victim), src_port=(1025 + F.floor(i / 200) % 60000 + i % 200 * 300).cast("int"), dst_port=F.lit(port), timestamp_us=at)


def scan(spark: SparkSession, ports: int = 60, scanner: str = "10.7.7.7", host: str = "10.9.9.8", start_us: int = 0, answered: bool = True) -> DataFrame:
    """A SYN to every port of a host, and resets in answer."""
    i = F.col("id")
    at = (F.lit(start_us) + i * 50_000).cast("long")
    out = _packet(spark.range(ports), ("syn",), src_ip=F.lit(scanner), dst_ip=F.lit(host), src_port=(40000 + i).cast("int"), dst_port=(20 + i).cast("int"), timestamp_us=at)
    back = _packet(spark.range(ports), ("rst", "ack"), src_ip=F.lit(host), dst_ip=F.lit(scanner), src_port=(20 + i).cast("int"), dst_port=(40000 + i).cast("int"), timestamp_us=at + 1000)
    return out.unionByName(back) if answered else out


def upload(spark: SparkSession, packets: int = 400, size: int = 1400, src: str = "10.1.1.1", dst: str = "198.51.100.9", start_us: int = 0) -> DataFrame:
    """One connection that sends much and gets little back."""
    i = F.col("id")
    back = i % 100 == 99
    return _packet(
        spark.range(packets), ("ack", "psh"),
        src_ip=F.when(back, dst).otherwise(src), dst_ip=F.when(back, src).otherwise(dst), src_port=F.when(back, 8444).otherwise(50000), dst_port=F.when(back, 50000).otherwise(8444),
        packet_len=F.when(back, 60).otherwise(size), timestamp_us=(F.lit(start_us) + i * 10_000).cast("long"),
    )


def beacon(spark: SparkSession, n: int = 8, period_us: int = 2_000_000, jitter_us: int = 0, src: str = "10.2.2.2", dst: str = "203.0.113.66", port: int = 9001, start_us: int = 0) -> DataFrame:
    """Regular connections: a SYN, data, and an answer each."""
    i = F.col("id")
    at = (F.lit(start_us) + i * period_us + F.floor(uniform("jitter") * jitter_us)).cast("long")
    sport = (41000 + i).cast("int")
    ends = {"src_ip": F.lit(src), "dst_ip": F.lit(dst), "src_port": sport, "dst_port": F.lit(port)}
    back = {"src_ip": F.lit(dst), "dst_ip": F.lit(src), "src_port": F.lit(port), "dst_port": sport}
    one = _packet(spark.range(n), ("syn",), timestamp_us=at, **ends)
    two = _packet(spark.range(n), ("syn", "ack"), timestamp_us=at + 1000, **back)
    three = _packet(spark.range(n), ("ack", "psh"), timestamp_us=at + 2000, packet_len=F.lit(90), **ends)
    return one.unionByName(two).unionByName(three)


def sessions(spark: SparkSession, n: int = 3, src: str = "10.3.3.3", dst: str = "203.0.113.44", port: int = 4444, start_us: int = 0) -> DataFrame:
    """Repeated sessions with real data: four data packets out, one answer."""
    i, k = F.floor(F.col("id") / 5), F.col("id") % 5
    back = k == 4
    sport = (42000 + i).cast("int")
    return _packet(
        spark.range(5 * n), ("ack", "psh"),
        src_ip=F.when(back, dst).otherwise(src), dst_ip=F.when(back, src).otherwise(dst), src_port=F.when(back, port).otherwise(sport), dst_port=F.when(back, sport).otherwise(port),
        packet_len=F.lit(220), timestamp_us=(F.lit(start_us) + i * 1_000_000 + k * 10_000).cast("long"),
    )


def lookups(spark: SparkSession, n: int = 20, src: str = "10.4.4.4", start_us: int = 0) -> DataFrame:
    """DNS queries for names that look generated."""
    name = F.concat(F.translate(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 14), "0123", "kqxz"), F.lit(".info"))
    return _packet(
        spark.range(n), src_ip=F.lit(src), dst_ip=F.lit("10.0.0.53"), src_port=(30000 + F.col("id")).cast("int"), dst_port=F.lit(53), protocol=F.lit(17), dns_query=name,
        timestamp_us=(F.lit(start_us) + F.col("id") * 100_000).cast("long"),
    )


def timeline(spark: SparkSession, phases: list[tuple[str, int]], benign: int = 40) -> DataFrame:
    """Benign flows throughout, and attacks ("flood", "scan", "upload", "beacon", "sessions", "lookups") that begin at given times (us)."""
    made = {"flood": flood, "scan": scan, "upload": upload, "beacon": beacon, "sessions": sessions, "lookups": lookups}
    parts = [made[name](spark, start_us=start) for name, start in phases]
    quiet = labelled_packets(spark, "DDoS", benign, 0).select(parts[0].columns if parts else "*")
    return reduce(DataFrame.unionByName, parts, quiet)


def _between(low: Column, high: Column, *seed: object) -> Column:
    return low + uniform(*seed) * (high - low)


def _of_profile(values: list[list[float]], label: Column, k: Column) -> Column:
    """values[label][k], by columns."""
    of = [F.element_at(F.array(*(F.lit(float(x)) for x in v)), F.pmod(k, F.lit(len(v))).cast("int") + 1) for v in values]
    return F.when(label == 1, of[1]).otherwise(of[0])


#: Benign and attack profiles of each class: packets out and back, their sizes, gap (ms), jitter (share of the gap), destination ports, share of SYN and of PSH
PROFILES: dict[str, tuple[list[dict], list[dict]]] = {
    "DDoS": (
        [
            {"out": (4, 30), "back": (6, 60), "size": (70, 400), "answer": (300, 1400), "gap": (15, 150), "jitter": (0.5, 1), "ports": (80, 443), "syn": 0.0, "psh": 0.4},
            {"out": (20, 80), "back": (20, 80), "size": (60, 200), "answer": (60, 300), "gap": (30, 120), "jitter": (0.5, 1), "ports": (22, 3389), "syn": 0.0, "psh": 0.6},
            {"out": (3, 6), "back": (2, 6), "size": (60, 90), "answer": (90, 300), "gap": (1, 20), "jitter": (0.2, 1), "ports": (53, 8080), "syn": 0.0, "psh": 0.2},
        ],
        [
            {"out": (60, 200), "back": (0, 3), "size": (40, 70), "answer": (40, 60), "gap": (0.05, 4), "jitter": (0, 0.5), "ports": (80, 443), "syn": 1.0, "psh": 0.0},
            {"out": (120, 200), "back": (0, 8), "size": (500, 1400), "answer": (40, 60), "gap": (0.05, 2), "jitter": (0, 0.3), "ports": (53, 443), "syn": 0.2, "psh": 0.0},
            {"out": (90, 160), "back": (60, 100), "size": (100, 300), "answer": (300, 900), "gap": (0.2, 3), "jitter": (0, 0.5), "ports": (80, 8080), "syn": 0.15, "psh": 0.3},
        ],
    ),
    "DataExfiltration": (
        [
            {"out": (8, 40), "back": (8, 90), "size": (120, 500), "answer": (400, 1400), "gap": (15, 200), "jitter": (0.5, 1), "ports": (443, 80), "syn": 0.0, "psh": 0.4},
            {"out": (20, 60), "back": (20, 60), "size": (100, 900), "answer": (100, 900), "gap": (20, 120), "jitter": (0.4, 1), "ports": (443, 993), "syn": 0.0, "psh": 0.6},
        ],
        [
            {"out": (60, 200), "back": (2, 12), "size": (900, 1460), "answer": (50, 80), "gap": (5, 40), "jitter": (0, 0.4), "ports": (443, 8444), "syn": 0.0, "psh": 0.7},
            {"out": (40, 120), "back": (2, 10), "size": (700, 1400), "answer": (50, 90), "gap": (40, 70), "jitter": (0, 0.2), "ports": (9001, 22), "syn": 0.0, "psh": 0.8},
        ],
    ),
    "EncryptedMalware": (
        [
            {"out": (4, 14), "back": (4, 20), "size": (70, 600), "answer": (100, 1200), "gap": (450, 900), "jitter": (0.7, 1), "ports": (22, 993), "syn": 0.0, "psh": 0.3},
            {"out": (5, 12), "back": (3, 9), "size": (60, 300), "answer": (60, 300), "gap": (500, 900), "jitter": (0.6, 1), "ports": (5222, 3389), "syn": 0.0, "psh": 0.5},
        ],
        [
            {"out": (4, 9), "back": (4, 9), "size": (180, 260), "answer": (120, 200), "gap": (600, 900), "jitter": (0, 0.1), "ports": (4444, 9001), "syn": 0.0, "psh": 0.9},
            {"out": (5, 10), "back": (3, 5), "size": (300, 380), "answer": (60, 90), "gap": (600, 800), "jitter": (0, 0.15), "ports": (6667, 8081), "syn": 0.0, "psh": 0.8},
        ],
    ),
}


#: Profiles that no detector is fitted on, for judging it: other software, other sizes, gaps and ports
UNSEEN: dict[str, tuple[list[dict], list[dict]]] = {
    "DDoS": (
        [
            {"out": (10, 50), "back": (80, 150), "size": (60, 120), "answer": (1000, 1450), "gap": (3, 25), "jitter": (0.3, 1), "ports": (8443, 1935), "syn": 0.0, "psh": 0.1},
            {"out": (15, 60), "back": (10, 40), "size": (150, 600), "answer": (150, 600), "gap": (8, 60), "jitter": (0.5, 1), "ports": (5432, 6379), "syn": 0.0, "psh": 0.7},
        ],
        [
            {"out": (80, 180), "back": (0, 12), "size": (44, 110), "answer": (40, 60), "gap": (1, 9), "jitter": (0.1, 0.8), "ports": (25, 5060), "syn": 0.8, "psh": 0.0},
            {"out": (100, 200), "back": (5, 30), "size": (250, 900), "answer": (60, 200), "gap": (0.1, 5), "jitter": (0, 0.6), "ports": (123, 8000), "syn": 0.1, "psh": 0.1},
        ],
    ),
    "DataExfiltration": (
        [
            {"out": (5, 25), "back": (60, 140), "size": (60, 200), "answer": (900, 1450), "gap": (5, 60), "jitter": (0.3, 1), "ports": (8443, 1935), "syn": 0.0, "psh": 0.2},
            {"out": (25, 70), "back": (15, 45), "size": (300, 1100), "answer": (100, 500), "gap": (25, 150), "jitter": (0.5, 1), "ports": (587, 5222), "syn": 0.0, "psh": 0.6},
        ],
        [
            {"out": (90, 180), "back": (8, 25), "size": (600, 1300), "answer": (60, 120), "gap": (10, 50), "jitter": (0.1, 0.7), "ports": (2049, 8022), "syn": 0.0, "psh": 0.5},
            {"out": (30, 80), "back": (2, 8), "size": (1000, 1460), "answer": (40, 90), "gap": (60, 110), "jitter": (0, 0.4), "ports": (445, 6697), "syn": 0.0, "psh": 0.9},
        ],
    ),
    "EncryptedMalware": (
        [
            {"out": (6, 18), "back": (6, 18), "size": (80, 900), "answer": (90, 900), "gap": (300, 700), "jitter": (0.5, 1), "ports": (143, 5900), "syn": 0.0, "psh": 0.4},
            {"out": (4, 10), "back": (4, 10), "size": (100, 350), "answer": (150, 450), "gap": (550, 900), "jitter": (0.5, 0.9), "ports": (1883, 22), "syn": 0.0, "psh": 0.7},
        ],
        [
            {"out": (5, 11), "back": (5, 11), "size": (220, 330), "answer": (140, 260), "gap": (500, 850), "jitter": (0, 0.25), "ports": (8888, 1337), "syn": 0.0, "psh": 0.8},
            {"out": (4, 8), "back": (3, 6), "size": (120, 190), "answer": (80, 130), "gap": (650, 900), "jitter": (0.05, 0.3), "ports": (4443, 9002), "syn": 0.0, "psh": 0.9},
        ],
    ),
}


def labelled_packets(spark: SparkSession, kind: str, benign: int = 1000, attack: int = 500, first: int = 0, profiles: dict[str, tuple[list[dict], list[dict]]] = PROFILES) -> DataFrame:
    """Packets of flows of a class; benign flows begin in even windows of 10 s, attacks in odd ones. Ids from ``first`` on give other flows."""
    both = profiles[kind]
    rows = spark.range(first, first + benign + attack).withColumn("label", (F.col("id") >= first + benign).cast("int")).withColumn("k", F.floor(uniform(kind, "k") * 12))
    label, k = F.col("label"), F.col("k")

    def drawn(name: str) -> Column:
        low, high = ([[x[name][e] for x in side] for side in both] for e in (0, 1))
        return _between(_of_profile(low, label, k), _of_profile(high, label, k), kind, name)

    port = F.when(uniform("port") < 0.5, _of_profile([[x["ports"][0] for x in side] for side in both], label, k)).otherwise(_of_profile([[x["ports"][1] for x in side] for side in both], label, k))
    share = lambda name: _of_profile([[x[name] for x in side] for side in both], label, k)
    rows = rows.select(
        "id", "label", F.floor(drawn("out")).alias("out"), F.floor(drawn("back")).alias("back"), drawn("size").alias("size"), drawn("answer").alias("answer"), drawn("gap").alias("gap"), drawn("jitter").alias("jitter"),
        port.cast("int").alias("port"), share("syn").alias("syn_share"), share("psh").alias("psh_share"),
    )
    rows = rows.withColumn("total", F.col("out") + F.col("back")).withColumn("gap", F.least(F.col("gap") * 1000, 9_300_000 / F.col("total")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    u = lambda name: F.shiftrightunsigned(F.xxhash64("id", "i", F.lit(name)), 11).cast("double") / float(1 << 53)
    back = F.floor((F.col("i") + 1) * F.col("back") / F.col("total")) > F.floor(F.col("i") * F.col("back") / F.col("total"))
    client, server = F.concat(F.lit("10."), (50 + label).cast("string"), F.lit("."), F.expr("cast(id div 250 as string)"), F.lit("."), (F.col("id") % 250 + 1).cast("string")), F.lit("198.18.0.9")
    sport, opens = (30000 + F.col("id") % 30000).cast("int"), F.col("i") == 0
    size = F.when(back, F.col("answer")).otherwise(F.col("size")) * (0.8 + 0.4 * u("size"))
    at = (2 * F.col("id") + label) * 10_000_000 + F.floor(F.col("i") * F.col("gap") + F.when(opens, 0.0).otherwise(F.col("jitter") * F.col("gap") * (u("at") - 0.5)))
    return rows.select(
        F.when(back, server).otherwise(client).alias("src_ip"), F.when(back, client).otherwise(server).alias("dst_ip"), F.when(back, F.col("port")).otherwise(sport).alias("src_port"), F.when(back, sport).otherwise(F.col("port")).alias("dst_port"),
        F.lit(6).alias("protocol"), at.alias("timestamp_us"), size.cast("int").alias("packet_len"), F.lit(0).cast("long").alias("payload_len"),
        (opens | (~back & (u("syn") < F.col("syn_share")))).alias("syn"), (~opens & (u("syn") >= F.col("syn_share"))).alias("ack"), F.lit(False).alias("rst"), (F.col("i") == F.col("total") - 1).alias("fin"), (~opens & (u("psh") < F.col("psh_share"))).alias("psh"), F.lit(False).alias("urg"),
        F.lit(None).cast("string").alias("dns_query"), F.xxhash64("id", "i").alias("seq"),
    )


def labelled_connections(spark: SparkSession, benign: int = 400, attack: int = 200, first: int = 0) -> DataFrame:
    """label and connection records of sources that use a few services, and of sources that scan ports or hosts."""
    rows = spark.range(first, first + benign + attack).withColumn("label", (F.col("id") >= first + benign).cast("int"))
    label = F.col("label") == 1
    n = F.floor(F.when(label, _between(F.lit(15.0), F.lit(120.0), "n")).otherwise(_between(F.lit(5.0), F.lit(60.0), "n")))
    rows = rows.withColumns({"n": n, "slow": uniform("slow"), "wide": uniform("wide") < 0.3}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    u = lambda name: F.shiftrightunsigned(F.xxhash64("id", "i", F.lit(name)), 11).cast("double") / float(1 << 53)
    port = F.when(label, F.when(F.col("wide"), F.lit(22)).otherwise(F.col("i") + 20)).otherwise(F.element_at(F.array(*map(F.lit, (443, 80, 53, 22))), F.floor(u("port") * u("port2") * 4).cast("int") + 1))
    host = F.when(label & F.col("wide"), F.col("i")).otherwise(F.floor(u("host") * F.when(label, 3).otherwise(12)))
    failed = u("state") < F.when(label, 0.85 - 0.5 * F.col("slow")).otherwise(0.05)
    state = F.when(failed, F.when(u("kind") < 0.5, "S0").otherwise("REJ")).otherwise(F.when(u("kind") < 0.8, "SF").otherwise("OTH"))
    at = F.floor(F.col("i") * 29e6 / F.col("n") + F.when(label, 0.0).otherwise(u("at") * 2e6))
    return rows.select(
        "label", at.cast("long").alias("ts_us"), F.concat(F.lit("10."), (60 + F.col("label")).cast("string"), F.lit("."), F.expr("cast(id div 250 as string)"), F.lit("."), (F.col("id") % 250 + 1).cast("string")).alias("src_ip"),
        F.concat(F.lit("172.20.0."), host.cast("string")).alias("dst_ip"), port.cast("string").alias("dst_port"), state.alias("conn_state"), F.when(failed, 0.0).otherwise(u("dur") * 5).alias("duration"),
        F.when(failed, 1.0).otherwise(F.floor(2 + u("pk") * 20)).alias("orig_pkts"), F.when(failed, 0.0).otherwise(F.floor(1 + u("rp") * 25)).alias("resp_pkts"), F.when(failed & (state == "S0"), "S").otherwise("-").alias("history"),
    )


def labelled_beacons(spark: SparkSession, window_s: int, benign: int = 400, attack: int = 200, first: int = 0) -> DataFrame:
    """label and flow records of hosts that call an endpoint regularly, or as people do, over one window each."""
    rows = spark.range(first, first + benign + attack).withColumn("label", (F.col("id") >= first + benign).cast("int"))
    label = F.col("label") == 1
    n = F.floor(F.when(label, _between(F.lit(5.0), F.lit(14.0), "n")).otherwise(_between(F.lit(1.0), F.lit(12.0), "n")))
    rows = rows.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    u = lambda name: F.shiftrightunsigned(F.xxhash64("id", "i", F.lit(name)), 11).cast("double") / float(1 << 53)
    width = window_s * 1_000_000
    at = F.when(label, (F.col("i") + 0.15 * u("at")) * (0.95 * width) / F.col("n")).otherwise(u("at") * u("at2") * 0.99 * width)
    same = F.when(label, 0.05).otherwise(1.0)
    return rows.select(
        "label", (F.col("id") * width + F.floor(at)).cast("long").alias("ts_us"), F.concat(F.lit("10."), (70 + F.col("label")).cast("string"), F.lit(".0."), F.expr("cast(id div 250 as string)"), F.lit("."), (F.col("id") % 250 + 1).cast("string")).alias("orig_h"),
        F.concat(F.lit("203.0.113."), (F.col("id") % 40).cast("string")).alias("resp_h"), F.lit(443).alias("resp_p"), F.lit("tcp").alias("proto"), F.floor(6 + 40 * same * u("op")).alias("orig_pkts"), F.floor(5 + 60 * same * u("rp")).alias("resp_pkts"),
        (0.3 + 8 * same * u("dur")).alias("duration"), F.floor(400 + 20_000 * same * u("ob")).alias("orig_ip_bytes"), F.floor(300 + 90_000 * same * u("rb")).alias("resp_ip_bytes"), F.concat(F.lit("T"), F.xxhash64("id", "i").cast("string")).alias("uid"),
    )

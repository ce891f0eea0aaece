"""Digests of sequences, numbers of rejected lines, counters and order of export datagrams."""
import hashlib
import random
import struct

from helpers import T0
from pyspark.sql import functions as F

from flowglass.operators.ordered import sequence_digest
from flowglass.plans import q_records
from flowglass.sources import events, exports


def digest(lines, size, levels=3):
    for level in range(levels):
        step = size if level < levels - 1 else max(len(lines), 1)
        lines = [hashlib.sha256("\n".join(lines[i : i + step]).encode()).hexdigest() for i in range(0, len(lines), step)]
    return lines[0]


def test_digest_of_a_sequence(spark):
    rng = random.Random(3)
    rows = [(i, T0 + rng.randrange(90_000_000), rng.choice("abc"), rng.choice(["x", "y", "ß\n", ""])) for i in range(900)] + [(9000, T0, "one", "x")]
    df = spark.createDataFrame(rows, "seq long, ts_us long, k string, t string")
    got = {r.k: (r.n, r.digest) for r in sequence_digest(df, ["k"], F.col("t"), size=7).collect()}
    for k in {r[2] for r in rows}:
        lines = [r[3] for r in sorted((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0]))]
        assert got[k] == (len(lines), digest(lines, 7))
    swapped = df.withColumn("t", F.when(F.col("seq") == 9000, "z").otherwise(F.col("t")))
    changed = {r.k: r.digest for r in sequence_digest(swapped, ["k"], F.col("t"), size=7).collect()}
    assert {k for k in changed if changed[k] != got[k][1]} == {"one"}


def test_a_long_sequence_makes_no_large_row(spark):
    df = spark.range(200_000).selectExpr("id as seq", f"{T0} + id * 1000 as ts_us", "'k' as k", "cast(id as string) as t")
    got = sequence_digest(df, ["k"], F.col("t"), size=256)
    assert got.first().digest == digest([str(i) for i in range(200_000)], 256)


def test_rejected_lines_of_several_splits(spark, tmp_path):
    rng = random.Random(1)
    want = set()
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for i in range(rng.choice([300, 700])):
            kind = rng.random()
            lines.append('{"seq": %d, "src_ip": "10.0.0.1", "ts_us": 5}' % i if kind < 0.6 else "" if kind < 0.7 else "   " if kind < 0.8 else f"broken ä {i}")
            if lines[-1].startswith("broken"):
                want.add((name, len(lines), lines[-1]))
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.jsonl" else ""))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in events.rejected_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert got == want and len(want) > 50


def v5(records, short=0):
    body = b"".join(struct.pack("!4s4s4xHHIIIIHHxBBB8x", bytes(map(int, a.split("."))), bytes([10, 0, 0, 9]), 0, 0, n, 100, 0, end, 1000, 80, 16, 6, 0) for a, n, end in records)
    return (struct.pack("!HHIIIIBBH", 5, len(records), 1000, 1_700_000_000, 0, 0, 0, 0, 0) + body)[: -short or None]


def ethernet(src, port, payload, protocol=17):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, protocol, 0, bytes(map(int, src.split("."))), bytes([10, 0, 0, 1]))
    return bytes(12) + b"\x08\x00" + ip + struct.pack("!HHHH", 4000, port, 8 + len(payload), 0) + payload


def sample(frame, rate):
    record = struct.pack("!IIIIII", 1, 16 + len(frame), 1, len(frame), 0, len(frame)) + frame
    flow = struct.pack("!IIIIIIII", 1, 1, rate, 0, 0, 0, 0, 1) + record
    return struct.pack("!IIIIIII", 5, 1, 0xC0000201, 0, 1, 0, 1) + struct.pack("!II", 1, len(flow)) + flow


def test_counters_and_order(spark):
    inner = ethernet("10.7.0.1", 99, b"hello")
    good = v5([("10.0.0.1", 3, 900), ("10.0.0.2", 0, 100), ("10.0.0.3", 5, 100), ("10.0.0.4", 1, 900)])
    payloads = [("10.0.0.5", 2055, good), ("10.0.0.5", 2055, v5([("10.0.0.1", 1, 1)], short=4)), ("10.0.0.5", 2055, b"\x00\x07abc"), ("10.0.0.5", 53, good), ("10.0.0.5", 2055, b""),
                ("10.0.0.5", 2055, sample(inner, 40)), ("10.0.0.5", 2055, struct.pack("!HHIIIHH", 10, 24, 0, 0, 7, 256, 8) + b"data")]
    rows = [(i, 1000 * i, bytearray(ethernet(*p))) for i, p in enumerate(payloads)] + [(99, 5, bytearray(b"short"))]
    frames = spark.createDataFrame(rows, "seq long, ts_us long, frame binary")
    assert exports.datagram_counters(frames, [2055]).first().asDict() == dict(datagrams=6, records=4, skipped_records=1, missing_template=1, malformed=1, unsupported=2, other_packets=2)
    d = spark.createDataFrame([(i, 1000 * i, "e", bytearray(p)) for i, (_, _, p) in enumerate(payloads)], "seq long, ts_us long, exporter string, payload binary")
    got = {}
    for r in exports.datagram_events(d.filter("seq in (0, 5)")).orderBy("seq", "place").collect():
        got.setdefault(r.seq, []).append((r.place, r.src_ip, r.packets))
    assert got == {0: [(0, "10.0.0.3", 5), (1, "10.0.0.1", 3), (2, "10.0.0.4", 1)], 5: [(0, "10.7.0.1", 40)]}
    assert exports.datagram_counters(frames.limit(0), [2055]).first().asDict() == dict(datagrams=0, records=0, skipped_records=0, missing_template=0, malformed=0, unsupported=0, other_packets=0)


def test_the_query_reads_every_datagram(spark):
    r = q_records.datagram_counters(spark, "/root/testdata/sf0.001").first()
    assert min(r) > 0


def test_sets_and_records_are_walked_once(spark):
    """Fields of their own length, cut fields, empty records and short sets; the plan holds no walk by expressions."""
    field = lambda *f: b"".join(struct.pack("!HH", *x) for x in f)
    message = lambda *sets: struct.pack("!HHIII", 10, 16 + len(b"".join(sets)), 1000, 0, 7) + b"".join(sets)
    one = lambda number, body: struct.pack("!HH", number, 4 + len(body)) + body
    template = one(2, struct.pack("!HH", 256, 5) + field((8, 4), (96, 65535), (12, 4), (2, 4), (1, 4)))
    record = lambda n, name, size=None: bytes([10, 0, 0, n]) + (bytes([len(name)]) if size is None else b"\xff" + struct.pack("!H", size)) + name + bytes([10, 0, 1, n]) + struct.pack("!II", n, 100 * n)
    body = record(1, b"") + record(2, b"abc") + record(3, b"x" * 300, 300) + record(4, b"tail")[:-4] + b"\0"
    d = spark.createDataFrame([(0, 0, "e", bytearray(message(template, one(256, body), one(256, record(5, b"y", 200)), struct.pack("!HH", 256, 2), one(256, record(6, b"")))))], "seq long, ts_us long, exporter string, payload binary")
    assert [(r.set_no, r.set_id) for r in exports.sets(d).orderBy("set_no").collect()] == [(0, 2), (1, 256), (2, 256)]
    out = exports.template_records(d)
    # the fourth record's last field is one byte of four; the name of the only one in the next set runs past its end, so it has no counters
    assert sorted((r.set_no, r.i, r.src_ip, r.dst_ip, r.packets, r.bytes) for r in out.collect()) == [(1, k - 1, f"10.0.0.{k}", f"10.0.1.{k}", k, 100 * k if k < 4 else 0) for k in (1, 2, 3, 4)]
    for df in (exports.sets(d), out):  # sets are written before the templates are looked up, so each plan has its own walk only
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1, plan

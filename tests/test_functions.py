"""Scalar functions, fingerprints, decoders, metrics and rules on hand-made rows."""
import ipaddress
import random
import struct

import pytest
from helpers import T0, by_seq, event, frame
from pyspark.sql import functions as F

from flowglass.functions import alerts, ip, text, times, tls
from flowglass.operators import dataprep, metrics
from flowglass.plans import detect as D
from flowglass.schema import validate
from flowglass.sources import captures, exports, wire


def one(spark, c, **values):
    d = spark.createDataFrame([tuple(values.values())], list(values))
    return d.select(c.alias("x")).first().x


def test_names(spark):
    names = ["", "localhost", "a.b.co.uk.", "XN--ABC.Test", "x" * 64 + ".com", "-a.com", "www.example.com", "com.au"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    rows = d.select("n", text.registrable_name("n").alias("r"), text.domain_label("n").alias("l"), text.first_label("n").alias("f")).collect()
    got = {r.n: (r.r, r.l, r.f) for r in rows}
    assert got[""] == ("", "", "") and got["localhost"] == ("localhost", "", "localhost")
    assert got["a.b.co.uk."] == ("b.co.uk", "a", "a") and got["XN--ABC.Test"][1] == "xn--abc"
    assert got["x" * 64 + ".com"][1] == "" and got["-a.com"][1] == "" and got["www.example.com"][0] == "example.com"


def test_readable_words(spark):
    words = ["click", "here", "now", "a", "art", "cart", "car", "to"]
    d = spark.createDataFrame([(x,) for x in ["clickherenow", "click", "click-here", "clickxere", "carto", "acart", "now2", ""]], "n string")
    got = {r.n: r.x for r in d.select("n", text.is_readable("n", words).alias("x")).collect()}
    assert got == {"clickherenow": True, "click": False, "click-here": True, "clickxere": False, "carto": True, "acart": False, "now2": False, "": False}


def test_address_predicates_match_the_standard_registry(spark):
    r = random.Random(1)
    pool = [str(ipaddress.ip_address(r.getrandbits(32))) for _ in range(1500)] + [str(ipaddress.ip_address(r.getrandbits(128))) for _ in range(300)]
    pool += [str(ipaddress.ip_address((h << 112) | r.getrandbits(100))) for h in (0x2001, 0x2002, 0xFE80, 0xFC00, 0x64, 0xFF02) for _ in range(50)]
    pool += ["::1", "::", "192.0.0.9", "192.0.0.170", "255.255.255.255", "0.0.0.0", "100.64.0.1"]
    d = spark.createDataFrame([(x,) for x in set(pool)], "ip string")
    for row in d.select("ip", *[f("ip").alias(f.__name__) for f in (ip.is_multicast, ip.is_loopback, ip.is_link_local, ip.is_unspecified, ip.is_reserved, ip.is_private)]).collect():
        a = ipaddress.ip_address(row.ip)
        assert [row[i] for i in range(1, 7)] == [a.is_multicast, a.is_loopback, a.is_link_local, a.is_unspecified, a.is_reserved, a.is_private], row


def test_published_client_fingerprint(spark):
    ciphers = [0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C, 0xC030, 0xCCA9, 0xCCA8, 0xC013, 0xC014, 0x009C, 0x009D, 0x002F, 0x0035]
    exts = [0x1B, 0x0, 0x33, 0x10, 0x4469, 0x17, 0x2D, 0xD, 0x5, 0x23, 0x12, 0x2B, 0xFF01, 0xB, 0xA, 0x15]
    sigs = [0x0403, 0x0804, 0x0401, 0x0503, 0x0805, 0x0501, 0x0806, 0x0601]
    d = spark.createDataFrame([(771, [0x2A2A] + ciphers, exts, [0x0A0A, 772, 771], sigs, bytearray(b"h2"))], "v int, c array<int>, e array<int>, s array<int>, g array<int>, a binary")
    assert d.select(tls.ja4(F.lit("t"), "v", "c", "e", "s", F.lit(True), "a", "g").alias("x")).first().x == "t13d1516h2_8daaf6152771_e5627efa2ab1"


def test_times(spark):
    assert one(spark, times.iso_ms("t"), t="2022-01-21T00:00:00.500+00:00") == 1642723200500.0
    assert one(spark, times.iso_ms("t"), t="2022-01-21T00:00:00") is None
    assert one(spark, times.decimal_ns("t"), t="1642723200.123456789") == 1642723200123456789
    assert one(spark, times.decimal_ns("t"), t="-1") is None
    assert one(spark, times.sample_day("t"), t="20180205abc") == "2018-02-05" and one(spark, times.sample_day("t"), t="180231") is None


def test_number_text_like_python(spark):
    vals = [0.0, 1.0, 0.25, 12.34567, 0.0001, 12345678.9, -3.5]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r.x for r in d.select(alerts.number_text("v").alias("x")).collect()] == [str(round(v, 4)) for v in vals]


def test_ipv6_text(spark):
    r = random.Random(2)
    addrs = [ipaddress.ip_address(r.getrandbits(128) & r.getrandbits(128) & int("ffff0000" * 4, 16) | r.choice([0, 1, 0xFFFF])) for _ in range(200)] + [ipaddress.ip_address(x) for x in ("::", "::1", "fe80::1", "2001:db8::", "1:0:0:2:0:0:0:3")]
    d = spark.createDataFrame([(i, bytearray(a.packed)) for i, a in enumerate(addrs)], "i int, b binary")
    got = {r.i: r.x for r in d.select("i", wire.ipv6("b", 0).alias("x")).collect()}
    assert all(got[i] == str(a) for i, a in enumerate(addrs))


def test_dns_compression_pointers(spark):
    head = struct.pack("!HHHHHH", 1, 0x8180, 1, 1, 0, 0)
    ok = head + b"\x03www\x07example\x03com\x00" + struct.pack("!HH", 16, 1)
    loop = head + b"\xc0\x0c" + struct.pack("!HH", 1, 1)
    back = struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0)[:12] + b"\x01a\xc0\x20" + b"\x00" * 8
    rows = [(1, bytearray(ok)), (2, bytearray(loop)), (3, bytearray(back)), (4, bytearray(head + b"\x40abc")), (5, bytearray(b"12"))]
    d = spark.createDataFrame(rows, "seq long, payload binary").withColumns({"src_port": F.lit(53), "dst_port": F.lit(4000), "protocol": F.lit(17)})
    got = by_seq(wire.decode_dns(d), "dns")
    assert (got[1].name, got[1].qtype, got[1].response, got[1].rcode) == ("www.example.com", 16, True, 0)
    assert got[2] is None and got[3] is None and got[4] is None and got[5] is None


def test_capture_formats(spark):
    frames = [b"\x01" * 60, b"\x02" * 61]
    little = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 10, 5 + i, len(f), len(f)) + f for i, f in enumerate(frames))
    nano = b"\xa1\xb2\x3c\x4d" + struct.pack(">HHiIII", 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 10, 7000, 60, 60) + frames[0]

    def block(kind, body):
        n = len(body) + 12
        return struct.pack("<II", kind, n) + body + struct.pack("<I", n)

    ng = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 3) + struct.pack("<HH", 0, 0)) + block(6, struct.pack("<IIIII", 0, 0, 12_345, 60, 60) + frames[0])
    files = [("little", little), ("nano", nano), ("blocks", ng), ("cut", little[:-3]), ("other", b"hello"), ("linktype", little[:20] + struct.pack("<I", 113))]
    d = spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")
    got = {}
    for r in captures.frames_of(d).collect():
        got.setdefault(r.path, []).append((r.ts_us, r.problem))
    assert got["little"] == [(10_000_005, None), (10_000_006, None)] and got["nano"] == [(10_000_007, None)] and got["blocks"] == [(12_345_000, None)]
    assert got["cut"] == [(10_000_005, None), (None, "truncated")] and got["other"][0][1] == "unsupported_capture" and got["linktype"][0][1] == "unsupported_capture"


def test_withdrawn_template(spark):
    def msg(*sets):
        body = b"".join(sets)
        return struct.pack("!HHIII", 10, 16 + len(body), 1000, 0, 7) + body

    tmpl = lambda *f: struct.pack("!HHHH", 2, 8 + 4 * len(f), 256, len(f)) + b"".join(struct.pack("!HH", *x) for x in f)
    rec = bytes([10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack("!IIB", 5, 500, 17)
    data = struct.pack("!HH", 256, 4 + len(rec)) + rec
    full = tmpl((8, 4), (12, 4), (2, 4), (1, 4), (4, 1))
    msgs = [msg(data), msg(full, data), msg(data), msg(tmpl()), msg(data)]
    d = spark.createDataFrame([(i, i, "e", bytearray(m)) for i, m in enumerate(msgs)], "seq long, ts_us long, exporter string, payload binary")
    got = exports.template_records(d).select("seq", "packets", "bytes", "src_ip", "ts_us").collect()
    assert sorted(tuple(r) for r in got) == [(1, 5, 500, "10.0.0.1", 1_000_000_000), (2, 5, 500, "10.0.0.1", 1_000_000_000)]
    assert exports.missing_templates(d).first().missing == 2


def test_undefined_metrics_are_null(spark):
    d = spark.createDataFrame([("tn",), ("tn",)], "outcome string")
    r = metrics.ratios(d.agg(*metrics.counts())).first()
    assert r.precision is None and r.recall is None and r.fpr == 0.0


def test_early_alert_boundary(spark):
    d = spark.createDataFrame([("a", True, 12, 10, 10_000_000), ("b", True, 12, 11, 1), ("c", True, 12, 12, 1), ("d", False, 5, None, None)], "s string, positive boolean, queries long, first_query long, delay_us long")
    got = {r.s: (r.outcome, r.early) for r in metrics.early_sessions(d, 10, 10_000_000).collect()}
    assert got == {"a": ("tp", True), "b": ("tp", False), "c": ("fn", False), "d": ("tn", False)}


def test_components(spark):
    r = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(0, 60) if i % 20 != 19] + [("hub", f"h{i}") for i in range(50)] + [("x", "x")]
    r.shuffle(edges)
    got = {x.node: x.component for x in dataprep.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for v in list(parent):
        groups.setdefault(find(v), set()).add(v)
    assert len(got) == len(parent)
    for g in groups.values():
        assert {got[v] for v in g} == {min(g)}


def test_event_bounds(spark):
    rows = [event(1, 0), event(2, 0, packets=0), event(3, 0, syn_packets=5), event(4, 0, src_port=70000), event(5, 0, reverse_observed=True), event(6, 0, transport="X")]
    got = by_seq(validate(frame(spark, rows)), "errors")
    assert got == {1: [], 2: ["packets"], 3: ["syn_packets"], 4: ["src_port"], 5: ["reverse_bytes"], 6: ["transport"]}


def test_rules_end_to_end(spark):
    """A scan, a flood with forged sources, a slow beacon and an exfiltration among ordinary events."""
    rows, seq = [], 0

    def add(ms, **kw):
        nonlocal seq
        rows.append(event(seq, ms, **kw))
        seq += 1

    for i in range(25):
        add(200 * i, src_ip="10.9.9.9", dst_ip=f"198.51.100.{i + 1}", dst_port=22, syn=True, syn_packets=1)
    for i in range(12):
        add(100_000 + i * 100, src_ip=f"127.0.0.{i + 1}", dst_ip="203.0.113.5", packets=2000, bytes=120_000, syn=True, syn_packets=2000)
    for i in range(12):
        add(200_000 + i * 60_000, src_ip="10.5.5.5", dst_ip="8.8.4.4", dst_port=8443)
    for i in range(4):
        add(950_000 + i * 1000, src_ip="10.6.6.6", dst_ip="8.8.8.8", dst_port=9000, bytes=6_000_000)
    got = D.alerts(frame(spark, rows)).collect()
    kinds = {(r.threat_class, r.src_ip, r.dst_ip) for r in got}
    assert ("RECONNAISSANCE", "10.9.9.9", "198.51.100.20") in kinds and ("BOTNET_C2", "10.5.5.5", "8.8.4.4") in kinds and ("DATA_EXFILTRATION", "10.6.6.6", "8.8.8.8") in kinds
    flood = [r for r in got if r.threat_class == "DDOS"]
    assert len(flood) == 1 and flood[0].dst_ip == "203.0.113.5" and "source_reserved_count=5" in flood[0].narrative and flood[0].severity == "CRITICAL"
    assert "c2_basis=slow_periodic_contact" in [r for r in got if r.threat_class == "BOTNET_C2"][0].narrative

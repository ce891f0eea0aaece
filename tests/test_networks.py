"""Addresses and networks of both families, covers of intervals, and episodes matched by them."""
import ipaddress
import random

from pyspark.sql import functions as F

from flowglass.functions import ip
from flowglass.operators import joins
from flowglass.sources import tables

TEXTS = ["10.0.0.1", "10.0.0.1/8", "0.0.0.0/0", "255.255.255.255", "10.1.2.3/255.255.0.0", "10.1.2.3/0.0.255.255", "10.1.2.3/255.0.255.0", "10.0.0.1/33", "10.0.0.256", "10.0.0", "010.0.0.1", "10.0.0.1/", "10.0.0.1/08", "1.2.3.4/-1",
         "::", "::/0", "::1", "2001:db8::/32", "2001:DB8:1:2:3:4:5:6/64", "fe80::1/10", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7:8/127", "1::2::3", ":1:2:3:4:5:6:7", "12345::", "g::", "::ffff:1.2.3.4/96", "::ffff:1.2.3.400",
         "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "::/129", "", "host.example", "8000::/1", "1::/65", ":::", "::1/64/3"]


def want(text):
    try:
        n = ipaddress.ip_network(text.strip(), strict=False)
    except ValueError:
        return None
    size, value = n.max_prefixlen, int(n.network_address)
    half = lambda x: x - (1 << 64) if x >> 63 else x
    if n.version == 4:
        return 4, n.prefixlen, value >> (32 - n.prefixlen), 0
    hi, lo = value >> 64, value & ((1 << 64) - 1)
    return 6, n.prefixlen, half(hi >> (64 - min(n.prefixlen, 64))), half(lo >> (128 - max(n.prefixlen, 64)))


def test_network_text(spark):
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", ip.network("t").alias("n")).orderBy("i").collect()]
    assert [tuple(g) if g else None for g in got] == [want(t) for t in TEXTS]


def test_cover(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        a = rng.randrange(1 << rng.randrange(10, 57))
        rows.append((i, a, a + rng.randrange(1 << rng.randrange(1, 57))))
    rows += [(98, 5, 4), (99, 1_700_000_000_000_000, 1_700_000_000_000_000)]
    for r in spark.createDataFrame(rows, "i int, s long, e long").withColumn("c", joins.cover("s", "e")).collect():
        first, last = r.s // joins.BUCKET_US, r.e // joins.BUCKET_US
        spans = sorted((b * joins.FAN**k, (b + 1) * joins.FAN**k) for k, b in r.c)
        assert len(spans) <= 2 * joins.FAN * (joins.TOP_LEVEL + 1)
        if last >= first:
            assert spans[0][0] == first and spans[-1][1] == last + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_matching(spark):
    rng = random.Random(4)
    v4 = [f"10.0.{a}.{b}" for a in range(2) for b in range(6)]
    v6 = [str(ipaddress.ip_address((0x20010DB8 << 96) + (rng.randrange(4) << 64) + rng.randrange(3))) for _ in range(12)]
    nets = ["10.0.0.0/30", "10.0.1.5", "10.0.0.0/16", "2001:db8::/63", "2001:db8:0:3::/64", "2001:db8::2", "::/0", "0.0.0.0/0"]
    events = [(i, rng.randrange(0, 9 * 10**9), rng.choice(v4 + v6), rng.choice(v4 + v6)) for i in range(400)]
    eps = [(f"e{i:02d}", rng.randrange(4), rng.choice("AB"), s, s + rng.choice([0, 10**6, 10**9, 10**12]), rng.sample(nets, rng.choice([0, 1, 1, 2]))) for i in range(25) for s in [rng.randrange(9 * 10**9)]]
    eps += [("none", 0, "A", 0, 10**12, None), ("unusable", 0, "A", 0, 10**12, ["10.0.0.999"]), ("both", 1, "B", 0, 10**13, ["10.0.0.0/30", "10.0.0.0/16"])]
    df = spark.createDataFrame(events, "seq long, ts_us long, src_ip string, dst_ip string")
    lab = spark.createDataFrame(eps, "id string, priority int, label string, start_us long, end_us long, hosts array<string>")
    got = {r.seq: (r.episode, r.label, r.matches) for r in joins.match_networks(df, lab).collect()}
    for seq, t, a, b in events:
        hit = []
        for i, p, l, s, e, hosts in eps:
            if s <= t <= e and i != "unusable" and (not hosts or any(ipaddress.ip_address(x) in ipaddress.ip_network(h) for x in (a, b) for h in hosts)):
                hit.append((p, i, l))
        assert got[seq] == ((min(hit)[1], min(hit)[2], len(hit)) if hit else (None, None, 0))
    plan = joins.match_networks(df, lab)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (_k" in plan.replace("knownfloatingpointnormalized", "").replace("(normalizenanandzero", "") or "_k#" in plan
    assert {r.matches for r in joins.match_networks(df, lab.limit(0)).collect()} == {0}


def test_columns_that_must_agree(spark):
    df = spark.createDataFrame([("a", 1, 5, "10.0.0.1", "10.0.0.2"), ("b", 2, 5, "10.0.0.1", "10.0.0.2")], "capture string, seq long, ts_us long, src_ip string, dst_ip string")
    lab = spark.createDataFrame([("a", "x", 0, "A", 0, 9, ["10.0.0.2"])], "capture string, id string, priority int, label string, start_us long, end_us long, hosts array<string>")
    assert {r.seq: r.episode for r in joins.match_networks(df, lab, ["capture"]).collect()} == {1: "x", 2: None}


def test_label_files_check_hosts(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"format": "x", "capture": "c", "split": "test", "episodes": [{"id": "a", "label": "DDOS", "start_ms": 1, "end_ms": 2, "hosts": ["10.0.0.0/8", "fe80::1"]},'
                                     ' {"id": "b", "label": "DDOS", "start_ms": 1, "end_ms": 2, "hosts": ["nowhere"]}, {"id": "c", "label": "DDOS", "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T00:00:01Z"}]}')
    rows = {r.id: r for r in tables.read_labels(spark, str(tmp_path)).collect()}
    assert rows["a"].errors == [] and rows["b"].errors == ["bad_host"] and rows["c"].errors == [] and rows["c"].end_us - rows["c"].start_us == 1_000_000


def test_matching_broadcasts_nothing(spark):
    """Rows that compress well look small to Spark, and would all be collected by the driver; nor may the plan grow with the shapes of networks."""
    df = spark.range(2000).selectExpr("id as seq", "id * 1000000 as ts_us", "concat('10.0.0.', id % 250) as src_ip", "'2001:db8::1' as dst_ip")
    lab = lambda n: spark.createDataFrame([(f"e{i}", i, "A", 0, 10**15, [f"10.0.0.0/{8 + i}", f"2001:db8::/{32 + i}"]) for i in range(n)], "id string, priority int, label string, start_us long, end_us long, hosts array<string>")
    m = joins.match_networks(df, lab(2))
    assert {r.matches for r in m.collect()} == {2}
    final = m._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in final and final.count("SortMergeJoin") >= 2
    size = lambda n: len(joins.match_networks(df, lab(n))._jdf.queryExecution().analyzed().toString())
    assert size(16) - size(2) < 14 * 2 * 6 * 60  # a constant per shape, no expression


def by_pairs(events, episodes):
    """What each seq matches, pair by pair; rows of one seq are one event."""
    found = {}
    for seq, t, a, b in events:
        for i, p, l, s, e, hosts in episodes:
            if seq is not None and t is not None and s <= t <= e and (not hosts or any(ipaddress.ip_address(x) in ipaddress.ip_network(h) for x in (a, b) if x for h in hosts)):
                found.setdefault(seq, set()).add((p, i, l, s, e))
    return {seq: (min(hit)[1], min(hit)[2], len(hit)) for seq, hit in found.items()}


def test_matching_of_pairs_nests_sets_and_repeated_rows(spark):
    """An episode counts once by both endpoints, by nested networks, by a long list of hosts, by equal rows; rows that share `seq` are one event."""
    rng = random.Random(9)
    hosts = [f"10.0.{a}.{b}" for a in range(3) for b in range(40)] + [f"2001:db8::{x:x}" for x in range(40)]
    nets = ["10.0.0.0/30", "10.0.0.0/24", "10.0.1.0/26", "2001:db8::/124", "2001:db8::/64", "::/0", "10.0.2.7", *hosts[:6]]
    eps = [(f"e{i:02d}", rng.randrange(3), rng.choice("AB"), s, s + rng.choice([0, 5, 40]), rng.sample(nets, rng.choice([0, 1, 2, 3, 5]))) for i in range(40) for s in [rng.randrange(90)]]
    eps += [(f"long{i}", 0, "A", 10 * i, 10 * i + 30, rng.sample(hosts, 50)) for i in range(6)]
    eps += [("over", 0, "A", 50, 40, []), ("e00", eps[0][1], eps[0][2], eps[0][3], eps[0][4], ["10.0.2.9"])]
    events = [(i, rng.randrange(120), rng.choice(hosts), rng.choice(hosts)) for i in range(300)] + [(400, None, "10.0.0.1", "10.0.0.2"), (401, 50, None, "10.0.0.1"), (None, 50, "10.0.0.1", "10.0.0.2")]
    events += events[:20] + [(i, rng.randrange(120), rng.choice(hosts), rng.choice(hosts)) for i in range(10, 40)]
    first = eps[0]
    eps_seen = [e if e[0] != "e00" else (*first[:5], sorted({*first[5], "10.0.2.9"}) if first[5] else []) for e in eps]
    df = spark.createDataFrame(events, "seq long, ts_us long, src_ip string, dst_ip string")
    lab = spark.createDataFrame(eps, "id string, priority int, label string, start_us long, end_us long, hosts array<string>")
    got = joins.match_networks(df, lab).collect()
    want = by_pairs(events, eps_seen)
    assert len(got) == len(events)
    assert all((r.episode, r.label, r.matches) == want.get(r.seq, (None, None, 0)) for r in got)


def _rows_out(node):
    """Rows that each node of an executed plan gave out."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _rows_out(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _rows_out(node.plan())
    m = node.metrics().get("numOutputRows")
    children = node.children()
    return ([m.get().value()] if m.isDefined() else []) + [x for i in range(children.size()) for x in _rows_out(children.apply(i))]


def test_matching_makes_no_pairs(spark):
    """Episodes of one network are open at the same time by the hundred: rows made must follow events and episodes, not their product."""
    n = 300
    df = spark.range(n).selectExpr("id as seq", "1000 + id as ts_us", "concat('10.0.0.', id % 250) as src_ip", "'198.51.100.1' as dst_ip")
    lab = spark.range(n).selectExpr("concat('e', id) as id", "cast(id as int) as priority", "'A' as label", "id as start_us", "5000 + id as end_us", "array('10.0.0.0/24') as hosts")
    m = joins.match_networks(df, lab)
    assert {(r.episode, r.matches) for r in m.collect()} == {("e0", n)}
    assert max(_rows_out(m._jdf.queryExecution().executedPlan())) <= 6 * n

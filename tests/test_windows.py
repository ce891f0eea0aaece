"""Boundary rules of the causal windows, and brute-force comparisons."""
import math
import random

import pytest
from helpers import T0, by_seq, event, frame
from pyspark.sql import functions as F

from flowglass.operators import beacons, connections, history, rates, sessions
from flowglass.operators.joins import asof_latest, order_statistics, quantiles
from flowglass.operators.ordered import most_before, neighbours, running_max, running_sums, sessionize
from flowglass.operators.throttle import throttle


def test_equal_times_do_not_see_each_other_backwards(spark):
    e = frame(spark, [event(1, 0, dst_ip="198.51.100.1"), event(2, 0, dst_ip="198.51.100.2"), event(3, 0, dst_ip="198.51.100.3")])
    assert by_seq(history.source_history(e), "destination_count") == {1: 1, 2: 2, 3: 3}
    assert by_seq(rates.global_rates(e), "packet_rate") == {1: 0.1, 2: 0.2, 3: 0.3}


def test_history_edges_are_inclusive(spark):
    rows = [event(1, 0, dst_ip="198.51.100.9"), event(2, 50_000, dst_ip="198.51.100.8"), event(3, 60_000), event(4, 60_001)]
    got = by_seq(history.source_history(frame(spark, rows)), "egress_bytes", "destination_count")
    assert got[3] == (300, 2) and got[4] == (300, 1)  # 60,000 ms and 10,000 ms back still count, one more does not


def test_history_has_no_row_limit(spark):
    e = frame(spark, [event(i, i * 2, bytes=1, dst_ip=f"198.51.{i % 40}.{i % 250}", dst_port=i % 3000) for i in range(5000)])
    h = by_seq(history.source_history(e, families=("source",)), "egress_bytes", "destination_count", "port_count")
    assert h[4999] == (5000, 1000, 3000) and h[700] == (701, 701, 701)
    assert by_seq(rates.forward_bytes(e), "source_forward_bytes_60s")[4999] == 5000


@pytest.mark.parametrize("block_us", [1_000_000, 60_000_000, 7_000])
def test_history_against_rescan(spark, monkeypatch, block_us):
    monkeypatch.setattr(history, "BLOCK_US", block_us)
    r = random.Random(3)
    t, rows = 0, []
    for i in range(700):
        t += r.choice([0, 1, 20, 300, 10_000 if i % 90 == 0 else 5])
        rows.append(event(i, t, dst_ip=f"198.51.100.{r.randrange(5)}", dst_port=r.randrange(3) + 80, bytes=r.randrange(1, 500), syn=r.random() < .5))
    cols = ["egress_bytes", "destination_count", "port_count", "history_count", "iat_mean", "iat_cv", "size_cv", "window_partial"]
    got = by_seq(history.source_history(frame(spark, rows), families=("source", "peer")), *cols)
    cv = lambda v: 0.0 if len(v) < 2 else math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) / max(1e-9, sum(v) / len(v))
    for i, row in enumerate(rows):
        kept = [x for x in rows[:i + 1] if x[1] >= row[1] - 60_000_000]
        ten = [x for x in kept if x[1] >= row[1] - 10_000_000]
        peer = [x for x in kept if (x[4], x[6]) == (row[4], row[6])]
        gaps = [(y[1] - x[1]) / 1e6 for x, y in zip(peer, peer[1:])]
        assert got[i][:4] == (sum(x[9] for x in kept), len({x[4] for x in ten}), len({x[6] for x in ten}), len(peer))
        assert got[i][4:7] == pytest.approx((sum(gaps) / len(gaps) if gaps else 0, cv(gaps), cv([x[9] for x in peer])), abs=1e-9)
        assert got[i][7] == (row[1] - kept[0][1] < 60_000_000)


@pytest.mark.parametrize("block_us", [1, 50, 10**9])
def test_neighbours_with_holes(spark, block_us):
    r = random.Random(2)
    rows = [("ab"[r.randrange(2)], t, r.randrange(100)) for t in sorted(r.sample(range(1000), 60))]
    df = spark.createDataFrame([(k, t, 0, v) for k, t, v in rows], "k string, ts_us long, seq long, v int")
    got = {x.ts_us: (x.p and x.p.v, x.n and x.n.v) for x in neighbours(df, ["k"], "p", "n", block_us, carry=["v"]).collect()}
    most = {x.ts_us: x.m for x in most_before(df, ["k"], F.col("v"), "m", block_us).collect()}
    for k, t, v in rows:
        own = [(u, w) for j, u, w in rows if j == k]
        i = own.index((t, v))
        assert got[t] == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None)
        assert most[t] == max((w for _, w in own[:i]), default=None)


def test_eleven_second_buckets(spark):
    got = by_seq(rates.global_rates(frame(spark, [event(1, 0), event(2, 10_000), event(3, 11_000)])), "packet_rate")
    assert got == {1: 0.1, 2: 0.2, 3: 0.2}


@pytest.mark.parametrize("sub_us", [None, 100_000])
def test_rates_and_entropy_against_rescan(spark, sub_us):
    r = random.Random(26145)
    t, rows = 0, []
    for i in range(300):
        t += r.randrange(0, 400)
        rows.append(event(i, t, src_ip=f"10.0.0.{r.randrange(8)}", packets=r.randrange(1, 21), bytes=r.randrange(60, 9000)))
    got = by_seq(rates.global_rates(frame(spark, rows), sub_us=sub_us), "packet_rate", "source_entropy", "source_count")
    for i, row in enumerate(rows):
        win = [x for x in rows[:i + 1] if x[2] >= row[2] - 10]
        n = {}
        for x in win:
            n[x[3]] = n.get(x[3], 0) + 1
        h = -sum(c / len(win) * math.log2(c / len(win)) for c in n.values())
        assert got[i][0] == pytest.approx(sum(x[8] for x in win) / 10)
        assert got[i][1] == pytest.approx(h, abs=1e-9) and got[i][2] == len(n)


def test_unknown_summary_hides_the_syn_share_until_it_expires(spark):
    e = frame(spark, [event(1, 0, packets=50, syn=True), event(2, 1000, syn=True, syn_packets=1), event(3, 12_000, syn=True, syn_packets=1)])
    got = by_seq(rates.target_rates(e), "syn_target_fraction", "syn_target_fraction_basis")
    assert got[1] == (None, "unavailable") and got[2] == (None, "unavailable") and got[3] == (1.0, "packet_exact")


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_suppression_reopens_at_expiry(spark, hot_rows):
    times = [0, 10_000, 30_000, 59_999, 60_000]
    d = spark.createDataFrame([(i, T0 + t * 1000, "k") for i, t in enumerate(times)], "seq long, ts_us long, k string")
    out = throttle(d, ["k"], 30_000_000, hot_rows=hot_rows)
    assert sorted(r.seq for r in out.filter("kept").collect()) == [0, 2, 4]


def test_hot_keys_are_throttled_exactly_in_chunks(spark):
    r = random.Random(8)
    rows, seq = [], 0
    for k in range(4):
        t = 0
        for _ in range(700):
            t += int(r.expovariate(1 / 40)) if r.random() < .97 else 5000
            rows.append((seq, T0 + t, f"k{k}"))
            seq += 1
    d = spark.createDataFrame(rows, "seq long, ts_us long, k string")
    expect = set()
    for k in range(4):
        expiry = 0
        for s, t, _ in sorted((x for x in rows if x[2] == f"k{k}"), key=lambda x: (x[1], x[0])):
            if t >= expiry:
                expect.add(s)
                expiry = t + 150
    for hot, gaps in ((10, 2), (10, 1), (10**9, 20)):
        got = {x.seq for x in throttle(d, ["k"], 150, hot_rows=hot, chunk_gaps=gaps).filter("kept").collect()}
        assert got == expect


def test_flow_gap_of_sixty_seconds_restarts(spark):
    e = frame(spark, [event(1, 0), event(2, 59_999), event(3, 119_999)])
    got = by_seq(sessions.flow_identity(e), "flow_start_us")
    assert got == {1: T0, 2: T0, 3: T0 + 119_999_000}


def test_tls_session_survives_exactly_sixty_seconds(spark):
    enc = dict(encrypted=True, transport="TLS", dst_port=443)
    e = frame(spark, [event(1, 0, tls_fingerprint="a", **enc), event(2, 60_000, **enc), event(3, 120_001, **enc)])
    assert by_seq(sessions.tls_features(e), "tls_session_packets", "tls_ja3") == {1: (1, "a"), 2: (2, "a"), 3: (1, None)}


def test_session_chaining_over_blocks(spark):
    r = random.Random(5)
    t, rows = 0, []
    for i in range(400):
        t += r.choice([5, 20, 59, 60, 61, 130])
        rows.append((i, t * 1_000_000, "a"))
    d = spark.createDataFrame(rows, "seq long, ts_us long, k string")
    got = by_seq(sessionize(d, ["k"], 60_000_000, keep_equal=True, block_us=70_000_000), "session_start")
    start = rows[0][1]
    for i, row in enumerate(rows):
        if i and row[1] - rows[i - 1][1] > 60_000_000:
            start = row[1]
        assert got[i] == start


def test_beacon_contacts(spark):
    gaps = [30_000] * 9
    times = [0]
    for g in gaps:
        times.append(times[-1] + g)
    rows, seq = [], 0
    for t in times:
        for k in range(3):  # packets of one contact, 40 ms apart
            rows.append(event(seq, t + 40 * k))
            seq += 1
    rows.append(event(seq, times[-1] + 1_999))
    rows.append(event(seq + 1, times[-1] + 2_000))
    got = by_seq(beacons.slow_contacts(frame(spark, rows)), "slow_beacon_events", "slow_beacon_mean_s", "slow_beacon_cv")
    assert got[27] == (10, 30.0, 0.0) and got[seq][0] == 10 and got[seq + 1][0] == 11
    later = frame(spark, [event(1, 0), event(2, 7_200_000), event(3, 14_400_001)])
    assert by_seq(beacons.slow_contacts(later), "slow_beacon_events") == {1: 1, 2: 2, 3: 1}


def test_slow_connections_open_age_and_close(spark):
    rows, seq = [], 0
    for p in range(60):
        rows.append(event(seq, 100 * p, src_port=40_000 + p, dst_port=80, bytes=300))
        seq += 1
    for k in range(1, 4):
        for p in range(60):
            rows.append(event(seq, 15_000 * k + 100 * p, src_port=40_000 + p, dst_port=80, bytes=70))
            seq += 1
    rows.append(event(seq, 50_950, src_port=40_000, dst_port=80, bytes=40, tcp_fin_rst=True))
    rows.append(event(seq + 1, 175_000, src_port=41_000, dst_port=80, bytes=100))
    got = by_seq(connections.slow_senders(connections.orient(frame(spark, rows))), "slow_http_connections", "slow_http_open_connections")
    assert got[59] == (0, 60) and got[seq - 1] == (60, 60) and got[seq] == (59, 59) and got[seq + 1] == (0, 1)


def test_connection_state_matches_a_plain_fold(spark):
    r = random.Random(11)
    t, rows = 0, []
    for i in range(1500):
        t += r.choice([10, 200, 900, 4000, 40_000 if r.random() < .05 else 50])
        rows.append(event(i, t, src_port=40_000 + r.randrange(6), dst_port=80, bytes=r.choice([40, 61, 90, 400]), tcp_fin_rst=r.random() < .06 or None))
    got = by_seq(connections.slow_senders(connections.orient(frame(spark, rows))), "slow_http_connections", "slow_http_open_connections", "slow_http_mean_age_s")
    live = {}
    for row in rows:
        now, port = row[1], row[5]
        live = {p: c for p, c in live.items() if now - c[1] <= 120_000_000}
        if row[19]:
            live.pop(port, None)
        elif row[9] >= 61:
            c = live.get(port, (now, now, 0))
            live[port] = (c[0], now, c[2] + row[9])
        ages = [(now - c[0]) / 1e6 for c in live.values()]
        slow = sum(a >= 30 and c[2] / max(a, 1) <= 100 for a, c in zip(ages, live.values()))
        assert got[row[0]][:2] == (slow, len(live))
        assert got[row[0]][2] == pytest.approx(sum(ages) / len(ages) if ages else 0)


def test_running_blocks_and_late_rows(spark):
    d = spark.createDataFrame([(i, i * 7_000_000, "a", i) for i in range(100)], "seq long, ts_us long, k string, v long")
    assert by_seq(running_sums(d, ["k"], {"s": F.col("v")}), "s")[99] == sum(range(100))
    l = spark.createDataFrame([(0, 5), (1, 9), (2, 7), (3, 9), (4, 12)], "seq long, ts_us long")
    got = by_seq(running_max(l, "ts_us", "m", block_rows=2).withColumn("late", F.col("ts_us") < F.col("m")), "late")
    assert [bool(got[i]) for i in range(5)] == [False, False, True, False, False]


def test_asof_takes_the_newest_earlier_row(spark):
    l = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (3, 20, "b")], "seq long, ts_us long, k string")
    r = spark.createDataFrame([(7, 10, "a", "x"), (8, 20, "a", "y"), (9, 30, "b", "z")], "seq long, ts_us long, k string, v string")
    assert by_seq(asof_latest(l, r, ["k"], ["v"]), "last_v") == {1: "x", 2: "y", 3: None}
    assert by_seq(asof_latest(l, r, ["k"], ["v"], strict=True), "last_v") == {1: None, 2: "x", 3: None}


def test_order_statistics_with_heavy_ties(spark):
    vals = [5.0] * 400 + [float(i) for i in range(200)] + [1e9]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    s = sorted(vals)
    row = order_statistics(d, [], "v", {"p50": lambda n: F.floor(n / 2), "p99": lambda n: F.floor((n - 1) * 0.99)}).first()
    assert (row.p50, row.p99, row.max) == (s[len(s) // 2], s[int((len(s) - 1) * .99)], 1e9)
    m = quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double"), [], "v", {"m": 0.5}).first()
    assert m.m == 3.0


def test_cold_keys_in_one_window_equal_blocks(spark):
    from flowglass.operators.ordered import Heat, change_points, heat, neighbours, sessionize

    d = spark.createDataFrame([(i, None if i == 30 else (i * 37 % 211) * 1_000_000, None if i == 40 else "abcd"[i % 4], None if i % 6 == 0 else i, f"p{i % 3}") for i in range(120)], "seq long, ts_us long, k string, v long, p string")
    every = heat(d, ["k"], 1)
    assert not heat(d, ["k"], 200) and len(every.hot) == 4
    some = Heat(every.by, every.hot[:2])
    parts = [(None, {"n": F.lit(1), "t": F.col("v")}, None), (F.col("ts_us") + 20_000_001, {"n": F.lit(-1), "t": -F.col("v")}, None)]
    for keys in (["k"], ["k", "p"]):
        for run in (lambda s: neighbours(d, keys, "a", "b", 10_000_000, carry=["v"], seen=s), lambda s: sessionize(d, keys, 15_000_000, True, block_us=10_000_000, seen=s),
                    lambda s: running_sums(d, keys, {"s": F.col("v"), "c": F.lit(1)}, block_us=10_000_000, lasts=["v"], seen=s), lambda s: change_points(d, keys, parts, 10_000_000, s)):
            want = sorted(map(str, run(None).collect()))
            assert len(want) == 118
            for seen in (Heat(("k",)), some, every):
                assert sorted(map(str, run(seen).collect())) == want

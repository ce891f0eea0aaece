"""Streaming runs equal their batch twins."""
from helpers import T0
from pyspark.sql import functions as F

from flowglass.operators.throttle import throttle
from flowglass.streaming import jobs


def _files(spark, tmp_path):
    rows = [(i, T0 + i * 1_700_000 + (i % 3) * 100, f"k{i % 5}", 1 + i % 9, 100) for i in range(120)]
    d = spark.createDataFrame(rows, "seq long, ts_us long, key string, packets long, bytes long")
    src = str(tmp_path / "in")
    for part in range(3):
        d.filter(F.floor(F.col("seq") / 40) == part).coalesce(1).write.mode("append").parquet(src)
    return d, src


def test_suppression_over_micro_batches_equals_batch(spark, tmp_path):
    d, src = _files(spark, tmp_path)
    stream = jobs.with_time(jobs.event_stream(spark, src, d.schema, files_per_trigger=1))
    path = jobs.run_available(jobs.suppress(stream, "key", 30_000_000), sink=jobs.write_alerts)
    got = spark.read.parquet(path)
    expect = {r.seq for r in throttle(d, ["key"], 30_000_000).filter("kept").collect()}
    assert {r.seq for r in got.collect()} == expect
    assert sorted(r.sequence for r in got.collect()) == list(range(1, len(expect) + 1))
    assert [r.sequence for r in jobs.read_since(spark, path, 3, 4).collect()] == [4, 5, 6, 7]


def test_repeated_batch_leaves_one_copy(spark, tmp_path):
    d, _ = _files(spark, tmp_path)
    sink = jobs.write_alerts(str(tmp_path / "alerts"))
    for batch in (0, 1, 1):
        sink(d.filter(F.floor(F.col("seq") / 40) == batch).select("key", "ts_us", "seq"), batch)
    out = spark.read.parquet(str(tmp_path / "alerts"))
    assert out.count() == 80 and out.agg(F.max("sequence")).first()[0] == 80


def test_all_sessions_close_at_the_end(spark, tmp_path):
    d, src = _files(spark, tmp_path)
    more = [(1000 + i, T0 + 10_000_000_000 + t, "edge", 1, 1) for i, t in enumerate((0, 4_999_999, 9_999_998, 14_999_999, 30_000_000))]
    spark.createDataFrame(more, d.schema).coalesce(1).write.mode("append").parquet(src)
    raw = jobs.event_stream(spark, src, d.schema, files_per_trigger=1)
    got = spark.read.parquet(jobs.run_to_end(raw, lambda e: jobs.closed_sessions(e, ["key"], "5 seconds")))
    rows = sorted([tuple(r) for r in d.collect()] + more, key=lambda r: (r[2], r[1]))
    want, last = {}, {}
    for seq, ts, key, packets, size in rows:
        if key in last and ts - want[last[key]][4] < 5_000_000:
            w = want[last[key]]
            want[last[key]] = (w[0] + 1, w[1] + packets, w[2] + size, w[3], ts)
        else:
            last[key] = (key, ts)
            want[last[key]] = (1, packets, size, ts, ts)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k[0], *v) for k, v in want.items())
    assert sum(v[0] for v in want.values()) == 125 and ("edge", T0 + 10_000_000_000) in want


def test_all_windows_close_at_the_end(spark, tmp_path):
    d, src = _files(spark, tmp_path)
    got = spark.read.parquet(jobs.run_to_end(jobs.event_stream(spark, src, d.schema, files_per_trigger=1), lambda e: jobs.sliding_rates(e, ["key"])))
    want = {}
    for r in d.collect():
        for sec in range(r.ts_us // 1_000_000, r.ts_us // 1_000_000 + 11):
            p, b, n = want.get((sec, r.key), (0, 0, 0))
            want[sec, r.key] = (p + r.packets, b + r.bytes, n + 1)
    assert {(r.sec, r.key): (round(r.packet_rate * 10), round(r.byte_rate * 10), r.events) for r in got.collect()} == want


def test_late_rows_are_counted(spark, tmp_path):
    d, _ = _files(spark, tmp_path)
    k = F.when(F.col("seq") % 7 == 3, (F.floor(F.col("seq") / 40) + 1) % 3).otherwise(F.floor(F.col("seq") / 40)).cast("int")
    rows = d.withColumn("k", k)
    stream = jobs.in_batches(rows, "k", 3, files=1)
    counts = {r.batch_id: (r.processed, r.late) for r in spark.read.parquet(jobs.run_available(stream, sink=jobs.count_arrivals)).collect()}
    top, want, late = -1, {}, 0
    for b in range(3):
        ts = [r.ts_us for r in rows.filter(F.col("k") == b).collect()]
        want[b] = (len(ts), sum(t < top for t in ts))
        top = max([top, *ts])
        late += want[b][1]
    assert {b: c for b, c in counts.items() if c[0]} == want and late > 10
    progress = []
    out = jobs.run_available(jobs.suppress(jobs.with_time(jobs.in_batches(rows, "k", 3, files=1)), "key", 30_000_000, with_late=True), progress=progress)
    told = spark.read.parquet(out).agg(F.sum("late")).first()[0] or 0
    assert told + jobs.dropped(progress) == late


def test_alerts_are_visible_while_input_remains(spark, tmp_path):
    d, _ = _files(spark, tmp_path)
    stream = jobs.with_time(jobs.in_batches(d.withColumn("k", F.floor(F.col("seq") / 40)), "k", 3, files=1))
    path = jobs.run_available(jobs.suppress(stream, "key", 30_000_000), sink=lambda p: jobs.watched(jobs.write_alerts, p))
    seen = {r.batch: r.visible for r in spark.read.parquet(f"{path}/_reader/_notes/*").collect()}
    kept = [r.seq for r in throttle(d, ["key"], 30_000_000).filter("kept").collect()]
    assert 0 < seen[0] < seen[1] < seen[2] and [seen[b] for b in range(3)] == [sum(s < 40 * (b + 1) for s in kept) for b in range(3)]
    assert sorted(r.sequence for r in jobs.read_alerts(spark, path).collect()) == list(range(1, len(kept) + 1))


def test_keys_that_share_a_bucket_keep_their_own_expiry(spark, tmp_path):
    d, src = _files(spark, tmp_path)
    d = d.withColumn("key", F.concat("key", F.lit("-"), (F.col("seq") % 7).cast("string")))
    stream = jobs.with_time(jobs.in_batches(d.withColumn("k", F.floor(F.col("seq") / 40)), "k", 3, files=1))
    out = jobs.run_available(jobs.suppress(stream, "key", 30_000_000, buckets=2))
    got = sorted((r.key, r.ts_us, r.seq) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.key, r.ts_us, r.seq) for r in throttle(d, ["key"], 30_000_000).filter("kept").collect()) and len({k for k, _, _ in got}) > 2

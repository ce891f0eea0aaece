"""Registered queries: micro-batch runs over the event table and writers read back."""
from pyspark.sql import functions as F

from .. import sinks
from ..streaming import jobs
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import TRAFFIC, over
from .q_joins import alert_rows


def _raw_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return V.traffic_of(V.typed(jobs.event_stream(spark, sf, schema, glob="events.parquet")))


def _traffic_stream(spark, sf):
    return jobs.with_time(_raw_stream(spark, sf))


RS = """, hits as (select src_ip, ts_us, seq from traffic where packets > 40), r as (select src_ip, min(ts_us) t from hits group by 1 union all
  select x.src_ip, min(x.ts_us) from r join hits x on x.src_ip = r.src_ip and x.ts_us >= r.t + 30000000 group by 1)"""


@query("streamed_suppression", over(TRAFFIC, RS + " select hits.src_ip as key, hits.ts_us, min(seq) seq from hits join r on hits.src_ip = r.src_ip and hits.ts_us = r.t group by 1, 2", recursive=True))
def streamed_suppression(spark, sf):
    hits = _traffic_stream(spark, sf).filter("packets > 40")
    return spark.read.schema("key string, ts_us long, seq long").parquet(jobs.run_available(jobs.suppress(hits, "src_ip", 30_000_000)))


@query("streamed_rates", over(TRAFFIC, """, s as (select unnest(range(sec, sec + 11)) sec, dst_ip, packets, bytes from traffic), g as (select sec, dst_ip, count(*) events, sum(packets) / 10.0 p, sum(bytes) / 10.0 b from s group by 1, 2)
  select sec, dst_ip, events, round(p, 6) packet_rate, round(b, 6) byte_rate from g"""))
def streamed_rates(spark, sf):
    """Every sliding window; those still open at the end of input are closed by its marker."""
    out = jobs.run_to_end(_raw_stream(spark, sf), jobs.sliding_rates)
    return rounded(spark.read.schema("sec long, dst_ip string, events long, packet_rate double, byte_rate double").parquet(out))


@query("streamed_sessions", over(TRAFFIC, """, g as (select *, case when ts_us - lag(ts_us) over w < 20000000 then 0 else 1 end as first from traffic window w as (partition by src_ip, dst_ip order by ts_us)),
  s as (select *, sum(first) over (partition by src_ip, dst_ip order by ts_us) sid from g)
  select src_ip, dst_ip, count(*) events, cast(sum(packets) as bigint) packets, cast(sum(bytes) as bigint) bytes, min(ts_us) first_us, max(ts_us) last_us from s group by src_ip, dst_ip, sid"""))
def streamed_sessions(spark, sf):
    """Every session of a pair, ended by 20 seconds of silence or by the end of input."""
    out = jobs.run_to_end(_raw_stream(spark, sf), lambda e: jobs.closed_sessions(e, ["src_ip", "dst_ip"], "20 seconds"))
    return spark.read.schema("src_ip string, dst_ip string, events long, packets long, bytes long, first_us long, last_us long").parquet(out)


PARTS = """, b as (select min(ts_us) lo, max(ts_us) hi from traffic), d as (select traffic.*, least(5, cast(floor((ts_us - lo) / ((hi - lo) / 6.0)) as int)) part from traffic, b)"""


def _parts(spark, sf):
    t = V.traffic(spark, sf)
    lo, hi = t.agg(F.min("ts_us"), F.max("ts_us")).first()
    return t.withColumn("part", F.least(F.lit(5), F.floor((F.col("ts_us") - lo) / ((hi - lo) / 6.0)).cast("int")))


@query("stream_counts", over(TRAFFIC, PARTS + """, m as (select *, case when seq % 11 = 0 then (part + 2) % 6 else part end k from d), g as (select k, max(ts_us) top from m group by 1),
  o as (select k, max(top) over (order by k rows between unbounded preceding and 1 preceding) seen, max(top) over (order by k) newest from g)
  select cast(k as bigint) batch, count(*) processed, count(*) filter (ts_us < seen) late, any_value(newest) max_ts_us from m join o using (k) group by 1"""))
def stream_counts(spark, sf):
    """Rows and late rows of every micro-batch; every eleventh row arrives two batches off its time."""
    d = _parts(spark, sf).withColumn("k", F.when(F.col("seq") % 11 == 0, (F.col("part") + 2) % 6).otherwise(F.col("part")))
    stream = jobs.in_batches(d.select("seq", "ts_us", "k"), "k", 6)
    out = spark.read.parquet(jobs.run_available(stream, sink=jobs.count_arrivals))
    return out.filter("processed > 0").select(F.col("batch_id").cast("long").alias("batch"), "processed", "late", "max_ts_us")


@query("late_hits", over(TRAFFIC, PARTS + """, m as (select *, case when seq % 11 = 0 then (part + 2) % 6 else part end k from d where packets > 40), g as (select k, max(ts_us) // 1000 * 1000 top from m group by 1),
  o as (select k, max(top) over (order by k rows between unbounded preceding and 1 preceding) seen from g)
  select count(*) hits, count(*) filter (ts_us < seen) late from m join o using (k)"""))
def late_hits(spark, sf):
    """Hits that came behind the watermark of the suppression: dropped by the operator or by Spark before it, but counted."""
    d = _parts(spark, sf).filter("packets > 40").withColumn("k", F.when(F.col("seq") % 11 == 0, (F.col("part") + 2) % 6).otherwise(F.col("part")))
    stream = jobs.with_time(jobs.in_batches(d.select("seq", "ts_us", "src_ip", "k"), "k", 6))
    progress = []
    out = jobs.run_available(jobs.suppress(stream, "src_ip", 30_000_000, with_late=True), progress=progress)
    seen = spark.read.schema("key string, ts_us long, seq long, late long").parquet(out).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    return seen.select(F.lit(d.count()).cast("long").alias("hits"), (F.col("late") + jobs.dropped(progress)).alias("late"))


@query("alerts_before_end", over(TRAFFIC, RS.replace("hits as (select src_ip, ts_us, seq from traffic", "b as (select min(ts_us) lo, max(ts_us) hi from traffic), hits as (select src_ip, ts_us, seq from traffic") + """,
  k as (select hits.src_ip, hits.ts_us from hits join r on hits.src_ip = r.src_ip and hits.ts_us = r.t group by 1, 2), p as (select least(5, cast(floor((ts_us - lo) / ((hi - lo) / 6.0)) as int)) part from k, b)
  select cast(i as bigint) batch, (select count(*) from p where part <= i) visible, i < 5 before_end from (select unnest(range(6)) i)""", recursive=True))
def alerts_before_end(spark, sf):
    """What a reader of the alert table sees after each of six micro-batches, while the rest of the input is still to come."""
    stream = jobs.with_time(jobs.in_batches(_parts(spark, sf).select("seq", "ts_us", "src_ip", "packets", "part"), "part", 6)).filter("packets > 40")
    out = jobs.run_available(jobs.suppress(stream, "src_ip", 30_000_000), sink=lambda p: jobs.watched(jobs.write_alerts, p))
    seen = spark.read.parquet(f"{out}/_reader/_notes/*")
    return seen.filter("batch < 6").select("batch", "visible", (F.col("batch") < 5).alias("before_end"))


@query("alert_table_cursor", over(TRAFFIC, RS + """, k as (select hits.src_ip as key, hits.ts_us, min(seq) seq from hits join r on hits.src_ip = r.src_ip and hits.ts_us = r.t group by 1, 2), n as (select *, row_number() over (order by ts_us, seq) as sequence from k)
  select sequence, key, ts_us, seq from n where sequence > 20 order by sequence limit 100""", recursive=True))
def alert_table_cursor(spark, sf):
    """Suppressed hits appended batch by batch with growing sequence numbers, read from a cursor."""
    hits = _traffic_stream(spark, sf).filter("packets > 40")
    path = jobs.run_available(jobs.suppress(hits, "src_ip", 30_000_000), sink=jobs.write_alerts)
    return jobs.read_since(spark, path, 20, 100).select("sequence", "key", "ts_us", "seq")


@query("sliced_recording", over(TRAFFIC, """, b as (select min(ts_us) lo, max(ts_us) hi from traffic), s as (select ts_us, least(3, cast(floor((ts_us - lo) / ((hi - lo) / 4.0)) as int)) part from traffic, b) select part, count(*) n, min(ts_us) first_us, max(ts_us) last_us from s group by 1"""))
def sliced_recording(spark, sf):
    return sinks.write_time_slices(V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "bytes"), jobs.shared_path(spark, "slices"), 4)


@query("exported_alerts", over(TRAFFIC, """ select seq as sequence, src_ip from traffic where protocol = 17 and packets > 20"""))
def exported_alerts(spark, sf):
    path = jobs.shared_path(spark, "alerts")
    sinks.write_alert_lines(alert_rows(spark, sf), path, "threat = 'DDOS' and severity = 'HIGH'")
    return spark.read.schema("sequence long, src_ip string").json(path)


@query("reread_events", over(TRAFFIC, " select seq, src_ip, packets, dns_name, syn_packets from traffic"))
def reread_events(spark, sf):
    """Events written as JSON lines and read back with the fixed schema; blank or broken lines would land in `_corrupt`."""
    from ..sources.events import read_event_lines

    path = jobs.shared_path(spark, "events")
    sinks.write_event_lines(V.traffic(spark, sf), path)
    good, _ = read_event_lines(spark, path)
    return good.select("seq", "src_ip", "packets", "dns_name", "syn_packets")

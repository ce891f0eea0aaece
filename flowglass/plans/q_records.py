"""Registered queries: sequence digests, rejected lines, counters and order of export datagrams."""
from pyspark.sql import functions as F

from ..operators.ordered import most_before, sequence_digest
from ..session import cut, shared_folder
from ..sources import events, exports, wire
from . import views as V
from .catalog import query
from .fixtures_sql import TRAFFIC, over
from .q_sources import hex_ip, hexn

DIGEST = """, t as (select src_ip, row_number() over w - 1 p, concat_ws('|', seq, bytes, max(bytes) over w) x from traffic window w as (partition by src_ip order by ts_us, seq rows unbounded preceding)),
  a as (select src_ip, p // 8 p, count(*) n, sha256(string_agg(x, chr(10) order by p)) x from t group by 1, t.p // 8), b as (select src_ip, p // 8 p, sum(n) n, sha256(string_agg(x, chr(10) order by p)) x from a group by 1, a.p // 8)
  select src_ip, cast(sum(n) as bigint) n, sha256(string_agg(x, chr(10) order by p)) digest from b group by 1"""


@query("feature_trace_digests", over(TRAFFIC, DIGEST))
def feature_trace_digests(spark, sf):
    """One digest per source over its trace: event, size and running maximum, in blocks of eight."""
    t = most_before(V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "bytes"), ["src_ip"], F.col("bytes"), "_before")
    text = F.concat_ws("|", F.col("seq").cast("string"), F.col("bytes").cast("string"), F.greatest("bytes", "_before").cast("string"))
    return sequence_digest(t, ["src_ip"], text, size=8)


@query("rejected_lines", over(TRAFFIC, """, r as (select seq, seq % 3 part, case when seq % 13 = 5 then concat('{"seq": ', cast(seq as varchar), ', oops') end broken, 1 + case when seq % 9 = 0 then 1 else 0 end k from traffic),
  n as (select *, sum(k) over (partition by part order by seq) line from r) select cast(part as varchar) part, cast(line as bigint) line, broken as text from n where broken is not null"""))
def rejected_lines(spark, sf):
    """Event lines in three files of several splits, with blank lines between; every thirteenth line is broken."""
    line = F.when(F.col("seq") % 13 == 5, F.concat(F.lit('{"seq": '), F.col("seq").cast("string"), F.lit(", oops"))).otherwise(F.to_json(F.struct("seq", "ts_us", "src_ip", "dst_ip", "packets")))
    t = V.traffic(spark, sf).select("seq", (F.col("seq") % 3).cast("string").alias("part"), F.concat(F.when(F.col("seq") % 9 == 0, "\n").otherwise(""), line).alias("value"))
    path = shared_folder(spark, "lines")
    t.repartition("part").sortWithinPartitions("part", "seq").select("part", "value").write.partitionBy("part").text(path)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        bad = cut(events.rejected_lines(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    return bad.select(F.regexp_extract("file", "part=([0-9]+)", 1).alias("part"), "line", "text")


def _udp_frames(d, port):
    """Ethernet frames around datagrams (seq, ts_us, exporter, payload as hex digits)."""
    size = (F.length("payload") / 2).cast("int")
    ip = F.concat(F.lit("4500"), hexn(size + 28, 2), F.lit("0000400040110000"), hex_ip("exporter"), F.lit("c0000201"))
    frame = F.concat(F.lit("0200000000010200000000020800"), ip, F.lit("c000"), hexn(port, 2), hexn(size + 8, 2), F.lit("0000"), F.col("payload"))
    return wire.stage(d, {"frame": F.unhex(frame)}).select("seq", "ts_us", "frame")


def _v5_hex(t, per, end_ms, packets="packets"):
    """Datagrams of `per` fixed records each, as hex digits; flows end at `end_ms` after boot, which was an hour before."""
    rec = F.concat(hex_ip("src_ip"), hex_ip("dst_ip"), F.repeat(F.lit("00"), 8), hexn(packets, 4), hexn("bytes", 4), hexn(F.lit(0), 4), hexn(end_ms, 4), hexn("src_port", 2), hexn("dst_port", 2), F.lit("0010"), hexn("protocol", 1), F.repeat(F.lit("00"), 9))
    g = t.withColumn("rec", rec).groupBy(F.floor(F.col("seq") / per).cast("long").alias("d")).agg(F.array_sort(F.collect_list(F.struct("seq", "rec"))).alias("r"))
    head = F.concat(F.lit("0005"), hexn(F.size("r"), 2), hexn(F.lit(3_600_000), 4), hexn(F.lit(V.EPOCH // 1_000_000), 4), F.lit("00000000"), F.repeat(F.lit("00"), 8))
    return g.select("d", F.concat(head, F.array_join(F.transform("r", lambda x: x["rec"]), "")).alias("payload"))


def _ipfix_hex(t, per, end_ms, with_template, packets="packets"):
    """Messages of `per` records each (addresses, protocol, packets, end in milliseconds); some carry their template."""
    rec = F.concat(hex_ip("src_ip"), hex_ip("dst_ip"), hexn("protocol", 1), hexn(packets, 8), hexn(end_ms, 8))
    g = t.withColumn("rec", rec).groupBy(F.floor(F.col("seq") / per).cast("long").alias("d")).agg(F.array_sort(F.collect_list(F.struct("seq", "rec"))).alias("r"))
    fields = "00080004000c00040004000100020008" + "00990008"
    tmpl = "0002" + "%04x" % (8 + len(fields) // 2) + "0100" + "%04x" % 5 + fields
    g = wire.stage(g, {"_body": F.array_join(F.transform("r", lambda x: x["rec"]), "")})
    g = wire.stage(g, {"_sets": F.concat(F.when(with_template, tmpl).otherwise(""), F.lit("0100"), hexn(F.length("_body") / 2 + 4, 2), F.col("_body"))})
    return g.select("d", F.concat(F.lit("000a"), hexn(F.length("_sets") / 2 + 16, 2), F.lit("65920080"), hexn("d", 4), F.lit("00000007"), F.col("_sets")).alias("payload"))


@query("datagram_counters", over(TRAFFIC, """, v as (select seq // 16 d, count(*) n, count(*) filter (seq % 5 = 0) z from traffic group by 1), i as (select seq // 8 d, count(*) n, count(*) filter (seq % 6 = 0) z from traffic group by 1),
  vk as (select *, case when d % 4 = 3 then 'other' when d % 7 = 0 then 'malformed' when d % 7 = 1 then 'unsupported' else 'ok' end kind from v),
  ik as (select i.*, exists (select 1 from (select distinct d e from i) q where e <= i.d and e % 3 = i.d % 3 and e % 5 = 2) known from i)
  select (select count(*) filter (kind <> 'other') from vk) + (select count(*) from ik) datagrams, cast((select sum(n - z) from vk where kind = 'ok') + (select coalesce(sum(n - z), 0) from ik where known) as bigint) records,
    cast((select sum(z) from vk where kind = 'ok') + (select coalesce(sum(z), 0) from ik where known) as bigint) skipped_records, (select count(*) from ik where not known) missing_template,
    (select count(*) from vk where kind = 'malformed') malformed, (select count(*) from vk where kind = 'unsupported') unsupported, (select count(*) from vk where kind = 'other') other_packets"""))
def datagram_counters(spark, sf):
    """Fixed and template datagrams from a capture: some cut short, of an unknown version, to another port, without template or with empty records."""
    t = V.traffic(spark, sf)
    ms = F.floor((F.col("ts_us") - V.EPOCH) / 1000) + 3_600_000
    v = _v5_hex(t, 16, ms, F.when(F.col("seq") % 5 == 0, 0).otherwise(F.col("packets")))
    cut_short = F.substring("payload", 1, F.length("payload") - 20)
    v = v.select((F.col("d") * 2 + 1).alias("seq"), F.lit("10.9.0.1").alias("exporter"), F.when(F.col("d") % 4 == 3, 53).otherwise(2055).alias("port"),
                 F.when(F.col("d") % 7 == 0, cut_short).when(F.col("d") % 7 == 1, F.concat(F.lit("0007"), F.substring("payload", 5, 1_000_000))).otherwise(F.col("payload")).alias("payload"))
    i = _ipfix_hex(t, 8, F.floor(F.col("ts_us") / 1000), F.col("d") % 5 == 2, F.when(F.col("seq") % 6 == 0, 0).otherwise(F.col("packets")))
    i = i.select((F.col("d") * 2).alias("seq"), F.concat(F.lit("10.8.0."), (F.col("d") % 3).cast("string")).alias("exporter"), F.lit(4739).alias("port"), "payload")
    d = v.unionByName(i).withColumn("ts_us", F.col("seq"))
    return exports.datagram_counters(_udp_frames(d, F.col("port")), [2055, 4739])


@query("datagram_event_order", over(TRAFFIC, """, x as (select seq, seq // 16 dv, seq // 8 di, (ts_us - 1704067200000000) // 1000 - seq % 3 * 400 ms, src_ip from traffic),
  v as (select 'v5' format, dv d, seq, 1704067200000000 + ms * 1000 ts_us, seq % 16 i, src_ip from x), f as (select 'template' format, di d, seq, 1704067200000000 + ms * 1000 ts_us, seq % 8 i, src_ip from x)
  select format, d datagram, cast(row_number() over (partition by format, d order by ts_us, i) - 1 as int) place, cast(i as int) i, ts_us, src_ip from (select * from v union all select * from f)"""))
def datagram_event_order(spark, sf):
    """Records whose ends are tied or run backwards inside their datagram, in two formats."""
    t = V.traffic(spark, sf)
    ms = F.floor((F.col("ts_us") - V.EPOCH) / 1000) - F.col("seq") % 3 * 400
    v = _v5_hex(t, 16, ms + 3_600_000).select((F.col("d") * 2 + 1).alias("seq"), "payload")
    f = _ipfix_hex(t, 8, ms + V.EPOCH // 1000, F.lit(True)).select((F.col("d") * 2).alias("seq"), "payload")
    d = v.unionByName(f).select("seq", F.col("seq").alias("ts_us"), F.lit("10.8.0.1").alias("exporter"), F.unhex("payload").alias("payload"))
    return exports.datagram_events(d).select("format", F.floor(F.col("seq") / 2).alias("datagram"), F.col("place").cast("int").alias("place"), "i", "ts_us", "src_ip")

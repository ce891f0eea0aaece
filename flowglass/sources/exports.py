"""Flow-export datagrams to events: fixed records, template-based records, packet samples."""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import asof_latest
from ..session import cut
from .wire import cut_bytes, decode_frames, ipv4, ipv6, stage, u

MAX_PACKETS, MAX_BYTES = 1_000_000, 1_000_000_000  # counters above are kept as they are and marked `clipped`
REVERSE = 29305  # enterprise number of reverse-direction counters
# Information element numbers.
IE = {"octets": 1, "packets": 2, "protocol": 4, "flags": 6, "src_port": 7, "src_v4": 8, "dst_port": 11, "dst_v4": 12, "end_uptime": 21, "src_v6": 27, "dst_v6": 28,
      "octets_total": 85, "packets_total": 86, "end_s": 151, "end_ms": 153, "init_ms": 160}
TEMPLATE = "array<struct<id:int,ent:long,len:int>>"


def flow_events(r: DataFrame, skipped=False) -> DataFrame:
    """Counters to event columns; rows without addresses, packets or time are dropped, or with `skipped` kept and marked by it.

    Needs seq, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, packets, octets, flags, reverse (null when unseen)."""
    tcp = F.col("protocol") == 6
    fl = F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(0x1FF))
    bit = lambda m: fl.bitwiseAND(F.lit(m)) != 0
    packets = F.col("packets").cast("long")
    over = (packets > MAX_PACKETS) | (F.coalesce("octets", F.lit(0)) > MAX_BYTES) | (F.coalesce("reverse", F.lit(0)) > MAX_BYTES)
    enc = (F.col("src_port") == 443) | (F.col("dst_port") == 443)
    good = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & (F.col("packets") > 0) & (F.col("ts_us") >= 0)
    good = F.coalesce(good, F.lit(False))
    r = r.withColumn("skipped", ~good) if skipped else r.filter(good)
    return r.select(
        *[c for c in r.columns if c not in ("packets", "octets", "flags", "reverse")], packets.alias("packets"), F.coalesce("octets", F.lit(0)).cast("long").alias("bytes"), bit(2).alias("syn"),
        F.when(tcp & bit(2) & ~bit(16), packets).when(tcp & ~bit(2), 0).cast("long").alias("syn_packets"), F.when(tcp & bit(5), True).alias("tcp_fin_rst"), enc.alias("encrypted"),
        F.when((F.col("protocol") == 17) & enc, "QUIC").otherwise("IP").alias("transport"), F.col("reverse").cast("long").alias("reverse_bytes"), F.col("reverse").isNotNull().alias("reverse_observed"), F.coalesce(over, F.lit(False)).alias("clipped"))


def export_datagrams(frames: DataFrame, ports) -> DataFrame:
    """UDP payloads sent to the export ports, with `kept` false for every other packet."""
    r = decode_frames(frames)
    kept = (F.col("status") == "ok") & (F.col("protocol") == 17) & F.col("dst_port").isin(list(ports))
    return r.withColumn("kept", F.coalesce(kept, F.lit(False)))


def datagram_kind(p="payload") -> Column:
    """'v5', 'v9', 'ipfix', 'samples', 'unsupported' or 'malformed' by version field and minimum length."""
    v2, v4 = u(p, 0, 2), u(p, 0, 4)
    n = F.length(F.col(p))
    return (F.when(v4 == 5, "samples").when((v2 == 5) & (n >= 24) & (n >= 24 + 48 * u(p, 2, 2)), "v5").when((v2 == 9) & (n >= 20), "v9")
            .when((v2 == 10) & (n >= 16) & (u(p, 2, 2) <= n) & (u(p, 2, 2) >= 16), "ipfix").when(v2.isin(5, 9, 10), "malformed").otherwise("unsupported"))


def fixed_records(d: DataFrame, skipped=False) -> DataFrame:
    """v5 datagrams (seq, payload) to events; an event is dated at the end of its flow."""
    p = "payload"
    n = u(p, 2, 2)
    boot_us = u(p, 8, 4) * 1_000_000 + F.floor(u(p, 12, 4) / 1000).cast("long") - u(p, 4, 4) * 1000
    r = d.filter((u(p, 0, 2) == 5) & (n > 0) & (F.length(p) >= 24 + 48 * n)).select("seq", boot_us.alias("boot"), p, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    r = r.select("seq", "i", "boot", cut_bytes(p, 24 + 48 * F.col("i"), 48).alias("r"))
    f = stage(r, {"ts_us": F.col("boot") + u("r", 28, 4) * 1000, "src_ip": ipv4("r", 0), "dst_ip": ipv4("r", 4), "src_port": u("r", 32, 2).cast("int"), "dst_port": u("r", 34, 2).cast("int"),
                  "protocol": u("r", 38, 1).cast("int"), "packets": u("r", 16, 4), "octets": u("r", 20, 4), "flags": u("r", 37, 1), "reverse": F.lit(None).cast("long")})
    return flow_events(f.drop("boot", "r"), skipped)


def _walk(start, end, room, init, step):
    """Fold from `start` while at least `room` bytes remain; `step(pos)` gives (advance, item)."""
    zero = F.struct(start.cast("int").alias("pos"), init.alias("out"))

    def go(s, _):
        adv, item = step(s["pos"])
        return F.when((s["pos"] + room <= end) & (adv > 0), F.struct((s["pos"] + adv).cast("int").alias("pos"), F.array_append(s["out"], item).alias("out"))).otherwise(s)

    most = F.greatest(F.lit(1), F.floor((end - start) / room).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), most), zero, go, lambda s: s["out"])


def sets(d: DataFrame) -> DataFrame:
    """Template-based datagrams (seq, ts_us, exporter, payload) to one row per set, with scope and clock."""
    p = "payload"
    ipfix = u(p, 0, 2) == 10
    r = d.filter(datagram_kind(p).isin("v9", "ipfix"))
    head = F.when(ipfix, 16).otherwise(20)
    end = F.when(ipfix, u(p, 2, 2)).otherwise(F.length(p)).cast("int")
    r = stage(r, {"ipfix": ipfix, "domain": F.when(ipfix, u(p, 12, 4)).otherwise(u(p, 16, 4)), "export_us": F.when(ipfix, u(p, 4, 4)).otherwise(u(p, 8, 4)) * 1_000_000,
                       "boot_us": F.when(~ipfix, u(p, 8, 4) * 1_000_000 - u(p, 4, 4) * 1000)})
    r = stage(r, {"_from": head, "_to": end}).select("seq", "ts_us", "exporter", "ipfix", "domain", "export_us", "boot_us", p, "_from", "_to")
    kept = r.schema.fields[:-3]
    added = [T.StructField("set_no", T.IntegerType()), T.StructField("set_id", T.IntegerType()), T.StructField("body", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found = [], []
            for row, (data, pos, stop) in enumerate(zip(*(batch.column(c).to_pylist() for c in (p, "_from", "_to")))):
                for no, one in enumerate(_walk_sets(data, pos, stop)):
                    which.append(row)
                    found.append((no, *one))
            yield from _rows_of(batch.select([f.name for f in kept]), which, found, ["set_no", "set_id", "body"], [pa.int32(), pa.int32(), pa.binary()])

    return r.mapInArrow(run, T.StructType([*kept, *added]))


def _walk_sets(data: bytes, pos: int, stop: int):
    """(set number, body) of each set that starts in [pos, stop); one shorter than its own head ends the datagram."""
    while pos + 4 <= stop:
        size = int.from_bytes(data[pos + 2 : pos + 4], "big")
        if size < 4:
            return
        yield int.from_bytes(data[pos : pos + 2], "big"), data[pos + 4 : pos + size]
        pos += size


def _rows_of(kept: pa.RecordBatch, which: list, found: list, names: list, kinds: list) -> Iterator[pa.RecordBatch]:
    """The rows `which` of a batch with what was found in each, some thousand at a time."""
    for k in range(0, len(which), 1 << 14):
        some = kept.take(pa.array(which[k : k + (1 << 14)], pa.int32()))
        values = [pa.array(c, kind) for c, kind in zip(zip(*found[k : k + (1 << 14)]), kinds)]
        yield pa.RecordBatch.from_arrays([*some.columns, *values], [*some.schema.names, *names])


def templates(s: DataFrame) -> DataFrame:
    """Template definitions in order: (exporter, ipfix, domain, template_id, fields); no fields means withdrawn."""
    b = "body"
    t = s.filter(F.col("set_id") == F.when(F.col("ipfix"), 2).otherwise(0))
    size = F.length(b)
    # A template is walked field by field: enterprise fields take eight bytes, others four.
    init = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("tid"), F.lit(0).alias("left"), F.array().cast(TEMPLATE).alias("fields"), F.array().cast(f"array<struct<tid:int,fields:{TEMPLATE}>>").alias("out"), F.lit(False).alias("stop"))

    def go(a, _):
        make = lambda **k: F.struct(*[k.get(f, a[f]).alias(f) for f in ("pos", "tid", "left", "fields", "out", "stop")])
        tid, count = u(b, a["pos"], 2).cast("int"), u(b, a["pos"] + 2, 2).cast("int")
        fid, length = u(b, a["pos"], 2).cast("int"), u(b, a["pos"] + 2, 2).cast("int")
        ent = F.col("ipfix") & (fid >= 0x8000)
        f = F.struct(F.when(ent, fid - 0x8000).otherwise(fid).cast("int").alias("id"), F.when(ent, u(b, a["pos"] + 4, 4)).otherwise(F.lit(0)).cast("long").alias("ent"), length.alias("len"))
        fields = F.array_append(a["fields"], f)
        done = F.array_append(a["out"], F.struct(a["tid"].alias("tid"), fields.alias("fields")))
        empty = F.array_append(a["out"], F.struct(tid.alias("tid"), F.array().cast(TEMPLATE).alias("fields")))
        nxt = (a["pos"] + F.when(ent, 8).otherwise(4)).cast("int")
        header = F.when(tid.isNull() | count.isNull() | (tid < 256), make(stop=F.lit(True))).when(count == 0, make(pos=(a["pos"] + 4).cast("int"), out=empty)).otherwise(
            make(pos=(a["pos"] + 4).cast("int"), tid=tid, left=count, fields=F.array().cast(TEMPLATE)))
        field = F.when(length.isNull(), make(stop=F.lit(True))).when(a["left"] == 1, make(pos=nxt, left=F.lit(0), out=done)).otherwise(make(pos=nxt, left=(a["left"] - 1).cast("int"), fields=fields))
        return F.when(a["stop"], a).when(a["left"] == 0, header).otherwise(field)

    defs = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(size / 4).cast("int"))), init, go, lambda a: a["out"])
    d = t.select("seq", "ts_us", "set_no", "exporter", "ipfix", "domain", F.explode(defs).alias("d"))
    return d.select("seq", "ts_us", "set_no", "exporter", "ipfix", "domain", F.col("d.tid").alias("template_id"), F.col("d.fields").alias("fields"))


def template_records(d: DataFrame, skipped=False) -> DataFrame:
    """v9 and IPFIX datagrams to events; sets without a known template are counted by `missing_templates`."""
    s = with_templates(d)
    known = s.filter(F.size("fields") > 0).select("seq", "set_no", "exporter", "export_us", "boot_us", "body", "fields")
    kept = known.schema.fields[:-2]
    wanted = {**{name: (number, 0) for name, number in IE.items()}, "reverse": (IE["octets"], REVERSE)}
    names = ["i", *["_" + name for name in wanted]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = {}
        for batch in batches:
            which, found = [], []
            for row, (body, fields) in enumerate(zip(batch.column("body").to_pylist(), batch.column("fields").to_pylist())):
                key = tuple((f["id"], f["ent"], f["len"]) for f in fields)
                if key not in layouts:
                    first = {}
                    for k, f in enumerate(key):
                        first.setdefault(f[:2], k)
                    if len(layouts) == 1024:
                        layouts.clear()
                    layouts[key] = [f[2] for f in key], [first.get(x) for x in wanted.values()]
                sizes, picks = layouts[key]
                for i, values in enumerate(_walk_records(body or b"", sizes)):
                    which.append(row)
                    found.append((i, *[None if k is None else values[k] for k in picks]))
            yield from _rows_of(batch.select([f.name for f in kept]), which, found, names, [pa.int32(), *[pa.binary()] * len(wanted)])

    r = known.mapInArrow(run, T.StructType([*kept, T.StructField("i", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in names[1:]]]))
    raw = lambda name: F.col("_" + name)
    num = lambda c: F.conv(F.hex(c), 16, 10).cast("long")
    addr4, addr6 = lambda c: F.when(F.length(c) == 4, ipv4(c, 0)), lambda c: F.when(F.length(c) == 16, ipv6(c, 0))
    boot = F.coalesce(F.col("boot_us"), num(raw("init_ms")) * 1000)
    end = F.coalesce(num(raw("end_ms")) * 1000, num(raw("end_s")) * 1_000_000, boot + num(raw("end_uptime")) * 1000, F.col("export_us"))
    zero = lambda c: F.coalesce(num(c), F.lit(0)).cast("int")
    f = stage(r, {"ts_us": end, "src_ip": F.coalesce(addr4(raw("src_v4")), addr6(raw("src_v6"))), "dst_ip": F.coalesce(addr4(raw("dst_v4")), addr6(raw("dst_v6"))),
                  "src_port": zero(raw("src_port")), "dst_port": zero(raw("dst_port")), "protocol": zero(raw("protocol")), "packets": F.coalesce(num(raw("packets")), num(raw("packets_total"))),
                  "octets": F.coalesce(num(raw("octets")), num(raw("octets_total"))), "flags": num(raw("flags")), "reverse": num(raw("reverse"))})
    return flow_events(f.drop(*names[1:], "export_us", "boot_us"), skipped)


def _walk_records(body: bytes, sizes: list):
    """The fields of each record of a set; a size of 65535 says that the field brings its own length.

    A field past the end is cut, one behind a length that is missing is None; both can only be in the last record."""
    least = max(1, sum(1 if n == 65535 else n for n in sizes))
    pos = 0
    for _ in range(max(1, len(body) // least)):
        if pos is None or len(body) - pos < least:
            return
        out = []
        for n in sizes:
            if pos is None:
                out.append(None)
                continue
            if n == 65535:
                head = body[pos : pos + 3]
                n, skip = (None, 1) if not head else (head[0], 1) if head[0] < 255 else (int.from_bytes(head[1:], "big") if len(head) == 3 else None, 3)
                pos += skip
            out.append(body[pos : pos + (n or 0)])
            pos = None if n is None else pos + n
        yield out


def with_templates(d: DataFrame) -> DataFrame:
    """Data sets with the newest earlier template of their scope (an as-of join in arrival order)."""
    s = cut(sets(d))  # read four times: templates and data, rows and block totals
    key = ["exporter", "ipfix", "domain", "template_id"]
    order = F.col("seq") * 65_536 + F.col("set_no")
    t = templates(s).select(*key, "ts_us", order.alias("seq"), "fields")
    data = s.filter("set_id >= 256").withColumn("template_id", F.col("set_id"))
    data = data.select(*key, "ts_us", order.alias("seq"), F.col("seq").alias("datagram"), "set_no", "export_us", "boot_us", "body")
    j = asof_latest(data, t, key, ["fields"])
    return j.withColumn("fields", F.coalesce("last_fields", F.array().cast(TEMPLATE))).drop("last_fields", "seq").withColumnRenamed("datagram", "seq")


def missing_templates(d: DataFrame) -> DataFrame:
    return with_templates(d).groupBy("exporter").agg(F.count(F.lit(1)).alias("data_sets"), F.count_if(F.size("fields") == 0).alias("missing"))


def sampled_headers(d: DataFrame) -> DataFrame:
    """Packet-sample datagrams (seq, ts_us, payload) to (seq, rate, frame): raw Ethernet header records of flow samples."""
    p = "payload"
    r = d.filter((u(p, 0, 4) == 5) & u(p, 4, 4).isin(1, 2))
    start = F.when(u(p, 4, 4) == 1, 28).otherwise(40)
    item = lambda pos: ((u(p, pos + 4, 4) + 8).cast("int"), F.struct(u(p, pos, 4).cast("int").alias("fmt"), cut_bytes(p, pos + 8, u(p, pos + 4, 4)).alias("body")))
    s = r.select("seq", "ts_us", F.explode(_walk(start, F.length(p).cast("int"), 8, F.array().cast("array<struct<fmt:int,body:binary>>"), item)).alias("s")).select("seq", "ts_us", "s.fmt", "s.body").filter("fmt in (1, 3)")
    b = "body"
    wide = F.col("fmt") == 3
    s = stage(s, {"rate": F.greatest(F.lit(1), F.when(wide, u(b, 12, 4)).otherwise(u(b, 8, 4)))})
    rec = lambda pos: ((u(b, pos + 4, 4) + 8).cast("int"), F.struct(u(b, pos, 4).cast("int").alias("fmt"), cut_bytes(b, pos + 8, u(b, pos + 4, 4)).alias("raw")))
    x = s.select("seq", "ts_us", "rate", F.explode(_walk(F.when(wide, 44).otherwise(32), F.length(b).cast("int"), 8, F.array().cast("array<struct<fmt:int,raw:binary>>"), rec)).alias("x"))
    x = x.select("seq", "ts_us", "rate", "x.fmt", "x.raw").filter("fmt = 1").filter((F.length("raw") >= 16) & (u("raw", 0, 4) == 1))
    return x.select("seq", "ts_us", "rate", cut_bytes("raw", 16, u("raw", 12, 4)).alias("frame"))


def sampled_records(d: DataFrame, skipped=False) -> DataFrame:
    """Packet-sample datagrams to events: the sampled header stands for `rate` packets of its length, dated at arrival."""
    s = sampled_headers(d).withColumn("i", F.row_number().over(W.partitionBy("seq").orderBy(F.monotonically_increasing_id())) - 1)
    h = decode_frames(s)
    ok = F.col("status") == "ok"
    only = lambda c: F.when(ok, F.col(c))
    f = stage(h, {"src_ip": only("src_ip"), "dst_ip": only("dst_ip"), "src_port": F.coalesce("src_port", F.lit(0)), "dst_port": F.coalesce("dst_port", F.lit(0)), "protocol": F.col("protocol"),
                  "packets": F.col("rate"), "octets": F.col("rate") * F.col("ip_bytes"), "flags": F.col("tcp_flags").cast("long"), "reverse": F.lit(None).cast("long")})
    return flow_events(f.select("seq", "i", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "octets", "flags", "reverse"), skipped)


def datagram_events(d: DataFrame, skipped=False) -> DataFrame:
    """Events of all export formats (seq, ts_us, exporter, payload) with `place`, their order in the datagram: by flow end, equal ends as they stand.

    A datagram holds at most 64 KB, so a group of this order is small whatever the traffic."""
    named = lambda df, kind, set_no: df.withColumns({"format": F.lit(kind), "set_no": set_no})
    none = F.lit(0).cast("int")
    parts = [named(fixed_records(d, skipped), "v5", none), named(template_records(d, skipped), "template", F.col("set_no")), named(sampled_records(d, skipped), "samples", none)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("place", F.row_number().over(W.partitionBy("seq").orderBy("ts_us", "set_no", "i")) - 1)


def datagram_counters(frames: DataFrame, ports) -> DataFrame:
    """One row of decode counters over captured frames (seq, ts_us, frame): datagrams, records, skipped_records, missing_template, malformed, unsupported, other_packets.

    Frames are decoded once; the datagrams alone are kept for the record counts."""
    r = export_datagrams(frames, ports).withColumn("kind", datagram_kind())
    kept = cut(r.select("seq", "ts_us", F.col("src_ip").alias("exporter"), "payload", "kept", F.when(F.col("kept"), F.col("kind")).alias("kind")).withColumn("payload", F.when(F.col("kept"), F.col("payload"))))
    d = kept.filter("kept and kind not in ('malformed', 'unsupported')").select("seq", "ts_us", "exporter", "payload")
    heads = kept.agg(F.count_if("kept").alias("datagrams"), F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("kind") == "unsupported").alias("unsupported"), F.count_if(~F.col("kept")).alias("other_packets"))
    none = F.lit(0).cast("long")
    per = datagram_events(d, skipped=True).agg(F.count_if(~F.col("skipped")).alias("records"), F.count_if("skipped").alias("skipped_records"))
    missing = missing_templates(d).agg(F.coalesce(F.sum("missing"), none).alias("missing_template"))
    names = ["datagrams", "records", "skipped_records", "missing_template", "malformed", "unsupported", "other_packets"]
    rows = heads.unionByName(per, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(n), none).alias(n) for n in names])

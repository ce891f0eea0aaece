"""Rate windows over whole seconds: global, per destination, per source (causal at every row)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import xlog2x
from .ordered import FIRST, bucket_sums, causal, running_sums

SECONDS = 10


def syn_accounting() -> dict:
    """Per-event packet counts behind the SYN shares."""
    tcp, one = F.col("protocol") == 6, F.col("packets") == 1
    known = F.col("syn_packets")
    syn = F.when(~tcp, 0).otherwise(F.coalesce(known, F.when(one, F.col("syn").cast("long")).otherwise(0)))
    return {
        "syn_count": syn.cast("long"),
        "syn_ack_count": (tcp & one & F.col("syn") & F.coalesce(known == 0, F.lit(False))).cast("long"),
        "unknown_syn_count": F.when(tcp & ~one & known.isNull(), F.col("packets")).otherwise(0).cast("long"),
        "summary_events": (~one).cast("long"),
        "size_squared": F.col("bytes") * F.col("bytes") / F.col("packets"),
    }


def source_mix(rows: DataFrame, keys, weight, sums=None, horizon=SECONDS, base=None, prefix="", sub_us=None) -> DataFrame:
    """Adds `<prefix>source_entropy`, `<prefix>source_count` and `<prefix><name>` for each of `sums`, over `[sec-horizon, sec]`.

    Entropy is log2(N) - S/N with S = sum of c*log2(c) over sources.  S at the start
    of a second is a running sum of changes: a source's count changes only in the
    second after it was seen and `horizon` + 1 seconds later.  Inside the second the
    rows add their own changes in arrival order.  Everything about earlier seconds
    comes from one table per (key, second, source), so the rows are shuffled twice:
    by source within the second, then by second."""
    base = rows if base is None else base
    keys, w, sums = list(keys), weight, sums or {}
    zero = F.lit(0).cast("long")
    per_source = base.groupBy(*keys, "sec", "src_ip").agg(F.sum(w).alias("c"), *[F.sum(e).alias("_t_" + n) for n, e in sums.items()])
    at = W.partitionBy(*keys, "src_ip").orderBy("sec")
    # Counts are dealt by source once, for what stands at a second and for its changes.
    counts = per_source.select(*keys, "sec", "src_ip", "c").repartition(*keys, "src_ip")
    standing = counts.select(*keys, "sec", "src_ip", F.coalesce(F.sum("c").over(at.rangeBetween(-horizon, -1)), F.lit(0)).alias("_c0"))

    # Change points of each source's visible count, one or two per (source, second).
    edges = counts.select(*keys, "src_ip", F.explode(F.array(
        F.struct((F.col("sec") + 1).alias("sec"), F.col("c").alias("d")),
        F.struct((F.col("sec") + horizon + 1).alias("sec"), (-F.col("c")).alias("d")))).alias("e"))
    edges = edges.groupBy(*keys, "src_ip", "e.sec").agg(F.sum("e.d").alias("d"))
    edges = edges.withColumn("_a", F.sum("d").over(at.rowsBetween(FIRST, 0))).withColumn("_b", F.col("_a") - F.col("d"))
    names = ["_t_" + n for n in sums]
    change = edges.groupBy(*keys, "sec").agg(
        F.sum(xlog2x("_a") - xlog2x("_b")).alias("s"), F.sum("d").alias("n"),
        F.sum((F.col("_a") > 0).cast("long") - (F.col("_b") > 0).cast("long")).alias("k"))
    change = change.select(*keys, "sec", F.lit(False).alias("own"), "s", "n", "k", *[zero.alias(n) for n in names])
    own = per_source.groupBy(*keys, "sec").agg(*[F.sum(n).alias(n) for n in names] or [F.count(F.lit(1)).alias("_")])
    own = own.select(*keys, "sec", F.lit(True).alias("own"), F.lit(0.0).alias("s"), zero.alias("n"), zero.alias("k"), *names)
    over_time = W.partitionBy(*keys).orderBy("sec")
    upto, window = over_time.rangeBetween(FIRST, 0), over_time.rangeBetween(-horizon, -1)
    start = (change.unionByName(own)
             .select(*keys, "sec", "own", *[F.sum(x).over(upto).alias("_%s0" % x) for x in "snk"], *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(n) for n in names])
             .filter("own").drop("own"))

    inside = W.partitionBy(*keys, "sec", "src_ip").orderBy("ts_us", "seq").rowsBetween(FIRST, -1)
    r = (rows.withColumns({"_w": w, **{"_x_" + n: e for n, e in sums.items()}}).join(standing, [*keys, "sec", "src_ip"])
         .withColumn("_c", F.col("_c0") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
         .withColumns({"_ds": xlog2x(F.col("_c") + F.col("_w")) - xlog2x("_c"), "_dk": (F.col("_c") == 0).cast("long")}))
    run = {"_s": F.col("_ds"), "_n": F.col("_w"), "_k": F.col("_dk"), **{"_i_" + n: F.col("_x_" + n) for n in sums}}
    if sub_us:
        r = running_sums(r, [*keys, "sec"], run, block_us=sub_us)
    else:
        r = r.select("*", *[F.sum(e).over(causal(*keys, "sec")).alias(n) for n, e in run.items()])
    r = r.join(start, [*keys, "sec"])
    n = (F.col("_n") + F.col("_n0")).cast("double")
    entropy = F.greatest(F.lit(0.0), F.log2(n) - (F.col("_s") + F.col("_s0")) / n)
    return r.select(*rows.columns, entropy.alias(prefix + "source_entropy"), (F.col("_k") + F.col("_k0")).alias(prefix + "source_count"),
                    *[(F.col("_i_" + m) + F.col("_t_" + m)).alias(prefix + m) for m in sums])


def global_rates(rows: DataFrame, base=None, cap=4096, sub_us=None) -> DataFrame:
    """Packet and byte rate and source entropy of the whole link."""
    out = source_mix(rows, [], F.lit(1).cast("long"), {"p": F.col("packets"), "b": F.col("bytes")}, base=base, prefix="_g", sub_us=sub_us)
    return out.select(*rows.columns, (F.col("_gp") / SECONDS).alias("packet_rate"), (F.col("_gb") / SECONDS).alias("byte_rate"),
                      F.col("_gsource_entropy").alias("source_entropy"), F.col("_gsource_count").alias("source_count"),
                      (F.col("_gsource_count") > cap).alias("source_entropy_partial"), F.col("_gp").alias("window_packets"))


def target_rates(rows: DataFrame, base=None, cap=256) -> DataFrame:
    """Per-destination window of the row's protocol; TCP and UDP readings with neutral values elsewhere.

    `udp_target_packets` over `window_packets` of `global_rates` is the destination's share (`concentration`)."""
    keys = ["dst_ip", "protocol"]
    acct = syn_accounting()
    sums = {"p": F.col("packets"), "b": F.col("bytes"), "syn": acct["syn_count"], "ack": acct["syn_ack_count"],
            "unk": acct["unknown_syn_count"], "sm": acct["summary_events"], "sq": acct["size_squared"]}
    out = source_mix(rows, keys, F.col("packets"), sums, base=base, prefix="_t")
    tcp, udp = F.col("protocol") == 6, F.col("protocol") == 17
    p = F.col("_tp").cast("double")
    mean = F.col("_tb") / p
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_tsq") / p - mean * mean))
    known = F.col("_tunk") == 0
    count, entropy = F.col("_tsource_count"), F.col("_tsource_entropy")

    def on(which, value, other):
        return F.when(which, value).otherwise(F.lit(other))

    return out.select(
        *rows.columns,
        on(tcp, p / SECONDS, 0.0).alias("syn_target_packet_rate"),
        on(tcp, F.when(known, F.col("_tsyn") / p), 0.0).alias("syn_target_fraction"),
        on(tcp, F.when(known, F.col("_tack") / p), 0.0).alias("syn_target_ack_fraction"),
        on(tcp, F.when(~known, "unavailable").when(F.col("_tsm") > 0, "declared_summary_counts").otherwise("packet_exact"), "not_tcp").alias("syn_target_fraction_basis"),
        on(tcp, entropy, 0.0).alias("syn_target_source_entropy"),
        on(tcp, count, 0).alias("syn_target_source_count"),
        on(tcp, count > cap, False).alias("syn_target_entropy_partial"),
        on(udp, p / SECONDS, 0.0).alias("udp_target_packet_rate"),
        on(udp, F.col("_tb") / SECONDS, 0.0).alias("udp_target_byte_rate"),
        on(udp, entropy, 0.0).alias("udp_target_source_entropy"),
        on(udp, count, 0).alias("udp_target_source_count"),
        on(udp, count > cap, False).alias("udp_target_entropy_partial"),
        on(udp, F.col("_tp"), 0).alias("udp_target_packets"),
        on(udp, mean, 0.0).alias("udp_packet_size_mean"),
        on(udp, F.when(mean > 0, spread / mean).otherwise(0.0), 0.0).alias("udp_packet_size_cv"),
        on(udp, F.when(F.col("_tsm") > 0, "summary_mean_proxy").otherwise("packet_exact"), "not_udp").alias("udp_packet_size_basis"))


def concentration():
    """Share of the link's packets in the window that go to the row's UDP destination; 0 for other protocols."""
    return F.col("udp_target_packets") / F.col("window_packets")


def forward_bytes(rows: DataFrame, base=None) -> DataFrame:
    """Bytes sent by the source in seconds [s-60, s] and their rate over [s-10, s]."""
    out = bucket_sums(rows, ["src_ip"], {"b": F.col("bytes")}, {"_b60": ("b", 60), "_b10": ("b", SECONDS)}, base=base)
    return out.select(*rows.columns, F.col("_b60").alias("source_forward_bytes_60s"), (F.col("_b10") / 10).alias("source_forward_byte_rate_10s"))


def reserved_share(rows: DataFrame, min_sources=4) -> DataFrame:
    """Martian sources among the distinct sources of each (destination, protocol) in the row's window.

    Reads one row per (destination, source, second), not the raw events; the answer is
    given per second at its end."""
    from ..functions.ip import is_martian

    seen = rows.select("dst_ip", "protocol", "src_ip", "sec").distinct().withColumn("bad", is_martian("src_ip"))
    at = W.partitionBy("dst_ip", "protocol", "src_ip").orderBy("sec")
    # A source stays visible until the earlier of its next sighting or `SECONDS` seconds later.
    until = F.least(F.coalesce(F.lead("sec").over(at), F.lit(2 ** 62)), F.col("sec") + SECONDS + 1)
    spans = seen.withColumn("until", until)
    steps = spans.select("dst_ip", "protocol", F.explode(F.array(
        F.struct("sec", F.lit(1).alias("n"), F.col("bad").cast("int").alias("b")),
        F.struct(F.col("until").alias("sec"), F.lit(-1).alias("n"), (-F.col("bad").cast("int")).alias("b")))).alias("e"))
    steps = steps.groupBy("dst_ip", "protocol", "e.sec").agg(F.sum("e.n").alias("n"), F.sum("e.b").alias("b"))
    run = W.partitionBy("dst_ip", "protocol").orderBy("sec").rowsBetween(FIRST, 0)
    live = steps.select("dst_ip", "protocol", "sec", F.sum("n").over(run).alias("tracked_sources"), F.sum("b").over(run).alias("reserved"))
    ok = (F.col("tracked_sources") >= min_sources) & (F.col("reserved") > 0)
    at_event = live.join(rows.select("dst_ip", "protocol", "sec").distinct(), ["dst_ip", "protocol", "sec"], "left_semi")
    return at_event.select("dst_ip", "protocol", "sec", "tracked_sources", F.when(ok, F.col("reserved")).alias("source_reserved_count"),
                           F.when(ok, F.round(F.col("reserved") / F.col("tracked_sources"), 4)).alias("source_reserved_fraction"))


def singleton_sources(rows: DataFrame, base=None, horizon=SECONDS) -> DataFrame:
    """Per event, over its destination's window: distinct sources, share seen exactly once, summary-record rate."""
    base = rows if base is None else base
    keys = ["dst_ip"]
    per_source = base.groupBy(*keys, "sec", "src_ip").agg(F.count("*").alias("c"))
    at = W.partitionBy(*keys, "src_ip").orderBy("sec")
    standing = per_source.select(*keys, "sec", "src_ip", F.coalesce(F.sum("c").over(at.rangeBetween(-horizon, -1)), F.lit(0)).alias("_c0"))
    edges = per_source.select(*keys, "src_ip", F.explode(F.array(
        F.struct((F.col("sec") + 1).alias("sec"), F.col("c").alias("d")),
        F.struct((F.col("sec") + horizon + 1).alias("sec"), (-F.col("c")).alias("d")))).alias("e")).groupBy(*keys, "src_ip", "e.sec").agg(F.sum("e.d").alias("d"))
    edges = edges.withColumn("_a", F.sum("d").over(at.rowsBetween(FIRST, 0))).withColumn("_b", F.col("_a") - F.col("d"))
    flag = lambda c: c.cast("long")
    change = edges.groupBy(*keys, "sec").agg(F.sum(flag(F.col("_a") > 0) - flag(F.col("_b") > 0)).alias("k"),
                                             F.sum(flag(F.col("_a") == 1) - flag(F.col("_b") == 1)).alias("o"))
    own = per_source.select(*keys, "sec", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("o"), F.lit(True).alias("own")).distinct()
    run = W.partitionBy(*keys).orderBy("sec").rangeBetween(FIRST, 0)
    start = (change.withColumn("own", F.lit(False)).unionByName(own)
             .select(*keys, "sec", "own", F.sum("k").over(run).alias("_k0"), F.sum("o").over(run).alias("_o0")).filter("own").drop("own"))
    r = bucket_sums(rows, keys, {"sm": (F.col("packets") > 1).cast("long")}, {"_sm": ("sm", horizon)}, base=base)
    inside = W.partitionBy(*keys, "sec", "src_ip").orderBy("ts_us", "seq").rowsBetween(FIRST, -1)
    r = r.join(standing, [*keys, "sec", "src_ip"]).withColumn("_c", F.col("_c0") + F.count(F.lit(1)).over(inside))
    w = causal(*keys, "sec")
    r = r.withColumns({"_k": F.sum(flag(F.col("_c") == 0)).over(w), "_o": F.sum(flag(F.col("_c") == 0) - flag(F.col("_c") == 1)).over(w)})
    r = r.join(start, [*keys, "sec"])
    n = F.col("_k") + F.col("_k0")
    return r.select(*rows.columns, n.alias("unique_sources"), ((F.col("_o") + F.col("_o0")) / n).alias("singleton_fraction"), (F.col("_sm") / horizon).alias("summary_rate"))

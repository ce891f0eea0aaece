"""Per-source history: what happened in the last 60 and 10 seconds, read at every event, whatever the number of events.

Nothing is collected.  Every event enters its windows when it arrives and leaves them when it is too old: two change points, and a
running sum over both, cut into blocks of a key's timeline, gives the window's content at each event.  Distinct values change when a value
enters unseen and when its last sighting grows too old.  Sums that are subtracted again are whole numbers, so nothing is lost."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, tunnel_name
from ..session import cut
from .ordered import Heat, change_points, heat, neighbours

BLOCK_US = 1_000_000
NAME_SHAPE = ["dns_label_count", "dns_encoded_max_label_length", "dns_encoded_total_length", "dns_encoded_entropy"]
# Fixed value: md5 of the lab handshake '771,49195-49199,0-23-65281,29-23-24,0'.
LAB_FINGERPRINT = "7e4d466a0b44cdff79321bd4c7115dc1"


def probe_syn():
    """SYN seen and not a lone SYN+ACK reply; an unknown count is a probe."""
    return F.col("syn") & ~F.col("syn_packets").eqNullSafe(F.lit(0))


def is_dns_question():
    return F.coalesce(F.length("dns_name") > 0, F.lit(False)) & (F.col("dst_port") == 53) & F.col("protocol").isin(6, 17)


def source_window(rows: DataFrame, wide: int, near: int, seen: Heat | None = None) -> DataFrame:
    """Per event: what its source did in the last `wide` and `near` microseconds."""
    one = rows.select("seq", "ts_us", "src_ip", "dst_ip", "dst_port", F.col("bytes").cast("long").alias("bytes"), probe_syn().cast("int").alias("probe"))
    # Dealt by source once: every window below is of one source.
    one = neighbours(neighbours(one.repartition("src_ip"), ["src_ip", "dst_ip"], "_pd", "_nd", BLOCK_US, seen=seen), ["src_ip", "dst_port"], "_pp", "_np", BLOCK_US, seen=seen)
    one = _twice(one, seen)
    short, long = {"events": F.lit(1), "probes": F.col("probe")}, {"total": F.col("bytes")}
    # `edge` counts events exactly as old as the window: with one, the window is full.
    c = change_points(one, ["src_ip"], [
        (None, {**short, **long}, None), (_at(near + 1), _minus(short), None), (_at(wide + 1), {**_minus(long), "edge": F.lit(-1)}, None), (_at(wide), {"edge": F.lit(1)}, None),
        *_distinct("_pd", "_nd", near, "destinations"), *_distinct("_pp", "_np", near, "ports")], BLOCK_US, seen)
    return c.select("seq", F.col("destinations").cast("int").alias("destination_count"), F.col("ports").cast("int").alias("port_count"),
                    (F.col("probes").cast("double") / F.col("events").cast("double")).alias("syn_fraction"), F.col("total").cast("long").alias("egress_bytes"), (F.col("edge") == 0).alias("window_partial"))


def peer_window(rows: DataFrame, wide: int, seen: Heat | None = None) -> DataFrame:
    """Per event: timing and sizes of its source's events to the same destination and port.  A gap counts while its earlier end is in the window."""
    peer = ["src_ip", "dst_ip", "dst_port"]
    one = rows.select("seq", "ts_us", *peer, F.coalesce(F.col("tls_fingerprint") == LAB_FINGERPRINT, F.lit(False)).cast("int").alias("lab"), F.round(F.col("bytes") / F.col("packets") * 1e6).cast("long").alias("size"))
    square = lambda c: c.cast("decimal(19,0)") * c.cast("decimal(19,0)")
    own = {"n": F.lit(1), "sizes": F.col("size"), "squares": square(F.col("size")), "labs": F.col("lab")}
    gap = F.col("ts_us") - F.col("_prev.ts_us")
    apart, counts = {"gaps": gap, "gap_squares": square(gap)}, F.coalesce(gap <= wide, F.lit(False))
    c = change_points(_twice(neighbours(one.repartition("src_ip"), peer, "_prev", "_next", BLOCK_US, seen=seen, newest_first=True), seen), peer, [
        (None, own, None), (_at(wide + 1), _minus(own), None), (None, apart, counts), (F.col("_prev.ts_us") + wide + 1, _minus(apart), counts)], BLOCK_US, seen)
    spread = lambda n, s, ss: F.sqrt(F.greatest(F.lit(0.0), (n * ss - s * s).cast("double"))) / n / 1e6
    n, gaps = F.col("n"), F.col("n") - 1
    gap_mean = F.when(n > 1, F.col("gaps").cast("double") / gaps.cast("double") / 1e6).otherwise(F.lit(0.0))
    size_mean = F.col("sizes").cast("double") / n.cast("double") / 1e6
    return c.select("seq", gap_mean.alias("iat_mean"),
                    F.when(gaps < 2, F.lit(0.0)).otherwise(spread(gaps, F.col("gaps"), F.col("gap_squares")) / F.greatest(gap_mean, F.lit(1e-9))).alias("iat_cv"),
                    F.when(n < 2, F.lit(0.0)).otherwise(spread(n, F.col("sizes"), F.col("squares")) / F.greatest(size_mean, F.lit(1e-9))).alias("size_cv"),
                    n.cast("int").alias("history_count"), (F.col("labs") > 0).cast("int").alias("fingerprint_risk"))


def question_window(rows: DataFrame, near: int, seen: Heat | None = None) -> DataFrame:
    """Per DNS question: its source's questions for the same base name."""
    shape = tunnel_name("dns_name")
    asked = rows.filter(is_dns_question()).select("seq", "ts_us", "src_ip", clean_name("dns_name").alias("name"), F.coalesce(shape["dns_base"], F.lit("")).alias("base"), *[shape[k].alias(k) for k in NAME_SHAPE])
    encoded = (F.col("dns_encoded_max_label_length") >= 24) & (F.col("dns_encoded_total_length") >= 32) & (F.col("dns_encoded_entropy") >= 3.5)
    quiet = asked.select("seq", "ts_us", "src_ip", "base", "name", encoded.cast("int").alias("enc")).repartition("src_ip")
    quiet = neighbours(quiet, ["src_ip", "base", "name"], "_pn", "_nn", BLOCK_US, seen=seen)
    both = {"q": F.lit(1), "q_enc": F.col("enc")}
    c = change_points(quiet, ["src_ip", "base"], [(None, both, None), (_at(near + 1), _minus(both), None), *_distinct("_pn", "_nn", near, "q_names")], BLOCK_US, seen)
    c = c.select("seq", F.col("q").cast("int").alias("dns_base_queries_10s"), (F.col("q_names").cast("double") / F.col("q").cast("double")).alias("dns_base_unique_ratio_10s"), F.col("q_enc").cast("int").alias("dns_base_encoded_queries_10s"))
    return c.join(asked.select("seq", F.lit(1).alias("dns_query_visible"), *NAME_SHAPE), "seq")


def _twice(rows: DataFrame, seen: Heat | None) -> DataFrame:
    """Blocks read the narrow rows twice, so for them they are written once instead of being derived again."""
    return cut(rows) if seen is None or seen else rows


def _at(us: int):
    return F.col("ts_us") + us


def _minus(amounts: dict) -> dict:
    return {k: -v for k, v in amounts.items()}


def _distinct(prev: str, next_: str, near: int, name: str) -> list:
    """A value counts from its first sighting in the recent window until its last has left it."""
    before, after = F.col(prev + ".ts_us"), F.col(next_ + ".ts_us")
    return [(None, {name: F.lit(1)}, before.isNull() | (before < F.col("ts_us") - near)), (_at(near + 1), {name: F.lit(-1)}, after.isNull() | (after > F.col("ts_us") + near))]


def source_history(rows: DataFrame, window_ms=60_000, recent_ms=10_000, families=("source", "peer", "question")) -> DataFrame:
    """Adds fan-out, SYN share and byte total (`source`), same-peer timing and sizes (`peer`), same-base DNS activity (`question`)."""
    wide, near = window_ms * 1000, recent_ms * 1000
    h, seen = rows, heat(rows, ["src_ip"])
    if "source" in families:
        h = h.join(source_window(rows, wide, near, seen), "seq")
    if "peer" in families:
        h = h.join(peer_window(rows, wide, seen), "seq")
    if "question" in families:
        h = h.join(question_window(rows, near, seen), "seq", "left").fillna({"dns_query_visible": 0, "dns_base_queries_10s": 0, "dns_base_unique_ratio_10s": 0.0, "dns_base_encoded_queries_10s": 0, **{c: 0 for c in NAME_SHAPE}})
    return h


def byte_ratio(rows: DataFrame) -> DataFrame:
    """Observed forward/reverse ratio: null unless reverse bytes were observed and nonzero."""
    seen = F.col("reverse_observed")
    ratio = F.when(seen & (F.col("reverse_bytes") > 0), F.col("bytes") / F.col("reverse_bytes"))
    status = (F.when(~seen, "reverse_unavailable").when(F.col("reverse_bytes") == 0, "zero_observed_reverse_bytes")
              .otherwise("finite_observed_ratio"))
    return rows.withColumns({"observed_byte_ratio": ratio, "observed_byte_ratio_status": status})

"""Encrypted sessions, flow identities and fingerprint rarity."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import array_cv, array_mean, gaps_seconds
from .ordered import drop_history, recent, running_sums, sessionize, with_history

IDLE_US = 60_000_000
FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
SESSION_KEY = ["client", "server", "service"]


def one_decimal_ms(us) -> Column:
    """Milliseconds with one decimal, rounded as IEEE doubles round (exact ties to even)."""
    c = F.col(us) if isinstance(us, str) else us
    ms = c / 1000.0
    whole = F.floor(ms).cast("long")
    m = ((ms - whole) * (1 << 20)).cast("long") * 10
    q, rem = F.shiftright(m, 20), m % (1 << 20)
    up = (rem > (1 << 19)) | ((rem == (1 << 19)) & (q % 2 == 1))
    tenths = q + up.cast("long")
    return F.concat((whole + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def flow_identity(rows: DataFrame, base=None) -> DataFrame:
    """Adds `flow_id`: 32 hex digits naming the 5-tuple session; a gap of 60 s or more restarts it."""
    s = sessionize(rows, FIVE_TUPLE, IDLE_US, keep_equal=False, base=base)
    text = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string"), F.lit("->"), F.col("dst_ip"), F.lit(":"),
                    F.col("dst_port").cast("string"), F.lit(":"), F.col("protocol").cast("string"), F.lit(":"), one_decimal_ms("session_start"))
    return s.withColumn("flow_id", F.substring(F.sha2(text, 256), 1, 32)).withColumnRenamed("session_start", "flow_start_us").drop("session_seq")


def orient_session(rows: DataFrame) -> DataFrame:
    """Both directions share one key: the lower port, or the side that sent a server handshake, serves."""
    back = (F.coalesce(F.length("tls_server_fingerprint") > 0, F.lit(False))) | ((F.col("src_port") > 0) & (F.col("src_port") < F.col("dst_port")))
    pick = lambda a, b: F.when(back, F.col(a)).otherwise(F.col(b))
    return rows.withColumns({"client": pick("dst_ip", "src_ip"), "server": pick("src_ip", "dst_ip"), "service": pick("src_port", "dst_port")})


def event_fingerprint() -> Column:
    full = lambda c: F.when(F.length(c) > 0, F.col(c))
    return F.coalesce(full("tls_ja4"), full("tls_fingerprint"), full("quic_fingerprint"))


def tls_sessions(rows: DataFrame, depth=64) -> DataFrame:
    """One row per encrypted event: causal statistics of its session."""
    enc = orient_session(rows.filter("encrypted").select(
        "seq", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "packets", "bytes", "tls_fingerprint", "tls_server_fingerprint", "tls_ja4", "quic_fingerprint"))
    full = lambda c: F.when(F.length(c) > 0, F.col(c))
    enc = enc.select("seq", "ts_us", *SESSION_KEY, "packets", "bytes", full("tls_fingerprint").alias("ja3"), full("tls_server_fingerprint").alias("ja3s"),
                     full("tls_ja4").alias("ja4"), full("quic_fingerprint").alias("quic"))
    s = sessionize(enc, SESSION_KEY, IDLE_US, keep_equal=True)
    key = [*SESSION_KEY, "session_start", "session_seq"]
    marks = ["ja3", "ja3s", "ja4", "quic"]
    h = with_history(s, key, depth - 1, sums={"_packets": F.col("packets")}, lasts=marks)
    item = F.struct("ts_us", (F.col("bytes") / F.col("packets")).alias("size"))
    h = drop_history(h.withColumn("_h", F.collect_list(item).over(recent(key, depth - 1))))
    h = h.withColumn("_g", gaps_seconds(F.col("_h.ts_us")))
    return h.select(
        "seq", "ts_us", *SESSION_KEY, F.coalesce("ja4", "ja3", "quic").alias("event_fp"),
        *[F.col("last_" + m).alias("tls_" + m) for m in marks],
        F.col("_packets").alias("tls_session_packets"),
        ((F.col("ts_us") - F.col("session_start")) / 1e6).alias("tls_session_duration_s"),
        array_mean(F.col("_h.size")).alias("tls_session_mean_bytes"), array_cv(F.col("_h.size")).alias("tls_session_size_cv"),
        (F.size(F.filter("_h", lambda x: x["size"] < 200)) / F.size("_h")).alias("tls_session_small_fraction"),
        F.when(F.size("_g") > 0, array_mean("_g")).otherwise(F.lit(0.0)).alias("tls_session_iat_mean_s"), array_cv("_g").alias("tls_session_iat_cv"))


def fingerprint_rarity(sessions: DataFrame, offers: DataFrame, clock: DataFrame) -> DataFrame:
    """Adds distinct clients per session fingerprint so far and the client population so far.

    `offers` holds one row per event that carried a fingerprint: (event_fp, client, ts_us, seq);
    `clock` the times of all rows of `sessions`, read from a cheaper input.
    Only first sightings change a count: they are stacked with the readings of the same
    fingerprint (before the reading of the same event) and summed in arrival order."""
    at = F.min(F.struct("ts_us", "seq")).alias("at")
    fp = F.coalesce("tls_ja4", "tls_ja3", "tls_quic")
    first = offers.groupBy("event_fp", "client").agg(at)
    points = first.select(F.col("event_fp").alias("_fp"), "at.ts_us", (F.col("at.seq") * 2).alias("seq"), F.lit(1).alias("_new"))
    reads = sessions.select(fp.alias("_fp"), "ts_us", (F.col("seq") * 2 + 1).alias("seq"), F.lit(0).alias("_new")).filter("_fp is not null")
    counts = running_sums(points.unionByName(reads), ["_fp"], {"_clients": F.col("_new")}).filter("seq % 2 = 1")
    s = sessions.join(counts.select(F.floor(F.col("seq") / 2).cast("long").alias("seq"), "_clients"), "seq", "left")
    s = s.withColumn("tls_fingerprint_clients", F.coalesce("_clients", F.lit(0)).cast("int")).drop("_clients")
    new = offers.groupBy("client").agg(at).select("at.seq", F.col("at.ts_us").alias("ts_us"), F.lit(1).alias("_new"))
    base = new.select("ts_us", "_new").unionByName(clock.select("ts_us", F.lit(0).alias("_new")))
    s = s.join(new.drop("ts_us"), "seq", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    return running_sums(s, [], {"tls_client_population": F.col("_new")}, base=base, block_us=1_000_000).drop("_new")


def tls_features(rows: DataFrame) -> DataFrame:
    """Session statistics with fingerprint rarity, keyed by `seq` (encrypted events only)."""
    enc = orient_session(rows.filter("encrypted"))
    offers = enc.withColumn("event_fp", event_fingerprint()).filter("event_fp is not null").select("event_fp", "client", "ts_us", "seq")
    return fingerprint_rarity(tls_sessions(rows).drop("event_fp"), offers, rows.filter("encrypted").select("ts_us"))

"""Event schema and validation."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l, _i, _b = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
EVENT = T.StructType([
    T.StructField("seq", _l), T.StructField("ts_us", _l), T.StructField("sec", _l), T.StructField("src_ip", _s), T.StructField("dst_ip", _s), T.StructField("src_port", _i), T.StructField("dst_port", _i),
    T.StructField("protocol", _i), T.StructField("packets", _l), T.StructField("bytes", _l), T.StructField("syn", _b), T.StructField("syn_packets", _l), T.StructField("dns_name", _s), T.StructField("dns_type", _i),
    T.StructField("encrypted", _b), T.StructField("transport", _s), T.StructField("tls_fingerprint", _s), T.StructField("tls_server_fingerprint", _s), T.StructField("tls_ja4", _s), T.StructField("tcp_fin_rst", _b),
    T.StructField("tcp_window", _i), T.StructField("quic_fingerprint", _s), T.StructField("reverse_bytes", _l), T.StructField("reverse_observed", _b), T.StructField("flow_id", _s)])

# Bounds of the event contract.
MAX_MS, MAX_PACKETS, MAX_BYTES = 253402300799999, 1_000_000, 1_000_000_000


def validate(events: DataFrame) -> DataFrame:
    """Adds `errors`: names of the violated bounds and cross-field rules; empty for a valid event."""
    q = F.col
    has = lambda c: c in events.columns
    out = lambda c, lo, hi: F.coalesce(~q(c).between(lo, hi), F.lit(True))
    checks = [("timestamp", out("ts_us", 0, MAX_MS * 1000)), ("src_port", out("src_port", 0, 65535)), ("dst_port", out("dst_port", 0, 65535)), ("protocol", out("protocol", 0, 255)),
              ("packets", out("packets", 1, MAX_PACKETS)), ("bytes", out("bytes", 0, MAX_BYTES)), ("syn_packets", F.coalesce((q("syn_packets") < 0) | (q("syn_packets") > q("packets")), F.lit(False)))]
    checks += [(c, F.coalesce(F.length(c) > n, F.lit(False))) for c, n in (("dns_name", 253), ("tls_fingerprint", 256)) if has(c)]
    checks += [("transport", F.coalesce(~q("transport").isin("IP", "TLS", "QUIC"), F.lit(True)))]
    checks += [("reverse_bytes", q("reverse_observed") != q("reverse_bytes").isNotNull())]
    return events.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])))

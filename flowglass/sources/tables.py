"""Columnar and text inputs: completed flows, list-valued sessions, name lists, resolver logs, labels, indicators."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ip
from ..functions.times import iso_ms, syslog_seconds
from ..functions.text import canonical_log_name


def flow_vectors(l: DataFrame) -> DataFrame:
    """Line items as completed-flow vectors (log1p of four counters), keyed by id and k."""
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), F.col(c)))
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("y"), F.col("l_shipdate").alias("day"),
                    log("l_quantity").alias("q"), log("l_extendedprice").alias("p"), log("l_discount").alias("d"), log("l_tax").alias("t"))


def read_flow_csv(spark: SparkSession, path: str, columns: list, label="Label") -> DataFrame:
    """Completed-flow CSV: header names trimmed, rows with missing, negative or non-numeric values dropped, log1p of the rest."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return flow_features(raw, columns, label)


def flow_features(raw: DataFrame, columns: list, label="Label") -> DataFrame:
    num = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns}
    r = raw.select(label, *[v.alias(c) for c, v in num.items()])
    ok = F.lit(True)
    for c in columns:
        v = F.col(f"`{c}`")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return r.filter(ok).select(F.trim(F.col(label)).alias(label), *[F.log1p(F.col(f"`{c}`")).alias(c) for c in columns])


def positive_statistics(df: DataFrame, items: str) -> DataFrame:
    """Adds n, mean and cv of the positive items of a list column."""
    from ..functions.numbers import array_cv, array_mean

    p = df.withColumn("_p", F.filter(F.col(items).cast("array<double>"), lambda v: v > 0))
    return p.withColumns({"n": F.size("_p"), "mean": F.when(F.size("_p") > 0, array_mean("_p")), "cv": array_cv("_p")}).drop("_p")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return clean_names(spark.read.text(path), "value")


def clean_names(df: DataFrame, c: str) -> DataFrame:
    """Usable names: trimmed, lower case, one trailing dot removed, a dot inside, only letters, digits, dot and hyphen, 253 at most."""
    name = F.regexp_replace(F.lower(F.trim(F.col(c))), "[.]+$", "")
    r = df.withColumn("name", name)
    return r.filter(F.col("name").contains(".") & F.col("name").rlike("^[a-z0-9.-]+$") & (F.length("name") <= 253))


# The resolver log line and its query message.
LOG_PREFIX = r"^([A-Z][a-z]{2} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}) (.*)$"
LOG_QUERY = r"^query\[([^\]\s]+)\] (\S+) from (\S+)$"


def parse_resolver_log(lines: DataFrame, year: int, c="value") -> DataFrame:
    """Adds status (query, other, malformed), second, qtype, name, source to each log line.

    Only the message part after the daemon tag is matched."""
    message = F.regexp_extract(F.col(c), r"(query\[.*)$", 1)
    stamp = F.regexp_extract(F.col(c), LOG_PREFIX, 1)
    r = lines.withColumns({"_m": message, "_s": stamp})
    hit = F.col("_m").rlike(LOG_QUERY) & (F.col("_s") != "")
    part = lambda i: F.when(hit, F.regexp_extract("_m", LOG_QUERY, i))
    name = canonical_log_name(part(2))
    status = F.when(F.col("_m") == "", "other").when(hit & name.isNotNull(), "query").otherwise("malformed")
    return r.withColumns({"status": status, "second": F.when(hit, syslog_seconds("_s", year)), "qtype": F.upper(part(1)), "name": name, "source": part(3)}).drop("_m", "_s")


EPISODE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "label", "scenario", "tool", "start", "end")]
                       + [T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("hosts", T.ArrayType(T.StringType()))])
LABEL_FILE = T.StructType([T.StructField(c, T.StringType()) for c in ("format", "capture", "split", "source")] + [T.StructField("episodes", T.ArrayType(EPISODE))])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return label_episodes(spark.read.schema(LABEL_FILE).option("multiLine", True).json(path))


def label_episodes(files: DataFrame, allowed=None) -> DataFrame:
    """One row per episode with its times in microseconds and an `errors` array (empty when usable)."""
    e = files.withColumn("_f", F.monotonically_increasing_id()).select("_f", "capture", "split", F.posexplode("episodes").alias("priority", "e")).select("_f", "capture", "split", "priority", "e.*")
    start = F.coalesce("start_ms", iso_ms("start"))
    end = F.coalesce("end_ms", iso_ms("end"))
    ids = e.groupBy("_f", "id").agg(F.count(F.lit(1)).alias("_k"))
    e = e.join(ids, ["_f", "id"], "left").withColumns({"start_us": (start * 1000).cast("long"), "end_us": (end * 1000).cast("long")})
    errors = [F.when(F.col("id").isNull() | (F.trim("id") == ""), "missing_id"), F.when(F.col("_k") > 1, "duplicate_id"),
              F.when(F.col("start_us").isNull() | F.col("end_us").isNull() | (F.col("start_us") < 0), "bad_time"), F.when(F.col("end_us") < F.col("start_us"), "end_precedes_start")]
    errors.append(F.when(F.exists(F.coalesce("hosts", F.array().cast("array<string>")), lambda h: ip.network(h).isNull()), "bad_host"))
    if allowed:
        errors.append(F.when(~F.col("label").isin(list(allowed)) | F.col("label").isNull(), "bad_label"))
    e = e.withColumns({"errors": F.array_compact(F.array(*errors)), "scenario": F.coalesce("scenario", F.lower("label"))})
    return e.drop("_f", "_k")


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """Indicator list file to (kind, fingerprint, note); fingerprints lower-cased."""
    raw = spark.read.option("multiLine", True).schema("ja3 map<string,string>, ja3s map<string,string>, ja4 map<string,string>, quic map<string,string>").json(path)
    parts = [raw.select(F.lit(k).alias("kind"), F.explode(k).alias("fingerprint", "note")) for k in ("ja3", "ja3s", "ja4", "quic")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("fingerprint", F.lower("fingerprint"))

"""Long-interval contact series per (source, destination, port)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ip import is_broadcast, is_multicast
from ..functions.numbers import gaps_seconds
from .throttle import throttle

PEER = ["src_ip", "dst_ip", "dst_port"]
COALESCE_US, RESET_US, WINDOW = 2_000_000, 7_200_000_000, 10


def eligible(rows: DataFrame) -> DataFrame:
    """TCP/UDP to a unicast destination; IPv4 addresses ending in .255 count as broadcast."""
    dotted = F.col("dst_ip").endswith(".255")
    return rows.filter(F.col("protocol").isin(6, 17) & ~is_multicast("dst_ip") & ~is_broadcast("dst_ip") & ~dotted)


def slow_contacts(rows: DataFrame, hot_rows=None) -> DataFrame:
    """Per event: contacts kept in the series, mean gap and variation of the last ten.

    Contacts closer than 2 s to the last recorded one merge into it (a greedy fold);
    after that a key holds at most one row per 2 s, so plain windows suffice."""
    slim = eligible(rows).select("seq", "ts_us", *PEER)
    held = throttle(slim, PEER, COALESCE_US, **({"hot_rows": hot_rows} if hot_rows else {}))
    w = W.partitionBy(*PEER).orderBy("ts_us", "seq")
    kept = held.filter("kept").withColumn("_gap", F.col("ts_us") - F.lag("ts_us").over(w))
    kept = kept.withColumn("_series", F.sum((F.coalesce(F.col("_gap"), F.lit(0)) > RESET_US).cast("int")).over(w))
    ws = W.partitionBy(*PEER, "_series").orderBy("ts_us", "seq")
    kept = kept.withColumns({"_n": F.row_number().over(ws), "_t": F.collect_list("ts_us").over(ws.rowsBetween(-(WINDOW - 1), 0))})
    g = gaps_seconds("_t")
    kept = kept.withColumn("_g", g)
    mean = F.aggregate("_g", F.lit(0.0), lambda a, x: a + x) / (WINDOW - 1)
    kept = kept.withColumn("_mean", mean)
    std = F.sqrt(F.aggregate("_g", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / (WINDOW - 1))
    full = F.col("_n") >= WINDOW
    stats = kept.select(*PEER, F.col("ts_us").alias("anchor_us"), F.col("_n").alias("slow_beacon_events"),
                        F.when(full, F.col("_mean")).otherwise(F.lit(0.0)).alias("slow_beacon_mean_s"),
                        F.when(full & (F.col("_mean") > 0), std / F.col("_mean")).otherwise(F.lit(9.0)).alias("slow_beacon_cv"))
    return held.join(stats, [*PEER, "anchor_us"]).select("seq", "ts_us", *PEER, "slow_beacon_events", "slow_beacon_mean_s", "slow_beacon_cv")

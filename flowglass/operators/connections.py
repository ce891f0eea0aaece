"""Open connections per client/service pair: slow senders and tiny-window readers, without visiting them event by event.

A touch opens a connection or keeps it open until its next touch, its close or two minutes of silence.  While nothing
touches it, a connection contributes constants to the sums of its pair, and it turns slow at a time that is known in
advance.  So each touch, close and expiry is a change point, and what is open at an event is a running sum over them."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import Heat, change_points, heat, neighbours, running_sums, sessionize

IDLE_US = 120_000_000
BLOCK_US = 10_000_000
PAIR = ["client", "server", "service"]
CONNECTION = [*PAIR, "cport"]


def orient(rows: DataFrame) -> DataFrame:
    """TCP rows with two different non-zero ports: the lower port is the service."""
    s, d = F.col("src_port"), F.col("dst_port")
    fwd = d < s
    pick = lambda a, b: F.when(fwd, F.col(a)).otherwise(F.col(b))
    ok = rows.filter((F.col("protocol") == 6) & (s > 0) & (d > 0) & (s != d))
    return ok.withColumns({"client": pick("src_ip", "dst_ip"), "server": pick("dst_ip", "src_ip"), "service": pick("dst_port", "src_port"),
                           "cport": pick("src_port", "dst_port"), "from_client": fwd, "fin_rst": F.coalesce("tcp_fin_rst", F.lit(False))})


def touched(acts: DataFrame, seen: Heat | None = None) -> DataFrame:
    """Acts (1 touch, -1 close) with `first` and `total` of the connection a touch belongs to, null on closes."""
    life = [*CONNECTION, "life"]
    again = cut if seen is None or seen else lambda df: df  # blocks read their rows twice
    acts = again(running_sums(acts, CONNECTION, {"life": (F.col("act") == -1).cast("long")}, block_us=BLOCK_US, seen=seen))
    touches = again(sessionize(acts.filter("act = 1"), life, IDLE_US, keep_equal=True, block_us=BLOCK_US, seen=seen))
    touches = running_sums(touches, [*life, "session_start", "session_seq"], {"total": F.col("amount")}, block_us=BLOCK_US, seen=seen)
    nothing = F.lit(None).cast("long")
    return touches.withColumnRenamed("session_start", "first").drop("session_seq", "life").unionByName(
        acts.filter("act = -1").drop("life").withColumns({"first": nothing, "total": nothing}))


def open_connections(rows: DataFrame, touch, close, amount, max_rate=None, min_age_s=30) -> DataFrame:
    """At every event of a pair: open connections, slow ones, mean age, mean last amount, and the mean rate where any is slow."""
    r = rows.select("seq", "ts_us", *CONNECTION, F.when(close, -1).when(touch, 1).otherwise(0).alias("act"), amount.cast("long").alias("amount"))
    late = F.lit(int(min_age_s * 1e6))
    turns = F.col("first") + (late if max_rate is None else F.greatest(late, F.ceil(F.col("total") * F.lit(1e6) / max_rate).cast("long")))
    seen = heat(r, PAIR)
    acts = touched(r.filter("act <> 0").repartition(*PAIR), seen).withColumn("turns", F.when(F.col("act") == 1, turns))
    acts = cut(neighbours(cut(acts) if seen else acts, CONNECTION, "_prev", "_next", BLOCK_US, carry=["act", "amount", "first", "turns"], seen=seen, newest_first=True))
    # What the act finds open, and until when its own touch counts.
    was = F.coalesce((F.col("_prev.act") == 1) & (F.col("ts_us") - F.col("_prev.ts_us") <= IDLE_US), F.lit(False))
    is_ = F.col("act") == 1
    ends = F.when(F.col("_next.ts_us") - F.col("ts_us") <= IDLE_US, F.col("_next.ts_us")).otherwise(F.col("ts_us") + IDLE_US + 1)
    acts = acts.withColumns({"was": was, "is": is_, "ends": ends, "silent": is_ & F.coalesce(F.col("_next.ts_us") - F.col("ts_us") > IDLE_US, F.lit(True))})
    other = r.filter("act = 0").select("seq", "ts_us", *PAIR)
    every = acts.unionByName(other, allowMissingColumns=True)
    gone = {"open": F.lit(-1), "firsts": -F.col("_prev.first"), "amounts": -F.col("_prev.amount")}
    here = {"open": F.lit(1), "firsts": F.col("first"), "amounts": F.col("amount")}
    arrive = {n: F.when(F.col("was"), gone[n]).otherwise(0) + F.when(F.col("is"), here[n]).otherwise(0) for n in here}
    arrive["slow"] = (F.when(F.col("was") & (F.col("_prev.turns") <= F.col("ts_us")), -1).otherwise(0)
                      + F.when(F.col("is") & (F.col("turns") <= F.col("ts_us")), 1).otherwise(0))
    sums = change_points(every, PAIR, [
        (None, arrive, None),
        (F.col("turns"), {"slow": F.lit(1)}, F.col("is") & (F.col("turns") > F.col("ts_us")) & (F.col("turns") <= F.col("ends"))),
        (F.col("ends"), {n: -c for n, c in here.items()}, F.col("silent")),
        (F.col("ends"), {"slow": F.lit(-1)}, F.col("silent") & (F.col("turns") <= F.col("ends")))], BLOCK_US, seen)
    n = F.greatest(F.col("open").cast("double"), F.lit(1.0))
    sums = sums.join(r.select("seq", "ts_us", *PAIR), "seq")
    out = sums.select("seq", "ts_us", *PAIR, F.col("slow").cast("long").alias("slow"), F.col("open").cast("long").alias("open"),
                      ((F.col("open") * F.col("ts_us") - F.col("firsts")).cast("double") / 1e6 / n).alias("mean_age_s"), (F.col("amounts").cast("double") / n).alias("mean_amount"))
    if max_rate is None:
        return out
    rates = mean_rates(out.filter("slow > 0").select("seq", "ts_us", *PAIR), acts.filter("is"))
    return out.join(rates, "seq", "left").withColumn("mean_rate", F.coalesce("mean_rate", F.lit(0.0)))


def mean_rates(events: DataFrame, touches: DataFrame) -> DataFrame:
    """Mean rate of the connections open at each of the (few) events that see a slow one: intervals met by pair and time slice."""
    slice_of = lambda c: F.floor(F.col(c) / IDLE_US)
    spans = touches.select(*PAIR, "first", "total", F.struct(F.col("ts_us").alias("t"), F.col("seq").alias("s")).alias("since"), F.struct(F.col("ends").alias("t"), F.coalesce("_next.seq", F.lit(-1)).alias("s")).alias("until"),
                           F.col("silent"), F.explode(F.sequence(slice_of("ts_us"), slice_of("ends"))).alias("slice"))
    now = F.struct(F.col("ts_us").alias("t"), F.col("seq").alias("s"))
    met = events.withColumns({"slice": slice_of("ts_us"), "now": now}).join(spans, [*PAIR, "slice"])
    alive = (F.col("since") <= F.col("now")) & F.when(F.col("silent"), F.col("now.t") < F.col("until.t")).otherwise(F.col("now") < F.col("until"))
    rate = F.col("total") / F.greatest((F.col("now.t") - F.col("first")) / 1e6, F.lit(1.0))
    return met.filter(alive).groupBy("seq").agg(F.avg(rate).alias("mean_rate"))


def slow_senders(rows: DataFrame, data_min_bytes=61, max_rate=100, min_age_s=30) -> DataFrame:
    """Connections that trickle client data (input already oriented)."""
    data = F.col("from_client") & (F.col("bytes") >= data_min_bytes)
    o = open_connections(rows, data, F.col("fin_rst"), F.col("bytes"), max_rate=max_rate, min_age_s=min_age_s)
    return o.select("seq", F.col("slow").alias("slow_http_connections"), F.col("open").alias("slow_http_open_connections"),
                    F.col("mean_age_s").alias("slow_http_mean_age_s"), F.col("mean_rate").alias("slow_http_mean_client_rate_bps"))


def slow_readers(rows: DataFrame, small_window=256, min_age_s=30) -> DataFrame:
    """Connections whose client keeps advertising a tiny receive window."""
    told = F.col("from_client") & ~F.col("syn") & F.col("tcp_window").isNotNull()
    small = told & (F.col("tcp_window") <= small_window) & ~F.col("fin_rst")
    closes = F.col("fin_rst") | (told & (F.col("tcp_window") > small_window))
    o = open_connections(rows, small, closes, F.coalesce("tcp_window", F.lit(0)), min_age_s=min_age_s)
    return o.select("seq", F.col("slow").alias("slow_read_connections"), F.col("open").alias("slow_read_open_connections"),
                    F.col("mean_age_s").alias("slow_read_mean_age_s"), F.col("mean_amount").alias("slow_read_mean_window"))

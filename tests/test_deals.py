"""Rows that are dealt to tasks: how often, and that what meets them afterwards does not move them again."""
import random

from pyspark.sql import functions as F

from flowglass.operators import connections, history, rates
from flowglass.plans import detect as D
from flowglass.session import dealt

from helpers import event, frame


def events(spark, n=400):
    rng = random.Random(5)
    return frame(spark, [event(i, rng.randrange(60_000), src_ip=f"10.0.0.{rng.randrange(9)}", dst_port=rng.choice([53, 80, 443]), src_port=rng.randrange(40000, 40004), bytes=rng.randrange(40, 400)) for i in range(n)])


def moved(df):
    """How often an executed plan deals rows by a hash."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_windows_of_one_source_or_pair_deal_rows_once(spark):
    rows = events(spark)
    seen = history.heat(rows, ["src_ip"])
    assert moved(history.peer_window(rows, 60_000_000, seen)) == 1
    web = connections.orient(rows)
    made = connections.slow_readers(web)
    assert "_blk" not in "".join(x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_counts_of_sources_are_dealt_once(spark):
    plan = rates.target_rates(events(spark))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_source = [x for x in text.splitlines() if "Exchange hashpartitioning(dst_ip" in x and "src_ip" in x and "sec" not in x.split("src_ip")[0] and "ReusedExchange" not in x]
    assert len(by_source) <= 2 and "_groupingexpression" not in "".join(by_source)


def test_dealt_rows_stay_where_they_are(spark):
    rows = events(spark).repartition("seq")
    kept = dealt(rows, "seq")
    assert sorted(kept.collect()) == sorted(rows.collect()) and kept.schema.names == rows.schema.names
    some = spark.range(0, 400, 7).select(F.col("id").alias("seq")).repartition(3)
    met = kept.join(some.hint("shuffle_hash"), "seq", "left_semi")
    assert {r.seq for r in met.collect()} == set(range(0, 400, 7))
    text = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 1  # the other side only
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rows_")]


def test_alerts_of_one_event_are_kept_apart(spark):
    """One event can hit by two classes of which only one passes the suppression."""
    rows = [event(i, i, dst_ip=f"198.51.100.{i}", src_ip="10.0.0.1", syn=True, src_port=50000) for i in range(1, 40)]
    rows += [event(100 + i, 35_000 + i, dst_ip="198.51.100.1", src_ip="10.0.0.1", bytes=10_000_000) for i in range(4)]
    h = D.hits(D.all_features(frame(spark, rows)))
    hits = {(r.seq, r.threat_class) for r in h.collect()}
    got = [(r.seq, r.threat_class) for r in D.alerts(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) < hits and len({t for _, t in got}) == 2

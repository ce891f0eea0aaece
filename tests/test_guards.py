"""Indicator tables in the rules, and reports as files."""
from flowglass import sinks
from flowglass.plans import detect as D


def test_indicator_table_takes_the_place_of_the_map(spark):
    rows = spark.createDataFrame([(1, "AA", None, None, None), (2, "aa", "s1", "j4", None), (3, None, "S1", None, "q"), (4, "zz", "zz", "zz", "zz"), (5, None, None, None, None)],
                                 "seq long, tls_ja3 string, tls_ja3s string, tls_ja4 string, tls_quic string")
    listed = {"ja3": {"aa": "first"}, "ja3s": {"S1": "server"}, "quic": {"q": "clear"}, "ja4": {"j4": None}}
    table = spark.createDataFrame([(k, f, n) for k, v in listed.items() for f, n in v.items()] + [("ja3", "AA", "later")], "kind string, fingerprint string, note string")
    got = {r.seq: tuple(r["_listed"]) for r in D.indicator_matches(rows, table).collect()}
    assert got == {1: ("ja3", "AA", "first"), 2: ("ja3", "aa", "first"), 3: ("ja3s", "S1", "server")}
    inline = {r.seq: tuple(r.h) for r in rows.withColumn("h", D.indicator(D.Thresholds(indicators=listed))).filter("h is not null").collect()}
    assert inline == got
    th = D.Thresholds(indicator_table=table)
    joined = rows.join(D.indicator_matches(rows, table), "seq", "left").withColumn("h", D.indicator(th))
    assert {r.seq for r in joined.filter("h is not null").collect()} == {1, 2, 3}
    assert D.indicator_matches(rows, table.limit(0)).count() == 0


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([((3, [("DDOS", 1.5)]),)], "summary struct<events: bigint, threats: array<struct<threat: string, recall: double>>>")
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().summary.asDict(True) == {"events": 3, "threats": [{"threat": "DDOS", "recall": 1.5}]}

"""Registered queries: exclusions and guards of the rules, indicator files, reports, scoring of an outside set."""
import hashlib

from pyspark.sql import functions as F

from .. import sinks
from ..operators import bayes, connections, joins, metrics, sessions
from ..session import shared_folder
from ..sources import tables
from . import detect as D
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import EPISODES, TRAFFIC, over
from .q_aggregates import CNT, LAB, RAT, _lab
from .q_models import FLOW, _flows
from .q_rules import TH
from .q_windows import TLS_SQL, _conn_sql, _tls_rows

READERS = _conn_sql("from_client and tcp_window <= 256 and not fin_rst", "fin_rst or (from_client and tcp_window > 256)", "tcp_window", "age >= 5", "slow slow_read_connections")
SENDERS = _conn_sql("from_client and bytes >= 61", "fin_rst", "bytes", "age >= 5 and rate <= 100", "slow slow_http_connections")


@query("slow_read_hits", f"with a as ({READERS}), b as ({SENDERS}) select seq, slow_read_connections, slow_http_connections from a join b using (seq) where slow_read_connections >= 2 and slow_http_connections < 2")
def slow_read_hits(spark, sf):
    """The slow-read half of connection exhaustion: counted only where the slow-sender half does not hold."""
    web, th = V.web(spark, sf), TH.with_(slow_connections=2)
    f = connections.slow_readers(web, min_age_s=5).select("seq", "slow_read_connections").join(connections.slow_senders(web, min_age_s=5).select("seq", "slow_http_connections"), "seq")
    return f.withColumn("protocol", F.lit(6)).filter(D.blocks(th)["slow_read"]).select("seq", "slow_read_connections", "slow_http_connections")


@query("beacon_guards", over(TRAFFIC, """, g as (select seq, seq % 8 v, packets % 6 h, seq % 5 = 0 slow, dst_port, protocol from traffic)
  select seq, (h >= 3 or slow) and case when v < 5 then false when v < 7 then true else not (dst_port = 53 and protocol = 17) end allowed from g"""))
def beacon_guards(spark, sf):
    """Which contacts may be called a beacon: no multicast or broadcast, no local resolver, no SNMP or ICMP monitoring inside one network."""
    v = F.col("seq") % 8
    pick = lambda values, other: F.coalesce(*[F.when(v == k, F.lit(x)) for k, x in values.items()], other)
    t = V.traffic(spark, sf).withColumns({
        "dst_ip": pick({0: "224.0.0.251", 1: "255.255.255.255", 2: "10.0.0.53", 3: "10.0.0.9", 4: "10.0.0.9", 5: "8.8.8.8", 6: "8.8.8.8"}, F.col("dst_ip")),
        "dst_port": pick({2: 53, 3: 161, 5: 53, 6: 161}, F.col("dst_port")), "protocol": pick({2: 17, 3: 17, 4: 1, 5: 17, 6: 17}, F.col("protocol")),
        "history_count": F.col("packets") % 6, "slow_beacon": F.col("seq") % 5 == 0})
    return t.select("seq", F.coalesce(D.guard_conditions(TH)["BOTNET_C2"], F.lit(False)).alias("allowed"))


@query("indicator_file_hits", over(TRAFFIC, TLS_SQL + """ select seq, case when ja3 in (md5('1'), md5('4')) then 'ja3' else 'ja3s' end kind, case when ja3 = md5('1') then 'first' when ja3 = md5('4') then 'second' else 'server' end note
  from k where ja3 in (md5('1'), md5('4')) or ja3s = md5('2')"""))
def indicator_file_hits(spark, sf):
    """An indicator file, written and read back, met with the session fingerprints by a join."""
    m = lambda v: hashlib.md5(v.encode()).hexdigest()
    path = shared_folder(spark, "indicators")
    text = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    spark.range(1).select(F.to_json(F.struct(text({m("1"): "first", m("4").upper(): "second"}).alias("ja3"), text({m("2"): "server"}).alias("ja3s"))).alias("value")).write.text(path)
    f = D.indicator_matches(sessions.tls_sessions(_tls_rows(spark, sf)), tables.indicators(spark, path))
    return f.select("seq", "_listed.kind", "_listed.note")


@query("evaluation_report", over(EPISODES, LAB + """, k as (select threat, count(*) alerts, count(*) filter (label is null or label = 'BENIGN') fb from ma group by 1),
  g as (select label threat, count(*) episodes, count(*) filter (pos is not null) detected from ep where label <> 'BENIGN' group by 1)
  select coalesce(g.threat, k.threat) threat, coalesce(episodes, 0) episodes, coalesce(detected, 0) detected, coalesce(alerts, 0) alerts, coalesce(fb, 0) false_on_benign, case when episodes > 0 then round(detected / episodes, 4) end recall,
    (select count(*) from ep) captures_episodes, (select count(*) from n) events from g full join k on g.threat = k.threat"""))
def evaluation_report(spark, sf):
    """The nested report of an evaluation, written as one JSON document and read back."""
    m, e, per = _lab(spark, sf)
    threats = rounded(metrics.lab_threats(m, per)).agg(F.array_sort(F.collect_list(F.struct("threat", "episodes", "detected", "alerts", "false_on_benign", "recall"))).alias("threats"))  # one entry per class
    counts = m.agg(F.count(F.lit(1)).alias("events")).withColumn("k", F.lit(1)).join(e.agg(F.count(F.lit(1)).alias("episodes")).withColumn("k", F.lit(1)), "k")
    report = threats.withColumn("k", F.lit(1)).join(counts, "k").select(F.struct(F.struct("events", "episodes", "threats").alias("all")).alias("summary"))
    path = shared_folder(spark, "report")
    sinks.write_report(report, path)
    kinds = "summary struct<all: struct<events: bigint, episodes: bigint, threats: array<struct<threat: string, episodes: bigint, detected: bigint, alerts: bigint, false_on_benign: bigint, recall: double>>>>"
    back = spark.read.schema(kinds).json(path).select("summary.all.*")
    return back.select(F.inline("threats"), F.col("episodes").alias("captures_episodes"), "events").select("threat", F.col("episodes"), "detected", "alerts", "false_on_benign", "recall", "captures_episodes", "events")


OUTSIDE = ["q", "d", "t"]
_MOM = ", ".join(f"avg({c}) m{c}, greatest(0.03, var_pop({c})) v{c}" for c in OUTSIDE)
_SC = " + ".join(f"ln(2 * pi() * v{c}) + ({c} - m{c}) * ({c} - m{c}) / v{c}" for c in OUTSIDE)


@query("external_flow_evaluation", FLOW + f""", v as (select id * 1000000 + k id, k, y, q, d, t, d0, concat_ws('|', cast(round(exp(q)) as int), cast(round(exp(d) * 100) as int), cast(round(exp(t) * 100) as int), cast(k % 20 as int)) sig from f),
  tr as (select y, count(*) / (sum(count(*)) over ()) pr, {_MOM} from v where year(d0) < 2000 group by 1), old as (select distinct sig from v where year(d0) < 2000),
  x as (select * from v where year(d0) >= 2000 and sig not in (select sig from old)), u as (select * from x where (id) in (select min(id) from x group by sig)),
  s as (select u.id, u.y, tr.y c, ln(pr) - 0.5 * ({_SC}) s from u, tr), g as (select *, max(s) over (partition by id) mx from s),
  r as (select id, any_value(y) y, arg_max(c, s) label, 1 / sum(exp(s - mx)) posterior from g group by 1),
  o as (select case when y = 'N' and label = 'N' and posterior >= 0.3 then 'tp' when y = 'N' then 'fn' when label = 'N' and posterior >= 0.3 then 'fp' else 'tn' end o from r), g9 as (select {CNT} from o)
  select *, (select count(*) from v where year(d0) >= 2000) - (select count(*) from u) excluded, {RAT} from g9""")
def external_flow_evaluation(spark, sf):
    """A fitted flow model on an outside set: vectors of the training set and repeated vectors are excluded, the rest is scored, in one run."""
    f = _flows(spark, sf).withColumn("id", F.col("id") * 1_000_000 + F.col("k")).withColumn("sig", F.concat_ws("|", F.round(F.exp("q")).cast("int"), F.round(F.exp("d") * 100).cast("int"), F.round(F.exp("t") * 100).cast("int"), (F.col("k") % 20).cast("int")))
    train, outside = f.filter("year(day) < 2000"), f.filter("year(day) >= 2000")
    model = bayes.fit_gaussian(train, "y", OUTSIDE)
    new = joins.unseen_vectors(outside, train, ["sig"], "id")
    p = bayes.predict_gaussian(outside.join(new, "id", "left_semi"), model, OUTSIDE)
    hit = (F.col("label") == "N") & (F.col("posterior") >= 0.3)
    o = p.withColumn("outcome", metrics.outcome((F.col("y") == "N").cast("int"), hit))
    counts = o.agg(*metrics.counts(), F.count(F.lit(1)).alias("_kept")).withColumn("excluded", F.lit(outside.count()) - F.col("_kept")).drop("_kept")
    return rounded(metrics.ratios(counts))

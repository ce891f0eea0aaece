"""Registered queries: aggregations and evaluation reports."""
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators import dataprep, history, joins, metrics
from ..operators.ordered import neighbours, running_max
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import EPISODES, NAMES, SCORED, TRAFFIC, over
from .q_joins import ALERTS, alert_rows
from .q_scalars import ENT, SURPRISE, VARIED, VOWELS, varied
from .q_windows import HIST_SQL


@query("alerts_per_class", over(TRAFFIC, ALERTS + " select threat, count(*) n from al group by 1"))
def alerts_per_class(spark, sf):
    return alert_rows(spark, sf).groupBy("threat").agg(F.count(F.lit(1)).alias("n"))


@query("class_shares", over(TRAFFIC, ALERTS + " select threat, round(count(*) / sum(count(*)) over (), 6) share from al group by 1"))
def class_shares(spark, sf):
    c = alert_rows(spark, sf).groupBy("threat").agg(F.count(F.lit(1)).alias("n"))
    return rounded(c.select("threat", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share")))


CLS = """, c as (select lang truth, case when n % 7 = 0 then 'en' when n % 5 = 0 then 'fr' else lang end pred from (select lang, n_chars n from documents)),
  k as (select distinct truth label from c union select distinct pred from c),
  m as (select label, (select count(*) from c where truth = label and pred = label) tp, (select count(*) from c where truth = label and pred <> label) fn, (select count(*) from c where truth <> label and pred = label) fp from k)"""


def _classified(spark, sf):
    return V.table(spark, sf, "documents").selectExpr("lang as truth", "case when n_chars % 7 = 0 then 'en' when n_chars % 5 = 0 then 'fr' else lang end as pred")


@query("confusion_matrix", over("z as (select 1)", CLS + " select truth, count(*) filter (pred = 'de') de, count(*) filter (pred = 'en') en, count(*) filter (pred = 'es') es, count(*) filter (pred = 'fr') fr from c group by 1"))
def confusion_matrix(spark, sf):
    p = _classified(spark, sf).groupBy("truth").pivot("pred", ["de", "en", "es", "fr"]).count()
    return p.fillna(0)


@query("class_metrics", over("z as (select 1)", CLS + """ select label, tp, fn, fp, round(tp / greatest(1, tp + fp), 6) "precision", round(tp / greatest(1, tp + fn), 6) recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) f1 from m"""))
def class_metrics(spark, sf):
    return rounded(metrics.per_class(_classified(spark, sf), "truth", "pred"))


@query("macro_f1", over("z as (select 1)", CLS + " select round(avg(2 * tp / greatest(1, 2 * tp + fp + fn)), 6) macro_f1, count(*) classes from m"))
def macro_f1(spark, sf):
    m = metrics.per_class(_classified(spark, sf), "truth", "pred")
    return rounded(m.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes")))


OUT = """, o as (select *, case when y = 1 and score >= 0.5 then 'tp' when y = 1 then 'fn' when score >= 0.5 then 'fp' else 'tn' end o from scored)"""
CNT = "count(*) filter (o = 'tp') tp, count(*) filter (o = 'fn') fn, count(*) filter (o = 'fp') fp, count(*) filter (o = 'tn') tn"
RAT = """round(case when tp + fp > 0 then tp / (tp + fp) end, 6) "precision", round(case when tp + fn > 0 then tp / (tp + fn) end, 6) recall, round(case when fp + tn > 0 then fp / (fp + tn) end, 6) fpr"""


def _outcomes(spark, sf):
    return V.scored(spark, sf).withColumn("outcome", metrics.outcome("y", F.col("score") >= 0.5))


@query("binary_metrics", over(SCORED, OUT + f", g as (select lang, {CNT} from o group by 1) select *, {RAT} from g"))
def binary_metrics(spark, sf):
    return rounded(metrics.ratios(_outcomes(spark, sf).groupBy("lang").agg(*metrics.counts())))


@query("family_metrics", over(SCORED, OUT + f", g as (select coalesce(family, 'all') family, {CNT} from o group by grouping sets ((family), ())) select *, {RAT} from g"))
def family_metrics(spark, sf):
    g = _outcomes(spark, sf).rollup("family").agg(*metrics.counts())
    return rounded(metrics.ratios(g.withColumn("family", F.coalesce("family", F.lit("all")))))


@query("worst_families", over(SCORED, OUT + f", g as (select family, {CNT} from o where y = 1 group by 1) select family, round(tp / (tp + fn), 6) recall from g order by tp / (tp + fn), family limit 10"))
def worst_families(spark, sf):
    g = metrics.ratios(_outcomes(spark, sf).filter("y = 1").groupBy("family").agg(*metrics.counts()))
    return rounded(g.select("family", "recall").orderBy("recall", "family").limit(10))


@query("macro_recall", over(SCORED, OUT + f", g as (select family, {CNT} from o group by 1), f as (select tp / nullif(tp + fn, 0) r, fp, tn from g) select round(avg(r), 6) macro_recall, count(*) filter (r >= 0.5) families_at_half, round(avg(r) / (avg(r) + sum(fp) / sum(fp + tn)), 6) balanced_precision from f"))
def macro_recall(spark, sf):
    """Mean family recall, families reaching a mark, and precision at one-to-one prevalence."""
    g = metrics.ratios(_outcomes(spark, sf).groupBy("family").agg(*metrics.counts()))
    a = g.agg(F.avg("recall").alias("macro_recall"), F.count_if(F.col("recall") >= 0.5).alias("families_at_half"), F.sum("fp").alias("fp"), F.sum("tn").alias("tn"))
    fpr = F.col("fp") / (F.col("fp") + F.col("tn"))
    return rounded(a.select("macro_recall", "families_at_half", (F.col("macro_recall") / (F.col("macro_recall") + fpr)).alias("balanced_precision")))


SESS = """, s as (select src_ip, count(*) queries, min(ts_us) t0, bool_or(seq % 5 = 0 and k0) positive from (select *, packets > 5 k0 from traffic where protocol = 17) group by 1),
  r as (select src_ip, ts_us, row_number() over (partition by src_ip order by ts_us, seq) q, packets from traffic where protocol = 17),
  f as (select src_ip, min(q) first_query, min(ts_us) ft from r where packets > 40 group by 1),
  x as (select s.*, f.first_query, f.ft - t0 delay from s left join f using (src_ip)),
  o as (select *, case when positive and coalesce(first_query < queries, false) then 'tp' when positive then 'fn' when first_query is not null then 'fp' else 'tn' end o, coalesce(first_query < queries, false) be from x),
  g as (select count(*) filter (o = 'tp') tp, count(*) filter (o = 'fn') fn, count(*) filter (o = 'fp') fp, count(*) filter (o = 'tn') tn, count(*) filter (o = 'tp' and first_query <= 10 and delay <= 60000000) early from o),
  h as (select *, case when tp + fp > 0 then tp / (tp + fp) end p, case when tp + fn > 0 then tp / (tp + fn) end r, case when fp + tn > 0 then fp / (fp + tn) end q from g)"""


@query("early_detection", over(TRAFFIC, SESS + """ select tp, fn, fp, tn, early, round(p, 6) "precision", round(r, 6) recall, round(q, 6) fpr, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) f1, round(early / tp, 6) early_fraction,
  coalesce(r >= 0.8, false) recall_ok, coalesce(p >= 0.9, false) precision_ok, coalesce(q <= 0.05, false) fpr_ok, coalesce(early / tp >= 0.8, false) timing_ok from h"""))
def early_detection(spark, sf):
    """Sessions (one source's questions) with their first alert; hits are questions of more than 40 packets."""
    from ..operators.ordered import running_sums

    q = V.traffic(spark, sf).filter("protocol = 17").select("seq", "ts_us", "src_ip", "packets")
    r = running_sums(q, ["src_ip"], {"pos": F.lit(1)})
    first = r.filter("packets > 40").groupBy("src_ip").agg(F.min("pos").alias("first_query"), F.min("ts_us").alias("ft"))
    s = q.groupBy("src_ip").agg(F.count(F.lit(1)).alias("queries"), F.min("ts_us").alias("t0"), F.bool_or((F.col("seq") % 5 == 0) & (F.col("packets") > 5)).alias("positive"))
    s = s.join(first, "src_ip", "left").withColumn("delay_us", F.col("ft") - F.col("t0"))
    return rounded(metrics.early_summary(metrics.early_sessions(s, 10, 60_000_000)))


LAB = HIST_SQL + """, hits as (select seq, any_value(src_ip) src_ip, any_value(now) ts_us from h group by seq having count(distinct case when ts_us >= now - 10000000 then dst_ip end) >= 5),
  al as (select seq, 'RECONNAISSANCE' threat from hits union all select seq, 'BOTNET_C2' from hits where seq % 4 = 0),
  m as (select * from (select t.seq, t.ts_us, e.id, e.label, row_number() over (partition by t.seq order by priority, id) r from traffic t left join episodes e on t.ts_us between e.start_us and e.end_us and (t.src_ip = e.host or t.dst_ip = e.host)) where r = 1),
  n as (select m.*, row_number() over (partition by id order by ts_us, seq) pos, min(ts_us) over (partition by id) t0 from m),
  ma as (select n.*, al.threat from n join al using (seq)),
  ep as (select e.id, e.label, count(n.seq) events, (select count(*) from ma where ma.id = e.id and ma.threat = e.label) correct, (select count(*) from ma where ma.id = e.id and (ma.threat <> e.label)) other,
    (select min(pos) from ma where ma.id = e.id and ma.threat = e.label) pos, (select min(ts_us - t0) / 1000.0 from ma where ma.id = e.id and ma.threat = e.label) delay from episodes e left join n on n.id = e.id group by e.id, e.label)"""


def _lab(spark, sf):
    t = V.traffic(spark, sf)
    hits = history.source_history(t, families=("source",)).filter("destination_count >= 5").select("seq")
    al = hits.withColumn("threat_class", F.lit("RECONNAISSANCE")).unionByName(hits.filter("seq % 4 = 0").withColumn("threat_class", F.lit("BOTNET_C2")))
    e = V.episodes(spark, sf)
    m = joins.match_networks(t.select("seq", "ts_us", "src_ip", "dst_ip"), e.withColumn("hosts", F.array("host")))
    m = metrics.lab_events(m.select("seq", "ts_us", "episode", "label", "matches"), al)
    e = e.withColumns({"scenario": F.lower("label"), "split": F.when(F.crc32("id") % 2 == 0, "development").otherwise("test")})
    return m, e, metrics.lab_episodes(m, e)


@query("episode_detection", over(EPISODES, LAB + " select id episode, events, correct correct_alerts, other other_alerts, pos is not null detected, pos events_into, round(delay, 6) delay_ms from ep"))
def episode_detection(spark, sf):
    return rounded(_lab(spark, sf)[2].select("episode", "events", "correct_alerts", "other_alerts", "detected", "events_into", "delay_ms"))


@query("lab_threat_summary", over(EPISODES, LAB + """, k as (select threat, count(*) alerts, count(*) filter (label is null or label = 'BENIGN') fb from ma group by 1),
  g as (select label threat, count(*) episodes, count(*) filter (events > 0) observed, count(*) filter (pos is not null) detected, cast(sum(correct) as bigint) correct_alerts, median(delay) md, max(delay) xd from ep where label <> 'BENIGN' group by 1)
  select coalesce(g.threat, k.threat) threat, coalesce(episodes, 0) episodes, coalesce(observed, 0) observed, coalesce(detected, 0) detected, coalesce(correct_alerts, 0) correct_alerts, coalesce(alerts, 0) alerts, coalesce(fb, 0) false_on_benign,
  round(md, 6) median_delay_ms, round(xd, 6) max_delay_ms, case when episodes > 0 then round(detected / episodes, 4) end recall, case when alerts > 0 then round(coalesce(correct_alerts, 0) / alerts, 4) end "precision" from g full join k on g.threat = k.threat"""))
def lab_threat_summary(spark, sf):
    m, _, per = _lab(spark, sf)
    return rounded(metrics.lab_threats(m, per))


@query("benign_false_alerts", over(EPISODES, LAB + """ select (select count(*) from n where label is null or label = 'BENIGN') benign_events, (select count(*) from ma where label is null or label = 'BENIGN') benign_alerts,
  round(1000.0 * (select count(*) from ma where label is null or label = 'BENIGN') / (select count(*) from n where label is null or label = 'BENIGN'), 4) per_1000, (select count(*) from ep where label = 'BENIGN' and other > 0) episodes_with_alerts"""))
def benign_false_alerts(spark, sf):
    m, _, per = _lab(spark, sf)
    none = F.lit(None).cast("long")
    b = m.filter("label is null or label = 'BENIGN'").agg(F.count(F.lit(1)).alias("ev"), F.sum(F.size("threats")).cast("long").alias("al")).withColumn("ep", none)
    e = per.filter("label = 'BENIGN'").agg(F.count_if(F.col("other_alerts") > 0).alias("ep")).select(none.alias("ev"), none.alias("al"), "ep")
    one = b.unionByName(e).agg(F.max("ev").alias("benign_events"), F.max("al").alias("benign_alerts"), F.max("ep").alias("episodes_with_alerts"))
    return one.withColumn("per_1000", F.round(1000.0 * F.col("benign_alerts") / F.col("benign_events"), 4))


@query("scenario_rollup", over(EPISODES, LAB + """ select lower(label) scenario, count(*) episodes, count(*) filter (pos is not null) detected, count(*) filter (correct + other > 0) with_any_alert from ep group by 1"""))
def scenario_rollup(spark, sf):
    per = _lab(spark, sf)[2]
    return per.groupBy("scenario").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("detected").alias("detected"), F.count_if(F.col("correct_alerts") + F.col("other_alerts") > 0).alias("with_any_alert"))


@query("split_summary", over(EPISODES, LAB + """, s as (select *, case when cast(substr(md5(id), 1, 1) in ('0','1','2','3','4','5','6','7') as int) = 1 then 'development' else 'test' end split from ep)
  select coalesce(split, 'all') split, count(*) episodes, cast(sum(events) as bigint) events, count(*) filter (pos is not null) detected from s group by grouping sets ((split), ())"""))
def split_summary(spark, sf):
    per = _lab(spark, sf)[2].withColumn("split", F.when(F.substring(F.md5("episode"), 1, 1).isin(*"01234567"), "development").otherwise("test"))
    g = per.rollup("split").agg(F.count(F.lit(1)).alias("episodes"), F.sum("events").alias("events"), F.count_if("detected").alias("detected"))
    return g.withColumn("split", F.coalesce("split", F.lit("all")))


PCT = """with r as (select {g} g, {v} v, row_number() over (partition by {g} order by {v}) - 1 i, count(*) over (partition by {g}) n from {t} where {v} is not null)
  select g{a}, count(*) count, min(v) min, max(v) max, max(v) filter (i = n // 2) p50, max(v) filter (i = cast(floor((n - 1) * 0.95) as bigint)) p95, max(v) filter (i = cast(floor((n - 1) * 0.99) as bigint)) p99 from r group by g"""


@query("value_distributions", PCT.format(g="l_returnflag", v="l_extendedprice", t="lineitem", a=" l_returnflag"))
def value_distributions(spark, sf):
    """Exact order statistics: p50 at index n/2, others at floor((n-1)*x)."""
    picks = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * 0.95), "p99": lambda n: F.floor((n - 1) * 0.99)}
    return joins.order_statistics(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", picks)


def before(rows, order, value):
    """Adds `_before`, the value of the row before in `order`, whose numbers may have holes."""
    n = neighbours(rows.select(F.col(order).alias("ts_us"), F.lit(0).alias("seq"), F.col(value).alias("_v")), [], "_p", "_n", 65_536, carry=["_v"])
    return n.select(F.col("ts_us").alias(order), F.col("_v").alias(value), F.col("_p._v").alias("_before"))


@query("latency_percentiles", over(TRAFFIC, """, l as (select seq, (ts_us - lag(ts_us) over (order by seq)) v from traffic), k as (select v from l), r as (select v, row_number() over (order by v) i, count(*) over () n from k where v is not null)
  select max(v) filter (i - 1 = least(n - 1, cast(floor(n * 0.95) as bigint))) p95_floor, max(v) filter (i = cast(ceil(n * 0.95) as bigint)) p95_nearest, max(v) filter (i = cast(ceil(n * 0.5) as bigint)) p50_nearest from r"""))
def latency_percentiles(spark, sf):
    """Percentiles over all gaps: index rule floor(n*x) and nearest rank ceil(n*x)."""
    t = V.traffic(spark, sf).select("seq", "ts_us")
    gaps = before(t, "seq", "ts_us").select("seq", (F.col("ts_us") - F.col("_before")).alias("v")).filter("v is not null")
    picks = {"p95_floor": lambda n: F.least(n - 1, F.floor(n * 0.95)), "p95_nearest": lambda n: F.ceil(n * 0.95) - 1, "p50_nearest": lambda n: F.ceil(n * 0.5) - 1}
    return joins.order_statistics(gaps, [], "v", picks).select(*picks)


@query("most_common_names", over(TRAFFIC, " select dns_name, count(*) n from traffic where dns_name is not null group by 1 order by n desc, dns_name limit 15"))
def most_common_names(spark, sf):
    return V.traffic(spark, sf).filter("dns_name is not null").groupBy("dns_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dns_name").limit(15)


@query("name_visibility", over(TRAFFIC, """ select dst_port, protocol, count(*) events, count(*) filter (dns_name is not null) questions, count(*) filter (dns_type = 16) type_16, count(distinct dns_name) unique_names, count(*) filter (length(split_part(dns_name, '.', 1)) >= 30) long_labels,
  count(distinct src_ip) sources from traffic group by 1, 2"""))
def name_visibility(spark, sf):
    """Inventory per port and protocol; distinct counts are exact and pre-aggregated."""
    t = V.traffic(spark, sf)
    return t.groupBy("dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("events"), F.count("dns_name").alias("questions"), F.count_if(F.col("dns_type") == 16).alias("type_16"), F.count_distinct("dns_name").alias("unique_names"),
        F.count_if(F.length(F.split_part("dns_name", F.lit("."), F.lit(1))) >= 30).alias("long_labels"), F.count_distinct("src_ip").alias("sources"))


@query("multiset_entropy", over(TRAFFIC, ", c as (select dst_ip, src_ip, count(*) n from traffic group by 1, 2) select dst_ip, round(greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) entropy from c group by 1"))
def multiset_entropy(spark, sf):
    c = V.traffic(spark, sf).groupBy("dst_ip", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return rounded(metrics.shannon(c, ["dst_ip"]))


@query("flow_throughput", over(TRAFFIC, """ select sec - sec % 10 as slot, count(distinct (src_ip, dst_ip, src_port, dst_port, protocol)) flows, cast(sum(packets) as bigint) packets, round(sum(packets) / 10.0, 6) packets_per_s, round(sum(bytes) / 10.0, 6) bytes_per_s from traffic group by 1"""))
def flow_throughput(spark, sf):
    t = V.traffic(spark, sf)
    g = t.groupBy((F.col("sec") - F.col("sec") % 10).alias("slot")).agg(F.count_distinct(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "protocol")).alias("flows"),
                                                                      F.sum("packets").alias("packets"), (F.sum("packets") / 10).alias("packets_per_s"), (F.sum("bytes") / 10).alias("bytes_per_s"))
    return rounded(g)


@query("connection_lifetimes", over(TRAFFIC, """, c as (select dst_ip, src_ip, dst_port, (max(ts_us) - min(ts_us)) / 1e6 life, sum(bytes) b, count(*) n from traffic where protocol = 6 group by 1, 2, 3)
  select dst_ip, count(*) connections, round(median(life), 6) median_s, round(quantile_cont(life, 0.9), 6) p90_s, round(max(life), 6) max_s, count(*) filter (life >= 30) over_30s, count(*) filter (life >= 30 and b / greatest(life, 1) <= 1000) slow from c group by 1"""))
def connection_lifetimes(spark, sf):
    c = V.traffic(spark, sf).filter("protocol = 6").groupBy("dst_ip", "src_ip", "dst_port").agg(((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("life"), F.sum("bytes").alias("b"))
    g = c.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("connections"), F.max("life").alias("max_s"),
                                F.count_if(F.col("life") >= 30).alias("over_30s"), F.count_if((F.col("life") >= 30) & (F.col("b") / F.greatest("life", F.lit(1)) <= 1000)).alias("slow"))
    return rounded(g.join(joins.quantiles(c, ["dst_ip"], "life", {"median_s": 0.5, "p90_s": 0.9}), "dst_ip"))


@query("order_diagnostics", over(TRAFFIC, """, d as (select seq, ts_us - case when seq % 7 = 0 then 3000000 else 0 end ts_us from traffic), w as (select *, lag(ts_us) over (order by seq) p, max(ts_us) over (order by seq rows between unbounded preceding and 1 preceding) m from d)
  select count(*) events, count(*) filter (ts_us < p) backward_steps, max(p - ts_us) max_backward_us, count(*) filter (ts_us < m) behind_watermark from w"""))
def order_diagnostics(spark, sf):
    d = V.traffic(spark, sf).selectExpr("seq", "ts_us - if(seq % 7 = 0, 3000000, 0) as ts_us")
    m = running_max(d, "ts_us", "m", block_rows=4096).join(before(d, "seq", "ts_us").select("seq", F.col("_before").alias("p")), "seq")
    return m.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("ts_us") < F.col("p")).alias("backward_steps"), F.max(F.col("p") - F.col("ts_us")).alias("max_backward_us"),
                 F.count_if(F.col("ts_us") < F.col("m")).alias("behind_watermark"))


@query("column_coverage", """with d as (select source, lang, case when n_chars % 11 = 0 then null when n_chars % 7 = 0 then '' else text end a, case when n_chars % 5 = 0 then null else text end b from documents)
  select source, count(*) rows_seen, count(*) filter (a is null) a_missing, count(*) filter (a = '') a_empty, count(*) filter (a <> '') a_present, count(*) filter (a <> '' and b is not null) joint from d group by 1""")
def column_coverage(spark, sf):
    d = V.table(spark, sf, "documents").selectExpr("source", "case when n_chars % 11 = 0 then null when n_chars % 7 = 0 then '' else text end as a", "if(n_chars % 5 = 0, null, text) as b")
    a = F.col("a")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(a.isNull()).alias("a_missing"), F.count_if(a == "").alias("a_empty"), F.count_if(a != "").alias("a_present"),
                                   F.count_if((a != "") & F.col("b").isNotNull()).alias("joint"))


LABELS = VARIED + f""", f as (select seq, y, lb, (seq * 37 % 1000) / 1000.0 score, length(lb) n, {ENT.replace('{c}', 'lb')} e, {SURPRISE.replace('{c}', 'lb')} s, {VOWELS.replace('{c}', 'lb')} v from m),
  o as (select *, case when y = 1 and score >= 0.5 then 'tp' when y = 1 then 'fn' when score >= 0.5 then 'fp' else 'tn' end outcome from f)"""


def _labels(spark, sf):
    v = varied(spark, sf).withColumn("lb", text.first_label("nm")).withColumn("score", (F.col("seq") * 37 % 1000) / 1000)
    v = v.select("seq", "y", "lb", "score", *[c.alias(k) for k, c in text.guard_features("lb").items()])
    return v.withColumn("outcome", metrics.outcome("y", F.col("score") >= 0.5))


@query("outcomes_per_bin", over(LABELS, """, b as (select 'length' feature, case when n < 8 then '[0, 8)' when n < 12 then '[8, 12)' when n < 16 then '[12, 16)' when n < 20 then '[16, 20)' when n < 32 then '[20, 32)' else '[32, +inf)' end bin, outcome from o
  union all select 'bigram_surprise', case when s < 0.5 then '[0, 0.5)' when s < 0.8 then '[0.5, 0.8)' else '[0.8, +inf)' end, outcome from o) select feature, bin, outcome, count(*) n from b group by 1, 2, 3"""))
def outcomes_per_bin(spark, sf):
    def bins(c, edges):
        lows = [0, *edges[:-1]]
        e = F.lit(f"[{edges[-1]}, +inf)")
        for lo, hi in reversed(list(zip(lows, edges))):
            e = F.when(F.col(c) < hi, f"[{lo}, {hi})").otherwise(e)
        return e

    cells = F.array(F.struct(F.lit("length").alias("feature"), bins("domain_label_length", [8, 12, 16, 20, 32]).alias("bin")),
                    F.struct(F.lit("bigram_surprise").alias("feature"), bins("bigram_surprise", [0.5, 0.8]).alias("bin")))
    return _labels(spark, sf).select(F.explode(cells).alias("c"), "outcome").groupBy("c.feature", "c.bin", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_profiles", over(LABELS, " select outcome, count(*) n, round(avg(n), 6) mean_length, round(avg(e), 6) mean_entropy, round(median(score), 6) median_score, round(median(n), 6) median_length from o group by 1"))
def outcome_profiles(spark, sf):
    l = _labels(spark, sf)
    g = l.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("domain_label_length").alias("mean_length"), F.avg("domain_entropy").alias("mean_entropy"))
    for c, name in (("score", "median_score"), ("domain_label_length", "median_length")):
        g = g.join(joins.quantiles(l, ["outcome"], c, {name: 0.5}), "outcome")
    return rounded(g)


@query("error_extremes", over(LABELS, """, r as (select outcome, lb, seq, score, row_number() over (partition by outcome order by score, lb, seq) a, row_number() over (partition by outcome order by score desc, lb desc, seq desc) d from o where outcome in ('fp', 'fn'))
  select outcome, lb, seq, score from r where a <= 5 or d <= 5""").replace("seq, score from r", "seq, round(score, 6) score from r"))
def error_extremes(spark, sf):
    """Five lowest and five highest errors per outcome; each side is a bounded top-k."""
    e = _labels(spark, sf).filter("outcome in ('fp', 'fn')").select("outcome", "lb", "seq", "score")
    top = lambda *order: e.withColumn("r", F.row_number().over(W.partitionBy("outcome").orderBy(*order))).filter("r <= 5").drop("r")
    low = top("score", "lb", "seq")
    high = top(F.desc("score"), F.desc("lb"), F.desc("seq"))
    return rounded(low.unionByName(high).distinct())


@query("group_eligibility", over(NAMES, """, r as (select family grp, case when seq % 13 = 0 then 0 else 1 end y, case when seq % 17 = 0 then '' else concat(lower(lang), cast(n_chars % 400 as varchar)) end label from (select 1000000 + doc_id seq, source family, lang, n_chars from documents)),
  dev as (select distinct sha256(concat('en', cast(i as varchar))) h from range(0, 40) t(i)), g as (select distinct grp, label from r where y = 1 and label <> ''), k as (select label, count(*) n from g group by 1),
  x as (select g.grp, g.label, sha256(g.label) h, n > 1 c, sha256(g.label) in (select h from dev) o from g join k using (label)),
  p as (select grp, substr(h, 1, 3) pre, count(*) u, count(*) filter (o) o, count(*) filter (c) c, count(*) filter (not o and not c) e, sha256(coalesce(string_agg(case when not o and not c then h end, '' order by h), '')) d from x group by 1, 2),
  q as (select grp, cast(sum(u) as bigint) unique_labels, cast(sum(o) as bigint) development_overlap, cast(sum(c) as bigint) collisions, cast(sum(e) as bigint) eligible, sha256(string_agg(d, '' order by pre)) digest from p group by 1)
  select r.grp, count(*) records, count(*) filter (y <> 1) wrong_label, count(*) filter (y = 1 and label = '') unsupported, any_value(unique_labels) unique_labels, any_value(development_overlap) development_overlap, any_value(collisions) collisions,
  any_value(eligible) eligible, any_value(digest) digest, any_value(eligible) >= 10 minimum_passed from r left join q using (grp) group by r.grp"""))
def group_eligibility(spark, sf):
    r = V.table(spark, sf, "documents").selectExpr("source as grp", "if((1000000 + doc_id) % 13 = 0, 0, 1) as y", "if((1000000 + doc_id) % 17 = 0, '', concat(lower(lang), n_chars % 400)) as label")
    dev = spark.range(40).select(F.sha2(F.concat(F.lit("en"), F.col("id").cast("string")), 256).alias("h"))
    return dataprep.eligibility(r, dev, 10)


@query("query_pace", over(TRAFFIC, """, q as (select dns_type, ts_us - lag(ts_us) over (partition by src_ip order by ts_us, seq) g from traffic where dns_name is not null)
  select dns_type, count(*) questions, count(*) filter (g > 2000000) low, count(*) filter (g <= 2000000 and g >= 500000) medium, count(*) filter (g < 500000) high from q group by 1"""))
def query_pace(spark, sf):
    """Question types and inter-question interval classes per source."""
    from ..operators.ordered import running_sums

    q = V.traffic(spark, sf).filter("dns_name is not null").select("seq", "ts_us", "src_ip", "dns_type")
    # The previous question's time: the row before in arrival order, also across blocks.
    n = running_sums(q, ["src_ip"], {"pos": F.lit(1)})
    prev = n.select("src_ip", (F.col("pos") + 1).alias("pos"), F.col("ts_us").alias("pt"))
    g = n.join(prev, ["src_ip", "pos"], "left").withColumn("g", F.col("ts_us") - F.col("pt"))
    return g.groupBy("dns_type").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("g") > 2_000_000).alias("low"), F.count_if(F.col("g").between(500_000, 2_000_000)).alias("medium"), F.count_if(F.col("g") < 500_000).alias("high"))


@query("capture_catalogue", over(TRAFFIC, ALERTS + """ select dst_ip, count(*) events, min(ts_us) first_us, max(ts_us) last_us, count(*) filter (threat = 'DDOS') ddos, count(*) filter (threat = 'RECONNAISSANCE') reconnaissance from al group by 1"""))
def capture_catalogue(spark, sf):
    a = alert_rows(spark, sf)
    return a.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if(F.col("threat") == "DDOS").alias("ddos"), F.count_if(F.col("threat") == "RECONNAISSANCE").alias("reconnaissance"))


@query("activity_summary", """with c as (select *, lead(role) over (partition by conv_id order by turn) nx from conversations) select role state, coalesce(nx, 'END') next_state, count(*) records, count(distinct conv_id) runs, min(turn) first_turn, max(turn) last_turn, count(*) filter (turn between 2 and 4) in_window from c group by 1, 2""")
def activity_summary(spark, sf):
    """States and transitions of an activity log, distinct runs, range, rows inside an observation window."""
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    n = c.select("conv_id", "role", F.col("turn").cast("long").alias("ts_us"), F.lit(0).alias("seq"))
    j = neighbours(n, ["conv_id"], "_p", "_n", 1024, carry=["role"]).select("conv_id", "role", F.col("ts_us").alias("turn"), F.col("_n.role").alias("nx"))
    return j.groupBy(F.col("role").alias("state"), F.coalesce("nx", F.lit("END")).alias("next_state")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("conv_id").alias("runs"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("turn").between(2, 4)).alias("in_window"))


@query("rate_between_polls", over(TRAFFIC, """, p as (select sec, max(seq) done from traffic group by 1), g as (select sec, done, greatest(0, done - lag(done) over (order by sec)) / greatest(0.001, sec - lag(sec) over (order by sec)) rate from p order by sec desc limit 24)
  select sec, round(rate, 6) rate from g"""))
def rate_between_polls(spark, sf):
    """Processed-count rate between consecutive polls, newest 24 samples (one extra poll is kept for the difference)."""
    p = V.traffic(spark, sf).groupBy("sec").agg(F.max("seq").alias("done")).orderBy(F.desc("sec")).limit(25)
    w = W.orderBy("sec")
    r = p.withColumn("rate", F.greatest(F.lit(0), F.col("done") - F.lag("done").over(w)) / F.greatest(F.lit(0.001), F.col("sec") - F.lag("sec").over(w)))
    return rounded(r.orderBy(F.desc("sec")).limit(24).select("sec", "rate"))


@query("first_alert_per_class", over(TRAFFIC, ALERTS + """, n as (select *, row_number() over (partition by src_ip order by ts_us, sequence) pos, min(ts_us) over (partition by src_ip) t0 from al), k as (select *, row_number() over (partition by src_ip, threat order by ts_us, sequence) r from n)
  select src_ip, threat, pos "position", ts_us - t0 delay_us, severity from k where r = 1"""))
def first_alert_per_class(spark, sf):
    """First alert per (stream, class) with its position in the stream and delay."""
    from ..operators.ordered import running_sums

    a = alert_rows(spark, sf).withColumnRenamed("sequence", "seq")
    n = running_sums(a, ["src_ip"], {"pos": F.lit(1)})
    t0 = a.groupBy("src_ip").agg(F.min("ts_us").alias("t0"))
    f = n.groupBy("src_ip", "threat").agg(F.min(F.struct("ts_us", "seq", "pos", "severity")).alias("f"))
    return f.join(t0, "src_ip").select("src_ip", "threat", F.col("f.pos").alias("position"), (F.col("f.ts_us") - F.col("t0")).alias("delay_us"), "f.severity")


@query("feature_trace_maxima", over(TRAFFIC, """, m as (select seq, src_ip, ts_us, bytes, max(bytes) over (partition by src_ip order by ts_us, seq) mx, row_number() over (partition by src_ip order by ts_us, seq) pos from traffic)
  select src_ip, max(mx) peak, min(pos) filter (bytes >= 20000) first_at_20000, array_to_string(list_sort(list(distinct case when bytes >= 20000 then 'high' else 'low' end)), ',') statuses from m group by 1"""))
def feature_trace_maxima(spark, sf):
    """Peak of a traced feature, first position meeting a threshold, statuses seen."""
    from ..operators.ordered import running_sums

    n = running_sums(V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "bytes"), ["src_ip"], {"pos": F.lit(1)})
    high = F.col("bytes") >= 20_000
    return n.groupBy("src_ip").agg(F.max("bytes").alias("peak"), F.min(F.when(high, F.col("pos"))).alias("first_at_20000"),
                                   F.array_join(F.array_sort(F.collect_set(F.when(high, "high").otherwise("low"))), ",").alias("statuses"))

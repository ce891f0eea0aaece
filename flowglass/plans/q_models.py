"""Registered queries: models, thresholds, comparisons, data-set preparation."""
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers, text
from ..operators import bayes, dataprep, history, joins, lexical_model, metrics
from . import detect as D
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import NAMES, SCORED, TRAFFIC, over
from .q_aggregates import CNT, LABELS, OUT, RAT, _labels, _outcomes
from .q_scalars import ENT, SURPRISE, VARIED, VOWELS, varied
from .q_windows import HIST_SQL

FEATS = ["q", "p", "d", "t"]
FLOW = """with f as (select l_orderkey * 10 + l_linenumber id, l_partkey k, l_returnflag y, l_shipdate d0, ln(1 + greatest(0, l_quantity)) q, ln(1 + greatest(0, l_extendedprice)) p, ln(1 + greatest(0, l_discount)) d, ln(1 + greatest(0, l_tax)) t from lineitem)"""
MOM = ", ".join(f"avg({c}) m{c}, greatest(0.03, var_pop({c})) v{c}" for c in FEATS)
SC = " + ".join(f"ln(2 * pi() * v{c}) + ({c} - m{c}) * ({c} - m{c}) / v{c}" for c in FEATS)


def _flows(spark, sf):
    from ..sources.tables import flow_vectors

    return flow_vectors(V.table(spark, sf, "lineitem"))


@query("class_moments", FLOW + f" select y, count(*) n, {', '.join(f'round(avg({c}), 6) {c}_mean, round(greatest(0.03, var_pop({c})), 6) {c}_var' for c in FEATS)} from f group by 1")
def class_moments(spark, sf):
    return rounded(bayes.gaussian_moments(_flows(spark, sf), "y", FEATS))


NB = FLOW + f""", tr as (select y, count(*) / (sum(count(*)) over ()) pr, {MOM} from f where year(d0) < 2000 group by 1),
  s as (select f.id, f.k, f.y, tr.y c, ln(pr) - 0.5 * ({SC}) s from f, tr where year(d0) >= 2000), g as (select *, max(s) over (partition by id, k) mx from s),
  r as (select id, k, any_value(y) y, arg_max(c, s) label, 1 / sum(exp(s - mx)) posterior from g group by 1, 2)"""


@query("bayes_predictions", NB + " select id, k, label, round(posterior, 5) posterior from r")
def bayes_predictions(spark, sf):
    """Fitted on one period, applied to the other (day hold-out)."""
    f = _flows(spark, sf)
    model = bayes.fit_gaussian(f.filter("year(day) < 2000"), "y", FEATS)
    return rounded(bayes.predict_gaussian(f.filter("year(day) >= 2000"), model, FEATS).select("id", "k", "label", "posterior"), 5)


@query("flow_model_evaluation", NB + f""", o as (select case when y = 'R' and label = 'R' and posterior >= 0.3 then 'tp' when y = 'R' then 'fn' when label = 'R' and posterior >= 0.3 then 'fp' else 'tn' end o from r), g9 as (select {CNT} from o) select *, {RAT} from g9""")
def flow_model_evaluation(spark, sf):
    f = _flows(spark, sf)
    model = bayes.fit_gaussian(f.filter("year(day) < 2000"), "y", FEATS)
    p = bayes.predict_gaussian(f.filter("year(day) >= 2000"), model, FEATS)
    hit = (F.col("label") == "R") & (F.col("posterior") >= 0.3)
    o = p.withColumn("outcome", metrics.outcome((F.col("y") == "R").cast("int"), hit))
    return rounded(metrics.ratios(o.agg(*metrics.counts())))


@query("counterfactual_scores", NB.replace("s as (select f.id, f.k, f.y, tr.y c, ln(pr)", "s as (select f.id * 2 + z id, f.k, f.y, tr.y c, ln(pr)").replace("from f, tr where", "from (select f.* exclude (d), z, case when z = 1 then 0 else d end d from f, (select 0 z union all select 1)) f, tr where")
       + """ select id // 2 id, k, any_value(label) filter (id % 2 = 0) before, any_value(label) filter (id % 2 = 1) after_zero, any_value(label) filter (id % 2 = 0) <> any_value(label) filter (id % 2 = 1) changed from r group by 1, 2""")
def counterfactual_scores(spark, sf):
    """Each row rescored with one feature set to zero."""
    f = _flows(spark, sf)
    model = bayes.fit_gaussian(f.filter("year(day) < 2000"), "y", FEATS)
    t = f.filter("year(day) >= 2000")
    a = bayes.predict_gaussian(t, model, FEATS, prefix="a_")
    b = bayes.predict_gaussian(a, model, ["q", "p", F.lit(0.0), "t"], prefix="b_")
    return b.select("id", "k", F.col("a_label").alias("before"), F.col("b_label").alias("after_zero"), (F.col("a_label") != F.col("b_label")).alias("changed"))


EMB = """with x as (select vec_id, label % 2 y, list_filter(embedding, lambda v: v > 0) p, cast(('0x' || substr(sha256(concat('tls:', cast(vec_id as varchar))), 1, 8)) as bigint) % 5 b from embeddings)"""


@query("positive_item_statistics", """with x as (select vec_id, list_transform(list_filter(embedding, lambda v: v > 0), lambda v: cast(v as double)) p from embeddings)
  select vec_id, cast(len(p) as int) n, round(list_avg(p), 6) mean, round(list_stddev_pop(p) / greatest(list_avg(p), 1e-9), 6) cv from x""")
def positive_item_statistics(spark, sf):
    """Mean and variation of the positive items of a list column."""
    from ..sources.tables import positive_statistics

    return rounded(positive_statistics(V.table(spark, sf, "embeddings"), "embedding").select("vec_id", "n", "mean", "cv"))


@query("list_model_evaluation", EMB + """, f as (select vec_id, y, b, ln(1 + len(p)) a, ln(1 + list_avg(list_transform(p, lambda v: cast(v as double)))) m from x),
  tr as (select y, count(*) / (sum(count(*)) over ()) pr, avg(a) ma, greatest(0.03, var_pop(a)) va, avg(m) mm, greatest(0.03, var_pop(m)) vm from f where b < 3 group by 1),
  s as (select f.vec_id, f.y, tr.y c, ln(pr) - 0.5 * (ln(2 * pi() * va) + (a - ma) * (a - ma) / va + ln(2 * pi() * vm) + (m - mm) * (m - mm) / vm) s from f, tr where b >= 4),
  r as (select vec_id, any_value(y) y, arg_max(c, s) label from s group by 1), o as (select case when y = 1 and label = 1 then 'tp' when y = 1 then 'fn' when label = 1 then 'fp' else 'tn' end o from r),
  g as (select """ + CNT + " from o) select *, " + RAT + " from g")
def list_model_evaluation(spark, sf):
    """Naive Bayes on list statistics with a 60/20/20 group-hash split, tested on the last fifth."""
    from ..sources.tables import positive_statistics

    e = positive_statistics(V.table(spark, sf, "embeddings"), "embedding")
    f = e.select("vec_id", (F.col("label") % 2).alias("y"), F.log1p("n").alias("a"), F.log1p("mean").alias("m"), numbers.hash_bucket("vec_id", 5, "tls:").alias("b"))
    model = bayes.fit_gaussian(f.filter("b < 3"), "y", ["a", "m"])
    p = bayes.predict_gaussian(f.filter("b >= 4"), model, ["a", "m"])
    return rounded(metrics.ratios(p.withColumn("outcome", metrics.outcome("y", F.col("label") == 1)).agg(*metrics.counts())))


TOK = VARIED + """, b as (select seq, y, cast(('0x' || substr(sha256(cast(seq as varchar)), 1, 8)) as bigint) % 10 k, concat('^', lb, '$') s from m),
  t as (select seq, y, k, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) token from b),
  c as (select token, count(*) filter (y = 0) n0, count(*) filter (y = 1) n1 from t where k < 6 group by 1), z as (select sum(n0) t0, sum(n1) t1, count(*) v from c)"""


def _bigrams(spark, sf):
    v = varied(spark, sf).withColumn("s", F.concat(F.lit("^"), text.first_label("nm"), F.lit("$")))
    return v.select("seq", "y", text.ngrams("s", 2).alias("tokens"), numbers.hash_bucket("seq", 10).alias("k"))


@query("bigram_counts", over(TOK, " select token, n0, n1 from c"))
def bigram_counts(spark, sf):
    return bayes.token_counts(_bigrams(spark, sf).filter("k < 6"), "tokens", "y")


@query("bigram_scores", over(TOK, """, w as (select token, ln((n1 + 1) / (t1 + v + 1)) - ln((n0 + 1) / (t0 + v + 1)) w, t0, t1, v from c, z), u as (select ln(1 / (t1 + v + 1)) - ln(1 / (t0 + v + 1)) u from z),
  s as (select t.seq, sum(coalesce(w, (select u from u))) logit from t left join w using (token) where k >= 8 group by 1) select seq, round(logit, 6) logit, round(1 / (1 + exp(-greatest(-700, least(700, logit)))), 6) score from s"""))
def bigram_scores(spark, sf):
    b = _bigrams(spark, sf)
    w, unseen = bayes.token_weights(bayes.token_counts(b.filter("k < 6"), "tokens", "y"))
    return rounded(bayes.score_tokens(b.filter("k >= 8"), "seq", "tokens", w, unseen))


THS = [.5, .6, .7, .8, .85, .9, .95, .975, .99]
SWEEP = SCORED + f""", th as (select unnest([{', '.join(str(t) for t in THS)}]) threshold), o as (select threshold, case when y = 1 and score >= threshold then 'tp' when y = 1 then 'fn' when score >= threshold then 'fp' else 'tn' end o from scored, th),
  g as (select cast(threshold as double) threshold, {CNT} from o group by 1), h as (select *, case when tp + fp > 0 then tp / (tp + fp) end p, case when tp + fn > 0 then tp / (tp + fn) end r, case when fp + tn > 0 then fp / (fp + tn) end f from g),
  k as (select threshold, tp, fn, fp, tn, round(p, 6) "precision", round(r, 6) recall, round(f, 6) fpr, coalesce(r >= 0.1 and p >= 0.6 and f <= 0.3, false) passes from h)"""


def _sweep(spark, sf):
    return metrics.threshold_sweep(V.scored(spark, sf), THS, 0.1, 0.6, 0.3)


@query("threshold_sweep", over(SWEEP, " select * from k"))
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf))


@query("best_threshold", over(SWEEP, " select * from k order by passes desc, case when passes then recall end desc, case when passes then fpr end, case when passes then threshold else -threshold end limit 1"))
def best_threshold(spark, sf):
    return rounded(metrics.best_threshold(_sweep(spark, sf)))


RULES = LABELS + """, w as (select seq, y, lb, n, e >= 3.5 and s >= 0.8 and n >= 20 old_rule, (n between 8 and 15 and e >= 2.5 and s >= 0.9 and v <= 0.2) or (n >= 16 and e >= 3.4 and s >= 0.8 and v <= 0.3) new_rule from f)"""


def _ruled(spark, sf):
    l = _labels(spark, sf)
    f = {k: F.col(k) for k in ("domain_entropy", "bigram_surprise", "domain_label_length", "domain_vowel_ratio")}
    two = text.validation_rule({**f, "domain_consonant_run": F.lit(1.0)})
    return l.select("seq", "y", F.col("domain_label_length").alias("n"), text.conservative_rule(f).alias("old_rule"), two.alias("new_rule"))


@query("rule_comparison", over(RULES, """, x as (select 'old_rule' rule, y, n, old_rule hit from w union all select 'new_rule', y, n, new_rule from w)
  select rule, case when n < 16 then 'short_under_16' else 'long_16_plus' end length_class, count(*) filter (y = 1 and hit) tp, count(*) filter (y = 1 and not hit) fn, count(*) filter (y = 0 and hit) fp, count(*) filter (y = 0 and not hit) tn from x group by 1, 2"""))
def rule_comparison(spark, sf):
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit")) for r in ("old_rule", "new_rule")])
    x = _ruled(spark, sf).select("y", "n", F.explode(cells).alias("c")).withColumn("outcome", metrics.outcome("y", F.col("c.hit")))
    return x.groupBy("c.rule", F.when(F.col("n") < 16, "short_under_16").otherwise("long_16_plus").alias("length_class")).agg(*metrics.counts())


@query("guard_evaluation", over(RULES, """, x as (select family, w.y, w.new_rule hit from w join m using (seq)), o9 as (select family, case when y = 1 and hit then 'tp' when y = 1 then 'fn' when hit then 'fp' else 'tn' end o from x),
  g as (select coalesce(family, 'all') family, """ + CNT + """ from o9 group by grouping sets ((family), ())) select *, """ + RAT + ", round(case when tp + fn > 0 and fp + tn > 0 then (tp / (tp + fn)) / nullif(tp / (tp + fn) + fp / (fp + tn), 0) end, 6) even_precision from g"))
def guard_evaluation(spark, sf):
    r = _ruled(spark, sf).join(varied(spark, sf).select("seq", "family"), "seq").withColumn("outcome", metrics.outcome("y", F.col("new_rule")))
    g = metrics.ratios(r.rollup("family").agg(*metrics.counts())).withColumn("family", F.coalesce("family", F.lit("all")))
    both = F.col("recall") + F.col("fpr")
    return rounded(g.withColumn("even_precision", F.when(both > 0, F.col("recall") / both)))


GRID = HIST_SQL + """, f as (select seq, any_value(now) ts_us, greatest(count(distinct case when ts_us >= now - 10000000 then dst_ip end), count(distinct case when ts_us >= now - 10000000 then dst_port end)) fan,
  sum(case when ts_us >= now - 10000000 and syn and (syn_packets is null or syn_packets <> 0) then 1 else 0 end) / sum(case when ts_us >= now - 10000000 then 1 else 0 end) s from h group by seq),
  x as (select f.*, t.syn y from f join traffic t using (seq)), g as (select fanout, share from (select unnest([3, 4, 5, 6]) fanout), (select unnest([0.0, 0.25, 0.5]) share)),
  r as (select fanout, cast(share as double) share, count(*) filter (y and fan >= fanout and s >= share) tp, count(*) filter (not y and fan >= fanout and s >= share) fp, count(*) filter (y) pos from x, g group by 1, 2)"""


@query("threshold_grid", over(TRAFFIC, GRID + """ select fanout, share, tp, fp, round(tp / pos, 6) recall, row_number() over (order by case when fp <= 400 then 0 else 1 end, -tp, fp, fanout, share) "rank" from r"""))
def threshold_grid(spark, sf):
    """All settings of two thresholds from one pass over the features, ranked by cap, recall, false alerts."""
    f = history.source_history(V.traffic(spark, sf), families=("source",)).select(F.greatest("destination_count", "port_count").alias("fan"), F.col("syn_fraction").alias("s"), "syn")
    # Counted per (fan-out, share) cell first, so that the grid multiplies cells, not events.
    cells = f.groupBy("fan", "s").agg(F.count_if("syn").alias("p"), F.count_if(~F.col("syn")).alias("n"))
    grid = F.array(*[F.struct(F.lit(a).alias("fanout"), F.lit(b).alias("share")) for a in (3, 4, 5, 6) for b in (0.0, 0.25, 0.5)])
    x = cells.select("*", F.explode(grid).alias("g"))
    hit = (F.col("fan") >= F.col("g.fanout")) & (F.col("s") >= F.col("g.share"))
    r = x.groupBy("g.fanout", "g.share").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), F.sum("p").alias("pos"))
    w = W.orderBy((F.col("fp") > 400).cast("int"), F.desc("tp"), "fp", "fanout", "share")
    return rounded(r.select("fanout", "share", "tp", "fp", (F.col("tp") / F.col("pos")).alias("recall"), F.row_number().over(w).cast("long").alias("rank")))


@query("detector_attribution", over(TRAFFIC, """, a as (select case when seq % 3 = 0 then 'ML' when seq % 4 = 0 then 'HYBRID' else 'RULE' end detector, packets > 20 rule_fired, encrypted benign from traffic)
  select detector, count(*) false_positives, count(*) filter (detector in ('RULE', 'HYBRID') and not rule_fired) inconsistent from a where benign group by 1"""))
def detector_attribution(spark, sf):
    """False positives by detector, with a consistency check against the rule verdict."""
    a = V.traffic(spark, sf).selectExpr("case when seq % 3 = 0 then 'ML' when seq % 4 = 0 then 'HYBRID' else 'RULE' end as detector", "packets > 20 as rule_fired", "encrypted as benign").filter("benign")
    return a.groupBy("detector").agg(F.count(F.lit(1)).alias("false_positives"), F.count_if(F.col("detector").isin("RULE", "HYBRID") & ~F.col("rule_fired")).alias("inconsistent"))


@query("digest_collisions", """with s as (select conv_id, md5(string_agg(role, ',' order by turn)) digest, conv_id % 3 = 0 positive from conversations group by 1)
  select digest, count(*) scenarios, count(*) filter (positive) positives from s group by 1 having bool_or(positive) and not bool_and(positive)""")
def digest_collisions(spark, sf):
    """Scenarios with identical digests and opposite labels."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    s = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(roles).alias("digest")).withColumn("positive", F.col("conv_id") % 3 == 0)
    return s.groupBy("digest").agg(F.count(F.lit(1)).alias("scenarios"), F.count_if("positive").alias("positives")).filter("positives > 0 and positives < scenarios")


@query("scenario_verdicts", over(TRAFFIC, """, r as (select src_ip, packets, syn, ts_us, seq, row_number() over (partition by src_ip order by ts_us, seq) pos from traffic), e9 as (select src_ip, count(*) total, min(pos) filter (packets > 30) first, bool_or(syn) positive from r group by 1)
  select src_ip, total, first first_alert, case when positive and coalesce(first < total, false) then 'TP' when positive then 'FN' when first is not null then 'FP' else 'TN' end verdict from e9"""))
def scenario_verdicts(spark, sf):
    """A positive scenario counts only when it alerts before its last event."""
    from ..operators.ordered import running_sums

    r = running_sums(V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "packets", "syn"), ["src_ip"], {"pos": F.lit(1)})
    e = r.groupBy("src_ip").agg(F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("packets") > 30, F.col("pos"))).alias("first_alert"), F.bool_or("syn").alias("positive"))
    before = F.coalesce(F.col("first_alert") < F.col("total"), F.lit(False))
    v = F.when(F.col("positive") & before, "TP").when(F.col("positive"), "FN").when(F.col("first_alert").isNotNull(), "FP").otherwise("TN")
    return e.select("src_ip", "total", "first_alert", v.alias("verdict"))


@query("rule_variants", over(TRAFFIC, """, d as (select src_ip, seq % 2 split, max(length(split_part(dns_name, '.', 1)) >= 30 and dns_type = 16) a, max(length(dns_name) >= 40) b, max(packets > 60) y from traffic where dns_name is not null group by 1, 2),
  x as (select 'active' variant, split, y, a hit from d union all select 'candidate', split, y, b from d)
  select variant, split, count(*) filter (y and hit) tp, count(*) filter (y and not hit) fn, count(*) filter (not y and hit) fp, count(*) filter (not y and not hit) tn from x group by 1, 2"""))
def rule_variants(spark, sf):
    """Two rule variants judged on the same labelled sessions, per split."""
    q = V.traffic(spark, sf).filter("dns_name is not null")
    d = q.groupBy("src_ip", (F.col("seq") % 2).alias("split")).agg(
        F.bool_or((F.length(F.split_part("dns_name", F.lit("."), F.lit(1))) >= 30) & (F.col("dns_type") == 16)).alias("active"), F.bool_or(F.length("dns_name") >= 40).alias("candidate"), F.bool_or(F.col("packets") > 60).alias("y"))
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("hit")) for v in ("active", "candidate")])
    x = d.select("split", F.col("y").cast("int").alias("y"), F.explode(cells).alias("c")).withColumn("outcome", metrics.outcome("y", F.col("c.hit")))
    return x.groupBy("c.variant", "split").agg(*metrics.counts())


FAM = """with d as (select doc_id, source family, concat(lang, '-', cast(n_chars % 3000 as varchar)) label, doc_id % 4 = 0 benign from documents),
  f as (select distinct family, label, case when b < 3 then 'train' when b = 3 then 'validation' else 'test' end split from (select *, cast(('0x' || substr(sha256(concat('fam:', family)), 1, 8)) as bigint) % 5 b from d where not benign)),
  n as (select distinct label, cast(('0x' || substr(sha256(concat('ben:', label)), 1, 8)) as bigint) % 10 b from d where benign),
  cf as (select label from f intersect select label from n), cr as (select label from f group by 1 having count(distinct split) > 1),
  pos as (select label, 1 y, split, max(family) family from f where label not in (select label from cf) and label not in (select label from cr) group by 1, 3),
  neg as (select label, 0 y, case when b < 6 then 'train' when b < 8 then 'validation' else 'test' end split, 'legit' family from n where label not in (select label from cf))"""


@query("family_disjoint_split", FAM + " select * from pos union all select * from neg")
def family_disjoint_split(spark, sf):
    """Split by family hash; labels of both classes or of several splits are removed; the last family reports a label."""
    d = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("family"), F.concat(F.col("lang"), F.lit("-"), (F.col("n_chars") % 3000).cast("string")).alias("label"))
    b = numbers.hash_bucket("family", 5, "fam:")
    f = d.filter("doc_id % 4 <> 0").select("family", "label", F.when(b < 3, "train").when(b == 3, "validation").otherwise("test").alias("split")).distinct()
    n = d.filter("doc_id % 4 = 0").select("label").distinct()
    conflict = f.select("label").intersect(n)
    pos = f.join(conflict, "label", "left_anti").join(joins.crossing(f, "label", "split"), "label", "left_anti")
    pos = pos.groupBy("label", "split").agg(F.max("family").alias("family")).select("label", F.lit(1).alias("y"), "split", "family")
    neg = n.join(conflict, "label", "left_anti").select("label", F.lit(0).alias("y"), numbers.family_split(numbers.hash_bucket("label", 10, "ben:")).alias("split"), F.lit("legit").alias("family"))
    return pos.unionByName(neg)


@query("split_integrity", FAM + ", a as (select * from pos union all select * from neg) select count(*) labels, count(distinct label) unique_labels, count(*) - count(distinct label) repeated from a")
def split_integrity(spark, sf):
    s = family_disjoint_split(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("label").alias("unique_labels")).withColumn("repeated", F.col("labels") - F.col("unique_labels"))


EDGES = """with recursive m as (select p_partkey id, p_size s, p_name n from part), nodes as (select concat('m:', cast(id as varchar)) node from m),
  ed as (select concat('m:', cast(id as varchar)) a, concat('k:', cast(id % 331 as varchar), '-', cast(s % 7 as varchar)) b from m union select concat('m:', cast(id as varchar)), concat('j:', cast(id // 3 as varchar)) from m where id % 5 = 0),
  bi as (select a, b from ed union select b, a from ed), r as (select a node, a root from bi union select bi.b, r.root from r join bi on bi.a = r.node and r.root < bi.b)"""


def _edges(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("concat('m:', p_partkey) as a", "p_partkey as id", "p_size as s")
    one = p.selectExpr("a", "concat('k:', id % 331, '-', s % 7) as b")
    return one.unionByName(p.filter("id % 5 = 0").selectExpr("a", "concat('j:', cast(floor(id / 3) as bigint)) as b"))


@query("linked_components", EDGES + """, c as (select node, min(root) component from r group by 1) select component, count(*) nodes, count(*) filter (node like 'm:%') members from c group by 1""")
def linked_components(spark, sf):
    c = dataprep.components(_edges(spark, sf))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node").startswith("m:")).alias("members"))


@query("component_disjoint_split", EDGES + """, c as (select node, min(root) component from r group by 1), l as (select concat('m:', cast(id as varchar)) node, case when id % 9 = 0 then 'UNLABELLED' when id % 2 = 0 then 'BENIGN_REFERENCE' else 'MALWARE_RELATED' end label from m),
  bad as (select distinct component from c where node in ('k:5-1', 'k:7-2', 'k:11-3')), u as (select component, max(case when label <> 'UNLABELLED' then 1 else 0 end) k from l join c using (node) group by 1)
  select case when component in (select component from bad) then 'quarantine' when k = 0 then 'unlabelled' when cast(('0x' || substr(sha256(component), 1, 8)) as bigint) % 10 < 6 then 'train' else 'validation' end part, label, count(*) n
  from l join c using (node) join u using (component) group by 1, 2""")
def component_disjoint_split(spark, sf):
    m = V.table(spark, sf, "part").selectExpr("concat('m:', p_partkey) as node", "case when p_partkey % 9 = 0 then 'UNLABELLED' when p_partkey % 2 = 0 then 'BENIGN_REFERENCE' else 'MALWARE_RELATED' end as label")
    q = _edges(spark, sf).filter("b in ('k:5-1', 'k:7-2', 'k:11-3')").select(F.col("b").alias("node")).distinct()
    return dataprep.linked_split(m, _edges(spark, sf), q).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("group_routing", """with b as (select doc_id, source, case when lang = 'de' then null else source end g from documents) select doc_id, case when g is null then 'unlabelled' when x < 3 then 'development' when x = 3 then 'validation' else 'historical_test' end route
  from (select *, cast(('0x' || substr(sha256(concat('route:', g)), 1, 8)) as bigint) % 5 x from b)""")
def group_routing(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("source")).alias("g"))
    x = numbers.hash_bucket("g", 5, "route:")
    return d.select("doc_id", F.when(F.col("g").isNull(), "unlabelled").when(x < 3, "development").when(x == 3, "validation").otherwise("historical_test").alias("route"))


@query("routed_scan", """with d as (select source, lang, n_chars from documents where source not in (select source from documents group by 1 having cast(('0x' || substr(sha256(source), 1, 8)) as bigint) % 4 = 0)) select source, count(*) n, cast(sum(n_chars) as bigint) chars from d group by 1""")
def routed_scan(spark, sf):
    """Groups routed to test are excluded before any other column is read."""
    d = V.table(spark, sf, "documents")
    held = d.select("source").distinct().filter(numbers.hash_bucket("source", 4) == 0)
    return d.select("source", "n_chars").join(held, "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("manifest_checks", """with s as (select o_orderkey id, o_custkey % 900 grp, o_orderkey % 997 frag, date_part('day', o_orderdate) st, date_part('day', o_orderdate) + o_orderkey % 5 - 1 en from orders)
  select 'duplicate_group' problem, count(*) n from (select grp from s group by 1 having count(*) > 1) union all select 'duplicate_fragment', count(*) from (select frag from s group by 1 having count(*) > 1) union all select 'reversed_interval', count(*) from s where st > en
  union all select 'duplicate_session', count(*) from (select id from s group by 1 having count(*) > 1)""")
def manifest_checks(spark, sf):
    """Problems of a session manifest: repeated identities and reversed intervals."""
    s = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 900).alias("grp"), (F.col("o_orderkey") % 997).alias("frag"),
                                                                          F.dayofmonth("o_orderdate").alias("st"), (F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 5 - 1).alias("en"))
    def repeated(c, name):
        return s.groupBy(c).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    rev = s.filter("st > en").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reversed_interval").alias("problem"), "n")
    return repeated("grp", "duplicate_group").unionByName(repeated("frag", "duplicate_fragment")).unionByName(rev).unionByName(repeated("id", "duplicate_session"))


STR = SCORED + """, d as (select s.doc_id, s.y, s.score, sha256(t.text) h, cast(('0x' || substr(sha256(concat('s:', cast(s.doc_id as varchar))), 1, 8)) as bigint) % 10 b from scored s join documents t using (doc_id)),
  v as (select distinct h from d where b in (6, 7)), x as (select distinct h from d where b >= 8), o as (select case when h in (select h from v) then 'validation_overlap' when h in (select h from x) then 'comparison_overlap' else 'disjoint' end stratum,
  case when y = 1 and score >= 0.5 then 'tp' when y = 1 then 'fn' when score >= 0.5 then 'fp' else 'tn' end o from d where b < 6)"""


@query("overlap_strata", over(STR, f", g as (select stratum, {CNT} from o group by 1) select *, {RAT} from g"))
def overlap_strata(spark, sf):
    t = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    d = V.scored(spark, sf).join(t, "doc_id").withColumn("b", numbers.hash_bucket("doc_id", 10, "s:"))
    flag = lambda cond, name: d.filter(cond).select("h").distinct().withColumn(name, F.lit(True))
    e = d.filter("b < 6").join(flag("b in (6, 7)", "val"), "h", "left").join(flag("b >= 8", "cmp"), "h", "left")
    s = F.when(F.col("val"), "validation_overlap").when(F.col("cmp"), "comparison_overlap").otherwise("disjoint")
    return rounded(metrics.ratios(e.withColumn("outcome", metrics.outcome("y", F.col("score") >= 0.5)).groupBy(s.alias("stratum")).agg(*metrics.counts())))


@query("session_membership", over(TRAFFIC, """ select case when dns_name is null then 'missing_name' when not ends_with(dns_name, '.example.test') then 'outside_namespace' when packets > 50 then 'several_packets' when sec > 1704067400 then 'outside_interval' else 'ok' end reason, count(*) n from traffic group by 1"""))
def session_membership(spark, sf):
    t = V.traffic(spark, sf)
    r = (F.when(F.col("dns_name").isNull(), "missing_name").when(~F.col("dns_name").endswith(".example.test"), "outside_namespace").when(F.col("packets") > 50, "several_packets")
         .when(F.col("sec") > 1704067400, "outside_interval").otherwise("ok"))
    return t.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("source_labels", """select doc_id, case when source in ('src1', 'src2', 'src3') then 'BENIGN_REFERENCE' when lang = 'de' and n_chars > 500 then 'MALWARE_RELATED' else 'UNLABELLED' end label from documents""")
def source_labels(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.when(F.col("source").isin("src1", "src2", "src3"), "BENIGN_REFERENCE").when((F.col("lang") == "de") & (F.col("n_chars") > 500), "MALWARE_RELATED").otherwise("UNLABELLED").alias("label"))


def _training(spark, sf):
    return lexical_model.prepare(V.names(spark, sf).select("seq", text.domain_label("name").alias("label"), "y", "family").filter("label <> ''"))


@query("lexical_classifier")
def lexical_classifier(spark, sf):
    """Scores of the boosted lexical classifier on the held-out fold (the fitting solver has no SQL twin); leaves of 50 rows fit these tables."""
    r = _training(spark, sf).withColumn("b", numbers.hash_bucket("label", 10, "lex:"))
    m = lexical_model.fit(lexical_model.weighted(r.filter("b < 8")), leaf=50)
    return m.score(r.filter("b >= 8")).select("seq", "y", F.round("logit", 4).alias("logit"), F.round("score", 4).alias("score"))


@query("out_of_fold_logits")
def out_of_fold_logits(spark, sf):
    r = lexical_model.balanced(_training(spark, sf)).withColumn("grp", F.when(F.col("y") == 1, F.col("family")).otherwise(F.col("label")))
    return lexical_model.out_of_fold(r, "grp").select("seq", "y", "fold", F.round("logit", 4).alias("logit"))

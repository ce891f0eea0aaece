"""Evaluation metrics as aggregations."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(y, predicted) -> Column:
    y, p = (F.col(c) if isinstance(c, str) else c for c in (y, predicted))
    return F.when((y == 1) & p, "tp").when(y == 1, "fn").when(p, "fp").otherwise("tn")


def counts(o="outcome") -> list:
    return [F.count_if(F.col(o) == k).alias(k) for k in ("tp", "fn", "fp", "tn")]


def ratios(df: DataFrame) -> DataFrame:
    """Precision, recall and false-positive rate; null when undefined."""
    div = lambda a, b: F.when(b > 0, a / b)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return df.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "fpr": div(fp, fp + tn)})


def per_class(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of every class, each guarded by max(1, denominator); one pass over (truth, predicted) counts."""
    c = pairs.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    by_truth = c.select(F.col(truth).alias("label"), right.alias("tp"), (F.col("n") - right).alias("fn"), F.lit(0).cast("long").alias("fp"))
    by_pred = c.select(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), (F.col("n") - right).alias("fp"))
    g = by_truth.unionByName(by_pred).groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fn", "fp")])
    one = lambda d: F.greatest(F.lit(1), d)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return g.select("label", "tp", "fn", "fp", (tp / one(tp + fp)).alias("precision"), (tp / one(tp + fn)).alias("recall"), (2 * tp / one(2 * tp + fp + fn)).alias("f1"))


def threshold_sweep(scored: DataFrame, thresholds, min_recall=0.8, min_precision=0.95, max_fpr=0.02) -> DataFrame:
    """Metrics at every threshold from one pass: a row contributes to the thresholds it reaches."""
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(ts, lambda t: F.col("score") >= t))
    h = scored.groupBy(reached.alias("k")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    steps = h.select(F.posexplode(ts).alias("i", "threshold"), "k", "p", "n")
    hit = F.col("k") > F.col("i")
    g = steps.groupBy("threshold").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"),
                                       F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("tn"))
    g = ratios(g)
    ok = (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision) & (F.col("fpr") <= max_fpr)
    return g.withColumn("passes", F.coalesce(ok, F.lit(False)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The passing threshold with the highest (recall, -FPR); the last candidate when none passes."""
    rank = F.struct(F.col("passes").alias("a"), F.when(F.col("passes"), F.col("recall")).alias("b"), F.when(F.col("passes"), -F.col("fpr")).alias("c"),
                    F.when(F.col("passes"), -F.col("threshold")).otherwise(F.col("threshold")).alias("d"))
    return sweep.agg(F.max_by(F.struct(*sweep.columns), rank).alias("r")).select("r.*")


def early_sessions(sessions: DataFrame, max_query: int, max_delay_us: int) -> DataFrame:
    """Outcome per session: a positive counts only when its first alert comes before the last query.

    Needs positive, queries, first_query, delay_us (both null without an alert)."""
    before = F.coalesce(F.col("first_query") < F.col("queries"), F.lit(False))
    o = (F.when(F.col("positive") & before, "tp").when(F.col("positive"), "fn").when(F.col("first_query").isNotNull(), "fp").otherwise("tn"))
    early = (o == "tp") & (F.col("first_query") <= max_query) & (F.col("delay_us") <= max_delay_us)
    return sessions.withColumns({"outcome": o, "before_end": before, "early": F.coalesce(early, F.lit(False))})


def early_summary(s: DataFrame, recall_min=0.8, precision_min=0.9, fpr_max=0.05, early_min=0.8) -> DataFrame:
    g = ratios(s.agg(*counts(), F.count_if("early").alias("early"), F.count_if((F.col("outcome") == "tp") & ~F.col("before_end")).alias("slow_tp")))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    frac = F.when(F.col("tp") > 0, F.col("early") / F.col("tp"))
    g = g.withColumns({"f1": f1, "early_fraction": frac})
    ok = lambda c: F.coalesce(c, F.lit(False))
    return g.withColumns({"recall_ok": ok(r >= recall_min), "precision_ok": ok(p >= precision_min), "fpr_ok": ok(F.col("fpr") <= fpr_max),
                          "timing_ok": ok(F.col("early_fraction") >= early_min) & (F.col("slow_tp") == 0)}).drop("slow_tp")


def lab_events(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Matched events (seq, ts_us, episode, label) with the classes alerted on them as an array `threats`."""
    a = alerts.groupBy("seq").agg(F.collect_set("threat_class").alias("threats"))
    return events.join(a, "seq", "left").withColumn("threats", F.coalesce("threats", F.array().cast("array<string>")))


def lab_episodes(matched: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per episode: events, alerts by kind, first correct alert with its delay and position.

    The position counts the episode's events up to that alert and is found by comparing
    with the first alert's time, not by numbering all rows of an episode."""
    order = F.struct("ts_us", "seq")
    hit = F.array_contains("threats", F.col("label"))
    at = matched.filter("episode is not null")
    first = at.groupBy("episode").agg(F.min(order).alias("begin"), F.min(F.when(hit & (F.col("label") != "BENIGN"), order)).alias("hit"))
    j = at.join(first, "episode")
    upto = F.col("hit").isNotNull() & (order <= F.col("hit"))
    correct = F.when(hit & (F.col("label") != "BENIGN"), 1).otherwise(0)
    g = j.groupBy("episode").agg(F.count(F.lit(1)).alias("events"), F.sum(correct).alias("correct_alerts"), F.sum(F.size("threats") - correct).alias("other_alerts"),
                                 F.first("hit").alias("hit"), F.first("begin").alias("begin"), F.count_if(upto).alias("events_into"))
    g = g.select("episode", "events", "correct_alerts", "other_alerts", F.col("hit").isNotNull().alias("detected"),
                 F.when(F.col("hit").isNotNull(), F.col("events_into")).alias("events_into"), ((F.col("hit.ts_us") - F.col("begin.ts_us")) / 1000).alias("delay_ms"))
    e = episodes.select(F.col("id").alias("episode"), "label", *[c for c in ("scenario", "split") if c in episodes.columns])
    zero = {"events": 0, "correct_alerts": 0, "other_alerts": 0, "detected": False}
    return e.join(g, "episode", "left").fillna(zero)


def lab_threats(matched: DataFrame, per_episode: DataFrame) -> DataFrame:
    """Per threat class: episodes, recall, alerts, precision, false alerts on benign traffic, detection delay."""
    e = per_episode.filter("label <> 'BENIGN'").groupBy(F.col("label").alias("threat")).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("events") > 0).alias("observed"), F.count_if("detected").alias("detected"), F.sum("correct_alerts").alias("correct_alerts"),
        F.median("delay_ms").alias("median_delay_ms"), F.max("delay_ms").alias("max_delay_ms"))
    al = matched.select("episode", "label", F.explode("threats").alias("threat"))
    benign = F.col("label").isNull() | (F.col("label") == "BENIGN")
    a = al.groupBy("threat").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(benign).alias("false_on_benign"))
    j = e.join(a, "threat", "full_outer").fillna(0, ["episodes", "observed", "detected", "correct_alerts", "alerts", "false_on_benign"])
    div = lambda x, y: F.when(y > 0, F.round(x / y, 4))
    return j.withColumns({"recall": div(F.col("detected"), F.col("episodes")), "precision": div(F.col("correct_alerts"), F.col("alerts"))})


def shannon(counts: DataFrame, keys, n="n") -> DataFrame:
    """Entropy of a multiset given its counts."""
    c = F.col(n).cast("double")
    g = counts.groupBy(*keys).agg(F.sum(c).alias("t"), F.sum(c * F.log2(c)).alias("s"))
    return g.select(*keys, F.greatest(F.lit(0.0), F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))

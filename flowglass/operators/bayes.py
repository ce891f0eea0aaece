"""Gaussian and token naive Bayes as aggregations and column expressions."""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import logistic

FLOOR = 0.03


def gaussian_moments(rows: DataFrame, label: str, features, floor=FLOOR) -> DataFrame:
    """Per class: row count, population mean and floored variance of every feature (one aggregation)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in features:
        aggs += [F.avg(c).alias(c + "_mean"), F.greatest(F.lit(floor), F.var_pop(c)).alias(c + "_var")]
    return rows.groupBy(label).agg(*aggs)


def fit_gaussian(rows: DataFrame, label: str, features, floor=FLOOR) -> dict:
    """The fitted model: label -> (prior, means, variances). One row per class reaches the driver."""
    got = gaussian_moments(rows, label, features, floor).collect()
    total = sum(r["n"] for r in got)
    return {r[label]: (r["n"] / total, [r[c + "_mean"] for c in features], [r[c + "_var"] for c in features]) for r in got}


def log_scores(model: dict, features) -> dict:
    """Label -> log joint density expression."""
    out = {}
    for label, (prior, means, variances) in sorted(model.items(), key=lambda kv: str(kv[0])):
        const = math.log(prior) - 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
        dist = F.lit(0.0)
        for c, m, v in zip(features, means, variances):
            d = (F.col(c) if isinstance(c, str) else c) - F.lit(float(m))
            dist = dist + d * d / F.lit(float(v))
        out[label] = F.lit(const) - dist / 2
    return out


def predict_gaussian(rows: DataFrame, model: dict, features, prefix="") -> DataFrame:
    """Adds `<prefix>label` and `<prefix>posterior` (softmax shifted by the maximum)."""
    names = {label: f"_s{i}" for i, label in enumerate(sorted(model, key=str))}
    scores = log_scores(model, features)
    r = rows.withColumns({names[k]: v for k, v in scores.items()})
    r = r.withColumn("_peak", F.greatest(*names.values()) if len(names) > 1 else F.col(next(iter(names.values()))))
    weight = lambda n: F.exp(F.greatest(F.lit(-700.0), F.col(n) - F.col("_peak")))
    total: Column = sum((weight(n) for n in names.values()), F.lit(0.0))
    pick = F.lit(None)
    for label, n in reversed(list(names.items())):
        pick = F.when(F.col(n) == F.col("_peak"), F.lit(label)).otherwise(pick)
    return r.select(*rows.columns, pick.alias(prefix + "label"), (1.0 / total).alias(prefix + "posterior"))


def token_counts(rows: DataFrame, tokens: str, label: str) -> DataFrame:
    """Occurrences of each token per class; `tokens` is an array column."""
    t = rows.select(label, F.explode(tokens).alias("token"))
    return t.groupBy("token").agg(F.sum((F.col(label) == 0).cast("long")).alias("n0"), F.sum((F.col(label) == 1).cast("long")).alias("n1"))


def token_weights(counts: DataFrame) -> tuple:
    """Laplace-smoothed log-likelihood difference per token, and the one of an unseen token.

    Totals are one aggregated row, so the weights stay a plain projection."""
    t = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("v")).first()
    d0, d1 = (t["t0"] or 0) + t["v"] + 1, (t["t1"] or 0) + t["v"] + 1
    w = counts.select("token", (F.log((F.col("n1") + 1) / F.lit(float(d1))) - F.log((F.col("n0") + 1) / F.lit(float(d0)))).alias("w"))
    return w, math.log(1 / d1) - math.log(1 / d0)


def score_tokens(rows: DataFrame, key: str, tokens: str, weights: DataFrame, unseen: float, prior_logit=0.0) -> DataFrame:
    """Sum of token weights per row and its logistic value."""
    t = rows.select(key, F.explode_outer(tokens).alias("token")).groupBy(key, "token").agg(F.count("token").alias("n"))
    s = t.join(weights, "token", "left").groupBy(key).agg(
        F.sum(F.when(F.col("token").isNull(), 0.0).otherwise(F.col("n") * F.coalesce("w", F.lit(unseen)))).alias("logit"))
    d = F.col("logit") + F.lit(float(prior_logit))
    return s.select(key, d.alias("logit"), logistic(d).alias("score"))

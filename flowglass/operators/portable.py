"""A lexical classifier as tables: term weights, composition weights and flattened tree nodes, scored without a machine-learning library.

The character score is a sparse product, taken as an equality join of a label's grams with the term table and summed per label; the
trees are walked by column expressions over a literal node array, whose size follows the number of trees and their depth, not the data."""
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.ip import let
from ..sources.wire import stage
from .lexical_model import NUMBERS, LexicalModel, prepare

NODE = "struct<left:int,right:int,feature:int,threshold:double,value:double>"


@dataclass
class Portable:
    terms: DataFrame  # token, weight, idf
    numbers: list  # (name, weight, mean, scale) in the order of NUMBERS
    intercept: float
    trees: list = field(default_factory=list)  # per tree its nodes (left, right, feature, threshold, value); left -1: leaf; feature 0: the logit, then NUMBERS
    boosted: float = 0.0  # where the trees start
    link: float = 1.0  # factor of the sum in the logistic function

    def depth(self) -> int:
        def below(nodes, i):
            left, right = nodes[i][:2]
            return 0 if left < 0 else 1 + max(below(nodes, left), below(nodes, right))

        return max((below(t, 0) for t in self.trees), default=0)


def export(m: LexicalModel, spark: SparkSession) -> Portable:
    """The tables of a fitted model; its terms are in the driver's memory already."""
    vocabulary, idf, scaler = m.terms.stages[0].vocabulary, m.vectors.stages[0], m.vectors.stages[3]
    weights = [float(x) for x in m.base.coefficients.toArray()]
    terms = spark.createDataFrame(list(zip(vocabulary, weights, (float(x) for x in idf.idf.toArray()))), "token string, weight double, idf double")
    scaled = [(n, w, float(mu), float(sd) or 1.0) for n, w, mu, sd in zip(NUMBERS, weights[len(vocabulary) :], scaler.mean, scaler.std)]
    trees = []
    for tree, share in zip(m.trees.trees, m.trees.treeWeights) if m.trees else ():
        nodes = []

        def add(node):
            at = len(nodes)
            nodes.append(None)
            if node.getClass().getSimpleName() == "LeafNode":
                nodes[at] = (-1, -1, 0, 0.0, float(share * node.prediction()))
            else:
                split = node.split()
                nodes[at] = (add(node.leftChild()), add(node.rightChild()), int(split.featureIndex()), float(split.threshold()), 0.0)
            return at

        add(tree._java_obj.rootNode())
        trees.append(nodes)
    return Portable(terms, scaled, float(m.base.intercept), trees, link=2.0)


def save(m: Portable, path: str) -> None:
    m.terms.write.parquet(f"{path}/terms")
    spark = m.terms.sparkSession
    rows = [(t, i, *n) for t, nodes in enumerate(m.trees) for i, n in enumerate(nodes)]
    spark.createDataFrame(rows, "tree int, node int, left int, right int, feature int, threshold double, value double").coalesce(1).write.parquet(f"{path}/nodes")
    spark.createDataFrame(m.numbers, "name string, weight double, mean double, scale double").coalesce(1).write.parquet(f"{path}/numbers")
    spark.createDataFrame([(m.intercept, m.boosted, m.link)], "intercept double, boosted double, link double").coalesce(1).write.parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Portable:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    nodes = read("nodes").orderBy("tree", "node").collect()
    trees = [[] for _ in range(max((n["tree"] for n in nodes), default=-1) + 1)]
    for n in nodes:
        trees[n["tree"]].append(tuple(n)[2:])
    named = {r["name"]: tuple(r) for r in read("numbers").collect()}
    if sorted(named) != sorted(NUMBERS):
        raise ValueError("the model was made for other composition numbers")
    s = read("settings").first()
    return Portable(read("terms"), [named[n] for n in NUMBERS], s["intercept"], trees, s["boosted"], s["link"])


def character_sums(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """label, dot, norm: sums over the label's known grams of weight * value and value^2, value = (1 + ln count) * idf."""
    grams = labels.select("label", F.explode("tokens").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    value = (1 + F.log(F.col("n").cast("double"))) * F.col("idf")
    known = grams.join(terms, "token").select("label", (F.col("weight") * value).alias("p"), (value * value).alias("q"))
    return known.groupBy("label").agg(F.sum("p").alias("dot"), F.sum("q").alias("norm"))


def tree_sum(trees: list, depth: int, inputs) -> F.Column:
    """Sum of the leaf values that an array of inputs reaches."""
    names = ("left", "right", "feature", "threshold", "value")
    literal = F.from_json(F.lit(json.dumps([[dict(zip(names, n)) for n in t] for t in trees])), f"array<array<{NODE}>>")

    def leaf(nodes):
        def step(i, _):
            n = F.get(nodes, i)
            return F.when(n["left"] < 0, i).when(F.get(inputs, n["feature"]) <= n["threshold"], n["left"]).otherwise(n["right"])

        at = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step)
        return let(at, lambda i: F.get(nodes, i)["value"])

    return F.aggregate(literal, F.lit(0.0), lambda total, nodes: total + leaf(nodes))


def label_scores(rows: DataFrame, m: Portable, label="label") -> DataFrame:
    """label, logit, score of every different label; empty and null labels are not scored."""
    labels = prepare(rows.select(F.col(label).alias("label")).filter("label <> ''").distinct())
    r = labels.select("label", *NUMBERS).join(character_sums(labels, m.terms), "label", "left")
    logit = F.lit(m.intercept) + F.when(F.col("norm") > 0, F.col("dot") / F.sqrt("norm")).otherwise(0.0)
    for name, weight, mean, scale in m.numbers:
        logit = logit + F.lit(weight) * (F.col(name) - F.lit(mean)) / F.lit(scale)
    r = stage(r, {"_x": F.array(logit, *NUMBERS)})
    total = F.lit(m.boosted) + (tree_sum(m.trees, m.depth(), F.col("_x")) if m.trees else F.get("_x", F.lit(0)))
    return r.select("label", F.get("_x", F.lit(0)).alias("logit"), numbers.logistic(total * m.link).alias("score"))


def score(rows: DataFrame, m: Portable, label="label") -> DataFrame:
    """The rows with `logit` and `score`; each different label is scored once."""
    return rows.join(label_scores(rows, m, label).withColumnRenamed("label", label), label, "left")


def fit_counts(rows: DataFrame) -> Portable:
    """A model in closed form from labelled rows (label, y): log ratios of gram shares, class distances of the numbers, and two-level trees at their means.

    No solver is involved, so any engine that counts alike gets the same model."""
    r = prepare(rows.select("label", "y"))
    per = r.select("y", "tokens", F.posexplode("tokens").alias("pos", "token")).withColumn("first", F.array_position("tokens", F.col("token")) == F.col("pos") + 1)
    c = per.groupBy("token").agg(*[F.sum((F.col("y") == k).cast("long")).alias(f"c{k}") for k in (0, 1)], F.count_if("first").alias("df"))
    totals = c.agg(F.count(F.lit(1)).alias("v"), F.sum("c0").alias("t0"), F.sum("c1").alias("t1")).first()
    stats = r.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"), *[x for f in NUMBERS for x in (
        F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.avg(F.when(F.col("y") == 1, F.col(f))).alias(f"a_{f}"), F.avg(F.when(F.col("y") == 0, F.col(f))).alias(f"b_{f}"))]).first()
    share = lambda k: F.log((F.col(f"c{k}") + 1.0) / float(totals[f"t{k}"] + totals["v"]))
    terms = c.select("token", (share(1) - share(0)).alias("weight"), (F.log((1.0 + stats["n"]) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    own = []
    for f in NUMBERS:
        scale = stats[f"s_{f}"] if stats[f"s_{f}"] > 1e-9 else 1.0
        own.append((f, (stats[f"a_{f}"] - stats[f"b_{f}"]) / scale, stats[f"m_{f}"], scale))
    cut = lambda mean: round(mean, 6) + 3e-7  # not on a value that labels have
    trees = []
    for j, (_, weight, mean, _) in enumerate(own):
        k = (j + 1) % len(own)
        leaves = [(-1, -1, 0, 0.0, 0.5 * weight * x) for x in (-1.0, -0.5, 0.5, 1.0)]
        trees.append([(1, 2, j + 1, cut(mean), 0.0), (3, 4, k + 1, cut(own[k][2]), 0.0), (5, 6, 0, 0.0, 0.0), *leaves])
    return Portable(terms, own, math.log(stats["n1"] / (stats["n"] - stats["n1"])), trees, boosted=0.1)

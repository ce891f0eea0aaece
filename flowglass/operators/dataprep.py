"""Preparing labelled data sets: slices, splits, linked components, eligibility."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hash_bucket
from ..session import cut


def time_slices(rows: DataFrame, parts: int) -> DataFrame:
    """Adds `part`: equal slices of the observed time range, the last bound inclusive."""
    ends = rows.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    width = (hi - lo) / parts or 1.0
    return rows.withColumn("part", F.least(F.lit(parts - 1), F.floor((F.col("ts_us") - lo) / F.lit(float(width))).cast("int")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (a, b): every node with the smallest node of its component.

    Alternating large-star / small-star steps: each round links nodes to ever
    smaller neighbours and needs only groupings, so it converges in a logarithmic
    number of rounds and never lists all pairs of a component.  It ends when a round
    changes nothing.  Each round is written to the checkpoint folder."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = cut(e)
    seen = None
    while True:
        # Large star: connect strictly larger neighbours of each node to its smallest neighbour (itself included).
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: connect smaller neighbours and the node itself to the smallest of them.
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def linked_split(members: DataFrame, links: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Component-disjoint split: components touching `quarantine` nodes are set aside, the rest go 60/40 by hash.

    `members`: node, label; `links`: a, b over members and shared identities; `quarantine`: node."""
    roots = components(links.unionByName(members.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    bad = roots.join(quarantine, "node", "left_semi").select("component").distinct().withColumn("bad", F.lit(True))
    labelled = members.join(roots, "node").groupBy("component").agg(F.max((F.col("label") != "UNLABELLED").cast("int")).alias("labelled"))
    part = labelled.join(bad, "component", "left").select("component", F.when(F.col("bad"), "quarantine").when(F.col("labelled") == 0, "unlabelled")
                                                          .when(hash_bucket("component", 10) < 6, "train").otherwise("validation").alias("part"))
    return members.join(roots, "node").join(part, "component")


def eligibility(rows: DataFrame, excluded: DataFrame, minimum: int) -> DataFrame:
    """Per group: records, wrong labels, unsupported, unique labels, overlaps, collisions, eligible and their digest.

    `rows`: grp, y, label ('' when unsupported); `excluded`: h = sha256 of development labels.
    The digest hashes each eligible label and combines the sorted hashes per prefix first,
    so that no group is gathered whole."""
    good = rows.filter("y = 1 and label <> ''").select("grp", "label").distinct()
    counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("y") != 1).alias("wrong_label"),
                                     F.count_if((F.col("y") == 1) & (F.col("label") == "")).alias("unsupported"))
    shared = good.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    g = good.join(shared, "label").withColumn("h", F.sha2("label", 256)).join(excluded.select("h", F.lit(True).alias("dev")).distinct(), "h", "left")
    ok = F.col("dev").isNull() & (F.col("k") == 1)
    part = g.withColumn("ok", ok).groupBy("grp", F.substring("h", 1, 3).alias("pre")).agg(
        F.count(F.lit(1)).alias("u"), F.count("dev").alias("o"), F.count_if(F.col("k") > 1).alias("x"), F.count_if("ok").alias("e"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("h")))), ""), 256).alias("d"))
    per = part.groupBy("grp").agg(F.sum("u").alias("unique_labels"), F.sum("o").alias("development_overlap"), F.sum("x").alias("collisions"), F.sum("e").alias("eligible"),
                                  F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
    return counts.join(per, "grp", "left").withColumn("minimum_passed", F.coalesce(F.col("eligible") >= minimum, F.lit(False)))

"""Labels that read as words of a word table."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORD = 2


def readable_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """label, readable: every hyphen-separated part is made of words of the table without a rest, and there are two or more words.

    `labels` (label) and `words` (word) may have repetitions and any case.  Segmentation by dynamic programming: all substrings of a label meet the
    word table in one equality join, so the table may be a whole dictionary; the matches of a part, at most the square of its length,
    are then followed from its start: a position is reached if a word ends there that starts at a reached one."""
    known = words.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    low = labels.select("label", F.lower(F.col("label")).alias("_c")).filter("label is not null").distinct()
    parts = low.select("label", F.posexplode(F.filter(F.split("_c", "-"), lambda p: p != "")).alias("part", "text"))
    parts = parts.withColumns({"size": F.length("text"), "alpha": F.col("text").rlike("^\\p{L}+$")})
    spans = parts.filter("alpha").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).filter(F.col("i") + MIN_WORD <= F.col("size"))
    spans = spans.withColumn("n", F.explode(F.sequence(F.lit(MIN_WORD), F.col("size") - F.col("i"))))
    spans = spans.select("label", "part", "i", "n", F.substring("text", F.col("i") + 1, F.col("n")).alias("word"))
    found = spans.join(known, "word").groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("edges"))
    grow = lambda reached, e: F.when(F.array_contains(reached, e["i"]), F.array_union(reached, F.array(e["i"] + e["n"]))).otherwise(reached)
    walked = found.select("label", "part", F.aggregate("edges", F.array(F.lit(0)), grow).alias("reached"))
    per = parts.select("label", "part", "size", "alpha").join(walked, ["label", "part"], "left")
    whole = F.coalesce(F.col("alpha") & F.array_contains("reached", F.col("size")), F.lit(False))
    per = per.groupBy("label").agg(F.min(whole).alias("whole"), F.count(F.lit(1)).alias("parts"))
    single = known.withColumn("_word", F.lit(True))
    out = low.join(per, "label", "left").join(single, low["_c"] == single["word"], "left")
    ok = F.col("whole") & ((F.col("parts") >= 2) | F.col("_word").isNull())
    return out.select("label", F.coalesce(ok, F.lit(False)).alias("readable"))

"""JSON-line event source."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..schema import EVENT


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, the start of its split in the file and a number that grows by one per line inside a split."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return spark.read.text(path).select("value", place.alias("_at")).select("value", "_at.*")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted), text of every line that is neither blank nor an event.

    A line's number is its place in its split plus the lines of the splits before it; only counts per split are grouped, lines stay
    where they are read.  Both passes list the files alike, so ids agree."""
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    per = _lines(spark, path).groupBy("file", "start").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    per = per.select("file", "start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    schema = T.StructType([*EVENT.fields, T.StructField("_corrupt", T.StringType())])
    broken = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()
    bad = _lines(spark, path).filter((F.trim("value") != "") & broken)
    return bad.join(per, ["file", "start"]).select("file", (F.col("id") + F.col("_shift")).alias("line"), F.col("value").alias("text"))


def read_event_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): rejects name the file and the broken text; blank lines are skipped."""
    schema = T.StructType([*EVENT.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter("e._corrupt is null").select("e.*").drop("_corrupt"), parsed.filter("e._corrupt is not null").select("file", F.col("e._corrupt").alias("text"))

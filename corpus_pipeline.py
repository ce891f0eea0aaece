"""A corpus pipeline of five stages; each takes all documents that the one before kept, written as Parquet and read again.

Null doc_ids, null and empty texts, repeated rows and further columns go through as the operators in flowglass/llm define it.
The first four stages return the columns of `documents`; packing returns pieces with their sequence and place."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowglass.llm import decontaminate, minhash, packing, quality, suffixes
from flowglass.llm.store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers do not reject."""
    return quality.select_good(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return minhash.dedup(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that occur elsewhere; n_chars follows the text."""
    out = suffixes.dedup(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("suffix_dedup", without_repeats), ("decontamination", not_in_benchmark), ("packing", packed)]
#: Trained models, signatures and tokens cannot be expressed in SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

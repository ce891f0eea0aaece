"""Intermediate tables in the folder that driver and executors share."""
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder of spark.checkpoint.dir (see `session.checkpoint_dir`)."""
    root = checkpoint_dir(spark) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table: lineage ends here, columns can be pruned, and a lost executor costs nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            if path.getName().startswith("llm-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

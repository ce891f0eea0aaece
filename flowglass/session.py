"""Session settings the jobs rely on."""
from pyspark.sql import SparkSession


def build_session(app="flowglass", master=None, shuffle_partitions=None, extra=None):
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark):
    """The shared folder named by the cluster; a private one only in local mode, where all tasks share this machine."""
    import tempfile

    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="flowglass-ckpt-"))
    return configured


def cut(df):
    """Write `df` to the reliable checkpoint folder and read it back.

    Used where a result feeds several later passes (iterations, two-pass folds),
    so that neither the work nor the lineage is repeated."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark, name):
    """A new path that driver and executors share, below the checkpoint folder."""
    import uuid

    root = checkpoint_dir(spark) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df):
    """Like `cut`, as compressed columns in the shared folder: for tables of many rows of which later passes read some columns."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df, key):
    """Like `written`, in buckets by the hash of `key`: a later join on `key` alone moves none of these rows.

    `df` should come dealt by `key`, so that a task writes few buckets.  The table's name is forgotten at once; its files are read by their path."""
    import uuid

    spark, name = df.sparkSession, f"rows_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", shared_folder(spark, "buckets")).saveAsTable(name, format="parquet")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")

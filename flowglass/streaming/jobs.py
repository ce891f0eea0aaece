"""Structured Streaming: late events, sliding rates, sessions, suppression, alert table."""
import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import running_sums
from ..session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger=None, glob=None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def with_time(events: DataFrame, lateness="0 seconds") -> DataFrame:
    """Event time as a timestamp with a zero-lateness watermark."""
    return events.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)


def sliding_rates(events: DataFrame, keys=("dst_ip",)) -> DataFrame:
    """Packet and byte rates over eleven one-second buckets, per key, one row per second."""
    w = F.window("ts", "11 seconds", "1 second")
    g = events.groupBy(w, *keys).agg(F.sum("packets").alias("p"), F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("events"))
    sec = (F.unix_micros(F.col("window.end")) / 1_000_000).cast("long") - 1
    return g.select(sec.alias("sec"), *keys, "events", (F.col("p") / 10).alias("packet_rate"), (F.col("b") / 10).alias("byte_rate"))


def closed_sessions(events: DataFrame, keys, gap="60 seconds") -> DataFrame:
    """Sessions that ended: events, packets, bytes and time range.  The state of a session is its sums; silence of `gap` closes it."""
    g = events.groupBy(F.session_window("ts", gap), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return g.drop("session_window")


class Suppressor(StatefulProcessor):
    """Keeps the first hit of a key and drops repeats until its expiry; late hits are dropped and their number is given out.

    Spark itself drops rows behind the watermark of the batch before and reports their number in its progress (`dropped`).

    The keys of a bucket share a call and a state, the expiries that the watermark has not passed; an event-time timer clears them once it has passed all."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiries = handle.getValueState("expiries", T.StructType([T.StructField("key", T.ArrayType(T.StringType())), T.StructField("expiry", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")
        state = self.expiries.get()
        expiries = dict(zip(*state)) if state is not None else {}
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        kept, late = [], {}
        for k, t, seq in zip(batch["key"].tolist(), batch["ts_us"].tolist(), batch["seq"].tolist()):
            if t < mark:
                late[k] = late.get(k, 0) + 1
            elif (expiry := expiries.get(k)) is None or t >= expiry:
                expiries[k] = t + self.gap_us
                kept.append((k, t, seq, 0))
        expiries = {k: e for k, e in expiries.items() if e > mark}
        if expiries:
            self.expiries.update((list(expiries), list(expiries.values())))
            self.handle.registerTimer(max(expiries.values()) // 1000 + 1)
        elif state is not None:
            self.expiries.clear()
        out = kept + [(k, None, None, n) for k, n in late.items()]
        yield pd.DataFrame(out, columns=["key", "ts_us", "seq", "late"]).astype({"ts_us": "Int64", "seq": "Int64", "late": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.expiries.get()
        if state is not None and max(state[1]) <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.expiries.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="str"), "ts_us": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "late": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def suppress(hits: DataFrame, key: str, gap_us: int, with_late=False, buckets=1024) -> DataFrame:
    """Streaming form of the repeat suppression: (key, ts_us, seq) of the hits that pass. Needs `ts` with a watermark and the RocksDB state store.

    `with_late`: also one row per key and micro-batch with the number of `late` hits that reached the operator and were dropped there.
    A call into Python costs more than the few hits of a key, so keys are dealt over `buckets` groups."""
    out = hits.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), "ts", "ts_us", "seq").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Suppressor(gap_us), outputStructType="key string, ts_us long, seq long, late long", outputMode="Append", timeMode="EventTime")
    return out if with_late else out.filter("seq is not null").drop("late")


def _note(spark: SparkSession, path: str, batch_id: int):
    """What an earlier batch left for the next one; None before the first."""
    if batch_id < 0:
        return None
    found = read_alerts(spark, f"{path}/_notes/{batch_id}")
    return None if found is None else found.first()


def write_alerts(path: str):
    """`foreachBatch` sink: one folder per batch, overwritten on retry, with sequence numbers that keep growing.

    A failed batch leaves no rows behind and a repeated one writes the same rows again.  Each batch leaves a note of one row with its last
    number, so a batch reads one row of the past however long the history is."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _note(spark, path, batch_id - 1)
        start = before["last"] if before else 0
        batch = batch.persist()  # the sums read it twice, and a batch made anew runs its stateful operator again
        rows = running_sums(batch, [], {"sequence": F.lit(1)}, block_us=10_000_000).withColumn("sequence", F.col("sequence") + F.lit(start))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        last = spark.read.parquet(f"{path}/batch_id={batch_id}").agg(F.coalesce(F.max("sequence"), F.lit(start)).cast("long").alias("last"))
        last.write.mode("overwrite").parquet(f"{path}/_notes/{batch_id}")
        batch.unpersist()

    return sink


def count_arrivals(path: str):
    """`foreachBatch` sink: per micro-batch the rows processed, those late (before the newest event time of earlier batches) and the newest time so far."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _note(spark, path, batch_id - 1)
        seen = F.lit(before["max_ts_us"] if before else None).cast("long")
        row = batch.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("ts_us") < seen).alias("late"), F.greatest(F.max("ts_us"), seen).alias("max_ts_us"))
        row.write.mode("overwrite").parquet(f"{path}/_notes/{batch_id}")
        spark.read.parquet(f"{path}/_notes/{batch_id}").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink


def watched(sink, path: str):
    """Wraps an alert sink by a reader of its own: after every micro-batch it reads on from its cursor, as a client would, and notes what it found."""

    def both(batch: DataFrame, batch_id: int) -> None:
        sink(path)(batch, batch_id)
        spark = batch.sparkSession
        before = _note(spark, f"{path}/_reader", batch_id - 1)
        cursor, total = (before["cursor"], before["visible"]) if before else (0, 0)
        new = spark.read.option("basePath", path).parquet(f"{path}/batch_id={batch_id}").filter(F.col("sequence") > cursor)
        seen = new.agg(F.coalesce(F.max("sequence"), F.lit(cursor)).cast("long").alias("cursor"), (F.count(F.lit(1)) + total).alias("visible"))
        seen.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/_reader/_notes/{batch_id}")

    return both


def read_alerts(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def read_since(spark: SparkSession, path: str, cursor: int, limit: int) -> DataFrame:
    """The next alerts after a reader's own cursor."""
    return spark.read.parquet(path).filter(F.col("sequence") > cursor).orderBy("sequence").limit(limit)


def dropped(progress: list) -> int:
    """Rows that stateful operators dropped behind the watermark, from the progress of a run."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def run_available(stream: DataFrame, sink=None, path=None, mode="append", state=None, progress: list | None = None) -> str:
    """Runs a stream over everything available and stops; returns the output folder.  With the `state` folder of an earlier run it goes on from there.

    `progress` takes one report per micro-batch (the newest that spark.sql.streaming.numRecentProgressUpdates keeps)."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = path or shared_path(spark, "stream-out")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", state or shared_path(spark, "stream-state")).trigger(availableNow=True)
    q = w.foreachBatch(sink(path)).start() if sink else w.format("parquet").option("path", path).start()
    q.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) if hasattr(p, "json") and not isinstance(p, dict) else p for p in q.recentProgress]
    return path


FAR_US = 4_000_000_000_000_000  # the year 2096: behind every window of earlier events


def run_to_end(events: DataFrame, build, sink=None) -> str:
    """Runs build(events with watermark) over everything available and then closes what is still open; returns the output folder.

    The end of input is said by one marker row far in the future.  It comes through a source of its own, in a second run from the same
    state, so it is behind every event; its watermark closes all windows and sessions.  Its other columns are null and its own window stays open."""
    spark = events.sparkSession
    marks, state = shared_path(spark, "stream-marks"), shared_path(spark, "stream-state")
    spark.createDataFrame([], "ts_us long").write.parquet(marks)
    both = events.unionByName(spark.readStream.schema("ts_us long").parquet(marks), allowMissingColumns=True)
    path = run_available(build(with_time(both)), sink, state=state)
    spark.createDataFrame([(FAR_US,)], "ts_us long").write.mode("append").parquet(marks)
    return run_available(build(with_time(both)), sink, path, state=state)


def in_batches(rows: DataFrame, batch: str, batches: int, files=4) -> DataFrame:
    """A stream of the rows in which micro-batch k holds those with `batch` = k: their files are written one batch after the other."""
    spark = rows.sparkSession
    path = shared_path(spark, "stream-in")
    for k in range(batches):
        rows.filter(F.col(batch) == k).repartition(files).write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
    return event_stream(spark, path, rows.schema, files_per_trigger=files)


def arrival_metrics(events: DataFrame) -> DataFrame:
    """Rows and newest event time per micro-batch, reported with the query progress; Spark adds the rows its watermark dropped."""
    return events.observe("arrivals", F.count(F.lit(1)).alias("rows"), F.max("ts_us").alias("max_ts_us"))

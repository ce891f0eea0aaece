"""Capture files to frames, and messages that span segments."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import most_before, neighbours, running_sums
from ..session import cut
from . import capture_files, wire
from .capture_files import FRAMES

IDLE_US, MAX_MESSAGE = 10_000_000, 65_537  # the longest message that the formats can declare (a name message with its length)


def read_captures(spark: SparkSession, path: str, split=capture_files.SPLIT) -> DataFrame:
    """Frames of every capture file below `path`, whatever its size, in tasks of about `split` bytes."""
    return capture_files.read_ranges(spark, path, split)


def frames_of(files: DataFrame) -> DataFrame:
    """(path, content) to frames in file order; a damaged file ends with one row that names the problem.

    For files that stand in a column (2 GB at most); `read_captures` reads files where they lie."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "idx", "ts_us", "frame", "original", "problem"]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = []
                for idx, row in enumerate(capture_files.walk(capture_files.View.of(bytes(data)))):
                    rows.append((path, idx, *row))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names).astype({"ts_us": "Int64", "original": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"ts_us": "Int64", "original": "Int64"})

    return files.select("path", "content").mapInPandas(parse, FRAMES)


def declared_size(payload: str, dns) -> "F.Column":
    """Bytes of the message whose first bytes stand in `payload`, by its own length field; 0 where there is none."""
    told = F.when(dns, wire.u(payload, 0, 2) + 2).when((wire.u(payload, 0, 1) == 0x16) & (wire.u(payload, 1, 1) == 3), wire.u(payload, 3, 2) + 5)
    return F.coalesce(told, F.lit(0)).cast("long")


def assemble(segments: DataFrame, limit=MAX_MESSAGE) -> DataFrame:
    """Adds `message` and `oversized` to TCP segments: the message a segment completes; null while one is incomplete.

    Sequence numbers become positions in the stream of a direction.  A segment below the highest position seen repeats what was
    there; the others are cut into runs where nothing can be pending: at a hole in the positions, after ten idle seconds, and around FIN or
    RST.  Runs are independent of each other, so a long connection is spread over as many tasks as it has runs.  Inside a run messages
    follow from declared sizes alone; their bytes are put together afterwards, a message at a time.  A message of more than `limit` bytes
    is passed on segment by segment, and `oversized` marks the segment that declares it."""
    keys = ["src_ip", "dst_ip", "src_port", "dst_port"]
    s = segments.filter(F.length("payload") > 0).select(
        "seq", "ts_us", *keys, F.col("tcp_seq").cast("long").alias("tcp_seq"), (F.col("tcp_flags").bitwiseAND(F.lit(5)) != 0).alias("ends"), F.length("payload").cast("long").alias("size"),
        declared_size("payload", (F.col("src_port") == 53) | (F.col("dst_port") == 53)).alias("told"))
    half = 1 << 31
    moved = F.pmod(F.col("tcp_seq") - F.col("_p.tcp_seq") + half, F.lit(1 << 32)) - half
    s = neighbours(s, keys, "_p", "_n", carry=["tcp_seq"]).withColumn("moved", F.coalesce(moved, F.lit(0)))
    s = running_sums(s, keys, {"at": F.col("moved")}).drop("_p", "_n", "moved", "tcp_seq")
    s = cut(most_before(cut(s), keys, F.col("at") + F.col("size"), "high"))
    late = F.coalesce(F.col("at") < F.col("high"), F.lit(False))
    fresh = neighbours(s.filter(~late), keys, "_p", "_n", carry=["ends"])
    apart = F.col("_p").isNull() | (F.col("at") > F.col("high")) | (F.col("ts_us") - F.col("_p.ts_us") > IDLE_US) | F.col("ends") | F.col("_p.ends")
    fresh = running_sums(cut(fresh.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("long")).drop("_p", "_n")), keys, {"run": F.col("apart")})
    spans = F.when(~F.col("ends") & (F.col("told") > F.col("size")) & (F.col("told") <= limit), F.col("told")).otherwise(0)
    fresh = fresh.select("seq", "ts_us", *keys, "run", "size", spans.alias("spans"))
    framed = fresh.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "ts_us", "seq")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first segment of each segment's message, the bytes that message still lacks after it, and its whole size."""
        here, head, lacks, whole = None, None, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if here != row[1:6]:
                    here, lacks = row[1:6], 0
                if lacks <= 0:
                    head, lacks, whole = row.seq, row.spans or row.size, row.spans or row.size
                lacks -= row.size
                out.append((row.seq, head, lacks, whole))
            yield pd.DataFrame(out, columns=["seq", "head", "lacks", "whole"])

    placed = cut(framed.select("seq", *keys, "run", "size", "spans").mapInPandas(heads, "seq long, head long, lacks long, whole long"))
    # A repeated segment stands for itself unless a message is pending around it.
    pending = running_sums(s.join(placed, "seq", "left"), keys, {}, lasts=["lacks"])
    alone = pending.filter((late & (F.coalesce("last_lacks", F.lit(0)) <= 0)) | ((F.col("head") == F.col("seq")) & (F.col("lacks") <= 0))).select("seq", (F.col("told") > limit).alias("_over"))
    parts = placed.filter((F.col("head") != F.col("seq")) | (F.col("lacks") > 0)).join(segments.select("seq", "ts_us", "payload"), "seq")
    whole = parts.groupBy("head").agg(F.max("whole").alias("whole"), F.min("lacks").alias("lacks"), F.max_by("seq", F.struct("ts_us", "seq")).alias("seq"),
                                      F.array_sort(F.collect_list(F.struct("ts_us", "seq", "payload"))).alias("p"))  # at most `limit` bytes and one segment
    joined = F.aggregate("p", F.lit(b""), lambda x, y: F.concat(x, y["payload"]))
    whole = whole.filter("lacks <= 0").withColumn("m", joined).selectExpr("seq", "substring(m, 1, cast(whole as int)) as _whole")
    out = segments.join(alone.withColumn("_alone", F.lit(True)), "seq", "left").join(whole, "seq", "left")
    return out.withColumn("message", F.when(F.col("_alone"), F.col("payload")).otherwise(F.col("_whole"))).withColumn("oversized", F.coalesce("_over", F.lit(False))).drop("_alone", "_whole", "_over")

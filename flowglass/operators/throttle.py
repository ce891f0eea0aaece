"""Greedy spacing of rows: keep one, ignore everything until `gap` has passed, repeat.

The same fold drives alert suppression and contact coalescing.  Rows are sorted
inside partitions and streamed through a small Python loop that carries only the
current key's expiry.  A key with more than `hot_rows` rows is cut into time
chunks: each chunk is first reduced to a map "expiry on entry -> expiry on exit"
(few steps, because chains starting at different points soon meet), the maps of a
key are walked in order, and every chunk is then replayed from its known entry.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import heat

HOT_ROWS = 1_000_000
NEVER = -(2 ** 62)


def group_starts(pdf: pd.DataFrame, keys, previous):
    """True where a row opens a new key group; `previous` is the last key of the batch before."""
    new = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        col = pdf[k].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    new[0] = previous != tuple(pdf[k].iloc[0] for k in keys)
    return new


def exit_steps(times, start, gap):
    """Steps (last entry time, exit expiry): on entry with expiry e, the first step whose entry time >= e applies."""
    nxt = np.searchsorted(times, times + gap, side="left")
    n = len(times)
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:
        hop = last[last]
        if np.array_equal(hop, last):
            break
        last = hop
    lead = min(n, int(np.searchsorted(times, start + gap, side="left")) + 1)
    entry, out = times[:lead], times[last[:lead]] + gap
    keep = np.append(out[1:] != out[:-1], True)
    return entry[keep], out[keep]


def _chunk_entries(hot: DataFrame, keys, chunk_gaps):
    """Expiry in force at the start of every chunk of the hot keys; a chunk lasts `chunk_gaps` gaps."""
    key_fields = [hot.schema[k] for k in keys]

    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["ts_us"].to_numpy(np.int64))
        gap = int(pdf["_gap"].iloc[0])
        entry, out = exit_steps(t, int(pdf["_chunk"].iloc[0]) * gap * chunk_gaps, gap)
        head = pdf.iloc[[0]][[*keys, "_chunk"]].copy()
        head["entry"], head["out"] = [entry.tolist()], [out.tolist()]
        return head

    def walk_maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        expiry, seen = NEVER, []
        for entry, out in zip(pdf["entry"], pdf["out"]):
            seen.append(expiry)
            i = int(np.searchsorted(entry, expiry, side="left"))
            if i < len(entry):
                expiry = int(out[i])
        res = pdf[[*keys, "_chunk"]].copy()
        res["_expiry"] = seen
        return res

    chunk_field, longs = T.StructField("_chunk", T.LongType()), T.ArrayType(T.LongType())
    maps = (hot.select(*keys, "_chunk", "_gap", "ts_us").distinct().groupBy(*keys, "_chunk")
            .applyInPandas(reduce_chunk, T.StructType([*key_fields, chunk_field, T.StructField("entry", longs), T.StructField("out", longs)])))
    return maps.groupBy(*keys).applyInPandas(walk_maps, T.StructType([*key_fields, chunk_field, T.StructField("_expiry", T.LongType())]))


def throttle(rows: DataFrame, keys, gap_us, hot_rows: int = HOT_ROWS, chunk_gaps: int = 20, base=None) -> DataFrame:
    """Adds `kept` (row passes) and `anchor_us` (time of the row that currently holds the key).

    `rows` needs `keys`, `ts_us`, `seq`.  A key re-opens exactly at kept time + gap;
    `gap_us` is a number or the name of a column that is constant per key.
    `base` is a cheap input with the same keys for the hot-key census."""
    keys = list(keys)
    names = rows.columns
    gap = F.col(gap_us) if isinstance(gap_us, str) else F.lit(gap_us)
    census = (rows if base is None else base).groupBy(*keys).count()
    hot = census.filter(F.col("count") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    chunk = F.floor(F.col("ts_us") / (F.col("_gap") * chunk_gaps)).cast("long")
    gapped = rows.withColumn("_gap", gap.cast("long"))
    if not heat(rows if base is None else base, keys, hot_rows):
        ready = gapped.withColumns({"_chunk": F.lit(0).cast("long"), "_expiry": F.lit(NEVER)}).repartition(*keys).sortWithinPartitions(*keys, "ts_us", "seq")
        return _replayed(ready, rows.schema, keys)
    tagged = gapped.join(hot, keys, "left").withColumn("_chunk", F.when(F.col("_hot"), chunk).otherwise(F.lit(0)).cast("long"))
    slim = gapped.select(*keys, "_gap", "ts_us").join(hot, keys).withColumn("_chunk", chunk)
    entries = _chunk_entries(slim, keys, chunk_gaps)
    ready = (tagged.join(entries, [*keys, "_chunk"], "left")
             .select(*names, "_gap", "_chunk", F.coalesce("_expiry", F.lit(NEVER)).alias("_expiry"))
             .repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "ts_us", "seq"))
    return _replayed(ready, rows.schema, keys)


def _replayed(ready: DataFrame, schema: T.StructType, keys) -> DataFrame:
    """Adds `kept` and `anchor_us` to the rows of `schema`, which come sorted by key, chunk and time."""
    names = schema.names

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        previous, expiry = None, NEVER
        for pdf in batches:
            if pdf.empty:
                continue
            fresh = group_starts(pdf, [*keys, "_chunk"], previous)
            previous = tuple(pdf[k].iloc[-1] for k in [*keys, "_chunk"])
            kept, anchor = [], []
            for new, t, entry, gap in zip(fresh.tolist(), pdf["ts_us"].tolist(), pdf["_expiry"].tolist(), pdf["_gap"].tolist()):
                if new:
                    expiry = entry
                hit = t >= expiry
                if hit:
                    expiry = t + gap
                kept.append(hit)
                anchor.append(expiry - gap)
            out = pdf[names].copy()
            out["kept"], out["anchor_us"] = kept, anchor
            yield out

    schema = T.StructType([*schema.fields, T.StructField("kept", T.BooleanType()), T.StructField("anchor_us", T.LongType())])
    return ready.mapInPandas(replay, schema)

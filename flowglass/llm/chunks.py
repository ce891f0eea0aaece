"""Substring dedup by content-defined chunks: a gear rolling hash cuts, chunks with equal digests are one.

A byte ends a chunk when the gear hash of the 32 bytes up to it falls below a bound, so cuts depend on content alone and meet
again soon after an insertion.  Chunks have at least `MIN` bytes (but for the last of a text), at most `MAX`, about `MEAN` above
the minimum, and never split a character.  Digests have 128 bits.  Of equal chunks the first by (doc_id, position) stays and the
others go, if they belong to a run of repeated chunks of at least `RUN` bytes; shorter coincidences are left alone.

Chunks are counted by digest with partial sums, so a chunk that a third of all documents share is one row per task; the counts
are written before the join back, so both sides are dealt anew and Spark can split a hot digest.  Null and empty texts have no chunks.  Rows of equal doc_id and text are one document and
lose nothing to each other; a null doc_id comes first.  Empty tables give no rows.  `dedup` keeps all other columns as they are."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import text
from .store import written

MEAN, MIN, MAX, RUN = 32, 16, 512, 100
SPAN = "array<struct<start:bigint,end:bigint>>"
GEAR = (text.mix(np.arange(1, 257, dtype=np.uint64)) >> text.U(32)).astype(np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[buf[i]] modulo 2**32: what is older than 32 bytes has been shifted out."""
    h = GEAR[buf]
    for s in (1, 2, 4, 8, 16):
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    return h


def cut(buf: np.ndarray, off: np.ndarray, mean=MEAN, low=MIN, high=MAX) -> tuple[np.ndarray, np.ndarray]:
    """(row, end) of every chunk of a slice, in order."""
    inside = np.concatenate([(buf[1:] & 0xC0) == 0x80, [False]]) if len(buf) else np.zeros(0, bool)
    ends = np.flatnonzero((gear_hashes(buf) < (1 << 32) // mean) & ~inside) + 1
    row = np.searchsorted(off, ends - 1, "right") - 1
    ok = ends - off[row] >= 32
    ends, first = ends[ok], np.searchsorted(row[ok], np.arange(len(off)))
    ends, out, rows = ends.tolist(), [], []
    bounds, edge = off.tolist(), first.tolist()

    def forced(last, to):
        while to - last > high:
            last += high
            while inside[last - 1]:
                last -= 1
            out.append(last)
        return last

    for r in range(len(bounds) - 1):
        before, last = len(out), bounds[r]
        for c in ends[edge[r] : edge[r + 1]]:
            if c - last >= low:
                last = forced(last, c)
                if c - last >= low:
                    out.append(c)
                    last = c
        last = forced(last, bounds[r + 1])
        if bounds[r + 1] > last:
            out.append(bounds[r + 1])
        rows.append(len(out) - before)
    return np.repeat(np.arange(len(rows)), rows), np.array(out, np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")


def chunks(docs: DataFrame, mean=MEAN, low=MIN, high=MAX) -> DataFrame:
    """One row per chunk: doc_id, _text (hash of the text), start, length, and the digest as d1 and d2."""

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(2)):
                row, end = cut(buf, off, mean, low, high)
                if not len(row):
                    continue
                start = np.concatenate([[0], end[:-1]])
                codes = buf.astype(np.uint16) + 1
                d = [text.signed(text.range_hash(text.prefix_hash(codes, base), start, end, base)) for base in (text.BASE, text.BASE2)]
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array((start - off[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(d[0]), pa.array(d[1])],
                                                 ["doc_id", "_text", "start", "length", "d1", "d2"])

    return _keyed(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _text long, start int, length int, d1 long, d2 long")


def repeated(docs: DataFrame, run_bytes=RUN, **cuts) -> DataFrame:
    """Per document that has any: `repeated` (spans of chunks that occur elsewhere too) and `removed` (those of them that go)."""
    all_ = chunks(docs, **cuts)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_text", "start")
    twice = written(all_.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "chunks-twice")
    found = all_.join(twice, ["d1", "d2"]).select("doc_id", "_text", F.struct("start", "length", (place == F.col("first")).alias("first")).alias("c"))
    per = found.groupBy("doc_id", "_text").agg(F.collect_set("c").alias("c"))  # no more than the chunks of one text

    def spans(batches):
        for b in batches:
            counts = np.diff(np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())]))
            flat = b.column(2).flatten()
            start, length, first = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((start, doc))
            start, end, first = start[order].astype(np.int64), (start + length)[order].astype(np.int64), first[order]
            joined = np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == end[:-1])])
            run = np.cumsum(~joined) - 1
            size = np.bincount(run, end - start)
            far = size[run] >= run_bytes
            cols = [b.column(0), b.column(1)]
            for want in (far, far & ~first):
                at = np.flatnonzero(want)
                head = np.ones(len(at), bool)
                head[1:] = (doc[at[1:]] != doc[at[:-1]]) | (start[at[1:]] != end[at[:-1]])
                tail = np.concatenate([head[1:], [True]])[: len(at)]
                cols.append(_span_lists(start[at[head]], end[at[tail]], np.bincount(doc[at[head]], minlength=len(counts))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_text", "repeated", "removed"])

    return per.mapInArrow(spans, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _text long, repeated {SPAN}, removed {SPAN}")


def _span_lists(start, end, counts) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))


def _with_spans(docs: DataFrame, spans: DataFrame, *columns) -> DataFrame:
    left = docs.select(*columns, F.xxhash64("text").alias("_key"), F.col("doc_id").alias("_id"))
    right = spans.select(F.col("doc_id").alias("_id2"), F.col("_text").alias("_key2"), "repeated", "removed")
    return left.join(right, (F.col("_key") == F.col("_key2")) & F.col("_id").eqNullSafe(F.col("_id2")), "left")


def _bytes(c: str):
    return F.aggregate(F.coalesce(c, F.array().cast(SPAN)), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def without(spans_column: int, text_column: int):
    """A mapInArrow function that takes the spans out of the text column and drops the spans column."""

    def run(batches):
        for b in batches:
            texts, spans = b.column(text_column).to_pylist(), b.column(spans_column).to_pylist()
            out = []
            for t, s in zip(texts, spans):
                if s:
                    raw, kept, at = t.encode(), [], 0
                    for x in s:
                        kept.append(raw[at : x["start"]])
                        at = x["end"]
                    t = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
                out.append(t)
            cols = [pa.array(out, b.schema.field(text_column).type) if i == text_column else c for i, c in enumerate(b.columns) if i != spans_column]
            yield pa.RecordBatch.from_arrays(cols, [n for i, n in enumerate(b.schema.names) if i != spans_column])

    return run


def dedup(docs: DataFrame, run_bytes=RUN, **cuts) -> DataFrame:
    """The documents with repeated chunks taken out of their texts; every other column as it is."""
    names = docs.columns
    marks = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    left = docs.select(*marks, F.col("doc_id"), F.col("text"))
    joined = _with_spans(left, repeated(docs, run_bytes, **cuts), *[f"c{i}" for i in range(len(names))]).select(*[f"c{i}" for i in range(len(names))], F.col("removed").alias("_gone"))
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return joined.mapInArrow(without(len(names), names.index("text")), schema).toDF(*names)


@query("op3_chunk_dedup")
def op3_chunk_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    rows = _with_spans(docs, repeated(docs), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    none = lambda c: F.coalesce(c, F.array().cast(SPAN))
    return rows.select("doc_id", "n_bytes", _bytes("repeated").alias("n_repeated"), _bytes("removed").alias("n_removed"), F.size(none("removed")).cast("long").alias("n_spans"), none("removed").alias("removed"))

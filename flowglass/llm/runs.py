"""Periodic runs of words, by recompression (`recompression.py`).

A run is a stretch of consecutive words of one text that repeats with period q (words q apart are equal, q the smallest such number),
is at least max(`MIN_WORDS`, 2q) words long and cannot be extended to either side.  Texts are worked off in slices: the words of
a slice are numbered, texts are set apart by separators, and one grammar is built over all.  For every period p the points of
the grid 0, p, 2p, ... that hold the same word as the next point are candidates: each run with period p has one.  The extensions to
the right and to the left of a candidate and its partner, read from the grammar, give the run exactly; of equal stretches
the smallest period counts.  A candidate inside a known run whose period divides p can give nothing else and is left out.

`runs` gives, per row, the words, all runs and the text without repetitions: each run keeps its first period.

Null and empty texts and texts of separators alone have no words and no runs, and their collapsed text is empty.  Repeated rows and
rows without id are each judged alone; an empty table gives no rows; only `doc_id` and `text` are read.  A text is one task's
work, however long: memory is some 100 bytes a word of the longest text.  Equality of words is that of 64-bit hashes
within one slice of texts."""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import text
from .recompression import compress

MIN_WORDS = 12
CANDIDATES = 1 << 17  # candidates that are extended together
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(words: np.ndarray, counts: np.ndarray, min_words=MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Runs of texts given as word numbers (all texts in a row, `counts` words each): text, start, length, period, in order."""
    texts, n = len(counts), len(words)
    doc = np.repeat(np.arange(texts, dtype=np.int32), counts)
    _, codes = np.unique(words, return_inverse=True)
    different = int(codes.max(initial=-1)) + 1
    # separator, text, separator, text, ..., separator
    s = np.empty(n + texts + 1, np.int32)
    edge = np.concatenate([[0], np.cumsum(counts + 1)])
    at = np.arange(n) + doc + 1
    s[edge] = different + np.arange(texts + 1)
    s[at] = codes
    owner = np.zeros(len(s), np.int32)
    owner[at] = doc
    grammar = compress(s)
    mirror = grammar.mirrored()
    covered = np.full(len(s), -1, np.int64)  # a run known to hold this place
    found = np.zeros((3, 0), np.int64)  # start, end, period

    def extend(i, p):
        nonlocal found
        r = covered[i]
        if found.shape[1]:
            skip = (r >= 0) & (found[1][r] > i + p) & (p % np.maximum(found[2][r], 1) == 0)
            i, p = i[~skip], p[~skip]
        right = grammar.extension(i, i + p)
        left = mirror.extension(len(s) - i, len(s) - i - p)
        ok = right + left >= np.maximum(p, min_words - p)
        start, end, p = (i - left)[ok], (i + p + right)[ok], p[ok]
        new = np.concatenate([found, np.stack([start, end, p])], axis=1)
        new = new[:, np.lexsort((new[2], new[1], new[0]))]
        first = np.ones(new.shape[1], bool)
        first[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])
        found = new[:, first]
        covered[:] = -1
        # the places of runs, smaller periods written over larger ones
        order = np.argsort(-found[2], kind="stable")
        size = (found[1] - found[0])[order]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(found[0][order], size)
        covered[place] = np.repeat(order, size)

    waiting, held = [], 0
    for p in range(1, int(counts.max(initial=0)) // 2 + 1):
        grid = s[::p]
        i = np.flatnonzero(grid[:-1] == grid[1:]) * p
        if len(i):
            i = i[owner[i] == owner[i + p]]
            waiting.append((i, np.full(len(i), p)))
            held += len(i)
        if held > CANDIDATES or (p == 1 and held):
            extend(*(np.concatenate(x) for x in zip(*waiting)))
            waiting, held = [], 0
    if held:
        extend(*(np.concatenate(x) for x in zip(*waiting)))
    start, end, period = found
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    of = owner[start]
    return of, start - edge[of] - 1, end - start, period


def runs(docs: DataFrame, min_words=MIN_WORDS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and `collapsed`, the kept words joined by one space."""

    def one(ids, buf, off):
        w = text.Words(buf, off, text.CASED)
        of, start, length, period = find_runs(w.hash, w.count, min_words)
        size = len(w.start) + 1
        change = np.bincount(w.first[of] + start + period, minlength=size) - np.bincount(w.first[of] + start + length, minlength=size)
        keep = np.cumsum(change)[:-1] == 0
        # bytes of kept words, each but the last of its text with the one byte after it, which becomes a space
        a, e, doc = w.start[keep], w.end[keep], w.doc[keep]
        inner = np.append(doc[1:] == doc[:-1], False)[: len(doc)]
        mark = np.zeros(len(buf) + 1, np.int8)
        mark[a] = 1
        mark[e + inner] -= 1  # the next kept word may start here
        mask = np.cumsum(mark, dtype=np.int8)[:-1] > 0
        buf = buf.copy()
        buf[e[inner]] = 0x20
        total = np.concatenate([[0], np.cumsum(mask)])[off]
        data = buf[mask]
        texts = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())
        n = np.bincount(of, minlength=len(ids))
        items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), items)
        return pa.RecordBatch.from_arrays([ids, pa.array(w.count.astype(np.int64)), found, texts], ["doc_id", "n_words", "runs", "collapsed"])

    def work(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(1)):
                yield one(b.column(0).slice(i, len(off) - 1), buf, off)

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth text (by crc32 h of the decimal doc_id) repeats a stretch: word i >= a becomes word a + (i - a) % p, where a = (h // 10) % n and
    p = 1 + (n - a) // (3 + h // 10 % 8).  Such texts have their words joined by one space; all others, and those without id, stay as they are."""

    def change(doc_id, buf, off):
        h = zlib.crc32(str(doc_id).encode())
        w = text.Words(buf, off, text.CASED)
        n, g = len(w.start), h // 10
        if h % 10 or not n:
            return None
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i = np.arange(n)
        i = np.where(i < a, i, a + (i - a) % p).tolist()
        data, start, end = buf.tobytes(), w.start.tolist(), w.end.tolist()
        return b" ".join([data[start[k] : end[k]] for k in i]).decode()

    def work(batches):
        for b in batches:
            texts = text.as_strings(b.column(1))
            buf, off = text.raw(texts)
            new = [None if d is None or zlib.crc32(str(d).encode()) % 10 else change(d, buf[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]])) for k, d in enumerate(b.column(0).to_pylist())]
            changed = pa.array(new, pa.large_string())
            yield pa.RecordBatch.from_arrays([b.column(0), changed.fill_null("") if not len(new) else pa.compute.coalesce(changed, texts).cast(pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    found = runs(planted(table(spark, sf, "documents")))
    # greatest length, then smallest start, then smallest period
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda acc, r: F.when(acc.isNull() | (r["length"] > acc["length"]), r).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(line, "\n"), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.expr("1000 * _best.length div _best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

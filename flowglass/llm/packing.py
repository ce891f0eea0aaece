"""Packing tokenised documents into sequences of a fixed capacity by best fit and swap-based local search.

Only lengths matter for packing, and a piece has one of `capacity` lengths.  So Spark counts the pieces of each length,
the plan is made once on those counts (kinds of bins with multiplicities: its size follows the capacity, not the number
of documents), and Spark deals the pieces out to the planned places by their rank among pieces of equal length.

The plan: best fit decreasing, then exchanges between the emptiest kind of bin and other underfull bins: moving a document,
one for one, two for one or one for two, always such that the sum of squared fills grows, until bins run empty.

A document's ids are followed by `end_id`; one longer than `capacity` is cut into full pieces, of which only the first may be
shorter.  Null and empty texts are one piece of the end id alone.  Repeated rows are packed once each.  An empty table
gives no rows.  Only `doc_id` and `text` are read, so further columns may have any name; a null doc_id is kept."""
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.catalog import query
from ..plans.views import table
from .store import written
from .text import lists
from .tokens import Encoder

CAPACITY = 2048
MAX_STEPS = 2_000  # exchanges between kinds of bins, each applied to all bins of the kind
PIECE = "doc_id {0}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity=CAPACITY, end_id=0, vocabulary: str | None = None, with_ids=False) -> DataFrame:
    """One row per piece; `with_ids` adds the ids themselves."""
    schema = PIECE.format(docs.schema["doc_id"].dataType.simpleString()) + (", ids array<long>" if with_ids else "")

    def run(batches):
        enc = Encoder(vocabulary)
        for b in batches:
            for i, ids, off in enc.ids(b.column(1)):
                n = len(off) - 1
                full = np.empty(len(ids) + n, np.uint32)
                at = off + np.arange(n + 1)  # bounds with the end ids
                keep = np.ones(len(full), bool)
                keep[at[1:] - 1] = False
                full[keep], full[~keep] = ids, end_id
                size = np.diff(at)
                count = -(-size // capacity)
                row = np.repeat(np.arange(n), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = size - (count - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = at[:-1][row] + start
                data = full.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist())]
                cols = [b.column(0).take(pa.array(row + i)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(lists(full.astype(np.int64), length))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Kinds of bins (lengths in falling order) with their numbers; many equal documents are placed at once."""
    rooms = [Counter() for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, np.int64)

    def put(room, kind, n):
        rooms[room][kind] += n
        filled[room] += n
        if not rooms[room][kind]:
            del rooms[room][kind]

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = np.flatnonzero(filled[size:])
            room = size + int(fits[0]) if len(fits) else capacity
            each = room // size
            kind, have = next(iter(rooms[room].items())) if len(fits) else ((), left)
            n = min(have, left // each)
            if not n:
                each, n = left, 1
            if len(fits):
                put(room, kind, -n)
            put(room - each * size, kind + (size,) * each, n)
            left -= n * each
    return sum(rooms, Counter())


def _offers(kind: tuple) -> dict[int, tuple]:
    """What a bin can give up at once: one or two documents, by their total length (0: nothing)."""
    sizes = sorted(set(kind))
    have = Counter(kind)
    out = {0: ()}
    out.update({a + b: (a, b) for i, a in enumerate(sizes) for b in sizes[i:] if a != b or have[a] > 1})
    out.update({a: (a,) for a in sizes})
    return out


def _without(kind: tuple, gone: tuple) -> list:
    rest = list(kind)
    for x in gone:
        rest.remove(x)
    return rest


def local_search(bins: Counter, capacity: int, max_steps=MAX_STEPS) -> Counter:
    """Exchanges between underfull bins that raise the sum of squared fills, emptying the emptiest bins first."""
    full = Counter({k: n for k, n in bins.items() if sum(k) == capacity})
    open_ = Counter({k: n for k, n in bins.items() if sum(k) < capacity})
    offers = {k: _offers(k) for k in open_}
    stuck, steps = set(), 0

    def add(kind, n):
        if not kind:
            return
        kind = tuple(sorted(kind, reverse=True))
        if sum(kind) == capacity:
            full[kind] += n
            return
        open_[kind] += n
        offers.setdefault(kind, None)
        if offers[kind] is None:
            offers[kind] = _offers(kind)

    def take(kind, n):
        open_[kind] -= n
        if not open_[kind]:
            del open_[kind]

    while steps < max_steps and sum((capacity - sum(k)) * n for k, n in open_.items()) >= capacity:
        free = [k for k in open_ if k not in stuck]
        if not free:
            break
        poor = min(free, key=lambda k: (sum(k), k))
        fill, best = sum(poor), None
        for kind in open_:
            if kind == poor and open_[poor] < 2:
                continue
            room, have = capacity - sum(kind), sum(kind)
            if have < fill:
                continue
            for total, given in offers[poor].items():
                if not given:
                    continue
                for back, other in offers[kind].items():
                    d = total - back
                    if 0 < d <= room and len(given) + len(other) <= 3:
                        gain = (d == room, 2 * d * (have - fill + d))
                        if best is None or gain > best[0]:
                            best = (gain, kind, given, other)
            if best and best[0][0]:
                break
        if best is None:
            stuck.add(poor)
            continue
        _, kind, given, other = best
        n = open_[poor] // 2 if kind == poor else min(open_[poor], open_[kind])
        take(poor, n)
        take(kind, n)
        add(_without(poor, given) + list(other), n)
        add(_without(kind, other) + list(given), n)
        steps += 1
        stuck.clear()
    return full + open_


def plan(counts: dict[int, int], capacity=CAPACITY) -> Counter:
    return local_search(best_fit(counts, capacity), capacity)


def places(bins: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence and offset of each run of equal places."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    first = 0
    for kind, n in sorted(bins.items()):
        offset = 0
        for size in kind:
            out.setdefault(size, []).append((used[size], first, offset))
            used[size] += n
            offset += size
        first += n
    return {size: tuple(np.array(x, np.int64) for x in zip(*runs)) for size, runs in out.items()}


def pack(docs: DataFrame, capacity=CAPACITY, end_id=0, vocabulary: str | None = None, with_ids=False) -> DataFrame:
    """Every piece with its `sequence_id` and `offset`."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    spots = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # follows the number of kinds of bins
    # Rank among equal lengths: inside salted groups, plus the sizes of the groups before.
    salt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = groups.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)

    def run(batches):
        where = spots.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
            for a, z in zip(edges[:-1], edges[1:]):
                rows = order[a:z]
                base, first, off = where[int(length[rows[0]])]
                g = np.searchsorted(base, rank[rows], "right") - 1
                seq[rows], offset[rows] = first[g] + rank[rows] - base[g], off[g]
            keep = [c for c in b.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    keep = cut.columns
    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*keep, "_rank").mapInArrow(run, schema)


@query("op6_packing")
def op6_packing(spark, sf):
    return pack(table(spark, sf, "documents"))

"""Suffix-array dedup: every byte covered by a string of `LENGTH` bytes that also starts elsewhere is removed.

Which strings meet.  Every window of `LENGTH` bytes has an anchor, the substring of `GRAM` bytes in it with the least hash (the
leftmost of equals), so equal windows have equal anchors at equal offsets.  Neighbouring windows of one anchor form a context,
the bytes they cover.  Equal contexts of one text are one row with all their places, so a line that fills a text is not a row for each time
it stands there.  Anchors that occur once are done with.  Equal contexts are found by their digest and counted: they repeat as
a whole, and one of them stands for all from there on.

Parts.  The different contexts of a repeated anchor are divided by their windows' offsets into parts of `STEPS[0]` windows, keyed
by the bytes that all windows of a part share.  A part whose key is alone has no repeated window; parts equal as a whole are again
counted.  Where more than `GROUP` different parts share a key, they are divided further.  A part of one window is such a whole, so the
division ends, no shard grows with a group of copies and no window is left out.

Suffix arrays.  The different parts of a key go to one shard; shards of about `SHARD` bytes are sorted by induced sorting, and the
permuted common prefixes tell which windows start elsewhere too.  A window belongs to one part only, so a match is always another place.

Anchors are looked for in slices of about `SLICE` bytes.  That and a shard hold some 150 bytes for each byte of theirs in every task.

Texts are compared as UTF-8 bytes, null is empty, matches never cross texts but may overlap and lie in one text.  Repeated rows are
repetitions of each other.  A row without doc_id takes part like any other.  Digests have 128 bits.  `dedup` takes the bytes out
(characters cut in two go with them) and keeps all other columns; a text may be left empty, null stays null."""
import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import text
from .induced import permuted_prefixes, suffix_array
from .store import written

LENGTH = 400
GRAM = 64
SLICE = 1 << 18
SHARD = 1 << 18
GROUP = 256
STEPS = (64, 16, 4, 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive members, from running minima inside blocks of that width."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(buf: np.ndarray, off: np.ndarray, length=LENGTH, gram=GRAM):
    """(row, start, windows, anchor, anchor hash, two digests) of every context of a slice; start and anchor count in the slice."""
    n, width = len(buf), length - gram + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64), z.view(np.uint64)
    codes = buf.astype(np.uint16) + 1
    sums = text.prefix_hash(codes)
    at = np.arange(n - gram + 1)
    h = text.range_hash(sums, at, at + gram)
    bits = text.U(int(n).bit_length())
    least = sliding_min((h >> bits << bits) | at.astype(np.uint64), width)
    anchor = (least & ((text.U(1) << bits) - text.U(1))).astype(np.int64)
    start = np.arange(n - length + 1)
    row = np.searchsorted(off, start, "right") - 1
    inside = start + length <= off[row + 1]
    start, row, anchor = start[inside], row[inside], anchor[inside]
    if not len(start):
        return contexts(buf[:0], off, length, gram)
    head = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(head)
    windows = np.diff(np.concatenate([first, [len(start)]]))
    start, row, anchor = start[first], row[first], anchor[first]
    end = start + windows - 1 + length
    other = text.prefix_hash(codes, text.BASE2)
    return row, start, windows, anchor, h[anchor], text.range_hash(sums, start, end), text.range_hash(other, start, end, text.BASE2)


def _id(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _together(row: np.ndarray, d1: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal members of a row together, earlier ones first, and where each group begins in it."""
    order = np.lexsort((d1, row))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (row, d1, *others)], axis=0)
    return order, np.flatnonzero(new)


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """Per different context of a text: doc_id, _text, starts (all its places), n (their number), windows, rel (first window's offset from the anchor), g (anchor), d1, d2 (digest)."""

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(2), SLICE):
                row, start, windows, anchor, g, d1, d2 = contexts(buf, off, length)
                order, begin = _together(row, d1, d2, g, windows, start - anchor)
                n = np.diff(np.concatenate([begin, [len(order)]]))
                starts = text.lists((start - off[row])[order].astype(np.int32), n)
                row, start, windows, anchor, g, d1, d2 = (x[order[begin]] for x in (row, start, windows, anchor, g, d1, d2))
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), starts, *(pa.array(x.astype(np.int32)) for x in (n, windows, start - anchor)), *(pa.array(text.signed(x)) for x in (g, d1, d2))],
                    ["doc_id", "_text", "starts", "n", "windows", "rel", "g", "d1", "d2"])

    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").mapInArrow(run, f"doc_id {_id(docs)}, _text long, starts array<int>, n int, windows int, rel int, g long, d1 long, d2 long")


KEY = ["g", "rel", "windows", "d1", "d2"]


def _counted(rows: DataFrame, key: list[str], times="count(1)", start="start") -> DataFrame:
    """Per different context: how often it occurs (`times`) and one place of it."""
    return rows.groupBy(*key).agg(F.expr(times).alias("times"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_text", F.expr(start).alias("start"))).alias("at"))


def _with_bytes(places: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """`places` (doc_id, _text, start, windows, ...) with the bytes of their windows as `data`; the texts move once."""
    names = [c for c in places.columns if c not in ("doc_id", "_text")]
    per = places.groupBy("doc_id", "_text").agg(F.collect_list(F.struct(*names)).alias("p"))  # no more than one text holds
    hashed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    per = per.withColumnsRenamed({"doc_id": "_id", "_text": "_key"})
    # Repeated rows are alike: their places are read from each, and the copies dropped.
    joined = hashed.join(per, hashed["doc_id"].eqNullSafe(per["_id"]) & (hashed["_text"] == per["_key"])).select("doc_id", "_text", "text", "p")
    kinds = dict(places.dtypes)
    schema = f"doc_id {_id(docs)}, _text long, " + ", ".join(f"{c} {kinds[c]}" for c in names) + ", data binary"

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                flat = part.column(3).flatten()
                n = part.column(3).value_lengths().to_numpy()
                own = np.repeat(np.arange(len(n)), n)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                start, windows = (flat.field(names.index(c)).to_numpy(zero_copy_only=False) for c in ("start", "windows"))
                data = [texts[d][s : s + w - 1 + length] for d, s, w in zip(own.tolist(), start.tolist(), windows.tolist())]
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *(flat.field(k) for k in range(len(names))), pa.array(data, pa.binary())], ["doc_id", "_text", *names, "data"])

    return joined.mapInArrow(run, schema).dropDuplicates(["doc_id", "_text", "start"])


def _shards(rows: DataFrame, length: int, shard: int) -> DataFrame:
    """Repeated windows among the contexts of each key, by suffix array and permuted common prefixes."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _text long, start int, windows int"

    def judged(batch):
        data = batch.column(batch.schema.names.index("data")).to_pylist()
        size = np.array([len(d) + 1 for d in data])
        begin = np.cumsum(size) - size
        s = np.frombuffer(b"".join(d + b"\0" for d in data), np.uint8).astype(np.int64) + 1
        stop = begin + size - 1
        s[stop] = 0  # separators
        end = np.repeat(stop, size)
        before, after = permuted_prefixes(s, suffix_array(s), end, length)
        own = np.repeat(np.arange(len(data)), size)
        hit = np.flatnonzero(np.maximum(before, after) >= length)
        if not len(hit):
            return
        head = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (own[hit[1:]] != own[hit[:-1]])])
        first = np.flatnonzero(head)
        n = np.diff(np.concatenate([first, [len(hit)]]))
        at = own[hit[first]]
        base = batch.column(batch.schema.names.index("start")).to_numpy()
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((base[at] + hit[first] - begin[at]).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "_text", "start", "windows"])

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            k1, k2 = (b.column(b.schema.names.index(c)).to_numpy() for c in ("k1", "k2"))
            n = np.cumsum(pc.binary_length(b.column(b.schema.names.index("data"))).to_numpy())
            new = np.flatnonzero(np.concatenate([[last is None or last != (k1[0], k2[0])], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(b) else []
            at = 0
            for edge in [*new, len(b)]:
                here = int(n[edge - 1] - (n[at - 1] if at else 0)) if edge > at else 0
                if edge < len(b) and size + here >= shard:
                    held.append(b.slice(at, edge - at))
                    yield from judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size, at = [], 0, edge
            if at < len(b):
                held.append(b.slice(at))
                size += int(n[-1] - (n[at - 1] if at else 0))
            if len(b):
                last = (k1[-1], k2[-1])
        if held:
            yield from judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2").select("doc_id", "_text", "start", "k1", "k2", "data").mapInArrow(run, schema)


def _divided(rows: DataFrame, length: int, step: int) -> DataFrame:
    """Every context cut at multiples of `step` of its windows' offsets, keyed by the bytes all windows of the part share.

    `from` is where the context started; the bytes stay with it."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _text long, start int, windows int, rel int, from int, k1 long, k2 long, d1 long, d2 long"

    def run(batches):
        for b in batches:
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
            own, out = [], {c: [] for c in ("start", "windows", "rel", "from", "k1", "k2", "d1", "d2")}
            for i, data in enumerate(cols["data"]):
                rel, n = cols["rel"][i], cols["windows"][i]
                at = rel
                while at < rel + n:
                    part = at // step * step
                    upto = min(rel + n, part + step)
                    piece = data[at - rel : upto - 1 - rel + length]
                    core = data[part + step - 1 - rel : part - rel + length]
                    digest = hashlib.blake2b(core, digest_size=16, salt=(part + (1 << 31)).to_bytes(8, "little")).digest()
                    whole = hashlib.blake2b(piece, digest_size=16).digest()
                    for c, v in (("start", cols["start"][i] + at - rel), ("windows", upto - at), ("rel", at), ("from", cols["start"][i]), ("k1", int.from_bytes(digest[:8], "little", signed=True)),
                                 ("k2", int.from_bytes(digest[8:], "little", signed=True)), ("d1", int.from_bytes(whole[:8], "little", signed=True)), ("d2", int.from_bytes(whole[8:], "little", signed=True))):
                        out[c].append(v)
                    own.append(i)
                    at = upto
            take = pa.array(own, pa.int64())
            types = {c: pa.int32() for c in ("start", "windows", "rel", "from")}
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(v, types.get(c, pa.int64())) for c, v in out.items())], ["doc_id", "_text", *out])

    return rows.select("doc_id", "_text", "start", "windows", "rel", "data").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, length=LENGTH, shard=SHARD, group=GROUP) -> DataFrame:
    """Runs of windows that also start elsewhere: doc_id, _text, starts, windows."""
    cols = ["doc_id", "_text", "start", "windows"]
    every = written(_anchored(docs, length), "anchors")
    # Counts are written before they are joined back: both sides of the join are then dealt anew, and Spark can split a hot key.
    often = written(every.groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g"), "often")
    rows = written(every.join(often, "g"), "repeated")
    counted = written(_counted(rows, KEY, "sum(n)", "starts[0]"), "contexts")
    # A key has one row on this side, so each context of a text comes out once at most.
    twice = counted.filter("times > 1").select(*KEY)
    equal = written(rows.join(twice, KEY).select("doc_id", "_text", "starts", "windows"), "equal")
    found = []
    kinds = written(counted.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "kinds")
    unlike = counted.join(kinds, "g").select("at.doc_id", "at._text", "at.start", "windows", "rel")
    todo = written(_with_bytes(unlike, docs, length), "bytes")
    key = ["k1", "k2", "rel", "windows", "d1", "d2"]
    same = lambda a, b, *cs: F.expr(" and ".join([f"{a}.doc_id <=> {b}.doc_id", f"{a}._text = {b}._text", *(f"{a}.{x} = {b}.{y}" for x, y in cs)]))
    for step in STEPS:
        parts = written(_divided(todo, length, step), "parts")
        counted = written(_counted(parts, key), "parts-counted")
        found.append(parts.join(counted.filter("times > 1").select(*key), key).select(*cols))
        groups = written(counted.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
        some = counted.join(groups, ["k1", "k2"]).select("at.doc_id", "at._text", "at.start", "k1", "k2", "n")
        one = parts.select(*cols, "rel", "from").alias("p").join(some.alias("s"), same("p", "s", ("start", "start"))).select("p.*", "k1", "k2", "n")
        bytes_ = todo.select("doc_id", "_text", "start", "data").alias("t")
        left = one.alias("o").join(bytes_, same("o", "t", ("from", "start"))).select("o.*", F.expr(f"substring(t.data, o.start - o.from + 1, o.windows - 1 + {length})").alias("data"))
        left = written(left.drop("from"), "left")
        found.append(_shards(left.filter(F.col("n") <= group), length, shard))
        todo = left.filter(F.col("n") > group).drop("k1", "k2", "n")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, [equal, *(f.select("doc_id", "_text", F.array("start").alias("starts"), "windows") for f in found)])


def removed_spans(docs: DataFrame, length=LENGTH, **how) -> DataFrame:
    """Per document that loses any: doc_id, _text and `spans` (start, end) in bytes, apart and in order."""
    windows = repeated_windows(docs, length, **how)
    per = windows.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("starts", "windows")).alias("w"))  # one text's own windows

    def run(batches):
        for b in batches:
            spans, counts = [], []
            for w in b.column(2).to_pylist():
                before = len(spans)
                for a, n in sorted((a, x["windows"]) for x in w for a in x["starts"]):
                    z = a + n - 1 + length
                    if len(spans) > before and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], z))
                    else:
                        spans.append((a, z))
                counts.append(len(spans) - before)
            off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = np.array(spans, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))], ["doc_id", "_text", "spans"])

    return per.mapInArrow(run, f"doc_id {_id(docs)}, _text long, spans array<struct<start:bigint,end:bigint>>")


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All columns of `docs` under the names c0, c1, ..., then the spans."""
    left = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").alias("_l"), F.xxhash64("text").alias("_h"))
    right = spans.select(F.col("doc_id").alias("_r"), F.col("_text").alias("_t"), "spans")
    return left.join(right, F.col("_l").eqNullSafe(F.col("_r")) & (F.col("_h") == F.col("_t")), "left").select(*[f"c{i}" for i in range(len(docs.columns))], "spans")


def _kept(raw: bytes, spans) -> bytes:
    parts, at = [], 0
    for s in spans or ():
        parts.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, raw[at:]])


def dedup(docs: DataFrame, length=LENGTH, **how) -> DataFrame:
    """The documents without the repeated bytes of their texts; every other column as it is."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            out = [t if not s else _kept(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(at).type) if i == at else b.column(i) for i in range(len(names))], b.schema.names[: len(names)])

    return _joined(docs, removed_spans(docs, length, **how)).mapInArrow(run, ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))).toDF(*names)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            spans = b.column(2).to_pylist()
            gone = [sum(s["end"] - s["start"] for s in x or ()) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x or ()) for x in spans], pa.int64()),
                                              pa.array([hashlib.sha256(_kept(t, x)).hexdigest() for t, x in zip(texts, spans)], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs, removed_spans(docs)).mapInArrow(run, f"doc_id {_id(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

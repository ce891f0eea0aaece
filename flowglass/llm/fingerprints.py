"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph (a line that is not empty) is hashed to a wide vector and the vectors of a document are added, lane by
lane, modulo a power of two.  So the order of paragraphs does not matter, equal multisets have equal fingerprints, and a
paragraph is inserted or deleted by adding or subtracting its vector (`insert`, `delete`) without reading the document.

A vector has two parts: `LANES` lanes of 64 bits from an extendable-output hash of the paragraph, which decide equality,
and `SKETCH` lanes of 32 bits that count the paragraph's word triples with hashed signs.  Sums of the latter estimate how
much two documents share: `likeness` = 2<a,b> / (<a,a> + <b,b>), clipped to 0..1, with an error of about 1/sqrt(SKETCH).
A text of under 2 GiB, the most a value can hold, has fewer than 2**30 triples, so the counts of one text never wrap.

Null and empty texts have the zero vector; two of those are alike (1), and unlike any text with words (0).  Repeated rows are
fingerprinted one by one.  Empty tables give no rows.  Only `doc_id` and `text` are read."""
import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import text

LANES = 16
SKETCH = 256
GRAM = 3
SLICE = 2 << 20


def vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Per text: exact lanes (rows x LANES, modulo 2**64) and sketch lanes (rows x SKETCH, modulo 2**32)."""
    exact, sketch = [], []
    for _, buf, off in text.slices(column):
        n = len(off) - 1
        line = np.ones(len(buf) + 1, bool)
        line[:-1] = buf == 0x0A
        line[-1] = False
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        edge[1:] |= line[:-1]  # a paragraph starts after a line feed, and at each text
        edge[:-1] |= line[:-1]  # and ends before it
        bounds = np.flatnonzero(edge)
        start, end = bounds[:-1], bounds[1:]
        solid = ~line[start] & (end > start)
        start, end = start[solid], end[solid]
        doc = np.searchsorted(off, start, "right") - 1
        data = buf.tobytes()
        wide = np.frombuffer(b"".join([hashlib.shake_256(data[a:b]).digest(8 * LANES) for a, b in zip(start.tolist(), end.tolist())]), "<u8").reshape(-1, LANES)
        sums = np.zeros((n, LANES), np.uint64)
        if len(doc):
            head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            sums[doc[head]] = np.add.reduceat(wide, head, axis=0)
        exact.append(sums)
        w = text.Words(buf, bounds, text.CASED)
        row, h = text.grams(w, GRAM)
        at = np.searchsorted(off, bounds[row], "right") - 1 if len(row) else row
        lane = at * SKETCH + (h >> text.U(40)).astype(np.int64) % SKETCH
        sign = (h & text.U(1)).astype(np.float64) * 2 - 1
        sketch.append(np.bincount(lane, sign, n * SKETCH).astype(np.int64).astype(np.int32).reshape(n, SKETCH))
    if not exact:
        return np.zeros((0, LANES), np.uint64), np.zeros((0, SKETCH), np.int32)
    return np.concatenate(exact), np.concatenate(sketch)


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    both = np.concatenate([exact.astype("<u8").view(np.uint8).reshape(len(exact), -1), sketch.astype("<i4").view(np.uint8).reshape(len(sketch), -1)], axis=1)
    return [base64.b64encode(r).decode() for r in np.ascontiguousarray(both)]


def decode(fingerprints) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(base64.b64decode(x) for x in fingerprints), np.uint8).reshape(len(fingerprints), -1)
    return np.ascontiguousarray(rows[:, : 8 * LANES]).view("<u8"), np.ascontiguousarray(rows[:, 8 * LANES :]).view("<i4")


def insert(fingerprint: str, paragraph: str, sign: int = 1) -> str:
    """The fingerprint of the document with one more paragraph."""
    exact, sketch = decode([fingerprint])
    e, s = vectors(pa.array([paragraph]))
    return encode(exact + e if sign > 0 else exact - e, (sketch + s if sign > 0 else sketch - s).astype(np.int32))[0]


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint of the document without one occurrence of a paragraph it has."""
    return insert(fingerprint, paragraph, -1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated share of common content per row, from the vectors alone."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = (x * x).sum(1) + (y * y).sum(1)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.clip(2 * (x * y).sum(1) / np.maximum(size, 1), 0, 1))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode(*vectors(b.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, _block, _tail: blocks of ascending doc_id, each followed by the first document of the next block.

    Blocks are cut at approximate quantiles and hold their documents in order in one partition, so neighbours meet without
    a second shuffle of the texts.  The driver keeps one number per block."""
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(docs.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks) or [], np.float64)).astype(np.int64)

    def block_of(ids: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"), 0)

    def number(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block_of(b.column(0)), pa.int64())], ["doc_id", "_block"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id").mapInArrow(number, f"doc_id {kind}, _block long").groupBy("_block").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f")).collect()
    seen = sorted((r["_block"], r["f"]["doc_id"]) for r in seen)
    before = {first: seen[i - 1][0] for i, (_, first) in enumerate(seen)}

    def deal(batches):
        for b in batches:
            at = block_of(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(np.zeros(len(at), bool))], ["doc_id", "text", "_block", "_tail"])
            again = [i for i, x in enumerate(b.column(0).to_pylist()) if x in before]
            if again:
                part = b.take(pa.array(again))
                to = [before[x] for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.int64()), pa.array([True] * len(to))], ["doc_id", "text", "_block", "_tail"])

    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, f"doc_id {kind}, text string, _block long, _tail boolean")
    return dealt.repartition(blocks // 4, "_block").sortWithinPartitions("_block", "_tail", "doc_id", "text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text and how alike it is to the edited text and to the next document.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many of the next document by doc_id
    (the last is followed by the first; rows of equal doc_id stand in the order of their texts, null ids come first)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def results(ids, texts, pair, own):
        """Rows of the documents at `pair`, each followed by its next one; `own` holds the vectors of all texts."""
        edited, sizes = [], []
        for i in pair:
            n = len(texts[i])
            edited.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
            sizes.append(n)
        mine, next_ = tuple(v[pair] for v in own), tuple(v[np.array(pair) + 1] for v in own)
        theirs = vectors(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(pair)), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(encode(*mine)), pa.array(encode(*theirs)),
             pa.array(likeness(mine, theirs)), pa.array(likeness(mine, next_))], names)

    def run(batches):
        last = None  # the row before, with its vectors
        for whole in batches:
            for first, _, off in text.slices(whole.column(1), SLICE):
                b = whole.slice(first, len(off) - 1)
                own = vectors(b.column(1))
                if last is not None:
                    b = pa.Table.from_batches([last[0], b]).combine_chunks().to_batches()[0]
                    own = tuple(np.concatenate(x) for x in zip(last[1], own))
                block, tail = b.column(2).to_pylist(), b.column(3).to_pylist()
                pair = [i for i in range(len(block) - 1) if not tail[i] and block[i] == block[i + 1]]
                if pair:
                    yield results(b.column(0), b.column(1).to_pylist(), pair, own)
                last = (pa.RecordBatch.from_pylist(b.slice(len(b) - 1).to_pylist(), b.schema), tuple(v[-1:] for v in own))

    return in_order(docs).mapInArrow(run, schema)


@query("op9_fingerprints")
def op9_fingerprints(spark, sf):
    return edited_likeness(table(spark, sf, "documents"))

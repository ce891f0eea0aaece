"""Quality by co-training: a classifier over the text and one over the page's metadata teach each other.

Two views of a document are kept apart: `content` (shares of kinds of characters and words, repetition, line shapes) and
`metadata` (language, source and stated length).  Both start from labelled rows.  In every round each view's confident
predictions on unlabelled documents become training rows of the other view.  Held-out labelled rows then calibrate each view and
weigh the two calibrated views against each other; the combination scores all documents.

The models are small (some tens of weights), so training runs over the whole table: a task adds up the gradients of its rows and
only the sums reach the driver.  Documents are read twice, once for the features and once to be scored; text is not shuffled.

Labels with a null doc_id or quality are left out; of repeated labels of a document the lowest counts.  Null and empty texts, null
languages, sources and lengths have features of their own.  Repeated rows are scored one by one, an empty table gives no rows, and
without labels of both kinds nothing is rejected.  `select_good` returns the columns of its input, whatever they are; missing
metadata columns count as null."""
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import linear, text
from .store import written

ROUNDS = 3
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.25
THRESHOLD = 0.5
HELD_OUT = 5  # every fifth labelled id, by hash, calibrates instead of training
LANGS, SOURCES = 16, 64
CONTENT = 20
META = LANGS + SOURCES + 4


def _classes() -> np.ndarray:
    """Byte classes: upper, lower, digit, space, line feed, plain punctuation, bar, marks of excitement, odd signs, others."""
    c = np.full(256, 9)
    c[65:91], c[97:123], c[48:58] = 0, 1, 2
    c[[9, 11, 12, 13, 32]], c[10] = 3, 4
    for k, chars in ((5, b".,;:'\"()-"), (6, b"|"), (7, b"!?"), (8, b"#$%&*+/<=>@[\\]^_`{}~")):
        c[list(chars)] = k
    return c


CLASS = _classes()


def content(column) -> np.ndarray:
    """Content view, rows x CONTENT."""
    out = []
    for _, buf, off in text.slices(column):
        n = len(off) - 1
        size = np.diff(off)
        rows = np.repeat(np.arange(n), size)
        shares = np.bincount(rows * 10 + CLASS[buf], minlength=n * 10).reshape(n, 10)
        w = text.Words(buf, off, text.SPACED)
        words = np.maximum(w.count, 1)
        per = lambda mask: np.bincount(w.doc[mask], minlength=n) / words
        same = np.zeros(len(w.hash), bool)
        if len(same) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        first = CLASS[buf[w.start]]
        last = CLASS[buf[np.maximum(w.end - 1, 0)]]
        shout = (first == 0) & (CLASS[buf[np.maximum(w.end - 3, w.start)]] == 0) & (w.end - w.start > 3)
        distinct = text.shingles(w, 1)[2] / words
        length = np.bincount(w.doc, w.end - w.start, n) / words
        lines = shares[:, 4] + 1
        tops = np.log(0.002 + shares / np.maximum(size, 1)[:, None])
        more = np.stack([np.log(0.01 + per(same)), np.log(0.01 + per(last == 8)), np.log(0.01 + per(shout)), np.log(0.01 + per(last == 7)), np.log(0.01 + per(first == 6)),
                         np.log(0.01 + distinct), np.log(1 + words), length / 10, np.log(words / lines), (w.count == 0).astype(float)], axis=1)
        out.append(np.concatenate([tops, more], axis=1))
    return np.concatenate(out) if out else np.zeros((0, CONTENT))


def metadata(lang, source, n_chars) -> np.ndarray:
    """Metadata view, rows x META: one-hot language and source by a hash of all their bytes, length and its absence."""
    n = len(lang)
    out = np.zeros((n, META))

    def buckets(column, size):
        known = [(0 if v is None else 1 + zlib.crc32(str(v).encode()) % (size - 1)) for v in column.to_pylist()]
        return np.array(known, np.int64)

    rows = np.arange(n)
    out[rows, buckets(lang, LANGS)] = 1
    out[rows, LANGS + buckets(source, SOURCES)] = 1
    chars = n_chars.cast(pa.float64())
    size = np.log1p(np.maximum(chars.fill_null(0).to_numpy(zero_copy_only=False), 0))
    out[:, LANGS + SOURCES :] = np.stack([size, size * size / 10, (size > 7).astype(float), chars.is_null().to_numpy(zero_copy_only=False).astype(float)], axis=1)
    return out


@dataclass
class Views:
    content: np.ndarray
    metadata: np.ndarray
    calibration: list[np.ndarray]  # per view: intercept and slope on its logit
    combined: np.ndarray  # intercept and a weight per calibrated view

    def logits(self, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return linear.with_one(c) @ self.content, linear.with_one(m) @ self.metadata

    def scores(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: calibrated content view, calibrated metadata view, combination."""
        z = [a + b * v for (a, b), v in zip(self.calibration, self.logits(c, m))]
        return np.stack([linear.sigmoid(z[0]), linear.sigmoid(z[1]), linear.sigmoid(linear.with_one(np.stack(z, axis=1)) @ self.combined)], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id with both views as arrays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    flat = docs.select("doc_id", *[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def run(batches):
        for b in batches:
            c, m = content(b.column(1)).astype(np.float32), metadata(*b.columns[2:]).astype(np.float32)
            n = np.ones(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), text.lists(c.ravel(), n * CONTENT), text.lists(m.ravel(), n * META)], ["doc_id", "content", "metadata"])

    return flat.mapInArrow(run, f"doc_id {kind}, content array<float>, metadata array<float>")


def _matrices(b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c, k: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), k)
    label = b.column("label").to_numpy(zero_copy_only=False)
    return linear.with_one(get("content", CONTENT)), linear.with_one(get("metadata", META)), label, b.column("held").to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, rounds=ROUNDS, confident=CONFIDENT) -> Views:
    known = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    rows = features(docs).join(known, "doc_id", "left")
    rows = written(rows.select("content", "metadata", F.coalesce("label", F.lit(-1)).alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held")), "views")
    count = rows.filter("label >= 0").groupBy("label", "held").count().collect()
    if len(count) < 4:
        return Views(np.zeros(CONTENT + 1), np.zeros(META + 1), [np.array([0.0, 0.0])] * 2, np.array([40.0, 0.0, 0.0]))
    sizes, w = [CONTENT + 1, META + 1], [np.zeros(CONTENT + 1), np.zeros(META + 1)]

    def design(teachers):
        def run(b):
            c, m, label, held = _matrices(b)
            train = (label >= 0) & ~held
            out = []
            for x, other, teacher in ((c, m, teachers and teachers[1]), (m, c, teachers and teachers[0])):
                weight, y = train.astype(float), (label > 0).astype(float)
                if teachers:
                    p = linear.sigmoid(other @ teacher)
                    new = (label < 0) & ((p >= confident) | (p <= 1 - confident))
                    weight[new], y[new] = PSEUDO_WEIGHT, p[new] > 0.5
                out.append((x, y, weight))
            return out

        return run

    w = linear.fit_table(rows, design(None), sizes, w, steps=7)
    for _ in range(rounds):
        w = linear.fit_table(rows, design([x.copy() for x in w]), sizes, w, steps=3)

    apart = rows.filter("label >= 0 and held")

    def single(b):
        c, m, label, _ = _matrices(b)
        return [(linear.with_one((x @ v)[:, None]), (label > 0).astype(float), np.ones(len(label))) for x, v in ((c, w[0]), (m, w[1]))]

    calibration = linear.fit_table(apart, single, [2, 2], [np.array([0.0, 1.0])] * 2, ridge=0.1)

    def both(b):
        c, m, label, _ = _matrices(b)
        z = np.stack([k[0] + k[1] * (x @ v) for k, x, v in zip(calibration, (c, m), w)], axis=1)
        return [(linear.with_one(z), (label > 0).astype(float), np.ones(len(label)))]

    (combined,) = linear.fit_table(apart, both, [3], [np.array([0.0, 1.0, 0.0])], ridge=0.1)
    return Views(w[0], w[1], calibration, combined)


def _scored(batches, names, views):
    at = {c: names.index(c) for c in ("text", "lang", "source", "n_chars") if c in names}
    for b in batches:
        column = lambda c, kind: b.column(at[c]).cast(kind) if c in at else pa.nulls(len(b), kind)
        yield b, views.scores(content(b.column(at["text"])), metadata(column("lang", pa.string()), column("source", pa.string()), column("n_chars", pa.int64())))


def score(docs: DataFrame, views: Views, threshold=THRESHOLD) -> DataFrame:
    """doc_id, content_score, metadata_score, quality_score (probabilities of good quality) and keep."""
    wanted = docs.select("doc_id", *[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
    names = wanted.columns

    def run(batches):
        for b, p in _scored(batches, names, views):
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k].copy()) for k in range(3)), pa.array(p[:, 2] >= threshold)], ["doc_id", "content_score", "metadata_score", "quality_score", "keep"])

    return wanted.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content_score double, metadata_score double, quality_score double, keep boolean")


def select_good(docs: DataFrame, views: Views, threshold=THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose combined score reaches the threshold."""
    names = docs.columns

    def run(batches):
        for b, p in _scored(batches, names, views):
            yield b.filter(pa.array(p[:, 2] >= threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op2_quality")
def op2_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return score(docs, fit(docs, table(spark, sf, "labels")))

"""Toxicity by a classifier chain: categories in order, each a linear model over words and the earlier categories' probabilities.

`fit` trains on at most `ROWS` labelled documents (those of the smallest id hashes; near copies among them count once), so its
work does not grow with the corpus.  Words and their stems enter as present or absent, chosen by the likelihood-ratio statistic between word
and any category among words at least `MIN_LIFT` times as common in it.  The probabilities of earlier categories that a later model is trained with are out of fold (`FOLDS` folds by
id hash); the final models are fitted on all rows of the sample.  `score` reads every document once, without a shuffle.

Labels with a null doc_id or a null category are left out, repeated labels of a document count as 1 if any is.  Null and empty
texts have no words and get the base rates.  Repeated rows are scored one by one; an empty table gives no rows; without labels
of both kinds every probability is the base rate (0 without any labels).  Only `doc_id` and `text` are read."""
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import linear, text
from .store import forget, written

ROWS = 20_000
FOLDS = 5
MAX_TERMS = 256
MIN_SCORE = 20.0
MIN_LIFT = 3.0
STEM = 6
RIDGE = 0.2
THRESHOLD = 0.3
#: Weak categories of the registered query, by their terms; documents labelled toxic are of a category if they hold one.
CATEGORIES = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser"],
    "contempt": ["worthless", "pathetic", "disgusting"],
    "dehumanising": ["trash", "scum"],
}


@dataclass
class Chain:
    names: list[str]
    terms: np.ndarray  # sorted word hashes
    weights: list[np.ndarray]

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        x = linear.with_one(present)
        out = np.zeros((len(present), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = linear.sigmoid(x @ w)
            x = np.concatenate([x, out[:, k : k + 1]], axis=1)
        return out


def word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for _, buf, off in text.slices(pa.array(words, pa.string())):
        out.append(text.Words(buf, off, text.ALNUM).hash)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def terms_of(w: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of the stems (the first `STEM` bytes) of longer ones."""
    long = np.flatnonzero(w.end - w.start > STEM)
    stems = text.range_hash(w.sums, w.start[long], w.start[long] + STEM)
    return np.concatenate([w.doc, w.doc[long]]), np.concatenate([w.hash, text.mix(stems + text.U(STEM))])


def _words(rows: DataFrame, more: list[str]) -> DataFrame:
    """Distinct words and stems of each document and `kin`, the smallest hash of its word triples (equal for near copies)."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(0)):
                w = text.Words(buf, off, text.ALNUM)
                _, h, n = text.distinct(*terms_of(w), len(w.count))
                doc, sh, m = text.shingles(w, 3)
                kin = np.zeros(len(n), np.uint64)
                if len(sh):
                    kin[m > 0] = np.minimum.reduceat(sh, (np.cumsum(m) - m)[m > 0])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(n)) for c in b.columns[1:]), text.lists(text.signed(h), n), pa.array(text.signed(kin))], [*more, "words", "kin"])

    return rows.select("text", *more).mapInArrow(run, f"{kinds}, words array<long>, kin long")


def sample_words(docs: DataFrame, labels: DataFrame, names: list[str], rows=ROWS) -> DataFrame:
    """The words of the labelled documents that are trained on, with doc_id, _y0, _y1, ... and `kin`: read once and written once."""
    known = labels.dropna(subset=["doc_id", *names]).groupBy("doc_id").agg(*[F.max(F.col(n).cast("int")).alias(f"_y{k}") for k, n in enumerate(names)])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows of a few numbers: safe to broadcast
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return written(_words(one, ["doc_id", *(f"_y{k}" for k in range(len(names)))]), "labelled")


def fit(docs: DataFrame, labels: DataFrame, names: list[str], rows=ROWS, max_terms=MAX_TERMS, min_score=MIN_SCORE) -> Chain:
    """`labels`: doc_id and one 0/1 column per name, in the order of the chain."""
    seen = sample_words(docs, labels, names, rows)
    chain = fit_words(seen, names, max_terms, min_score)
    forget(seen)
    return chain


def fit_weak(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows=ROWS) -> Chain:
    """The chain from one toxic label: a toxic document is of each category of whose terms it holds one; the last link is the label itself."""
    seen = sample_words(docs, labels, ["toxic"], rows)
    marks = [((F.col("_y0") == 1) & _holds(t)).cast("int") for t in categories.values()]
    table_ = seen.select("doc_id", "words", "kin", *[m.alias(f"_y{k}") for k, m in enumerate(marks)], F.col("_y0").alias(f"_y{len(marks)}"))
    chain = fit_words(table_, [*categories, "toxic"])
    forget(seen)
    return chain


def _holds(terms: list[str]):
    return F.arrays_overlap("words", F.array(*[F.lit(int(t)) for t in word_hashes(terms).view(np.int64)]))


def fit_words(seen: DataFrame, names: list[str], max_terms=MAX_TERMS, min_score=MIN_SCORE) -> Chain:
    """The chain from a table like that of `sample_words`."""
    ys = [f"_y{k}" for k in range(len(names))]
    kin = seen.groupBy("kin").agg(F.min("doc_id").alias("doc_id"))
    kept = seen.join(F.broadcast(kin), ["kin", "doc_id"])
    if kept.select("doc_id").groupBy("doc_id").count().filter("count > 1").limit(1).count():  # repeated rows; else the words need not be dealt anew
        kept = kept.dropDuplicates(["doc_id"])
    totals = kept.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n = totals["n"]
    if not n:
        return Chain(names, np.zeros(0, np.uint64), [np.concatenate([[-40.0], np.zeros(k)]) for k in range(len(names))])
    per = kept.select(F.explode("words").alias("term"), *ys).groupBy("term").agg(F.count(F.lit(1)).alias("c"), *[F.sum(y).alias(y) for y in ys])

    def statistic(y):
        a, c, t = F.col(y).cast("double"), F.col("c").cast("double"), float(totals[y] or 0)
        cells = [(a, c * t / n), (c - a, c * (n - t) / n), (t - a, (n - c) * t / n), (n - t - c + a, (n - c) * (n - t) / n)]
        g = sum((F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
        return F.when(a > MIN_LIFT * c * t / n, g).otherwise(0.0)

    best = per.withColumn("score", F.greatest(*[statistic(y) for y in ys], F.lit(0.0))).filter(F.col("score") >= min_score)
    terms = np.sort(np.array([r["term"] for r in best.orderBy(F.desc("score"), "term").limit(max_terms).collect()], np.int64).view(np.uint64))
    wanted = {int(t): i for i, t in enumerate(terms.view(np.int64))}
    hit = F.array_intersect("words", F.array(*[F.lit(int(t)) for t in wanted])) if wanted else F.array().cast("array<bigint>")
    got = kept.select("doc_id", hit.alias("t"), *ys).collect()  # at most `rows` short rows
    got.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        x[i, [wanted[t] for t in r["t"]]] = 1
    y = np.array([[r[c] for c in ys] for r in got], float)
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in got])
    x = linear.with_one(x)
    weights = []
    for k in range(len(names)):
        weights.append(linear.fit(x, y[:, k], RIDGE))
        apart = np.zeros(len(x))
        for f in range(FOLDS):
            apart[fold == f] = linear.sigmoid(x[fold == f] @ linear.fit(x[fold != f], y[fold != f, k], RIDGE))
        x = np.concatenate([x, apart[:, None]], axis=1)
    return Chain(names, terms, weights)


def score(docs: DataFrame, chain: Chain, threshold=THRESHOLD) -> DataFrame:
    """doc_id, one probability p_<name> per category and `flagged`: the last category's probability reaches the threshold."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"p_{n} double" for n in chain.names) + ", flagged boolean"
    names = ["doc_id", *(f"p_{n}" for n in chain.names), "flagged"]

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(1)):
                w = text.Words(buf, off, text.ALNUM)
                present = np.zeros((len(w.count), len(chain.terms)))
                if len(chain.terms) and len(w.hash):
                    doc, h = terms_of(w)
                    at = np.minimum(np.searchsorted(chain.terms, h), len(chain.terms) - 1)
                    ok = chain.terms[at] == h
                    present[doc[ok], at[ok]] = 1
                p = chain.probabilities(present)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(p)), *(pa.array(p[:, k].copy()) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def weak_labels(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows=ROWS) -> DataFrame:
    """Labels for the chain from one toxic label: a toxic document is of each category of whose terms it holds one.

    Only the documents of `fit`'s sample are read for it."""
    known = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    words = _words(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "toxic"])
    return words.select("doc_id", *[((F.col("toxic") == 1) & _holds(t)).cast("int").alias(c) for c, t in categories.items()], "toxic")


@query("op10_toxicity")
def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return score(docs, fit_weak(docs, table(spark, sf, "labels")))

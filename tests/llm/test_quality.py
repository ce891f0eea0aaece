import numpy as np
import pyarrow as pa
import pytest

from flowglass.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    views = Q.fit(docs, labels.filter("doc_id % 4 <> 0"))
    rows = Q.score(docs, views).collect()
    assert len(rows) == docs.count()
    keep = {r.doc_id: r.keep for r in rows}
    test = {r.doc_id: r.quality for r in labels.filter("doc_id % 4 = 0").collect()}
    good, bad = ([keep[i] for i, q in test.items() if q == k] for k in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    kept = Q.select_good(docs, views)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in keep.items() if k}


@pytest.mark.parametrize("some", [True, False])
def test_edges(spark, some):
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0), (1, None, None, None, None, 1.0), (2, "", "en", "s", -5, 2.0), (None, "x " * 90_000, "de", None, 180000, 3.0), (4, "|||", "xx", "src1", 3, 0.0)],
                                 "doc_id long, text string, lang string, source string, n_chars long, quality_score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)] if some else [], "doc_id long, quality int")
    views = Q.fit(docs, labels)
    rows = Q.score(docs, views).collect()
    assert len(rows) == 5 and all(r.keep for r in rows)
    assert Q.select_good(docs, views).columns == docs.columns and Q.select_good(docs, views).count() == 5
    assert Q.score(docs.filter("doc_id > 9"), views).count() == 0
    assert Q.score(docs.select("doc_id", "text"), views).count() == 5


def test_sources_with_equal_ends_differ():
    hosts = ["good.example.com", "spam.example.com"]
    a, b = Q.metadata(pa.array(["en", "en"]), pa.array(hosts), pa.array([100, 100]))
    assert not np.array_equal(a, b)
    a, b = Q.metadata(pa.array(["a-long-language-tag", "b-long-language-tag"]), pa.array(["src1", "src1"]), pa.array([100, 100]))
    assert not np.array_equal(a, b)


def newton(x, y, weight, w, ridge, steps, least):
    """Plain Newton steps on the weighted log loss."""
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for row, t, q, k in zip(x, y, p, weight):
            g += k * (q - t) * row
            h += k * q * (1 - q) * np.outer(row, row)
        pen = np.full(len(w), ridge)
        pen[0] = 1e-6
        move = np.linalg.solve(h + np.diag(pen), g + pen * w)
        new = w - move * min(1.0, 8.0 / max(1e-12, np.abs(move).max()))
        done, w = np.abs(new - w).max() < least, new
        if done:
            break
    return w


def test_rounds_recomputed_plainly(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("doc_id % 2 = 0")
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(Q.HELD_OUT)) == 0).alias("h")).collect()}
    rows = Q.features(docs).collect()
    one = lambda c: np.array([[1.0, *getattr(r, c)] for r in rows])
    x = [one("content"), one("metadata")]
    y = np.array([known.get(r.doc_id, -1) for r in rows])
    train = (y >= 0) & np.array([not held[r.doc_id] for r in rows])
    # two views that train together stop together
    def both(designs, w, steps):
        for _ in range(steps):
            new = [newton(a, b, c, v, 1.0, 1, 0) for (a, b, c), v in zip(designs, w)]
            stop = max(np.abs(n - o).max() for n, o in zip(new, w)) < 1e-4
            w = new
            if stop:
                break
        return w

    w = both([(v, (y > 0).astype(float), train.astype(float)) for v in x], [np.zeros(v.shape[1]) for v in x], 7)
    first, given = [v.copy() for v in w], 0
    for _ in range(Q.ROUNDS):
        designs = []
        for k in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(x[1 - k] @ w[1 - k], -40, 40)))
            new = (y < 0) & ((p >= Q.CONFIDENT) | (p <= 1 - Q.CONFIDENT))
            given += new.sum()
            designs.append((x[k], np.where(new, p > 0.5, y > 0).astype(float), np.where(new, Q.PSEUDO_WEIGHT, train).astype(float)))
        w = both(designs, w, 3)
    views = Q.fit(docs, labels)
    assert given > 20
    for mine, theirs in zip(w, (views.content, views.metadata)):
        assert np.abs(mine - theirs).max() < 1e-6 * max(1, np.abs(mine).max())
    assert any(np.abs(a - b).max() > 1e-3 for a, b in zip(first, w))  # the exchange changes the views

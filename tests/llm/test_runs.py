import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowglass.llm import runs as R
from flowglass.llm.recompression import compress

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=12):
    """(start, length, period) of all runs, comparing word by word."""
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def brute(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_query_is_brute_force(spark):
    df = R.op13_periodic_runs(spark, SF)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 30_000]
    ids = {r[0] for r in rows}
    got = [tuple(r) for r in df.collect()]
    assert Counter(r for r in got if r[0] in ids) == brute(rows) and sum(r[1] for r in got) > 10


def test_extensions():
    rng = random.Random(3)
    for kind in range(40):
        n = rng.choice([1, 2, 5, 60, 400])
        body = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
        if kind % 3 == 0:
            body = (body[: max(1, n // 7)] * n)[:n]
        s = np.array([1000, *body, 1001])
        g = compress(s)
        m = g.mirrored()
        a = np.array([rng.randrange(1, n + 1) for _ in range(200)])
        b = np.array([rng.randrange(1, n + 1) for _ in range(200)])
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        for x, y, right, left in zip(a, b, g.extension(a, b), m.extension(len(s) - a, len(s) - b)):
            k = 0
            while s[x + k] == s[y + k]:
                k += 1
            j = 0
            while s[x - 1 - j] == s[y - 1 - j]:
                j += 1
            assert (right, left) == (k, j)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(R, "CANDIDATES", 5)
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        n = rng.choice([0, 1, 11, 12, 40, 90])
        w = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a, p = rng.randrange(n // 2), rng.randrange(1, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        texts.append(w)
    got = R.find_runs(np.array([x for t in texts for x in t], np.uint64), np.array([len(t) for t in texts]))
    assert list(zip(*(x.tolist() for x in got))) == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_edges(spark):
    long = "lorem " * 30_000
    rows = [(1, None), (1, None), (2, ""), (3, " \t\n "), (None, "a b " * 9), (None, "x"), (4, "Same same " * 6), (5, "ß ü\x0b" * 8 + "end"), (5, "ß ü\x0b" * 8 + "end"), (6, "  a" * 6), (8, "w " * 11), (9, "w " * 12),
            *[(i, f"one two three {i} " * 20) for i in range(20, 60)]]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, runs string, n_words int")
    query = lambda docs: Counter(tuple(r) for r in _digest(docs).collect())
    assert query(df) == brute(rows)
    got = R.runs(spark.createDataFrame([(11, long)], "doc_id long, text string")).first()
    assert got.collapsed == "lorem" and [tuple(r) for r in got.runs] == [(0, 30_000, 1)] and got.n_words == 30_000
    assert R.runs(df.filter("doc_id > 99")).count() == 0
    names = R.runs(spark.createDataFrame([("k", "a b c " * 5)], "doc_id string, text string")).first()
    assert (names.doc_id, names.collapsed) == ("k", "a b c")


def _digest(docs, monkey=None):
    original = R.table
    try:
        R.table = lambda spark, sf, name: docs
        return R.op13_periodic_runs(docs.sparkSession, "")
    finally:
        R.table = original

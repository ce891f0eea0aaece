import random
import re

import numpy as np
import pytest

from flowglass.llm import minhash as M

WORD = re.compile("[^\x20\x09-\x0D]+")


def sets_of(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(docs, size, percent=80):
    sets = [(d, sets_of(t, size)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, (d, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        for j in {j for x in s for j in holders[x] if j < i}:
            e, t = sets[j]
            both = len(s & t)
            if e is not None and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return sorted(((d, len(s), root(d) if d is not None and s else d, d is None or not s or root(d) == d) for d, s in sets), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(M.op4_minhash(spark, sf)) == brute(docs, 4)


def near(seed, base, edits):
    r = random.Random(seed)
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("chunk", [10**6, 2000, 400])
def test_large_groups_and_shared_passages(spark, chunk):
    r = random.Random(4)
    fresh = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    base, passage = fresh(150), fresh(60)
    texts = [near(i, base, 1 + i % 12) for i in range(120)] + [fresh(25) + " " + passage + " " + fresh(20) for _ in range(60)] + [base] * 40 + [fresh(100) for _ in range(20)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(M.near_duplicates(df, 4, chunk=chunk)) == brute(docs, 4)


def test_forest_joins_what_similar_pairs_join():
    r = np.random.default_rng(5)
    for first in (30, 12):
        base = r.integers(0, 10**6, 60)
        sets = [np.unique(np.where(r.random(60) < r.choice([0, 0.05, 0.1, 0.4]), r.integers(0, 10**6, 60), base)) for _ in range(30)]
        off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        group = np.arange(30)
        group[3], group[20] = 1, 19
        links = M.forest(np.concatenate(sets), off, group, first, 80)
        want, got = group.copy(), group.copy()
        for i in range(first):
            for j in range(i + 1, 30):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[j]] = want[i]
        for i, j in links:
            got[got == got[j]] = got[i]
        same = lambda g: g[:, None] == g[None, :]
        assert (same(want) == same(got)).all() and len(links) < 30


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"), (6, "one"), (9, "a b c d e f"), (9, "a b c d e f"), (8, "x " * 60_000), (12, "ÄB c d e"), (13, "äb c d e")]
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, kept string")
    assert rows_of(M.near_duplicates(df)) == brute(docs, 5)
    out = M.dedup(df)
    assert out.columns == df.columns and sorted((x.doc_id or 0) for x in out.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 9, 12, 13]
    none = df.filter("doc_id > 99")
    assert M.near_duplicates(none).count() == 0 and M.dedup(none).count() == 0


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(2)
    for size in (3, 40, 700):
        union = r.integers(0, 2**63, size * 2, dtype=np.uint64)
        a, b = union[: int(size * 1.6)], union[int(size * 0.4) :]
        doc = np.repeat([0, 1, 2], [len(a), len(b), len(a)])
        sig = M.super_minhash(doc, np.concatenate([a, b, a[::-1]]), 3, 240)
        assert (sig[0] == sig[2]).all()
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.13
        for row, e in ((0, a), (1, b)):
            assert len(np.unique(sig[row])) == 240 if len(e) == 1 else True

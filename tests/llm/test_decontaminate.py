import hashlib
import re

import numpy as np

from flowglass.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            grams.setdefault(tuple(w[p : p + size]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for s in sizes:
            for p in range(len(w) - s + 1):
                got = grams.get(tuple(w[p : p + s]))
                if got:
                    hit.update(range(p, p + s))
                    ids |= {x for x in got if x is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_is_brute_force(spark):
    read = lambda n, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{n}.parquet").select(*c).collect()]
    want = brute(read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"]))
    assert sorted((tuple(r) for r in D.op5_decontamination(spark, SF).collect()), key=repr) == want
    assert any(r[5] for r in want)


def test_edges_blocks_and_shards(spark):
    p = "Alpha beta gamma Delta eins zwei drei vier fünf sechs sieben acht"
    docs = [(1, None), (2, ""), (3, p), (3, p), (4, "x " + re.sub("[a-z]", lambda m: m[0].upper(), p) + " y " + p), (5, "eins zwei"), (None, "kurz und klein"), (6, "lang " * 3000 + p), (7, "zwei drei vier")]
    items = [(1, p), (2, p), (3, None), (4, "?!"), (5, "Eins, zwei!"), (None, "kurz und"), (6, " ".join(p.split()[::-1])), (7, "absent words")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for shard, block in ((D.SHARD, D.BLOCK), (5, 7)):
        got = D.find_matches(d, b, shard=shard, block=block).collect()
        full = [(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(sorted(map(str, r.item_ids))).encode()).hexdigest(), r.n_hit > 0) for r in got]
        assert sorted(full, key=repr) == brute(docs, items)
        assert {(m.item_id, m.item_start, m.doc_start, m.n_words) for r in got if r.doc_id == 4 for m in r.matches} == {
            (i, 0, s, 12) for i in (1, 2) for s in (1, 14)} | {(5, 0, 5, 2), (5, 0, 18, 2)}
        kept = D.clean(d, b, shard=shard, block=block)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 7]
    none = b.filter("item_id > 99")
    assert D.clean(d, none).count() == len(docs) and all(r.n_hit == 0 for r in D.find_matches(d, none).collect())
    assert D.find_matches(d.filter("doc_id > 99"), b).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, k in ((0, 3), (1, 3), (300, 3), (300, 1), (300, 200)):
        r = rng.integers(0, k, n)
        got = D.suffix_order(r, n)
        assert [tuple(r[i:]) for i in got] == sorted(tuple(r[i:]) for i in range(n))

import hashlib
import random
from collections import Counter

import pyarrow as pa

from flowglass.llm import fingerprints as P

SF = "/root/testdata/sf0.001"


def brute(docs):
    rows = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        own, ed, ne = (P.vectors(pa.array([x])) for x in (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.encode(*own)[0], P.encode(*ed)[0], float(P.likeness(own, ed)[0]), float(P.likeness(own, ne)[0])))
    return Counter(out)


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [tuple(r) for r in P.op9_fingerprints(spark, SF).collect()]
    assert Counter(rows) == brute(docs)
    n = len(rows)
    assert 0.35 < sum(r[5] for r in rows) / n < 0.65 and sum(r[6] for r in rows) / n < 0.1


def test_edges(spark):
    docs = [(5, None), (5, None), (None, "null id ß"), (7, ""), (9, "a\nb\n\nc c c c"), (9, "a\nb\n\nc c c c"), (11, "😀" * 9), (12, "w " * 30000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    assert Counter(tuple(r) for r in P.edited_likeness(df).collect()) == brute(docs)
    assert P.edited_likeness(df.filter("doc_id > 99")).count() == 0
    one = df.filter("doc_id = 12")
    assert Counter(tuple(r) for r in P.edited_likeness(one).collect()) == brute([docs[-1]])


def test_multiset():
    f = lambda t: P.encode(*P.vectors(pa.array([t])))[0]
    lines = [f"line {i} of some words {i * i}" for i in range(12)] + ["twice", "twice"]
    mixed = lines[:]
    random.Random(1).shuffle(mixed)
    assert f("\n".join(lines)) == f("\n".join(mixed)) == f("\n\n".join(mixed) + "\n")
    assert f("\n".join(lines)) != f("\n".join(lines[:-1]))
    assert P.delete(f("\n".join(lines)), "twice") == f("\n".join(lines[:-1]))
    assert P.insert(f("\n".join(lines[1:])), lines[0]) == f("\n".join(lines))
    assert f("") == f("\n\n") and P.decode([f("")])[0].sum() == 0


def triples(doc):
    c = Counter()
    for line in doc.split("\n"):
        w = line.split()
        c.update(zip(w, w[1:], w[2:]))
    return c


def exact(a, b):
    a, b = triples(a), triples(b)
    return min(2 * sum(n * b[k] for k, n in a.items()) / (sum(n * n for n in a.values()) + sum(n * n for n in b.values())), 1.0)


def test_equal_triples_do_not_wrap(spark):
    other = " ".join(f"word{i}" for i in range(3000))
    docs = [(1, "x " * 90000), (2, other), (3, "x " * 240000), (4, "the same line again\n" * 120000), (5, "x " * 130000), (6, "a short last text with other words")]
    rows = {r.doc_id: r for r in P.edited_likeness(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (d, t) in enumerate(docs):
        nxt, k = docs[(i + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        assert abs(rows[d].near_edited - exact(t, edited)) < 0.15 and abs(rows[d].near_next - exact(t, nxt)) < 0.15, d
    assert 0.7 < rows[1].near_edited < 0.9
    assert P.delete(P.insert(rows[1].fingerprint, docs[2][1]), docs[2][1]) == rows[1].fingerprint

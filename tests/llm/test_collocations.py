import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowglass.llm import collocations as C
from flowglass.llm import text

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pieces(t):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for w in pieces(t):
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            gone |= {(lang, p[i : i + m]) for i in range(len(p) - m + 1) if a >= f[lang, p[i : i + m]]}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("every,least", [(16, 20), (2, 8), (1, 15), (10**9, 12)])
def test_whole_texts(spark, every, least, monkeypatch):
    if every == 2:
        monkeypatch.setattr(C, "SLICE", 3000)
        monkeypatch.setattr(C, "MOST_BITS", 64)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = rows_of(C.collocations(spark.createDataFrame(rows, "lang string, text string"), least, 50, every))
    assert got == brute(rows, least, 50) and len(got) > 20


def test_edges(spark):
    rng = random.Random(5)
    rows = [(None, "New York New York. ") for _ in range(6)] + [("und", "new york is new, york\tNEW  york; is new")] * 4 + [("en", None), (None, None), ("en", ""), ("en", " .,\n"), ("fr", "Été à la plage\x0bété à la  plage!")] * 5
    rows += [("en", " ".join(rng.choice("abc") for _ in range(400))), ("en", "x " * 3000), ("en", "ÀB c\x00d e" * 7), ("", "a b c d e f g " * 9), ("en", "one"), ("en", "longer " + "w" * 5000 + " end")]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "lang string, text string, n int, phrase string")
    for least in (2, 5):
        for top in (3, 2000):
            assert rows_of(C.collocations(df, least, top, 4)) == brute(rows, least, top)
    assert C.collocations(df.filter("n > 1")).count() == 0 and C.collocations(df.filter("text is null")).count() == 0


def test_chunks_cover_every_phrase_once():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "b", "Cc", "d,", "e"]) for _ in range(rng.choice([0, 1, 4, 5, 200]))) for _ in range(30)]
    (_, buf, off), = text.slices(pa.array(texts))
    row, chunk, own = C.parse(buf, off, 3)
    got, want = Counter(), Counter()
    for r, c, o in zip(row, chunk.to_pylist(), own):
        w = c.split(" ")
        got.update((r, tuple(w[i : i + m])) for m in range(1, 6) for i in range(min(o, len(w) - m + 1)))
    for r, t in enumerate(texts):
        for w in pieces(t):
            want.update((r, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    assert got == want
    # a shift moves no other chunk border
    (_, a, ao), = text.slices(pa.array(["p q r " + texts[-1].replace(",", "")]))
    (_, b, bo), = text.slices(pa.array([texts[-1].replace(",", "")]))
    one, two = C.parse(a, ao, 3)[1].to_pylist(), C.parse(b, bo, 3)[1].to_pylist()
    assert one[-len(two) + 1 :] == two[1:] or len(two) < 2


def test_counts_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**14, 9 * 10**17, 9 * 10**14, 10**15
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    got = df.selectExpr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) s").first().s
    assert got == 1000 * a * n // (l * r)

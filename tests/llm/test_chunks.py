import random
from collections import Counter

import numpy as np
import pyarrow as pa

from flowglass.llm import chunks as C
from flowglass.llm import text


def one_by_one(data: bytes):
    """Chunk ends by the plain rolling recurrence."""
    out, last, h = [], 0, 0

    def forced(to):
        nonlocal last
        while to - last > C.MAX:
            last += C.MAX
            while last < len(data) and data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)

    for i, b in enumerate(data):
        h = (2 * h + int(C.GEAR[b])) & 0xFFFFFFFF
        end = i + 1
        if h < (1 << 32) // C.MEAN and end >= 32 and not (end < len(data) and data[end] & 0xC0 == 0x80) and end - last >= C.MIN:
            forced(end)
            if end - last >= C.MIN:
                out.append(end)
                last = end
    forced(len(data))
    if len(data) > last:
        out.append(len(data))
    return out


def make(seed, n, letters="abcdefghij éß"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def brute(docs):
    cut = {}
    for d, t in set(docs):
        data = (t or "").encode()
        ends = one_by_one(data)
        cut[d, t] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends)]
    count = Counter(x[2] for d in docs for x in cut[d])
    order = lambda k: (k[0] is not None, k[0] or 0)
    first = {}
    for k in sorted(cut, key=order):
        for a, _, x in cut[k]:
            first.setdefault(x, (k, a))
    out = []
    for k in docs:
        run, removed, rep = [], 0, 0
        for a, b, x in [*cut[k], (None, None, None)]:
            if x is not None and count[x] > 1:
                run.append((a, b, x))
                continue
            if sum(b - a for a, b, _ in run) >= C.RUN:
                rep += sum(b - a for a, b, _ in run)
                removed += sum(b - a for a, b, x in run if first[x] != (k, a))
            run = []
        out.append((k[0], len((k[1] or "").encode()), rep, removed))
    return Counter(out)


def test_cuts_are_the_plain_recurrence():
    texts = ["", "x" * 3000, make(1, 5000), "ü" * 900, make(2, 40), "é" + make(3, 100)]
    (_, buf, off), = text.slices(pa.array(texts))
    row, end = C.cut(buf, off)
    for i, t in enumerate(texts):
        assert (end[row == i] - off[i]).tolist() == one_by_one(t.encode())


def test_insertions_do_not_shift_the_rest():
    a = make(5, 20_000, "abcdefghij ")
    b = a[:7000] + "INSERTED" + a[7000:]
    parts = []
    for t in (a, b):
        (_, buf, off), = text.slices(pa.array([t]))
        ends = C.cut(buf, off)[1].tolist()
        parts.append({t[x:y] for x, y in zip([0, *ends], ends)})
    assert len(parts[1] - parts[0]) <= 6


def test_query_and_dedup(spark, tmp_path):
    p = make(9, 400)
    docs = [(1, make(11, 900) + p + make(12, 300)), (2, p), (3, make(13, 50) + p), (5, None), (6, ""), (None, make(14, 300) + p), (7, make(15, 5000)), (8, "ab " * 4000), (9, p), (9, p), (10, make(16, 60))]
    df = spark.createDataFrame([(*d, "x", i) for i, d in enumerate(docs)], "doc_id long, text string, removed string, start int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = C.op3_chunk_dedup(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_repeated, r.n_removed) for r in got) == brute(docs)
    out = C.dedup(df)
    assert out.columns == df.columns
    kept = {r.start: r for r in out.collect()}
    assert kept[0].text == docs[0][1][:0] + kept[0].text and len(kept) == len(docs)
    sizes = {(r.doc_id, r.n_bytes): r.n_bytes - r.n_removed for r in got}
    for i, d in enumerate(docs):
        assert len((kept[i].text or "").encode()) == sizes[d[0], len((d[1] or "").encode())] and kept[i].removed == "x"
    assert kept[3].text is None and kept[6].text == docs[6][1]
    assert C.dedup(df.filter("doc_id > 99")).count() == 0


def test_counts_are_written_before_the_join_back(spark, monkeypatch):
    shared = " ".join(f"shared{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{shared} own {i}") for i in range(12)], "doc_id long, text string")
    sides, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, *a, **k: sides.append(other) or join(self, other, *a, **k))
    assert C.repeated(docs).count() == 12
    assert len(sides) == 1 and "Aggregate" not in sides[0]._jdf.queryExecution().optimizedPlan().toString()

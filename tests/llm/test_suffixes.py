import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowglass.llm import induced, suffixes as S, text


def brute(docs, length=400):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def saved(spark, docs, path):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    df.write.parquet(f"{path}/documents.parquet")
    return df


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(S.op8_suffix_dedup(spark, sf)) == brute(docs)


def make(r, n, letters="abcdefgh éß\n"):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("group", [256, 2])
def test_copies_passages_and_runs(spark, tmp_path, monkeypatch, group):
    whole = S.repeated_windows
    monkeypatch.setattr(S, "repeated_windows", lambda docs, length=400, **how: whole(docs, length, shard=5000, group=group))
    r = random.Random(group)
    p, q = make(r, 450), make(r, 380)
    edge = "".join(r.choice("xyz") for _ in range(399))
    docs = [(i, make(r, r.randrange(300)) + p + make(r, r.randrange(300))) for i in range(12)]
    docs += [(100 + i, make(r, 200) + q + make(r, 200)) for i in range(6)]
    docs += [(200, "ab" * 700), (201, "z" * 900), (202, "z" * 399), (203, edge + "1"), (204, edge + "2"), (205, edge + "1"), (206, None), (207, ""), (None, p), (208, p + p), (209, p[:420]), (209, p[:420])]
    base = make(r, 3000)
    docs += [(300 + i, base[: 200 * i] + "#" + base[200 * i :]) for i in range(12)]
    df = saved(spark, docs, str(tmp_path))
    want = brute(docs)
    assert rows_of(S.op8_suffix_dedup(spark, str(tmp_path))) == want
    out = S.dedup(df)
    assert out.columns == df.columns
    kept = sorted((x.doc_id if x.doc_id is not None else -1, len((x.text or "").encode())) for x in out.collect())
    full = sorted((d if d is not None else -1, n - gone) for d, n, gone, _, _ in want)
    assert [k[0] for k in kept] == [f[0] for f in full] and all(f[1] - 8 <= k[1] <= f[1] for k, f in zip(kept, full))


def test_nothing(spark, tmp_path):
    df = saved(spark, [(1, "a")], str(tmp_path)).filter("doc_id > 5")
    assert S.dedup(df).count() == 0


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_arrays(monkeypatch, small):
    monkeypatch.setattr(induced, "SMALL", small)
    r = np.random.default_rng(5)
    for _ in range(150):
        n, k = int(r.integers(0, 60)), int(r.integers(1, 5))
        s = r.integers(0, k, n)
        sa = induced.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))
        if n:
            before, _ = induced.permuted_prefixes(s, sa, np.full(n, n))
            for a, b in zip(sa[:-1], sa[1:]):
                m = 0
                while max(a, b) + m < n and s[a + m] == s[b + m]:
                    m += 1
                assert before[b] == m


class Task:
    """Stands for a table and hands out what one of its tasks runs."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema = spark, spark.createDataFrame([], schema).schema

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, schema):
        return run


def peak(run, batch):
    """(MB that numpy and Python held at most, rows out) of a task over one batch."""
    tracemalloc.start()
    rows = sum(len(b) for b in run([batch]))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, rows


def test_a_task_holds_little_at_once(spark, monkeypatch):
    monkeypatch.setattr(text, "_POWERS", {})
    r = random.Random(3)
    words = [make(r, r.randrange(2, 9), "abcdefgh") for _ in range(5000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(1400)]
    n = len(texts)
    assert sum(map(len, texts)) > 3e6
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["doc_id", "_text", "text"])
    most, rows = peak(S._anchored(Task(spark, "doc_id long, text string"), 400), batch)
    assert rows > n and most < 80
    data = [x for t in texts[:400] for x in (t[:450].encode(), t[:420].encode() + b"-" * 30)]
    keys = pa.array([i // 2 for i in range(len(data))])
    place = [pa.array(range(len(data))), keys, pa.array([0] * len(data), pa.int32()), keys, keys, pa.array(data, pa.binary())]
    shard = pa.RecordBatch.from_arrays([pa.concat_arrays([x, x]) for x in place], ["doc_id", "_text", "start", "k1", "k2", "data"])
    shard = shard.set_column(3, "k1", pa.array([i // 2 for i in range(len(shard))])).set_column(4, "k2", pa.array([i // 2 for i in range(len(shard))]))
    most, rows = peak(S._shards(Task(spark, "doc_id long"), 400, S.SHARD), shard)
    assert rows == len(shard) and most < 80


def test_a_line_that_fills_texts_is_one_row_a_text(spark, tmp_path):
    r = random.Random(11)
    line = make(r, 90, "abcdefgh ") + "\n"
    kept = []
    for n in (15, 30):
        docs = [(i, make(r, 60, "klmnop") + line * 25) for i in range(n)] + [(n, make(r, 700))]
        df = saved(spark, docs, f"{tmp_path}/{n}")
        rows = S._anchored(df.select("doc_id", "text"), 400).collect()
        assert len({(x.doc_id, *(x[c] for c in S.KEY)) for x in rows}) == len(rows)
        want = []
        for d, t in docs:
            b = np.frombuffer(t.encode(), np.uint8)
            _, start, windows, *_ = S.contexts(b, np.array([0, len(b)]))
            want += [(d, s, w) for s, w in zip(start.tolist(), windows.tolist())]
        assert sorted((x.doc_id, s, x.windows) for x in rows for s in x.starts) == sorted(want)
        assert all(x.n == len(x.starts) for x in rows) and len(want) > len(rows) + 15 * n
        kept.append(len(rows))
        assert rows_of(S.op8_suffix_dedup(spark, f"{tmp_path}/{n}")) == brute(docs)
    assert kept[1] <= 2 * kept[0]

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowglass.llm import packing, tokens

SF = "/root/testdata/sf0.001"


def check(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for spots in at.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(at)


def brute(docs, capacity):
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter()
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        head = len(ids) % capacity or min(capacity, len(ids))
        bounds = [0, *range(head, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


@pytest.mark.parametrize("capacity", [2048, 64])
def test_documents(spark, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute([(r.doc_id, r.text) for r in docs.collect()], capacity)
    total = sum(r.length for r in rows)
    assert check(rows, capacity) <= -(-total // capacity) * 1.02 + 1


def test_edges(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "a b c " * 50), (2, "a b c " * 50), (3, "x")]
    df = spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, length int, sequence_id string")
    rows = packing.pack(df, 32, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute(docs, 32)
    check(rows, 32)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack(df.filter("doc_id > 9"), 32).count() == 0


def test_local_search_never_worse():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(rng.integers(20, 60, 80).tolist())
        start = Counter((s,) for s, n in counts.items() for _ in range(n))
        for bins in (packing.best_fit(counts, 100), start):
            after = packing.local_search(bins, 100)
            got = Counter()
            for kind, n in after.items():
                assert sum(kind) <= 100
                for s in kind:
                    got[s] += n
            assert got == counts and sum(after.values()) <= sum(bins.values())
            assert sum(n * sum(k) ** 2 for k, n in after.items()) >= sum(n * sum(k) ** 2 for k, n in bins.items())

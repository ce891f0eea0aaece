import math
import random
from collections import Counter

import numpy as np
import pytest

from flowglass.llm import ball_tree as B

KIND = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, k=5, every=50):
    """Rows of (id, vector); equal query rows count once."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        s = sorted((-max(min(sum(a * b for a, b in zip(q, v)), B.HIGH), B.LOW + 1), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s[:k])]
    return Counter(out)


def found(spark, rows, k=5, shard=8192, leaf=256, block=4096):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    index = B.build(df, shard=shard, leaf=leaf)
    return Counter(tuple(r) for r in B.search(index, df.filter("vec_id % 50 = 0"), k, block=block).collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = B.op12_ball_tree_top_k(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("shard,leaf,block,pilot", [(40, 4, 3, 4), (25, 25, 100, 1000), (7, 1, 1, 2)])
def test_waves_blocks_and_ties(spark, monkeypatch, shard, leaf, block, pilot):
    monkeypatch.setattr(B, "PILOT", pilot)
    rng = random.Random(shard)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [0.9, 0.9, 0.9, 0.9]) for i in range(150)]  # a third is one vector
    rng.shuffle(rows)
    assert found(spark, rows, 5, shard, leaf, block) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.001]), (50, [-1.0, 0.001]), (50, [3.0, 4.0]), (7, None), (8, [1.0, None]), (9, [nan, 1.0]), (100, [inf, 1.0]), (None, [5.0, 5.0]), (150, None),
            (3, [2.0, 2.0]), (3, [2.0, 2.0]), (4, [1.0, 2.0, 3.0]), (200, [1.0, 1.0, 1.0]), (250, []), (6, []), (300, [9.0]), (-50, [0.5, -0.5])]
    assert found(spark, rows) == brute(rows)
    big = [(0, [1e20, 1.0]), (1, [1e20, -1.0]), (2, [-1e20, 1.0]), (3, [1e6, 1e6]), (50, [4e6, 3e6]), (4, [1e6, 1e6 - 1 / 256]), (5, [1e7, -1e7])]
    assert found(spark, big) == brute(big)
    assert found(spark, [(1, [1.0])]) == Counter() and found(spark, []) == Counter()


def test_balls_are_left_closed():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.01, (500, 8)) for c in (-1, 0, 1, 2)]))
    ids = np.arange(len(x))
    order, centre, radius, low, tree = B.ball_tree(x, ids, 50)
    assert sorted(order) == list(ids)
    shard = dict(dims=8, ids=ids[order].tobytes(), kind="<f8", vectors=x[order].tobytes(), centre=centre.tobytes(), radius=radius.tobytes(), low=low.tobytes(), tree=tree.tobytes())
    q, best = x[::100], B.Best(20, 5)
    assert B.search_shard(shard, q, ids[::100], best) < 0.5 * len(q) * len(x)
    again = B.Best(20, 5)
    again.floor[:], again.floor_id[:] = best.last(np.arange(20))
    assert B.search_shard(shard, q, ids[::100], again) <= 0.5 * len(q) * len(x)
    assert ((again.score > again.floor[:, None]) | (again.score == B.LOW) | (again.score == again.floor[:, None])).all()

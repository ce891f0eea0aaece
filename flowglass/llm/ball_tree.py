"""Exact top-k inner-product search with a ball tree per shard, branch and bound, and a shared k-th score.

`build` cuts the rows of every partition into shards of at most `SHARD` vectors of one length and stores each with its tree: balls with
centre, radius and smallest id, split at the median between two far points down to `LEAF` vectors.  Equal vectors are split by id.

`search` works on blocks of about `BLOCK` queries.  A block travels to the shards; in a shard, balls wait in a queue ordered by the
upper bound q.c + |q| r of the inner product and are opened only for those queries whose k-th result so far they can still beat (or
equal with a smaller id).  The k-th results pass from shard to shard within a task, and from a first wave of shards (one in `PILOT`) to all others.
Bounds are rounded upwards, so nothing is lost; the results are exact whatever the shape of the data.  What the driver holds is one block.

Vectors that are null or hold null or non-finite components take no part, nor do rows without id or vectors that leave the range of doubles when
quantised.  Vectors of different length are not compared.  A query is never its own result: rows of its id are left out.  Equal query rows
(same id, same vector) are answered once; as candidates, repeated rows count each.  Scores beyond 64 bits count as the largest or
smallest long.  An empty table gives no rows; only the id and the vector are read."""
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from .store import folder, forget, written

SHARD = 8192
LEAF = 256
BLOCK = 4096
PILOT = 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1
SHARDS = "dims int, kind string, ids binary, vectors binary, centre binary, radius binary, low binary, tree binary"


def quantised(column, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows that take part and their vectors floor(scale * x) as doubles, by vector length."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_list(pa.float64()))
    size = pa.compute.fill_null(pa.compute.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    flat = pa.compute.list_flatten(a).to_numpy(zero_copy_only=False)  # nulls become NaN
    off = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    with np.errstate(over="ignore"):
        x = np.floor(scale * flat)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    fine = (size >= 0) & (bad[off[1:]] == bad[off[:-1]])
    out = []
    for d in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == d))
        out.append((rows, x[off[rows][:, None] + np.arange(d)]))
    return out


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    top = np.abs(x).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def ball_tree(x: np.ndarray, ids: np.ndarray, leaf=LEAF):
    """The order of the rows and the nodes in it: centre, radius, smallest id, and (start, end, left child, right child; 0: leaf)."""
    order = np.argsort(ids, kind="stable")
    centre, radius, low, tree = [], [], [], []

    def ball(a, b):
        p = x[order[a:b]]
        c = p[0] if (p == p[0]).all() else p.mean(0)
        centre.append(c)
        radius.append(np.sqrt(((p - c) ** 2).sum(1).max()))
        low.append(ids[order[a:b]].min())
        tree.append([a, b, 0, 0])
        return len(tree) - 1

    todo = [ball(0, len(x))]
    while todo:
        node = todo.pop()
        a, b = tree[node][:2]
        if b - a <= leaf:
            continue
        part = order[a:b]
        half = len(part) // 2
        if radius[node]:
            p = x[part]
            one = p[((p - centre[node]) ** 2).sum(1).argmax()]
            other = p[((p - one) ** 2).sum(1).argmax()]
            order[a:b] = part[np.argpartition(p @ (other - one), half)]
        else:
            order[a:b] = part[np.argsort(ids[part], kind="stable")]
        tree[node][2:] = ball(a, a + half), ball(a + half, b)
        todo += tree[node][2:]
    return order, np.array(centre), np.array(radius), np.array(low, np.int64), np.array(tree, np.int32)


def build(vectors: DataFrame, id_col="vec_id", vector_col="embedding", scale=256.0, shard=SHARD, leaf=LEAF) -> DataFrame:
    """One row per shard, written to the shared folder."""

    def pack(ids, x):
        order, centre, radius, low, tree = ball_tree(x, ids, leaf)
        kind, data = _packed(x[order])
        row = [x.shape[1], kind, ids[order].astype("<i8").tobytes(), data, centre.tobytes(), radius.tobytes(), low.tobytes(), tree.tobytes()]
        kinds = [pa.int32(), pa.string()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in SHARDS.split(", ")])

    def run(batches):
        held = {}  # by length: rows waiting for their shard
        for b in batches:
            ids = b.column(0).cast(pa.int64())
            for rows, x in quantised(b.column(1), scale):
                known = ids.is_valid().to_numpy(zero_copy_only=False)[rows]
                rows, x = rows[known], x[known]
                d = x.shape[1]
                old = held.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                n, v = np.concatenate([old[0], ids.take(pa.array(rows)).to_numpy(zero_copy_only=False)]), np.concatenate([old[1], x])
                while len(n) >= shard:
                    yield pack(n[:shard], v[:shard])
                    n, v = n[shard:], v[shard:]
                held[d] = n, v
        for n, v in held.values():
            if len(n):
                yield pack(n, v)

    return written(vectors.select(id_col, vector_col).mapInArrow(run, SHARDS), "shards")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as 64-bit numbers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if bound < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(q) @ whole(x).T
    return np.frompyfunc(lambda v: min(max(v, LOW + 1), HIGH), 1, 1)(exact).astype(np.int64)


class Best:
    """The k best (score, id) of every query so far, LOW in free places, and what a result must beat in any case."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), LOW, np.int64), np.full((n, k), HIGH, np.int64)
        self.floor, self.floor_id = np.full(n, LOW, np.int64), np.full(n, HIGH, np.int64)

    def last(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, i, f, j = self.score[at, -1], self.id[at, -1], self.floor[at], self.floor_id[at]
        outside = (f > s) | ((f == s) & (j < i))
        return np.where(outside, f, s), np.where(outside, j, i)

    def put(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray):
        """Results (query, score, id), any number per query."""
        some, k = np.unique(at), self.score.shape[1]
        q = np.concatenate([at, np.repeat(some, k)])
        s = np.concatenate([score, self.score[some].ravel()])
        i = np.concatenate([ids, self.id[some].ravel()])
        order = np.lexsort((i, ~s, q))  # ~s falls as s grows, without passing 64 bits
        q, s, i = q[order], s[order], i[order]
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        keep = rank < k
        self.score[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = s[keep], i[keep]


def search_shard(shard: dict, q: np.ndarray, q_ids: np.ndarray, best: Best) -> int:
    """Improves `best` by the vectors of a shard; returns the number of (query, vector) products."""
    d = shard["dims"]
    ids = np.frombuffer(shard["ids"], "<i8")
    x = np.frombuffer(shard["vectors"], shard["kind"]).reshape(len(ids), d)
    radius = np.frombuffer(shard["radius"])
    centre = np.frombuffer(shard["centre"]).reshape(len(radius), d)
    low, tree = np.frombuffer(shard["low"], np.int64), np.frombuffer(shard["tree"], np.int32).reshape(-1, 4)
    norm = np.sqrt((q * q).sum(1))
    k, done = best.score.shape[1], 0

    def bounds(node, at):
        inner, away = q[at] @ centre[node], norm[at] * radius[node]
        slack = 1e-9 * (norm[at] * np.sqrt((centre[node] ** 2).sum()) + away) + 1e-6
        return np.maximum(np.floor(inner + away + slack), -(2.0**62))

    def entry(node, at, bound):
        return (-float(bound.max()), node, at, bound)

    everyone = np.arange(len(q))
    queue = [entry(0, everyone, bounds(0, everyone))] if len(q) else []
    while queue:
        _, node, at, bound = heapq.heappop(queue)
        last, last_id = best.last(at)
        open_ = (bound > last) | ((bound == last) & (low[node] < last_id))
        at, bound, last = at[open_], bound[open_], last[open_]
        if not len(at):
            continue
        a, b, left, right = tree[node]
        if left:
            for child in (left, right):
                heapq.heappush(queue, entry(child, at, np.minimum(bound, bounds(child, at))))
            continue
        s = products(q[at], x[a:b].astype(np.float64))
        done += s.size
        s[q_ids[at][:, None] == ids[None, a:b]] = LOW
        free = best.score[at, -1] == LOW
        if free.any() and b - a > k:
            last[free] = np.maximum(last[free], np.partition(s[free], b - a - k, axis=1)[:, b - a - k])
        row, col = np.nonzero((s >= last[:, None]) & (s != LOW))
        if len(row):
            best.put(at[row], s[row, col], ids[a:b][col])
    return done


def search(index: DataFrame, queries: DataFrame, k: int, id_col="vec_id", vector_col="embedding", scale=256.0, block=BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `index` (from `build`) for every query row."""
    spark = queries.sparkSession

    def prepare(batches):
        for b in batches:
            for rows, x in quantised(b.column(1), scale):
                ids = b.column(0).cast(pa.int64()).take(pa.array(rows))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                data = pa.array([r.astype("<f8").tobytes() for r, ok in zip(x, known) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(known)), pa.array(np.full(len(data), x.shape[1], np.int32)), data], ["id", "dims", "v"])

    asked = written(queries.select(id_col, vector_col).mapInArrow(prepare, "id long, dims int, v binary").dropDuplicates(), "queries")
    count = asked.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-count // block)
    dealt = written(asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).repartition("block").sortWithinPartitions("block"), "blocks")
    pilot = F.pmod(F.xxhash64("ids"), F.lit(PILOT)) == 0
    waves = [pilot, ~pilot] if index.count() > PILOT else [F.lit(True)]
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    top = folder(spark, "top")
    for number in range(blocks):
        rows = sorted(dealt.filter(F.col("block") == number).collect(), key=lambda r: (r["dims"], r["id"], r["v"]))  # one block: about BLOCK vectors
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["dims"] for r in rows], np.int64), [bytes(r["v"]) for r in rows]))
        floor, parts = np.zeros((0, 3), np.int64), []
        for wave in waves:
            parts.append(written(index.filter(wave).mapInArrow(_answer(sent, spark.sparkContext.broadcast(floor), k), "q int, query_id long, vec_id long, score long"), "answers"))
            best = ranked(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
            if wave is not waves[-1]:
                floor = np.array([(r["q"], r["score"], r["vec_id"]) for r in best.filter(F.col("rank") == k).collect()], np.int64).reshape(-1, 3)
        best.select("query_id", "rank", "vec_id", "score").write.parquet(f"{top}/block={number}")
        forget(*parts)
    forget(asked, dealt)
    return spark.read.schema("query_id long, rank int, vec_id long, score long, block int").parquet(top).drop("block")


def _answer(sent, floor, k):
    """A task's share of the search: all its shards, one after the other, with the k-th results so far."""

    def run(batches):
        ids, dims, data = sent.value
        groups = {}
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            groups[d] = at, np.frombuffer(b"".join(data[at[0] : at[-1] + 1]), "<f8").reshape(len(at), d), Best(len(at), k)
            known = floor.value[np.isin(floor.value[:, 0], at)]
            groups[d][2].floor[known[:, 0] - at[0]], groups[d][2].floor_id[known[:, 0] - at[0]] = known[:, 1], known[:, 2]
        for b in batches:
            for shard in b.to_pylist():
                if shard["dims"] in groups:
                    at, q, best = groups[shard["dims"]]
                    search_shard(shard, q, ids[at], best)
        for at, _, best in groups.values():
            row, place = np.nonzero(best.score != LOW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[row].astype(np.int32)), pa.array(ids[at[row]]), pa.array(best.id[row, place]), pa.array(best.score[row, place])], ["q", "query_id", "vec_id", "score"])

    return run


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.e) = len(q.e))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


@query("op12_ball_tree_top_k", SQL)
def op12_ball_tree_top_k(spark, sf):
    vectors = table(spark, sf, "embeddings")
    index = build(vectors)
    out = search(index, vectors.filter(F.col("vec_id") % 50 == 0), 5)
    forget(index)
    return out

"""Benchmark decontamination with suffix arrays over shards of the training text.

A task gathers documents to a shard of about `SHARD` words, sorts the word suffixes of the shard and looks every test
suffix up by binary search.  The places found give the longest verbatim matches (runs of windows on one diagonal), the
words they cover and the items they come from.  Documents never leave their task, so nothing is shuffled.

Test items reach the tasks in broadcast blocks of at most `BLOCK` words (an item longer than that is a block of its own);
a shard is sorted once and searched block by block.

A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.  Words are runs of digits,
letters and non-ASCII characters, A-Z lower-cased.  Null and empty texts have no words, and items without words match
nothing; an item with a null id marks words but is not listed.  Equal items are all listed; repeated documents are judged
one by one.  With an empty benchmark every document is clean.  `clean` returns the columns of its input, whatever they are."""
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import text

WINDOW = 10
SHARD = 1 << 20
BLOCK = 1 << 20


def suffix_order(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a sequence in the order of their first `depth` members at least (a power of 3 or 2 above)."""
    n = len(ranks)
    step, bits = (3, 21) if n + 2 < 1 << 21 and (not n or ranks.max() < (1 << 21) - 2) else (2, 31)
    r = ranks.astype(np.int64) + 1
    order, known, mask = np.arange(n), 1, None
    while known < depth and n:
        padded = np.concatenate([r, np.zeros((step - 1) * known, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(step):
            key = key << bits | padded[i * known : i * known + n]
        if mask is None:
            order = np.argsort(key)
        else:  # only suffixes that are still tied change places, inside their ties
            part = order[mask]
            order[mask] = part[np.argsort(key[part])]
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        r = np.empty(n, np.int64)
        r[order] = np.cumsum(new)
        known *= step
        mask = ~(new & np.concatenate([new[1:], [True]]))
        if not mask.any():
            break
    return order


def block_of(hashes: list[np.ndarray], ids: list, window: int) -> SimpleNamespace:
    """Test windows: distinct word sequences, and for each the (item, position) pairs it stands at.

    A plain object of arrays, which executors can read without this package."""
    seen: dict[tuple, list] = {}
    for item, h in enumerate(hashes):
        size = min(window, len(h))
        for p in range(len(h) - size + 1 if size else 0):
            seen.setdefault(tuple(h[p : p + size].tolist()), []).append((item, p))
    by_size: dict[int, list] = {}
    for w in seen:
        by_size.setdefault(len(w), []).append(w)
    groups = []
    for _, ws in sorted(by_size.items()):
        at = [seen[w] for w in ws]
        groups.append((np.array(ws, np.uint64), np.array([len(a) for a in at]), np.array([x for a in at for x in a], np.int64).reshape(-1, 2)))
    return SimpleNamespace(ids=ids, groups=groups)


class Shard:
    """Suffix array over the words of some documents; a separator ends each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, window: int):
        n, docs = len(hashes), len(counts)
        self.doc_start = np.cumsum(counts) - counts + np.arange(docs)
        word = np.repeat(self.doc_start - np.cumsum(counts) + counts, counts) + np.arange(n)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
        self.vocabulary = ranked[new]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        self.seq = np.zeros(n + docs, np.int64)
        self.seq[word] = rank
        self.order = suffix_order(self.seq, window)
        self.padded = np.concatenate([self.seq, np.full(window, -1)])

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence, by binary search for both ends of the run of suffixes that start with it."""
        v = self.vocabulary
        if not len(v):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(v, windows), len(v) - 1)
        able = np.flatnonzero((v[at] == windows).all(axis=1))
        want = at[able] + 1
        size = want.shape[1]
        ends = []
        for upper in (False, True):
            lo, hi = np.zeros(len(able), np.int64), np.full(len(able), len(self.order))
            while (active := np.flatnonzero(lo < hi)).size:
                mid = (lo[active] + hi[active]) >> 1
                begin = self.order[mid]
                below = np.full(len(active), upper)
                open_ = np.ones(len(active), bool)
                for i in range(size):
                    a, b = self.padded[begin + i], want[active, i]
                    differs = open_ & (a != b)
                    below[differs] = a[differs] < b[differs]
                    open_ &= ~differs
                lo[active[below]], hi[active[~below]] = mid[below] + 1, mid[~below]
            ends.append(lo)
        n = ends[1] - ends[0]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - ends[0], n)
        return np.repeat(able, n), self.order[place]


def judged(hashes: np.ndarray, counts: np.ndarray, blocks, window: int):
    """Per document: covered words, listed items (distinct), and matches (item, item_start, doc_start, n_words)."""
    shard = Shard(hashes, counts, window)
    docs = len(counts)
    cover = np.zeros(len(shard.seq) + 1, np.int64)
    items = [set() for _ in range(docs)]
    found = [[] for _ in range(docs)]
    for block in blocks:
        for windows, times, spots in block.groups:
            which, place = shard.find(windows)
            if not len(which):
                continue
            size = windows.shape[1]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + size, -1)
            n = times[which]
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - (np.cumsum(times) - times)[which], n)
            item, p = spots[pick].T
            place = np.repeat(place, n)
            order = np.lexsort((place, place - p, item))
            item, p, place = item[order], p[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (p[1:] != p[:-1] + 1)]))
            tail = np.concatenate([head[1:], [len(item)]]) - 1
            doc = np.searchsorted(shard.doc_start, place[head], "right") - 1
            for d, i, a, b, m in zip(doc.tolist(), item[head].tolist(), p[head].tolist(), (place[head] - shard.doc_start[doc]).tolist(), (tail - head + size).tolist()):
                found[d].append((block.ids[i], a, b, m))
                if block.ids[i] is not None:
                    items[d].add(block.ids[i])
    hit = (np.cumsum(cover)[:-1] > 0).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[shard.doc_start + counts] - total[shard.doc_start], items, found


def test_blocks(benchmark: DataFrame, window: int, limit: int) -> list:
    """The items as broadcast blocks; each is made from a bounded part of the table."""
    spark = benchmark.sparkSession

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(1)):
                w = text.Words(buf, off, text.ALNUM)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(w.count)), text.lists(text.signed(w.hash), w.count), pa.array(w.count)], ["item_id", "words", "n"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words array<long>, n long")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // limit)
    if parts > 1:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("item_id", "words"), F.lit(2 * parts)))
    out = []
    for k in range(2 * parts if parts > 1 else min(1, parts)):
        part = (rows.filter(F.col("_part") == k) if parts > 1 else rows).filter("n > 0").collect()
        out.append(spark.sparkContext.broadcast(block_of([np.array(r["words"], np.int64).view(np.uint64) for r in part], [r["item_id"] for r in part], window)))
    return out


def _loaded(blocks):
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            del b._value  # one block at a time in a worker


def _shards(batches, at: int, blocks, window: int, limit: int):
    """Runs of whole rows with their verdicts: (batch, words per row, covered words, items, matches)."""
    held, hashes, counts, size = [], [], [], 0

    def verdict():
        h, c = np.concatenate(hashes), np.concatenate(counts)
        return pa.Table.from_batches(held).combine_chunks(), c, *judged(h, c, _loaded(blocks), window)

    for b in batches:
        for i, buf, off in text.slices(b.column(at)):
            w = text.Words(buf, off, text.ALNUM)
            held.append(b.slice(i, len(w.count)))
            hashes.append(w.hash)
            counts.append(w.count)
            size += len(w.hash)
            if size >= limit:
                yield verdict()
                held, hashes, counts, size = [], [], [], 0
    if held:
        yield verdict()


def find_matches(docs: DataFrame, benchmark: DataFrame, window=WINDOW, shard=SHARD, block=BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (distinct) and matches: the longest verbatim runs with their places."""
    blocks = test_blocks(benchmark, window, block)
    ids, kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    match = f"struct<item_id:{kind},item_start:bigint,doc_start:bigint,n_words:bigint>"
    schema = f"doc_id {ids}, n_words long, n_hit long, item_ids array<{kind}>, matches array<{match}>"

    def run(batches):
        for rows, counts, hit, items, found in _shards(batches, 1, blocks, window, shard):
            as_rows = [[dict(zip(("item_id", "item_start", "doc_start", "n_words"), m)) for m in f] for f in found]
            kinds = arrow_kinds(kind)
            yield from pa.table([rows.column(0), pa.array(counts), pa.array(hit), pa.array([sorted(x) for x in items], pa.list_(kinds)), pa.array(as_rows, pa.list_(pa.struct(
                [("item_id", kinds), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])))], ["doc_id", "n_words", "n_hit", "item_ids", "matches"]).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def arrow_kinds(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def clean(docs: DataFrame, benchmark: DataFrame, window=WINDOW, shard=SHARD, block=BLOCK) -> DataFrame:
    """The documents, with all their columns, that hold no window of any test item."""
    blocks = test_blocks(benchmark, window, block)
    at = docs.columns.index("text")

    def run(batches):
        for rows, _, hit, _, _ in _shards(batches, at, blocks, window, shard):
            yield from rows.filter(pa.array(hit == 0)).to_batches()

    return docs.mapInArrow(run, docs.schema)


@query("op5_decontamination")
def op5_decontamination(spark, sf):
    found = find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

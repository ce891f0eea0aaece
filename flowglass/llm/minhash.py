"""Near duplicates by SuperMinHash, banding, verification on full sets and connected components.

SuperMinHash.  Every element of a set gets a random permutation of the slots and, at its j-th slot, a value j + u with u in [0, 1);
a slot keeps the least value it is given.  Elements give out their slots in steps, all together, and a set stops at the step
after which no larger value could improve any of its slots: a set of some hundred elements needs a few steps.  The ranks of an
element being a permutation, the variance is below that of independent minima.

Bands.  `BANDS` keys of `ROWS` slots each.  A pair at the threshold of 0.8 is missed with probability (1 - 0.8**8)**64, about 8e-6,
and a component only if all its connecting pairs are.  Equal sets are one from the start.

Links without pairs.  Sets that share a bucket are read again as full shingle sets, once each.  Buckets with the same members are one; the
members of a bucket meet in one task, in chunks of about `CHUNK` shingles.  There a local union-find joins them: each member is compared, on the full sets and
exactly, with those later ones that are in other groups and of fitting size, so a group of copies costs little more than its size.
One bucket in `EARLY` is done first; of the others only those whose members are still in different groups.  Only the links of a
spanning forest leave a task, at most one less than there are members.  Where a bucket has several chunks, a second
pass compares the members outside its largest component with the chunks they have not met.  So nothing is left out or capped.

Texts of fewer words than a shingle have the whole sequence as one; texts without words have no shingles and are linked with
nothing.  Rows without doc_id are linked with nothing and kept.  Rows of equal doc_id are judged each by its text; `dedup` keeps or drops
exact repetitions together.  Empty tables give no rows.  `dedup` returns the columns of its input, whatever they are."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataprep import components
from ..plans.catalog import query
from ..plans.views import table
from . import text
from .bits import bits_of, has
from .store import forget, written

WORDS = 5
BANDS, ROWS = 64, 8
SIMILAR = 80  # percent
CHUNK = 1_500_000  # shingles that are compared in one go
EARLY = 4  # one bucket in so many is looked at before the others
LAZY = 14  # steps after which the few sets still open get whole permutations


def super_minhash(doc: np.ndarray, elements: np.ndarray, sets: int, m: int) -> np.ndarray:
    """Signatures, sets x m, as fixed-point numbers j * 2**32 + u; a set without elements keeps the largest number everywhere."""
    sig = np.full(sets * m, np.iinfo(np.uint64).max, np.uint64)
    done = np.bincount(doc, minlength=sets) == 0
    doc, seed = doc.astype(np.int64), text.mix(elements)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []  # per step: where a value was put, and which
    perm = None
    for j in range(m):
        live = ~done[doc]
        if not live.any():
            break
        if live.sum() < 0.8 * len(doc) or perm is None and j >= LAZY:
            doc, seed = doc[live], seed[live]
            swaps = [(k[live], v[live]) for k, v in swaps]
            perm = perm[live] if perm is not None else None
        if perm is None and j >= LAZY:
            perm = np.tile(np.arange(m, dtype=np.int16), (len(doc), 1))
            for k, v in swaps:
                perm[np.arange(len(doc)), k] = v
            swaps = []
        x = text.mix(seed + text.U((j + 1) * text.BASE & (1 << 64) - 1))
        k = (j + ((x >> text.U(32)) * text.U(m - j) >> text.U(32))).astype(np.int64)
        if perm is None:
            at_j, at_k = np.full(len(doc), j), k.copy()
            for where, value in swaps:
                hit = where == j
                at_j[hit] = value[hit]
                hit = where == k
                at_k[hit] = value[hit]
            swaps.append((k, at_j))
        else:
            rows = np.arange(len(doc))
            at_j, at_k = perm[rows, j].copy(), perm[rows, k].astype(np.int64)
            perm[rows, k] = at_j
        np.minimum.at(sig, doc * m + at_k, text.U(j << 32) | x & text.U(0xFFFFFFFF))
        open_ = np.flatnonzero(~done)
        done[open_] = sig.reshape(sets, m)[open_].max(axis=1) < text.U((j + 1) << 32)
    return sig.reshape(sets, m)


def _features(docs: DataFrame, words: int) -> DataFrame:
    """Per row of `docs`: doc_id, _text, n, two sums that stand for the set, and band keys."""
    m = BANDS * ROWS

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(2), 1 << 19):
                w = text.Words(buf, off, text.SPACED)
                doc, sh, n = text.shingles(w, words)
                sums = np.zeros((2, len(n)), np.uint64)
                for k, x in enumerate((sh, text.mix(sh + text.U(text.BASE2)))):
                    np.add.at(sums[k], doc, x)
                sig = super_minhash(doc, sh, len(n), m)
                keys = np.zeros((len(n), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = text.mix(keys * text.U(text.BASE) + sig[:, r::ROWS] + text.U(1))
                keys = text.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64))
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, rows), b.column(1).slice(i, rows), pa.array(n.astype(np.int64)), pa.array(text.signed(sums[0])), pa.array(text.signed(sums[1])),
                     text.lists(text.signed(keys.ravel()), np.full(rows, BANDS))], ["doc_id", "_text", "n", "s1", "s2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").mapInArrow(run, f"doc_id {kind}, _text long, n long, s1 long, s2 long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, set: the sorted shingle hashes of the wanted sets (id, _text).  A bit set of their ids passes over all other texts where they are read."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bits_of(wanted.select(F.xxhash64("id").alias("key"))))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(has(bits.value, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
            for i, buf, off in text.slices(b.column(3)):
                doc, sh, n = text.shingles(text.Words(buf, off, text.SPACED), words)
                sh = sh[np.lexsort((sh, doc))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(n)), b.column(2).slice(i, len(n)), text.lists(text.signed(sh), n)], ["id", "_text", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("_key"), F.xxhash64("text").alias("_text"), "text")
    full = known.mapInArrow(run, f"id {kind}, _text long, set array<long>")
    return written(full.join(wanted, ["id", "_text"]).select("id", "set").dropDuplicates(["id"]), "sets")


def forest(flat: np.ndarray, off: np.ndarray, group: np.ndarray, first: int, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join what the similar pairs of sets join: sets flat[off[i]:off[i + 1]], already in the given groups.

    Pairs of two sets from `first` on are left out."""
    n, size = len(off) - 1, np.diff(off)
    _, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    group, links = group.copy(), []
    for i in range(min(first, n)):
        other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        other = other[np.minimum(size[other], size[i]) * 100 >= np.maximum(size[other], size[i]) * percent]
        if not len(other):
            continue
        mine = code[off[i] : off[i + 1]]
        mark[mine] = True
        m = size[other]
        ends = np.cumsum(m)
        place = np.arange(ends[-1]) + np.repeat(off[other] - (ends - m), m)
        both = np.diff(np.concatenate([[0], np.cumsum(mark[code[place]])])[np.concatenate([[0], ends])])
        mark[mine] = False
        for j in other[both * 100 >= (m + size[i] - both) * percent].tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _links(rows: DataFrame, percent: int, across: bool) -> DataFrame:
    """a, b: a spanning forest of each part of `rows` (part, side, id, comp, set).  `across`: only pairs with one set of side 0 and one of side 1."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        held, here = [], None

        def found():
            t = pa.Table.from_batches(held).combine_chunks()
            sets = t.column(3).combine_chunks()
            off = sets.offsets.to_numpy().astype(np.int64)
            flat = sets.values.to_numpy()[off[0] : off[-1]]
            first = int((t.column(1).to_numpy() == 0).sum()) if across else len(t)
            group = np.unique(t.column(4).to_numpy(), return_inverse=True)[1]
            pairs = forest(flat, off - off[0], group, first, percent)
            ids = t.column(2)
            take = lambda k: ids.take(pa.array([p[k] for p in pairs], pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([take(0), take(1)], ["a", "b"])

        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for lo, hi in zip(edge, [*edge[1:], len(part)]):
                if part[lo] != here:
                    if len(held):
                        yield found()
                    held, here = [], part[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield found()

    sorted_ = rows.repartition("part").sortWithinPartitions("part", "side", "id").select("part", "side", "id", "set", "comp")
    return written(sorted_.mapInArrow(run, f"a {kind}, b {kind}"), "links")


def near_duplicates(docs: DataFrame, words=WORDS, percent=SIMILAR, chunk=CHUNK) -> DataFrame:
    """doc_id, _text (hash of the text), n_shingles, component_id (smallest doc_id reachable over links) and kept."""
    feats = written(_features(docs, words), "features")
    distinct = feats.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "_text")).alias("r"), F.first("bands").alias("bands"))
    sets = written(distinct.select(F.col("r.doc_id").alias("id"), F.col("r._text").alias("_text"), "n", "s1", "s2", "bands"), "distinct")

    keyed = _shared_bands(sets)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_w"), F.bit_xor(F.xxhash64("id")).alias("_x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_y")).filter("_n > 1")
    # Buckets with the same members are one.  Written, so that both sides of the join back are dealt anew and Spark can split a hot key.
    shared = written(shared.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key"), F.first("_w").alias("_w")).select("key", F.ceil(F.col("_w") / chunk).alias("_chunks")), "shared")
    rows = written(keyed.join(shared, "key").select("key", "id", "_chunks", F.pmod(F.xxhash64("id", "key"), F.col("_chunks")).alias("_chunk")), "buckets")
    full = _full_sets(docs, rows.select("id").distinct().join(sets.select("id", "_text"), "id"), words)

    # A part of the buckets first: they join most copies, and of the others only those are left whose members are still apart.
    early = F.pmod("key", F.lit(EARLY)) == 0
    together = lambda r: _links(r.select(F.xxhash64("key", "_chunk").alias("part"), F.lit(0).alias("side"), "id", F.xxhash64("comp").alias("comp")).join(full, "id"), percent, False)
    links = [together(rows.filter(early).withColumn("comp", F.col("id")))]
    comps = written(components(links[0]), "components")
    late = written(_labelled(rows.filter(~early), comps), "late")
    open_ = late.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high").select("key")
    links.append(together(late.join(open_, "key", "left_semi")))
    comps = written(components(links[0].unionByName(links[1])), "components")
    many = rows.filter("_chunks > 1")
    if not many.isEmpty():
        links.append(_links(_across(many, comps, full), percent, True))
        comps = written(components(links[0].unionByName(links[1]).unionByName(links[2])), "components")

    named = sets.select("n", "s1", "s2", "id").join(comps, sets["id"] == comps["node"], "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("comp"))
    named = written(named, "named")
    forget(sets, keyed, shared, rows, late, full, *links, comps)
    out = feats.select("doc_id", "_text", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_text", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def _shared_bands(sets: DataFrame) -> DataFrame:
    """id, n, key of the bands that more than one set has, and of a few others.  Keys alone are counted; a bit set of those that repeat picks the rows."""
    again = written(sets.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"), "again")
    bits = sets.sparkSession.sparkContext.broadcast(bits_of(again))

    def run(batches):
        for b in batches:
            keys = b.column(2).flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(has(bits.value, keys.view(np.uint64)))
            row = pa.array(at // BANDS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(keys[at])], ["id", "n", "key"])

    kind = sets.schema["id"].dataType.simpleString()
    out = written(sets.select("id", "n", "bands").mapInArrow(run, f"id {kind}, n long, key long"), "bands")
    forget(again)
    return out


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Bucket rows with the component that each set has so far, itself where it has none."""
    return rows.join(comps, rows["id"] == comps["node"], "left").select("key", "id", "_chunks", "_chunk", F.coalesce("component", "id").alias("comp"))


def _across(rows: DataFrame, comps: DataFrame, full: DataFrame) -> DataFrame:
    """Parts of buckets with several chunks: the members outside the bucket's largest component (side 0), by chunk, with every other chunk (side 1).

    A member stands in as many parts as there are chunks of such outsiders, and an outsider in as many as there are chunks."""
    r = written(_labelled(rows, comps), "labelled")
    top = r.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("_top"))
    r = r.join(written(top, "top"), "key")
    outside = r.filter("comp <> _top")
    chunks = written(outside.groupBy("key", F.col("_chunk").alias("_from")).agg(F.count(F.lit(1)).alias("_few")).select("key", "_from"), "outside")
    part = lambda a, b: F.xxhash64("key", a, b)
    comp = F.xxhash64("comp").alias("comp")
    left = outside.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).filter("_to <> _chunk").select(part("_chunk", "_to").alias("part"), F.lit(0).alias("side"), "id", comp)
    right = r.join(chunks, "key").filter("_from <> _chunk").select(part("_from", "_chunk").alias("part"), F.lit(1).alias("side"), "id", comp)
    return left.unionByName(right).join(full, "id")


def dedup(docs: DataFrame, words=WORDS, percent=SIMILAR) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns as they are."""
    found = near_duplicates(docs, words, percent)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")


@query("op4_minhash")
def op4_minhash(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), words=4).drop("_text")

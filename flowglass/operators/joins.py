"""Interval, as-of, tolerance and parity joins."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import ip
from ..session import cut, written
from .ordered import BLOCK_US, heat, running_sums


def spans(labels: DataFrame, start: str, end: str, bucket_us: int) -> DataFrame:
    """One row per time bucket an interval touches, so that interval joins become equi-joins on `_b`."""
    b = lambda c: F.floor(F.col(c) / bucket_us).cast("long")
    return labels.withColumn("_b", F.explode(F.sequence(b(start), b(end))))


BUCKET_US, FAN, TOP_LEVEL = 60_000_000, 64, 5


def cover(start, end) -> Column:
    """array(struct(level, bucket)) that covers an interval: minutes at its ends, spans of 64, 64 * 64, ... minutes between.

    So an interval of any length has at most some hundred entries, and an instant lies in one bucket per level."""
    none = F.array().cast("array<struct<level:int,bucket:bigint>>")
    b = lambda c: F.floor(F.col(c) / BUCKET_US).cast("long")
    at = lambda level, lo, hi: F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda x: F.struct(level.alias("level"), x.alias("bucket")))).otherwise(none)

    def step(s, level):
        lo, hi = s["lo"], s["hi"]
        up_lo, up_hi = F.ceil(lo / FAN).cast("long"), F.floor((hi + 1) / FAN).cast("long") - 1
        last = (hi - lo < 2 * FAN) | (level == TOP_LEVEL)
        here = F.when(last, at(level, lo, hi)).otherwise(F.concat(at(level, lo, up_lo * FAN - 1), at(level, (up_hi + 1) * FAN, hi)))
        nothing = F.lit(0).cast("long")
        return F.struct(F.when(last, nothing).otherwise(up_lo).alias("lo"), F.when(last, nothing - 1).otherwise(up_hi).alias("hi"), F.concat(s["out"], here).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), F.struct(b(start).alias("lo"), b(end).alias("hi"), none.alias("out")), step, lambda s: s["out"])


EVERYWHERE, ALONE, SETS = -1, -2, 32  # places of `_k`; hosts beyond SETS are looked up as one set
SWAP = -(2 ** 63)  # turns the order of signed longs into that of unsigned ones


def match_networks(events: DataFrame, episodes: DataFrame, by=()) -> DataFrame:
    """First matching episode per event (by `priority`, `id`), number of different matching episodes, background when none.

    `events`: seq, ts_us, src_ip, dst_ip; `episodes`: id, priority, label, start_us, end_us (inclusive), hosts (addresses or networks, IPv4 or IPv6;
    none: any event of the time).  An event matches by either endpoint; columns `by` must agree.

    No pair of an event and an episode is made.  The episodes of a network are steps in time: how many are open, and the first of them.
    Different addresses look up their networks by equality, and an event reads the steps of its networks at its time.  What an episode would give by
    both endpoints through two of its networks is taken off again by the steps of that pair of networks.  Rows that share `seq` with other rows are
    matched as one event, pair by pair (`_matched_pairs`).

    All sides grow with the events or the episodes; merge joins keep them out of the driver, which a small compressed size would not."""
    by = list(by)
    lab = _networks_of(episodes, by)
    shapes = lab.select("_n.family", "_n.bits").distinct().collect()  # at most 33 + 129 + 1 lengths
    if not shapes:
        none = F.lit(None).cast("string")
        return events.withColumns({"episode": none, "label": none, "matches": F.lit(0).cast("long")})
    points = written(events.select(*by, "seq", "ts_us", "src_ip", "dst_ip").filter("seq is not null and ts_us is not null"))
    repeated = points.groupBy("seq").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("seq")
    found = []
    if not repeated.isEmpty():
        rows = points.join(repeated.hint("merge"), "seq", "left_semi").distinct()
        rows = cut(rows.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy("seq"))))
        found = [_matched_pairs(rows.filter("_c > 1").drop("_c"), lab, by)]
        points = points.join(repeated.hint("merge"), "seq", "left_anti").unionByName(rows.filter("_c = 1").drop("_c"))
    found.append(_matched_steps(points, lab, by, [(r["family"], r["bits"]) for r in shapes]))
    best = reduce(DataFrame.unionByName, found).select("seq", F.col("m.id").alias("episode"), F.col("m.label").alias("label"), "matches")
    return events.join(best.hint("merge"), "seq", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def _networks_of(episodes: DataFrame, by) -> DataFrame:
    """One row per different episode and network of it that lies in no other of its networks; `_size` counts them."""
    everywhere = F.array(F.struct(F.lit(0).alias("family"), F.lit(0).alias("bits"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo")))
    nets = F.when(F.size(F.coalesce("hosts", F.array().cast("array<string>"))) == 0, everywhere).otherwise(F.array_distinct(F.filter(F.transform("hosts", ip.network), lambda n: n.isNotNull())))
    same = [*by, "priority", "id", "label", "start_us", "end_us"]
    lab = episodes.filter("start_us <= end_us").select(*same, F.xxhash64(*same).alias("_e"), F.explode(nets).alias("_n")).distinct()
    # Networks hold each other or have nothing in common, so one that begins inside an earlier one lies in it.
    left = lambda c, n: F.call_function("shiftleft", c, n.cast("int"))
    mask = lambda n: F.when(n >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1)
    v6, n = F.col("_n.family") == 6, F.col("_n.bits")
    over = F.when(F.col("_n.family") == 4, 32 - n).otherwise(64 - F.least(n, F.lit(64)))  # host bits of `hi`
    under = F.when(v6, F.least(128 - n, F.lit(64))).otherwise(0)  # and of `lo`
    unsigned = lambda c: c.bitwiseXOR(F.lit(SWAP))
    lab = lab.withColumns({"_hi": F.when(over >= 64, 0).otherwise(left(F.col("_n.hi"), over)), "_lo": F.when(under >= 64, 0).otherwise(left(F.col("_n.lo"), under))})
    lab = lab.withColumns({"_from": F.struct(unsigned(F.col("_hi")).alias("a"), unsigned(F.col("_lo")).alias("b")),
                           "_to": F.struct(unsigned(F.col("_hi").bitwiseOR(mask(over))).alias("a"), unsigned(F.col("_lo").bitwiseOR(mask(under))).alias("b"))})
    same = [*by, "_e"]
    earlier = W.partitionBy(*same, "_n.family").orderBy("_from", "_n.bits").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*same)
    lab = lab.withColumns({"_most": F.max("_to").over(earlier), "_any": F.min("_n.family").over(whole)})
    lab = lab.filter(F.when(F.col("_any") == 0, F.col("_n.family") == 0).otherwise(F.col("_most").isNull() | (F.col("_most") < F.col("_to"))))
    return cut(lab.drop("_hi", "_lo", "_from", "_to", "_most", "_any").withColumn("_size", F.count(F.lit(1)).over(whole)))


def _place(a: Column, family, bits, hi, lo) -> Column:
    """The network of a length that an address lies in, null for an address of another family."""
    return F.when(a["family"] == family, ip.let(ip.prefix(a, family, bits), lambda one: F.struct(family.alias("family"), bits.alias("bits"), one[hi].alias("hi"), one[lo].alias("lo"))))


def _matched_pairs(rows: DataFrame, lab: DataFrame, by) -> DataFrame:
    """seq, m (first episode), matches, by every pair of a row and an episode: for the few rows that only together are an event."""
    keyed = lab.select(*by, "id", "priority", "label", "start_us", "end_us", "_e", "_n", F.explode(cover("start_us", "end_us")).alias("_t"))
    keyed = cut(keyed.select("*", F.struct("_n.family", "_n.bits", "_n.hi", "_n.lo", "_t.level", "_t.bucket").alias("_k")).drop("_n", "_t"))
    shapes = keyed.select("_k.family", "_k.bits", "_k.level").distinct().collect()  # at most (33 + 129 + 1) lengths times six levels
    if not shapes:
        return keyed.select(F.lit(0).cast("long").alias("seq"), F.struct("priority", "id", "label").alias("m"), F.lit(0).cast("long").alias("matches")).limit(0)
    ends = rows.select(*by, "seq", "ts_us", F.explode(F.array_distinct(F.array(ip.address("src_ip"), ip.address("dst_ip")))).alias("_a"))
    # one expression over a list of constants, so the plan is as short with many shapes as with one
    listed = F.array(*[F.struct(F.lit(r["family"]).alias("family"), F.lit(r["bits"]).alias("bits"), F.lit(r["level"]).alias("level"), F.lit(BUCKET_US * FAN ** r["level"]).cast("long").alias("width")) for r in shapes])

    def key(r):
        zero = F.lit(0).cast("long")
        place = lambda hi, lo: F.struct(r["family"].alias("family"), r["bits"].alias("bits"), hi.alias("hi"), lo.alias("lo"), r["level"].alias("level"), F.floor(F.col("ts_us") / r["width"]).cast("long").alias("bucket"))
        return F.when(r["family"] == 0, place(zero, zero)).when(F.col("_a.family") == r["family"], ip.let(ip.prefix(F.col("_a"), r["family"], r["bits"]), lambda one: place(one["hi"], one["lo"])))

    looked = ends.withColumn("_k", F.explode(F.array_compact(F.transform(listed, key)))).drop("_a")
    pairs = looked.join(keyed.hint("merge"), [*by, "_k"]).filter(F.col("ts_us").between(F.col("start_us"), F.col("end_us")))
    return pairs.groupBy("seq").agg(F.min(F.struct("priority", "id", "label")).alias("m"), F.count_distinct("_e").alias("matches"))


def _matched_steps(points: DataFrame, lab: DataFrame, by, shapes) -> DataFrame:
    """seq, m (first episode), matches of rows with different `seq`, by the steps of their networks."""
    at = lambda a, b: F.named_struct(F.lit("a"), a.cast("long"), F.lit("b"), b.cast("long"))
    lit = lambda x: F.lit(x).cast("long")
    numbered = cut(lab.filter("_n.family <> 0").select(*by, "_n").distinct().withColumn("_i", F.monotonically_increasing_id()))
    placed = lab.filter("_n.family <> 0").join(numbered.hint("merge"), [*by, "_n"])
    sets = placed.groupBy(*by, "_e").agg(F.sort_array(F.collect_list("_i")).alias("_is"), F.first("_size").alias("_size"), F.first(F.struct("priority", "id", "label", "start_us", "end_us")).alias("_v"))
    # Long lists of hosts have no steps of pairs, which would grow with their square: their set as a whole is one more place.
    own = F.when(F.col("_size") > SETS, F.array(at(F.xxhash64("_is"), lit(ALONE))))
    pairs = F.flatten(F.transform("_is", lambda x: F.transform(F.filter("_is", lambda y: y >= x), lambda y: at(x, y))))
    sets = cut(sets.withColumn("_ks", F.coalesce(own, pairs)))
    open_ = sets.select(*by, F.explode("_ks").alias("_k"), "_v.*")
    everywhere = lab.filter("_n.family = 0")
    open_ = open_.unionByName(everywhere.select(*by, at(lit(EVERYWHERE), lit(EVERYWHERE)).alias("_k"), "priority", "id", "label", "start_us", "end_us"))
    steps = _steps(open_, by)

    # Places of a network: itself, if a short list names it, and the long lists that do.  `many`: other networks share an episode with it.
    short = F.col("_size") <= SETS
    places = sets.select(*by, F.explode("_is").alias("_i"), F.when(short, at(F.col("_i"), F.col("_i"))).otherwise(F.get("_ks", F.lit(0))).alias("_p"), (short & (F.col("_size") > 1)).alias("_many"))
    places = places.groupBy(*by, "_i", "_p").agg(F.max("_many").alias("_many")).join(numbered.hint("merge"), [*by, "_i"])
    places = places.groupBy(*by, "_n").agg(F.collect_list(F.struct("_p", "_many")).alias("_ps"))
    listed = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(b).alias("bits")) for f, b in shapes if f] or [F.struct(F.lit(0).alias("family"), F.lit(0).alias("bits"))])
    texts = points.select(*by, F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("_text")).distinct()
    looked = texts.select("*", F.explode(ip.let(ip.address("_text"), lambda a: F.array_compact(F.transform(listed, lambda r: _place(a, r["family"], r["bits"], "hi", "lo"))))).alias("_n"))
    hits = looked.join(places.hint("merge"), [*by, "_n"]).groupBy(*by, "_text").agg(F.flatten(F.collect_list("_ps")).alias("_h"))
    side = lambda c, name: hits.select(*by, F.col("_text").alias(c), F.col("_h").alias(name))
    none = F.array().cast(hits.schema["_h"].dataType)
    e = points.join(side("src_ip", "_s").hint("merge"), [*by, "src_ip"], "left").join(side("dst_ip", "_d").hint("merge"), [*by, "dst_ip"], "left")
    e = e.select(*by, "seq", "ts_us", F.coalesce("_s", none).alias("_s"), F.coalesce("_d", none).alias("_d"))
    single = F.array_distinct(F.transform(F.concat("_s", "_d"), lambda h: h["_p"]))
    if not everywhere.isEmpty():
        single = F.concat(single, F.array(at(lit(EVERYWHERE), lit(EVERYWHERE))))
    many = lambda c: F.transform(F.filter(c, lambda h: h["_many"]), lambda h: h["_p"]["a"])
    both = F.array_distinct(F.flatten(F.transform(many("_s"), lambda x: F.transform(F.filter(many("_d"), lambda y: y != x), lambda y: at(F.least(x, y), F.greatest(x, y))))))
    signed = lambda c, n: F.transform(c, lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"), F.lit(n).alias("sign")))
    e = written(e.select(*by, "seq", "ts_us", F.concat(signed(single, 1), signed(both, -1)).alias("_ks")).filter(F.size("_ks") > 0))

    reads = e.select(*by, "ts_us", F.col("seq").alias("_seq"), F.explode("_ks").alias("_x"))
    reads = reads.select(*by, "ts_us", "_seq", at(F.col("_x.a"), F.col("_x.b")).alias("_k"), F.col("_x.sign").alias("_sign"))
    # Inside an instant: beginnings, events, ends.
    stacked = reads.withColumns({"seq": F.lit(1), "_step": F.lit(None).cast(steps.schema["_step"].dataType)}).unionByName(steps.withColumns({"_seq": F.lit(None).cast(reads.schema["_seq"].dataType), "_sign": F.lit(0)}))
    keys = [*by, "_k"]
    out = running_sums(stacked, keys, {}, lasts=["_step"], seen=heat(reads, keys)).filter("seq = 1 and last__step.n > 0")
    return out.groupBy(F.col("_seq").alias("seq")).agg(F.min("last__step.m").alias("m"), F.sum(F.col("_sign") * F.col("last__step.n")).alias("matches"))


def _steps(open_: DataFrame, by) -> DataFrame:
    """by, _k, ts_us, seq, _step: per place, how many episodes are open (`n`) and the first of them (`m`) from a time on.

    `seq` is 0 where it holds for events of that very time and 2 where it holds after them.  Rows of a place come in order of time; what is held is its open episodes."""
    keys = [*by, "_k"]
    first = F.struct("priority", "id", "label")
    change = F.explode(F.array(F.struct(F.col("start_us").alias("ts_us"), F.lit(0).alias("seq")), F.struct(F.col("end_us").alias("ts_us"), F.lit(2).alias("seq"))))
    rows = open_.select(*keys, F.col("end_us"), first.alias("_m"), change.alias("_c")).select(*keys, "_c.*", "end_us", "_m")
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "ts_us", "seq")
    fields = [ordered.schema[c] for c in (*keys, "ts_us", "seq")]
    schema = T.StructType([*fields, T.StructField("_step", T.StructType([T.StructField("n", T.LongType()), T.StructField("m", ordered.schema["_m"].dataType)]))])
    names, kinds = [f.name for f in schema.fields], [*fields, schema["_step"]]
    # as Spark orders: nulls first, texts by their bytes
    rank = lambda m: tuple((v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False,) for v in (m["priority"], m["id"], m["label"]))

    def walk(batches):
        import heapq

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(T.StructType(kinds))
        place, at, n, heap, serial, last = None, None, 0, [], 0, None

        def ended():
            while heap and (heap[0][2], 2) <= at:
                heapq.heappop(heap)
            return {**last, "_step": {"n": n, "m": heap[0][3] if heap else None}}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                here, now = [r[k] for k in keys], (r["ts_us"], r["seq"])
                if last is not None and (here != place or now != at):
                    out.append(ended())
                if here != place:
                    place, n, heap = here, 0, []
                at, last = now, {c: r[c] for c in names[:-1]}
                if r["seq"] == 0:
                    serial += 1
                    n += 1
                    heapq.heappush(heap, (rank(r["_m"]), serial, r["end_us"], r["_m"]))
                else:
                    n -= 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=want)
        if last is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=want)

    return cut(ordered.mapInArrow(walk, schema))


def asof_latest(left: DataFrame, right: DataFrame, keys, cols, strict=False) -> DataFrame:
    """Adds `last_<c>` from the newest right row of the same keys that is not later than the left row.

    Both sides carry `ts_us` and `seq`; with `strict` a right row of the same instant is not seen.
    The sides are interleaved in time and the value carried forward block by block."""
    left_cols = left.columns
    side = 1 if not strict else -1
    tag = lambda df, n: df.withColumn("_side", F.lit(n))
    extra = [c for c in left_cols if c not in (*keys, "ts_us", "seq")]
    l = tag(left.select(*keys, "ts_us", "seq", F.struct(*[F.col(c) for c in extra]).alias("_row") if extra else F.lit(True).alias("_row")), 0)
    value = F.struct(*cols)
    r = tag(right.select(*keys, "ts_us", F.col("seq").alias("_rseq"), value.alias("_val")), -side)
    both = l.withColumn("_rseq", F.lit(None).cast("long")).unionByName(r, allowMissingColumns=True)
    # Order inside an instant: right rows first (or last when strict), then arrival.
    both = both.withColumn("seq", F.struct(F.col("_side").alias("s"), F.coalesce("seq", "_rseq").alias("q")))
    out = running_sums(both, keys, {}, lasts=["_val"]).filter("_side = 0")
    back = [F.col("seq.q").alias("seq")] + ([F.col("_row." + c).alias(c) for c in extra] if extra else [])
    return out.select(*keys, "ts_us", *back, *[F.col("last__val." + c).alias("last_" + c) for c in cols])


def single_interval_match(points: DataFrame, windows: DataFrame, keys, slack_us: int, bucket_us=BLOCK_US) -> DataFrame:
    """Points inside exactly one window of the same keys, the window widened by `slack_us` on both sides."""
    w = windows.withColumns({"_lo": F.col("start_us") - slack_us, "_hi": F.col("end_us") + slack_us})
    w = spans(w, "_lo", "_hi", bucket_us)
    p = points.withColumn("_b", F.floor(F.col("ts_us") / bucket_us).cast("long"))
    pairs = p.join(w, [*keys, "_b"]).filter(F.col("ts_us").between(F.col("_lo"), F.col("_hi")))
    return pairs.groupBy("seq").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("candidates"))


def label_errors(source: DataFrame, labels: DataFrame, fields) -> DataFrame:
    """Full outer comparison on `uid`: duplicate, unmatched and disagreeing records with reasons."""
    s = source.groupBy("uid").agg(F.count(F.lit(1)).alias("_ns"), *[F.min(c).alias("s_" + c) for c in fields])
    l = labels.groupBy("uid").agg(F.count(F.lit(1)).alias("_nl"), *[F.min(c).alias("l_" + c) for c in fields])
    j = s.join(l, "uid", "full_outer")
    reasons = [F.when(F.col("_ns") > 1, "duplicate_source"), F.when(F.col("_nl") > 1, "duplicate_label"),
               F.when(F.col("_nl").isNull(), "unlabelled"), F.when(F.col("_ns").isNull(), "unmatched_label")]
    both = F.col("_ns").isNotNull() & F.col("_nl").isNotNull()
    reasons += [F.when(both & ~F.col("s_" + c).eqNullSafe(F.col("l_" + c)), f"{c}_differs") for c in fields]
    j = j.withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), "+"))
    return j.filter("reason <> ''").select("uid", "reason")


def unseen_vectors(rows: DataFrame, train: DataFrame, cols, order: str) -> DataFrame:
    """Rows whose vector signature is neither in `train` nor seen on an earlier row."""
    sig = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
    first = rows.withColumn("_sig", sig).groupBy("_sig").agg(F.min(order).alias(order))
    return first.join(train.select(sig.alias("_sig")).distinct(), "_sig", "left_anti").select(order)


def aligned_differences(a: DataFrame, b: DataFrame, keys, pos: str, fields) -> DataFrame:
    """Position-wise comparison of two record sequences per key: differing fields and length of the equal prefix."""
    pick = lambda df, p: df.select(*keys, pos, *[F.col(c).alias(p + c) for c in fields], F.lit(True).alias(p + "in"))
    j = pick(a, "a_").join(pick(b, "b_"), [*keys, pos], "full_outer")
    differs = {c: ~F.col("a_" + c).eqNullSafe(F.col("b_" + c)) | F.col("a_in").isNull() | F.col("b_in").isNull() for c in fields}
    any_diff = F.lit(False)
    for d in differs.values():
        any_diff = any_diff | d
    j = j.withColumn("_any", any_diff)
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("positions"), *[F.sum(d.cast("long")).alias(c + "_differs") for c, d in differs.items()],
                                F.coalesce(F.min(F.when(F.col("_any"), F.col(pos))), F.max(pos) + 1).alias("first_difference"))


def feature_parity(before: DataFrame, after: DataFrame, key: str, cols, tol=1e-10) -> DataFrame:
    """Per column: rows compared, rows beyond the relative/absolute tolerance, largest difference."""
    j = before.select(key, *[F.col(c).cast("double").alias("a_" + c) for c in cols]).join(
        after.select(key, *[F.col(c).cast("double").alias("b_" + c) for c in cols]), key)
    def cell(c):
        a, b = F.col("a_" + c), F.col("b_" + c)
        same = a.eqNullSafe(b) | (F.abs(a - b) <= tol * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
        return F.struct(F.lit(c).alias("feature"), (~F.coalesce(same, F.lit(False))).cast("long").alias("changed"), F.abs(a - b).alias("delta"))
    x = j.select(F.explode(F.array(*[cell(c) for c in cols])).alias("x")).select("x.*")
    return x.groupBy("feature").agg(F.count(F.lit(1)).alias("compared"), F.sum("changed").alias("changed"), F.max("delta").alias("max_delta"))


def pair_overlap(sets: DataFrame, group: str, item: str) -> DataFrame:
    """Items shared by each pair of groups, counted from the items' own group lists.

    Groups are few by nature (splits, sources); each item emits the pairs it belongs to."""
    g = sets.select(group, item).distinct().groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g")).filter(F.size("g") > 1)
    left = g.select(item, "g", F.explode("g").alias("a"))
    pairs = left.select(item, "a", F.explode(F.filter("g", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def crossing(rows: DataFrame, item: str, split: str) -> DataFrame:
    """Items assigned to more than one split."""
    return rows.groupBy(item).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def last_family(rows: DataFrame, item: str, family: str, order) -> DataFrame:
    """One reporting family per item: the last in `order`."""
    return rows.groupBy(item).agg(F.max_by(family, order).alias(family))


def hash_top(rows: DataFrame, group: str, item: str, n: int, seed="") -> DataFrame:
    """The first `n` items per group in hash order: a bounded, repeatable uniform sample."""
    h = F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256)
    w = W.partitionBy(group).orderBy("_h", item)
    return rows.withColumn("_h", h).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_h", "_r")


def order_statistics(rows: DataFrame, group, value: str, picks: dict, slots=1024) -> DataFrame:
    """Exact order statistics per group at zero-based indices computed from the count.

    Values are counted first; a coarse histogram finds the slot of every index and
    only the distinct values of those slots are ordered, so no group is sorted in one task."""
    group = list(group)
    keys = group or ["_all"]
    base = rows.filter(F.col(value).isNotNull())
    base = base if group else base.withColumn("_all", F.lit(1))
    c = base.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = c.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    span = F.col("hi") - F.col("lo")
    slot = F.when(span > 0, F.least(F.lit(slots - 1), F.floor((F.col("v") - F.col("lo")) / span * slots))).otherwise(0).cast("int")
    c = c.join(ends, keys).withColumn("slot", slot)
    w = W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    hist = c.groupBy(*keys, "slot", "n").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(w))
    n = F.col("n")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), idx(n).cast("long").alias("idx")) for name, idx in picks.items()])
    hist = hist.withColumn("p", F.explode(wanted)).filter((F.col("p.idx") < F.col("upto")) & (F.col("p.idx") >= F.col("upto") - F.col("c")))
    hist = hist.select(*keys, "slot", "p.name", (F.col("p.idx") - F.col("upto") + F.col("c")).alias("rest"))
    fine = c.select(*keys, "slot", "v", "c").join(hist, [*keys, "slot"])
    wf = W.partitionBy(*keys, "name").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    fine = fine.withColumn("upto", F.sum("c").over(wf)).filter((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("c")))
    wide = fine.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in picks])
    out = ends.select(*keys, F.col("n").alias("count"), F.col("lo").alias("min"), F.col("hi").alias("max")).join(wide, keys)
    return out if group else out.drop("_all")


def quantiles(rows: DataFrame, group, value: str, qs: dict) -> DataFrame:
    """Exact interpolated quantiles (median included) from two neighbouring order statistics each."""
    picks = {}
    for name, q in qs.items():
        picks["_lo_" + name] = lambda n, q=q: F.floor((n - 1) * q)
        picks["_hi_" + name] = lambda n, q=q: F.ceil((n - 1) * q)
    o = order_statistics(rows, group, value, picks)
    frac = lambda q: (F.col("count") - 1) * q - F.floor((F.col("count") - 1) * q)
    return o.select(*group, *[(F.col("_lo_" + n) + frac(q) * (F.col("_hi_" + n) - F.col("_lo_" + n))).alias(n) for n, q in qs.items()])

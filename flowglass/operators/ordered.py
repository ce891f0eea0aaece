"""Building blocks for causal (arrival-ordered) computations on keys of any size.

Rows arrive in `(ts_us, seq)` order.  A plain `Window.partitionBy(key)` sends one
key to one task; here the key's timeline is cut into blocks, each block is
processed on its own, and a small per-block table carries state across blocks.
A key holding a large share of the rows is therefore spread over as many tasks as
it has blocks.  `base` names the input the per-block tables are computed from; it
defaults to the rows, but callers that have stacked many columns pass the raw
events so that the summaries never re-run the stacked plan.

Most keys hold few rows, and for them blocks cost more than they spare.  A caller
that has counted its keys (`heat`) has only those of crowded buckets cut into blocks.
"""
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("ts_us", "seq")
BLOCK_US = 60_000_000
FIRST, LAST = W.unboundedPreceding, W.unboundedFollowing


def block(us=BLOCK_US, ts="ts_us") -> Column:
    return F.floor(F.col(ts) / F.lit(us)).cast("long")


HOT_ROWS, BUCKETS, MANY = 200_000, 65_536, 1024


@dataclass(frozen=True)
class Heat:
    """Buckets of `by`, some of the keys, that hold more than HOT_ROWS rows: a hot key is in one of them."""
    by: tuple
    hot: tuple = ()

    def __bool__(self):
        return bool(self.hot)

    def column(self) -> Column:
        return _bucket(self.by).isin(list(self.hot))


def _bucket(by) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(BUCKETS))


def heat(rows: DataFrame, by, hot_rows: int = HOT_ROWS) -> Heat:
    """Counts the rows per bucket; what comes to the driver is no longer than the number of buckets."""
    crowded = rows.groupBy(_bucket(by).alias("b")).count().filter(F.col("count") > hot_rows)
    return Heat(tuple(by), tuple(r["b"] for r in crowded.select("b").collect()))


def _by_heat(rows: DataFrame, keys, seen: Heat | None, plain: Callable, blocked: Callable) -> DataFrame:
    """`blocked` for keys in hot buckets, `plain`, one window a key, for the others; rows without key or time are dropped, as the joins of blocks drop them."""
    if seen is None or len(seen.hot) > MANY:
        return blocked(rows)
    whole = rows.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    cold = plain(whole.filter(~seen.column()) if seen else whole).filter("ts_us is not null")
    return cold.unionByName(blocked(whole.filter(seen.column()))) if seen else cold


def causal(*keys):
    """Every row of the group up to and including the current one."""
    return W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(FIRST, 0)


def running_sums(rows: DataFrame, keys, sums: dict, base=None, block_us=BLOCK_US, lasts=(), seen: Heat | None = None) -> DataFrame:
    """Adds, per key in arrival order, inclusive running sums and `last_<c>`, the latest non-null value of each of `lasts`."""
    keys = list(keys)

    def plain(cold):
        # Blocks follow time, so one order serves both windows; a sum is null until its block has a value.
        w = W.partitionBy(*keys).orderBy("_blk", *ORDER).rowsBetween(FIRST, 0)
        nullable = [n for n, e in sums.items() if cold.select(e.alias(n)).schema[n].nullable]
        r = cold.withColumn("_blk", block(block_us)).select("*", *[F.sum(e).over(w).alias("_s_" + n) for n, e in sums.items()], *[F.last(c, ignorenulls=True).over(w).alias("last_" + c) for c in lasts],
                                                            *[F.count(sums[n]).over(causal(*keys, "_blk")).alias("_n_" + n) for n in nullable])
        return r.select(*rows.columns, *[(F.when(F.col("_n_" + n) > 0, F.col("_s_" + n)) if n in nullable else F.col("_s_" + n)).alias(n) for n in sums], *["last_" + c for c in lasts])

    return _by_heat(rows, keys, seen, plain, lambda r: _blocked_sums(r, keys, sums, r if base is None else base, block_us, lasts))


def _blocked_sums(rows: DataFrame, keys, sums: dict, base, block_us, lasts) -> DataFrame:
    inner = causal(*keys, "_blk")
    local = rows.withColumn("_blk", block(block_us)).select(
        "*", *[F.sum(e).over(inner).alias(n) for n, e in sums.items()], *[F.last(c, ignorenulls=True).over(inner).alias("_l_" + c) for c in lasts])
    order = F.struct(*ORDER)
    totals = (base.withColumn("_blk", block(block_us)).groupBy(*keys, "_blk")
              .agg(*[F.sum(e).alias(n) for n, e in sums.items()],
                   *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias("_m_" + c) for c in lasts]))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(FIRST, -1)
    carry = totals.select(*keys, "_blk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_c_" + n) for n in sums],
                          *[F.last("_m_" + c, ignorenulls=True).over(before).alias("_c_" + c) for c in lasts])
    out = local.join(carry, [*keys, "_blk"])
    return out.select(*rows.columns, *[(F.col(n) + F.col("_c_" + n)).alias(n) for n in sums],
                      *[F.coalesce("_l_" + c, "_c_" + c).alias("last_" + c) for c in lasts])


def bucket_sums(rows: DataFrame, keys, sums: dict, horizons: dict, base=None, sub_us=None) -> DataFrame:
    """Sliding sums over whole seconds `[sec-h, sec]`, read at the current row.

    `sums` maps a name to a row expression; `horizons` maps an output name to
    `(sum name, h)`.  Earlier seconds come from a per-(key, second) table; only the
    running part inside the current second needs the rows, so no task ever holds
    more than one second of one key (or one sub-block of it with `sub_us`)."""
    base = rows if base is None else base
    keys = list(keys)
    used = {n: sums[n] for n in sums if any(s == n for s, _ in horizons.values())}
    ins = {"_in_" + n: e for n, e in used.items()}
    if sub_us:
        local = running_sums(rows, [*keys, "sec"], ins, base=base, block_us=sub_us)
    else:
        w = causal(*keys, "sec")
        local = rows.select("*", *[F.sum(e).over(w).alias(n) for n, e in ins.items()])
    per_sec = base.groupBy(*keys, "sec").agg(*[F.sum(e).alias(n) for n, e in used.items()])
    prior = []
    for out, (n, h) in horizons.items():
        wr = W.partitionBy(*keys).orderBy("sec").rangeBetween(-h, -1)
        prior.append(F.coalesce(F.sum(n).over(wr), F.lit(0)).alias("_p_" + out))
    table = per_sec.select(*keys, "sec", *prior)
    joined = local.join(table, [*keys, "sec"])
    return joined.select(*rows.columns, *[(F.col("_p_" + o) + F.col("_in_" + n)).alias(o) for o, (n, _) in horizons.items()])


def with_history(rows: DataFrame, keys, depth: int, base=None, chunk_rows=65_536, block_us=BLOCK_US, sums=None, lasts=()) -> DataFrame:
    """Copies rows so that each (keys, `_chunk`) group holds the `depth` rows before it.

    Chunks are cut by arrival position, so their size never depends on how hot a
    key is.  Context copies carry `_context = true` and are dropped by
    `drop_history` once the bounded row window has been read.  `sums` and `lasts` are
    passed on to `running_sums`, which numbers the rows in the same pass."""
    ordinal = running_sums(rows, keys, {"_ord": F.lit(1), **(sums or {})}, base=base, block_us=block_us, lasts=lasts)
    pos = F.col("_ord") - 1
    own = F.floor(pos / chunk_rows).cast("long")
    later = F.when(pos % chunk_rows >= chunk_rows - depth, F.array(own, own + 1)).otherwise(F.array(own))
    return (ordinal.withColumn("_own", own).withColumn("_chunk", F.explode(later))
            .withColumn("_context", F.col("_chunk") != F.col("_own")).drop("_ord", "_own"))


def drop_history(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("_context")).drop("_chunk", "_context")


def recent(keys, depth: int):
    """The last `depth` earlier rows plus the current one, after `with_history`."""
    return W.partitionBy(*keys, "_chunk").orderBy(*ORDER).rowsBetween(-depth, 0)


def sessionize(rows: DataFrame, keys, gap_us: int, keep_equal: bool, base=None, block_us=BLOCK_US, seen: Heat | None = None) -> DataFrame:
    """Adds `session_start` and `session_seq`: time and seq of the first row of the session.

    A silence of more than `gap_us` (or of `gap_us` exactly unless `keep_equal`)
    opens a new session.  Sessions may span blocks; each block reports its first
    time, last time and last local start, and these are chained in a small table."""
    keys = list(keys)

    def opens(gap):
        return gap > gap_us if keep_equal else gap >= gap_us

    def plain(cold):
        w = W.partitionBy(*keys).orderBy(*ORDER)
        gap = F.col("ts_us") - F.lag("ts_us").over(w)
        s = cold.withColumn("_s", F.when(gap.isNull() | opens(gap), F.struct(*ORDER))).withColumn("_s", F.last("_s", ignorenulls=True).over(causal(*keys)))
        return s.select(*rows.columns, F.col("_s.ts_us").alias("session_start"), F.col("_s.seq").alias("session_seq"))

    return _by_heat(rows, keys, seen, plain, lambda r: _blocked_sessions(r, keys, opens, r if base is None else base, block_us))


def _blocked_sessions(rows: DataFrame, keys, opens, base, block_us) -> DataFrame:
    wk = W.partitionBy(*keys, "_blk").orderBy(*ORDER)

    def local(df):
        df = df.withColumn("_blk", block(block_us))
        prev = F.lag("ts_us").over(wk)
        here = F.struct("ts_us", "seq")
        return df.withColumn("_here", F.when(prev.isNotNull() & opens(F.col("ts_us") - prev), here))

    narrow = base.select(*keys, *ORDER)
    summary = (local(narrow).groupBy(*keys, "_blk")
               .agg(F.min(F.struct("ts_us", "seq")).alias("_first"), F.max("ts_us").alias("_last"),
                    F.max("_here").alias("_local")))
    wb = W.partitionBy(*keys).orderBy("_blk")
    fresh = F.lag("_last").over(wb)
    summary = summary.withColumn("_lead", F.when(fresh.isNull() | opens(F.col("_first.ts_us") - fresh), F.col("_first")))
    summary = summary.withColumn("_exit", F.last(F.coalesce("_local", "_lead"), ignorenulls=True).over(wb.rowsBetween(FIRST, 0)))
    summary = summary.select(*keys, "_blk", F.coalesce(F.col("_lead"), F.lag("_exit").over(wb)).alias("_entry"))
    start = F.coalesce(F.last("_here", ignorenulls=True).over(wk.rowsBetween(FIRST, 0)), F.col("_entry"))
    out = local(rows).join(summary, [*keys, "_blk"]).withColumn("_s", start)
    return out.select(*rows.columns, F.col("_s.ts_us").alias("session_start"), F.col("_s.seq").alias("session_seq"))


def most_before(rows: DataFrame, keys, value, name: str, block_us=BLOCK_US) -> DataFrame:
    """Adds the greatest `value` among the earlier rows of the key, across blocks; null on its first row."""
    keys = list(keys)
    blocked = rows.withColumns({"_blk": block(block_us), "_v": value})
    inside = W.partitionBy(*keys, "_blk").orderBy(*ORDER).rowsBetween(FIRST, -1)
    tops = blocked.groupBy(*keys, "_blk").agg(F.max("_v").alias("_t"))
    carry = tops.select(*keys, "_blk", F.max("_t").over(W.partitionBy(*keys).orderBy("_blk").rowsBetween(FIRST, -1)).alias("_c"))
    out = blocked.withColumn("_m", F.max("_v").over(inside)).join(carry, [*keys, "_blk"])
    return out.select(*rows.columns, F.greatest("_m", "_c").alias(name))


def neighbours(rows: DataFrame, keys, prev: str, next_: str, block_us=BLOCK_US, carry=(), seen: Heat | None = None, newest_first=False) -> DataFrame:
    """Adds the row before and the row after of the same key, across blocks, as structs of ts_us, seq and `carry`.

    Rows of equal time and seq leave in the order they are linked in, or with `newest_first` in the opposite one."""
    keys = list(keys)
    me, w = F.struct(*ORDER, *carry), W.partitionBy(*keys).orderBy(*[F.desc(c) if newest_first else F.asc(c) for c in ORDER])
    before, after = (F.lead, F.lag) if newest_first else (F.lag, F.lead)
    plain = lambda cold: cold.select(*rows.columns, before(me).over(w).alias(prev), after(me).over(w).alias(next_))
    return _by_heat(rows, keys, seen, plain, lambda r: _blocked_neighbours(r, keys, prev, next_, block_us, carry))


def _blocked_neighbours(rows: DataFrame, keys, prev: str, next_: str, block_us, carry) -> DataFrame:
    blocked = rows.withColumns({"_blk": block(block_us), "_me": F.struct(*ORDER, *carry)})
    w = W.partitionBy(*keys, "_blk").orderBy(*ORDER)
    local = blocked.withColumns({prev: F.lag("_me").over(w), next_: F.lead("_me").over(w)})
    order = F.struct(*ORDER)
    ends = blocked.groupBy(*keys, "_blk").agg(F.min_by("_me", order).alias("_min"), F.max_by("_me", order).alias("_max"))
    wb = W.partitionBy(*keys).orderBy("_blk")
    ends = ends.select(*keys, "_blk", F.lag("_max").over(wb).alias("_before"), F.lead("_min").over(wb).alias("_after"))
    out = local.join(ends, [*keys, "_blk"])
    return out.select(*rows.columns, F.coalesce(prev, "_before").alias(prev), F.coalesce(next_, "_after").alias(next_))


def change_points(rows: DataFrame, keys, parts, block_us=BLOCK_US, seen: Heat | None = None) -> DataFrame:
    """seq and the running total of every amount at each row, all changes up to it included.

    `parts`: (time of the change, or None for the row's own arrival; name -> amount; condition or None).  Changes of a time come
    before the arrivals of that time.  Amounts are summed as whole numbers, so what enters and leaves again leaves nothing behind:
    amounts of 32 bits, counts above all, in 64 bits, others as decimals."""
    names = list(dict.fromkeys(n for _, amounts, _ in parts for n in amounts))
    of = [(n, e) for _, amounts, _ in parts for n, e in amounts.items()]
    made = rows.select(*[e.alias(f"_{i}") for i, (_, e) in enumerate(of)]).schema
    wide = {n for (n, _), f in zip(of, made) if f.dataType.simpleString() not in ("int", "smallint", "tinyint")}
    gaps = {n for (n, _), f in zip(of, made) if f.nullable}
    whole = lambda n, c: c.cast("decimal(38,0)" if n in wide else "long")
    arrival = {n: F.lit(0) for n in names}
    points = []
    for at, amounts, where in parts:
        if at is None:
            arrival.update({n: F.when(where, e).otherwise(0) if where is not None else e for n, e in amounts.items()})
            continue
        point = F.struct(at.alias("ts_us"), F.lit(-1).cast("long").alias("seq"), *[whole(n, amounts.get(n, F.lit(0))).alias(n) for n in names])
        points.append(F.when(where, point) if where is not None else point)
    own = F.struct(F.col("ts_us"), F.col("seq").cast("long").alias("seq"), *[whole(n, arrival[n]).alias(n) for n in names])
    stacked = rows.select(*keys, F.explode(F.array(own, *points)).alias("_p")).filter("_p is not null").select(*keys, "_p.*")
    sums = running_sums(stacked, keys, {"_" + n: F.col(n) if n in gaps else F.coalesce(n, F.lit(0)) for n in names}, block_us=block_us, seen=seen)
    return sums.filter("seq >= 0").select("seq", *[F.col("_" + n).cast("decimal(38,0)").alias(n) for n in names])


def running_max(rows: DataFrame, value: str, out: str, order="seq", block_rows=65_536) -> DataFrame:
    """Adds the maximum of `value` over all rows up to this one in `order`, without a global sort.

    Works on runs of consecutive order numbers; only one row per run is ordered globally."""
    b = F.floor(F.col(order) / block_rows).cast("long")
    inner = W.partitionBy("_run").orderBy(order).rowsBetween(FIRST, 0)
    local = rows.withColumn("_run", b).withColumn("_m", F.max(value).over(inner))
    tops = rows.groupBy(b.alias("_run")).agg(F.max(value).alias("_t"))
    carry = tops.select("_run", F.max("_t").over(W.orderBy("_run").rowsBetween(FIRST, -1)).alias("_c"))
    return local.join(carry, "_run").select(*rows.columns, F.greatest("_m", "_c").alias(out))


def sequence_digest(rows: DataFrame, keys, text, size=4096, levels=3) -> DataFrame:
    """keys, n, digest: an order-preserving digest of a key's rows in arrival order; `text` is what counts of a row.

    Rows are numbered and cut into blocks of `size`; a block's digest is the SHA-256 of its lines, and the digests of `size` blocks are
    lines of the next level, `levels` levels in all, the last one taking what is left.  So no row or task ever holds a whole sequence,
    digests of parts can be made apart, and equal digests mean equal sequences."""
    keys = list(keys)
    r = running_sums(rows.select("seq", "ts_us", *keys, text.alias("_t")), keys, {"_p": F.lit(1).cast("long")}).select(*keys, (F.col("_p") - 1).alias("_p"), F.lit(1).cast("long").alias("n"), "_t")
    for level in range(levels):
        part = F.floor(F.col("_p") / size).cast("long") if level < levels - 1 else F.lit(0).cast("long")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n")
        r = r.withColumn("_q", part).groupBy(*keys, "_q").agg(F.sum("n").alias("n"), F.sha2(lines, 256).alias("_t")).withColumnRenamed("_q", "_p")
    return r.select(*keys, "n", F.col("_t").alias("digest"))

"""Phrase collocations by prefix-free parsing.

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`.  The words of a piece are
parsed into overlapping chunks: a chunk ends with a window of `LONGEST` - 1 words whose hash is divisible by `EVERY`, and the next one starts
with that window.  Where a chunk ends depends on its content alone, so copies of a passage are parsed alike wherever they stand.
The dictionary keeps each different chunk once with its frequency in the parse.  Phrases are counted inside dictionary chunks only and
weighted by that frequency; a phrase belongs to the chunk in which it starts before the closing window, so overlaps count once.

Counting takes four passes over the dictionary, and only the last one handles strings.  The first three count hashes of words, of
pairs made of frequent words and of triples made of frequent pairs; each leaves a bit set of the hashes that reach the least count (sized by
their number, at most `MOST_BITS` bits: beyond that it only lets more through).  Hash counts can only be too high, so nothing frequent is
missed.  The last pass counts, as strings, phrases found in the bit sets and longer ones all of whose triples are; those counts are exact.

A candidate has 2 to 5 words and a count a of at least `least`.  A cut after k words with counts l and r of its parts scores
floor(1000 a n / (l r)), n being the words of the language; the lowest cut counts, ties to the smallest k.  Candidates contained in a
longer one of the same count are dropped (one word longer is enough to look at: counts cannot grow with length).

A null lang is `und`, a null text is empty; empty texts and pieces have no words.  Repeated rows count each.  Languages without candidates
and empty tables give no rows.  Only `lang` and `text` are read, so further columns may have any name."""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.views import table
from . import text
from .bits import MOST_BITS, bits_of, has
from .store import forget, written

LONGEST = 5
EVERY = 16
LEAST = 100
TOP = 2000
SLICE = 2 << 20

#: Lower-cased byte codes, 0 where a word ends; and where a piece ends.
WORD = text._table([0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)], True)
PIECE = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
SPACE = text._table([0x20], False)


def _cut(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings buf[start:end]."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _window(h: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    acc = np.full(len(at), words, text.U)
    for i in range(words):
        acc = (acc + h[at + i]) * text.U(text.BASE) ^ (acc >> text.U(29))
    return text.mix(acc)


def parse(buf: np.ndarray, off: np.ndarray, every=EVERY, longest=LONGEST):
    """Chunks of the texts of a slice: text, chunk as words joined by one space, number of words at which its own phrases start."""
    over = longest - 1
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    edge[1:] |= PIECE[buf]
    bounds = np.flatnonzero(edge)
    w = text.Words(buf, bounds, WORD)
    n = len(w.start)
    last = w.first[1:][w.doc]  # end of each word's piece
    begin = np.zeros(n, bool)
    begin[w.first[:-1][w.count > 0]] = True
    at = np.flatnonzero(np.arange(n) + over <= last)
    begin[at[_window(w.hash, at, over) % text.U(every) == 0]] = True
    head = np.flatnonzero(begin)
    next_ = np.append(head[1:], n)
    end = np.minimum(next_ + over, last[head]) if n else head
    # the words in order, one space after each
    size = w.end - w.start + 1
    place = np.concatenate([[0], np.cumsum(size)])
    lower = (WORD[buf] - 1).astype(np.uint8)
    joined = lower[np.minimum(np.arange(place[-1]) + np.repeat(w.start - place[:-1], size), max(len(buf) - 1, 0))] if n else lower[:0]
    joined[place[1:] - 1] = 0x20
    row = np.searchsorted(off, bounds[w.doc[head]], "right") - 1 if n else head
    return row, _cut(joined, place[head], place[end] - 1 if n else place[head]), next_ - head


def dictionary(docs: DataFrame, every=EVERY) -> DataFrame:
    """lang, chunk, own, n: every different chunk with the number of its occurrences, written to the shared folder."""

    def run(batches):
        for b in batches:
            for i, buf, off in text.slices(b.column(1)):
                row, chunk, own = parse(buf, off, every)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), chunk, pa.array(own.astype(np.int64))], ["lang", "chunk", "own"])

    chunks = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, chunk string, own long")
    return written(chunks.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("n")), "dictionary")


class Slice:
    """Words of dictionary chunks with their languages and weights."""

    def __init__(self, langs: pa.Array, buf, off, own, weight):
        self.buf, self.w = buf, text.Words(buf, off, SPACE)
        coded = langs.dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        marks = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in self.names.to_pylist()]
        self.lang, self.weight = np.array(marks, text.U)[self.code], weight
        self.pos = np.arange(len(self.w.start)) - self.w.first[:-1][self.w.doc]
        self.left = self.w.count[self.w.doc] - self.pos  # words from here to the end of the chunk
        self.own = self.pos < own[self.w.doc]

    def keys(self, at: np.ndarray, words: int) -> np.ndarray:
        return text.mix(_window(self.w.hash, at, words) ^ self.lang[self.w.doc[at]])

    def counted(self, at: np.ndarray, keys: np.ndarray):
        """The different keys, one place of each, and their weighted counts."""
        different, one, which = np.unique(keys, return_index=True, return_inverse=True)
        return different, at[one], np.bincount(which, self.weight[self.w.doc[at]], len(different)).astype(np.int64)


def _slices(batches):
    def out(held):
        t = pa.Table.from_batches(held).combine_chunks()
        lang, own, n = t.column(0).combine_chunks(), t.column(2).to_numpy(), t.column(3).to_numpy()
        for i, buf, off in text.slices(t.column(1), SLICE):
            j = i + len(off) - 1
            yield Slice(lang.slice(i, j - i), buf, off, own[i:j], n[i:j])

    held = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) > SLICE:
            yield from out(held)
            held = []
    if held:
        yield from out(held)


def _links(s: Slice, size: int, bits) -> np.ndarray:
    """For each word whether the `size` words from it on are a phrase found in the bit set; some words more at the end."""
    out = np.zeros(len(s.pos) + LONGEST, bool)
    at = np.flatnonzero(s.left >= size)
    out[at] = has(bits, s.keys(at, size))
    return out


def frequent_bits(words: DataFrame, size: int, least: int, shorter=None):
    """A broadcast bit set over the hashes of phrases of `size` words that may occur `least` times; `shorter`: that of phrases one word shorter."""
    spark = words.sparkSession

    def run(batches):
        for s in _slices(batches):
            at = np.flatnonzero(s.own & (s.left >= size))
            if shorter is not None:
                part = _links(s, size - 1, shorter.value)
                at = at[part[at] & part[at + 1]]
            key, _, n = s.counted(at, s.keys(at, size))
            yield pa.RecordBatch.from_arrays([pa.array(text.signed(key)), pa.array(n)], ["key", "n"])

    keys = written(words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"), "frequent")
    out = bits_of(keys, MOST_BITS)
    forget(keys)
    return spark.sparkContext.broadcast(out)


def frequent_phrases(words: DataFrame, least=LEAST, longest=LONGEST) -> DataFrame:
    """lang, phrase, m (words), a: all phrases of up to `longest` words that occur `least` times."""
    single = frequent_bits(words, 1, least)
    double = frequent_bits(words, 2, least, single)
    triple = frequent_bits(words, 3, least, double)

    def run(batches):
        for s in _slices(batches):
            found = [_links(s, size, bits.value) for size, bits in enumerate((single, double, triple), 1)]
            for m in range(1, longest + 1):
                at = np.flatnonzero(s.own & (s.left >= m))
                size = min(m, len(found))
                for i in range(m - size + 1):
                    at = at[found[size - 1][at + i]]
                _, one, n = s.counted(at, s.keys(at, m))
                lang = s.names.take(pa.array(s.code[s.w.doc[one]]))
                yield pa.RecordBatch.from_arrays([lang, _cut(s.buf, s.w.start[one], s.w.end[one + m - 1]), pa.array(np.full(len(one), m, np.int32)), pa.array(n)], ["lang", "phrase", "m", "n"])

    counted = words.mapInArrow(run, "lang string, phrase string, m int, n long")
    return counted.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def collocations(docs: DataFrame, least=LEAST, top=TOP, every=EVERY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` of every language."""
    spark = docs.sparkSession
    chunks = dictionary(docs, every)
    total = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    phrases = written(frequent_phrases(chunks, least), "phrases")
    candidates = phrases.filter(F.col("m") >= 2)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - m)"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(total, "lang")
    # 38 digits hold both products for counts below 10**15
    score = F.expr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = candidates.filter(F.col("m") >= 3).select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase"))
    kept = scored.join(longer, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", F.col("cut.l"), F.col("cut.r"), "n", F.col("cut.score"))
    # a first ranking in parts keeps a large language out of one task
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    parts = parts.withColumn("_place", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces),
starts as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
grams as (
  select lang, m, array_to_string(words[i : i + m - 1], ' ') as phrase, count(*) as f
  from starts, (select unnest(range(1, 6)) as m) where i + m - 1 <= len(words) group by all),
total as (select lang, cast(sum(f) as bigint) as n from grams where m = 1 group by lang),
cand as (select lang, m, phrase, f as a, string_split(phrase, ' ') as words from grams where m >= 2 and f >= 100),
cuts as (
  select c.lang, c.m, c.phrase, c.a, k, h.f as l, t.f as r, n, cast((cast(1000 as hugeint) * c.a * n) // (cast(h.f as hugeint) * t.f) as bigint) as score
  from (select *, unnest(range(1, m)) as k from cand) c
  join grams h on h.lang = c.lang and h.m = k and h.phrase = array_to_string(c.words[1 : k], ' ')
  join grams t on t.lang = c.lang and t.m = c.m - k and t.phrase = array_to_string(c.words[k + 1 : c.m], ' ')
  join total on total.lang = c.lang),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as p from cuts) where p = 1),
kept as (
  select * from best b where not exists (
    select 1 from cand c where c.lang = b.lang and c.m > b.m and 100 * c.a >= 100 * b.a and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""


@query("op11_collocations", SQL)
def op11_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))

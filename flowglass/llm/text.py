"""Helpers shared by the text operators: Arrow strings as bytes, words and their hashes, sliced by bytes.

Everything here works on one Arrow batch inside a task.  Batches are cut into slices of about
`SLICE` bytes (a longer text is a slice of its own), so memory follows the longest text, not the batch."""
import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n + n // 8, 1 << 16)  # a worker keeps the tables, so they follow the longest slice it has met
        inverse = pow(base, -1, 1 << 64)
        run = lambda b: np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, b, U)]))
        got = _POWERS[base] = (run(base), run(inverse))
    return got


def prefix_hash(codes: np.ndarray, base: int = BASE) -> np.ndarray:
    """Running polynomial sums: see `range_hash`."""
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes.astype(U) * powers(len(codes) + 1, base)[0][: len(codes)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of codes[start:end]: equal contents give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), base)[1][start] ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def as_strings(column) -> pa.Array:
    """The column as one Arrow array of strings; nulls become empty texts."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string())
    return a.fill_null("") if a.null_count else a


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the bounds of each."""
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column, limit: int = SLICE):
    """(first row, bytes, bounds) of runs of rows with about `limit` bytes."""
    buf, off = raw(as_strings(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _table(separators, upper_too: bool) -> np.ndarray:
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32 if upper_too else 0
    t[list(separators)] = 0
    return t


#: Lower-cased byte codes, 0 where a word ends: at white space, or at everything but digits, letters and non-ASCII.
SPACED = _table([0x20, *range(0x09, 0x0E)], True)
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)


class Words:
    """Words of a slice: `start`, `end` (bytes), `doc` (row in the slice), `hash`, and per row `count` and `first`."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        codes = table[buf]
        inside = codes != 0
        n = len(off) - 1
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        before = np.concatenate([[False], inside])  # before[i]: byte i-1 belongs to a word
        self.start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.concatenate([inside[1:], [False]])
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self.sums = prefix_hash(codes)
        self.hash = range_hash(self.sums, self.start, self.end)


#: The same words with their case kept.
CASED = _table([0x20, *range(0x09, 0x0E)], False)


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of `size` words, (row, hash); a row of fewer words, but not none, has its whole sequence as one."""
    h, rows, out = w.hash, [], []
    for m in range(min(size, int(w.count.max(initial=0))), 0, -1):
        if m == size:
            n = len(h) - m + 1
            at = np.flatnonzero(w.doc[:n] == w.doc[m - 1 :])
        else:
            at = w.first[:-1][w.count == m]
        acc = np.full(len(at), m, U)
        for i in range(m):
            acc = (acc + h[at + i]) * U(BASE) ^ (acc >> U(29))
        rows.append(w.doc[at])
        out.append(mix(acc))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows), np.concatenate(out)


def distinct(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (row, hash) pairs, sorted by row, and their number per row."""
    order = np.argsort(h ^ mix(doc.astype(U) + U(1)))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order], np.bincount(doc, minlength=rows)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row, hash) sorted by row, and the number per row."""
    return distinct(*grams(w, size), len(w.count))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list array of consecutive runs of `values`."""
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind) if kind else pa.array(values))

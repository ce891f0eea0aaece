"""Suffix arrays of a shard by induced sorting, and common prefixes in text order.

`suffix_array` classifies suffixes as smaller or larger than the next one, sorts the leftmost-smaller substrings (recursively on
their names where those repeat) and induces the order of all other suffixes in two passes over the buckets.  For small alphabets a
pass takes a whole bucket at a time; in the recursion, whose alphabet is large, it goes suffix by suffix.

`permuted_prefixes` gives for each position the common prefix with its neighbour in the array, in the order of the text."""
import numpy as np

from . import text

SMALL = 1024


def _append(sa, fill, items, chars, back):
    """Puts `items` at the open ends of their buckets, in order."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    n = np.diff(np.concatenate([head, [len(c)]]))
    rank = np.arange(len(c)) - np.repeat(head, n)
    if back:
        sa[fill[c] - rank] = items[order]
        fill[c[head]] -= n
    else:
        sa[fill[c] + rank] = items[order]
        fill[c[head]] += n


def _induce_buckets(s, smaller, starts, sorted_lms):
    n = len(s)
    sa = np.full(n, -1, np.int64)
    ends = starts[1:] - 1
    fill = ends.copy()
    _append(sa, fill, sorted_lms[::-1], s[sorted_lms[::-1]], True)
    lms_from = fill + 1
    larger, fill = ~smaller, starts[:-1].copy()
    used = np.flatnonzero(np.diff(starts))

    def spread(items, want, back):
        j = items[items > 0] - 1
        j = j[want[j]]
        if len(j):
            _append(sa, fill, j, s[j], back)

    for c in used:
        at = starts[c]
        while at < fill[c]:
            upto = fill[c]
            spread(sa[at:upto], larger, False)
            at = upto
        spread(sa[lms_from[c] : ends[c] + 1], larger, False)
    fill = ends.copy()
    larger_end = starts[:-1] + np.bincount(s[larger], minlength=len(ends))
    for c in used[::-1]:
        at = ends[c]
        while at > fill[c]:
            upto = fill[c]
            spread(sa[upto + 1 : at + 1][::-1], smaller, True)
            at = upto
        spread(sa[starts[c] : larger_end[c]][::-1], smaller, True)
    return sa


def _induce_items(s, smaller, starts, sorted_lms):
    n = len(s)
    table = np.full(n, -1, np.int64)
    ends = starts[1:] - 1
    _append(table, ends.copy(), sorted_lms[::-1], s[sorted_lms[::-1]], True)
    sa, chars, small, fill = table.tolist(), s.tolist(), smaller.tolist(), starts[:-1].tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = chars[j]
            sa[fill[c]] = j
            fill[c] += 1
    fill = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = chars[j]
            sa[fill[c]] = j
            fill[c] -= 1
    return np.array(sa, np.int64)


def _sort(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of `s` over 0..k-1, whose last member is its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # A suffix is smaller than the next if the first change after it is a rise; the last one counts as smaller.
    change = np.flatnonzero(s[1:] != s[:-1])
    rise = s[change] < s[change + 1]
    smaller = np.empty(n, bool)
    smaller[:-1] = rise[np.searchsorted(change, np.arange(n - 1))]
    smaller[-1] = True
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=k))])
    induce = _induce_buckets if k <= SMALL else _induce_items
    first = induce(s, smaller, starts, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # Names of the substrings from one leftmost-smaller position to the next, both included.
    until = np.zeros(n, np.int64)
    until[lms] = np.concatenate([lms[1:] + 1, [n]])
    h = text.range_hash(text.prefix_hash(s + 1), ordered, until[ordered])
    name = np.zeros(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    reduced = name[lms]
    if reduced.max() + 1 < len(lms):
        ordered = lms[_sort(reduced, int(reduced.max()) + 1)]
    return induce(s, smaller, starts, ordered)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of a sequence of non-negative numbers, in order."""
    if not len(s):
        return np.zeros(0, np.int64)
    padded = np.concatenate([s.astype(np.int64) + 1, [0]])
    return _sort(padded, int(padded.max()) + 1)[1:]


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, end: np.ndarray, least=0) -> tuple[np.ndarray, np.ndarray]:
    """Per position: common prefix with the suffix before it in the array, and with the one after it.

    `end[i]` is where the text of position i ends; prefixes do not reach beyond it.  With `least`, prefixes of at least that length
    are given as `least` and shorter ones as 0.  All positions halve their search range
    together, on hashes of ranges."""
    n = len(s)
    sums = text.prefix_hash(s.astype(np.int64) + 1)
    room = end - np.arange(n)

    def common(a, b):
        low, high = np.zeros(len(a), np.int64), np.minimum(room[a], room[b])
        if least:
            at = np.flatnonzero(high >= least)
            low[at[text.range_hash(sums, a[at], a[at] + least) == text.range_hash(sums, b[at], b[at] + least)]] = least
            return low
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live] + 1) >> 1
            x, y = a[live], b[live]
            same = text.range_hash(sums, x, x + mid) == text.range_hash(sums, y, y + mid)
            low[live[same]], high[live[~same]] = mid[same], mid[~same] - 1
        return low

    lcp = common(sa[:-1], sa[1:])
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[sa[1:]], after[sa[:-1]] = lcp, lcp
    return before, after

"""Recompression: a run-length grammar of a sequence, and longest common extensions from it.

The sequence is shortened in rounds.  A block round replaces every maximal run of one symbol by a symbol of its own (symbol, length);
a pair round gives each symbol a random side, left or right, and replaces every left symbol followed by a right one by a new symbol.
Equal pairs and equal blocks get equal names, so a string that occurs twice is parsed alike in both places but for its edges, and
a round leaves at most some three quarters of the symbols: all levels together are a small multiple of the sequence.

An extension query climbs while the two sides agree.  On each level at most one symbol (pair rounds) or one rest of a block (block
rounds) has to be stepped over before both sides stand at the start of a symbol of the next level.  From the first difference it
descends again, with at most one more such step per level.  Many queries climb together, level by level, as arrays.

The sequence must end, and for extensions to the left begin, with a symbol that occurs nowhere else."""
import numpy as np

from .text import U, mix

SIDES = 4  # assignments of sides tried per pair round; the best one is taken
TOP = 8  # symbols left at which the rounds stop


def _name(keys: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    different, rank = np.unique(keys, return_inverse=True)
    return (base + rank).astype(np.int32), base + len(different)


class Grammar:
    """`symbols[h]`: level h; `first[h]`: for each symbol of level h + 1 its first symbol on level h, with the end; `up[h]`: the other way."""

    def __init__(self, symbols, first, up, blocks):
        self.symbols, self.first, self.up, self.blocks = symbols, first, up, blocks

    def mirrored(self) -> "Grammar":
        """The grammar of the reversed sequence, by the same rounds."""
        first = [(len(s) - f)[::-1] for s, f in zip(self.symbols, self.first)]
        up = [(len(f) - 2 - u)[::-1] for f, u in zip(self.first, self.up)]
        return Grammar([s[::-1] for s in self.symbols], first, up, self.blocks)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from each a on and from each b on (a differs from b)."""
        out, at, start = np.zeros(len(a), np.int64), np.arange(len(a)), a
        stopped = []
        for symbols, first, up, block in zip(self.symbols, self.first, self.up, self.blocks):
            same = symbols[a] == symbols[b]
            stop = [(at[~same], a[~same], b[~same])]
            at, a, b = at[same], a[same], b[same]
            ua, ub = up[a], up[b]
            if block:
                rest, other = first[ua + 1] - a, first[ub + 1] - b
                uneven = rest != other
                step = np.minimum(rest, other)[uneven]
                stop.append((at[uneven], a[uneven] + step, b[uneven] + step))
                at, a, b = at[~uneven], ua[~uneven] + 1, ub[~uneven] + 1
            else:
                inside = (first[ua] != a) | (first[ub] != b)
                a, b = up[a + inside], up[b + inside]
            stopped.append(stop)
        symbols = self.symbols[-1]
        top = []
        while len(at):
            same = symbols[a] == symbols[b]
            top.append((at[~same], a[~same], b[~same]))
            at, a, b = at[same], a[same] + 1, b[same] + 1
        at, a, b = (np.concatenate(x) for x in zip(*top)) if top else (at, a, b)
        for h in range(len(self.first) - 1, -1, -1):
            symbols, first = self.symbols[h], self.first[h]
            ca, cb = first[a], first[b]
            same = symbols[ca] == symbols[cb]
            step = np.minimum(first[a + 1] - ca, first[b + 1] - cb) * same if self.blocks[h] else same
            at, a, b = (np.concatenate(x) for x in zip((at, ca + step, cb + step), *stopped[h]))
        out[at] = a - start[at]
        return out


def compress(sequence: np.ndarray) -> Grammar:
    """The grammar of a sequence of numbers below 2**31."""
    s = sequence.astype(np.int32)
    names = int(s.max(initial=0)) + 1
    symbols, first, up, blocks = [s], [], [], []

    def level(heads, new, block):
        heads = np.append(heads, len(symbols[-1])).astype(np.int32)
        up.append(np.repeat(np.arange(len(new), dtype=np.int32), np.diff(heads)))
        first.append(heads)
        symbols.append(new)
        blocks.append(block)

    seed = 0
    while len(symbols[-1]) > TOP:
        s = symbols[-1]
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(heads) < len(s):
            length = np.diff(np.append(heads, len(s)))
            new, many = s[heads], length > 1
            new[many], names = _name(new[many].astype(np.int64) * (len(s) + 1) + length[many], names)
            level(heads, new, True)
            s = new
        best = None
        for _ in range(SIDES):
            seed += 1
            right = (mix(s.astype(U) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64))) & U(1)).astype(bool)
            pair = ~right[:-1] & right[1:]
            if best is None or np.count_nonzero(pair) > np.count_nonzero(best):
                best = pair
        if not best.any():
            continue
        left = np.flatnonzero(best)
        keep = np.ones(len(s), bool)
        keep[left + 1] = False
        heads = np.flatnonzero(keep)
        new = s[heads]
        paired = best[np.minimum(heads, len(best) - 1)] & (heads < len(best))
        new[paired], names = _name(s[left].astype(np.int64) * names + s[left + 1], names)
        level(heads, new, False)
    return Grammar(symbols, first, up, blocks)

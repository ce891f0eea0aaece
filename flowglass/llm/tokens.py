"""Encoding texts by a public byte-level BPE vocabulary, inside tasks.

The splitting pattern of this vocabulary starts a new piece at every space (and at every lone line feed) that
stands before a visible character, so a text can be cut there and the parts encoded on their own.  Words repeat, so each
distinct part of a batch is encoded once and its ids are reused; the ids equal those of encoding the whole text."""
import base64
import itertools
import json
import os

import numpy as np
import pyarrow as pa

from . import text

VOCABULARY = "byte_bpe_50k.json"
KEEP = 400_000  # parts whose ids one task remembers (some 16 MB); beyond that it starts afresh
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x7F]] = True
#: First bytes of characters that are certainly visible: other white space starts with C2 or E1 to E3.
_VISIBLE = ~_SPACE
_VISIBLE[[*range(0x00, 0x20), *range(0x7F, 0xC3), 0xE1, 0xE2, 0xE3]] = False
_ASCII = _VISIBLE & (np.arange(256) < 0x80)
#: Bytes of printable ASCII, tab, line ends and the letters U+00C0 to U+027F: both libraries class these alike.
_COMMON = np.zeros(256, bool)
_COMMON[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts.  New parts of common letters go through the rank file of the same vocabulary, which is several times
    faster; parts with any other character, or with the text of a special token, through the vocabulary file itself."""

    def __init__(self, path: str | None = None):
        self.path = path = path or vocabulary_path()
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"].encode() for x in json.load(f).get("added_tokens", [])]
        self.whole = None
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            for b, i in table.items():
                self.width[i] = len(b)
        self.keys = np.zeros(0, np.uint64)  # hashes of the parts known so far, in order
        self.size = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def tokenizer(self):
        """The vocabulary file, loaded when a part first needs it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    def learn(self, buf: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.keys) > KEEP:
            self.keys, self.size, self.begin, self.flat = self.keys[:0], self.size[:0], self.begin[:0], self.flat[:0]
        odd = np.concatenate([[0], np.cumsum(~_COMMON[buf])])
        common = (odd[end] == odd[start]) if self.fast else np.zeros(len(keys), bool)
        data = buf.tobytes()
        if any(x in data for x in self.special):
            common &= [not any(x in data[a:b] for x in self.special) for a, b in zip(start.tolist(), end.tolist())]
        # Parts that begin with a space can be encoded in one go: such a space starts a new piece after any text.
        joined = common & (buf[start] == 0x20)
        run, size, flat = np.flatnonzero(joined), np.zeros(len(keys), np.int64), []
        if len(run):
            ids = self.fast.encode_to_numpy("".join([data[a:b].decode() for a, b in zip(start[run].tolist(), end[run].tolist())]))
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(end[run] - start[run])) + 1
            size[run] = np.diff(ends, prepend=0)
            flat.append(ids)
        rest = np.flatnonzero(~joined)
        got = [self.fast.encode_ordinary(data[start[i] : end[i]].decode()) if common[i] else self.tokenizer().encode(data[start[i] : end[i]].decode("utf-8", "replace"), add_special_tokens=False).ids for i in rest]
        size[rest] = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate([*flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size[rest].sum()))])
        place = np.empty(len(keys), np.int64)
        order = np.concatenate([run, rest])
        place[order] = np.cumsum(size[order]) - size[order]
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.begin = np.concatenate([self.begin, len(self.flat) + place])[order]
        self.keys, self.size, self.flat = keys[order], np.concatenate([self.size, size])[order], np.concatenate([self.flat, flat])

    def parts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first part of each row, per part its place among the known ones)."""
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        cut[-1] = True
        if len(buf) > 1:
            ahead = _VISIBLE[buf[1:]]
            cut[:-2] |= (buf[:-1] == 0x20) & ahead
            cut[1:-2] |= (buf[1:-1] == 0x0A) & ahead[1:] & _ASCII[buf[:-2]]
        bounds = np.flatnonzero(cut)
        start, end = bounds[:-1], bounds[1:]
        if not len(start):
            return np.zeros(len(off), np.int64), start
        h = text.range_hash(text.prefix_hash(buf.astype(np.uint16) + 1), start, end)
        order = np.argsort(h)
        ranked = h[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        keys, at = ranked[new], order[new]
        place = np.searchsorted(self.keys, keys)
        missing = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        missing[inside] = self.keys[place[inside]] != keys[inside]
        if missing.any():
            full = len(self.keys) > KEEP
            self.learn(buf, *((keys, start[at], end[at]) if full else (keys[missing], start[at[missing]], end[at[missing]])))
            place = np.searchsorted(self.keys, keys)
        which = np.empty(len(h), np.int64)
        which[order] = place[np.cumsum(new) - 1]
        return np.searchsorted(start, off), which

    def counts(self, column) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for _, buf, off in text.slices(column, SLICE):
            first, which = self.parts(buf, off)
            total = np.concatenate([[0], np.cumsum(self.size[which])])
            out.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def ids(self, column):
        """For each slice: (first row, ids of all its texts, bounds of each text)."""
        for i, buf, off in text.slices(column, SLICE):
            first, which = self.parts(buf, off)
            n = self.size[which]
            total = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[which], n)
            yield i, self.flat[place], total[first]


def count_column(docs, path: str | None = None, column: str = "text"):
    """A table of one column `length`: the number of ids of each text (null text: 0)."""

    def run(batches):
        encoder = Encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder.counts(b.column(0)), pa.int64())], ["length"])

    return docs.select(column).mapInArrow(run, "length long")

"""Capture files in byte ranges: the same frames however a file is cut, wrong guesses mended, damage named."""
import io
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowglass.sources import capture_files as C

T = 1_700_000_000_000_000


def some_frames(n, seed=1):
    rng = random.Random(seed)
    return [(T + 1000 * i + rng.randrange(900), bytes(rng.randrange(256) for _ in range(rng.choice([0, 14, 60, 300]))), i % 3) for i in range(n)]


def file_bytes(form, frames, **options):
    f = (C._Blocks if form == "blocks" else C._Classic)(options)
    return f.start() + b"".join(f.frame(t, b, len(b) + 5, i if form == "blocks" else 0) for t, b, i in frames)


def whole(data):
    return [(i, *r) for i, r in enumerate(C.walk(C.View.of(data)))]


def in_ranges(spark, tmp_path, files, split):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in C.read_ranges(spark, str(tmp_path), split).collect():
        got.setdefault(os.path.basename(r.path), []).append((r.idx, r.ts_us, None if r.frame is None else bytes(r.frame), r.original, r.problem))
    return {k: sorted(v) for k, v in got.items()}


CLASSIC = file_bytes("classic", some_frames(120))
BIG = file_bytes("classic", some_frames(90, 2), order=">")
BLOCKS = file_bytes("blocks", some_frames(150, 3), resolutions="6,9,148", section=7, order="<>")
ONE_SECTION = file_bytes("blocks", some_frames(90, 4), resolutions="6,9,3")


@pytest.mark.parametrize("split", [100, 1111, 1 << 20])
def test_ranges_give_the_frames_of_the_whole(spark, tmp_path, split):
    nested = [(T + i, CLASSIC[24 + 500 * i : 1800 + 500 * i] if i % 2 else BLOCKS[: 1500 + 4 * i], 0) for i in range(8)]  # captures carried inside frames
    files = {"a.pcap": CLASSIC, "b.pcap": BIG, "c.ng": BLOCKS, "d.ng": ONE_SECTION, "n.pcap": file_bytes("classic", nested), "n.ng": file_bytes("blocks", nested)}
    got = in_ranges(spark, tmp_path, files, split)
    for name, data in files.items():
        assert got[name] == sorted(whole(data)), name
    assert [r[1] for r in got["c.ng"]][:2] == [t for t, _, _ in some_frames(2, 3)]


def test_damage_ends_a_file(spark, tmp_path):
    broken = bytearray(CLASSIC)
    struct.pack_into("<I", broken, 24 + 8, 1 << 30)
    late = bytearray(BLOCKS)
    late[len(late) // 2 // 4 * 4 : len(late) // 2 // 4 * 4 + 4] = b"\xff\xff\xff\xff"
    files = {"broken.pcap": bytes(broken), "late.ng": bytes(late), "cut.pcap": CLASSIC[:-3], "cut.ng": BLOCKS[:-8], "short.pcap": CLASSIC[:24], "junk": b"no capture at all, but text of some length", "empty": b"", "head": CLASSIC[:10],
             "v3.pcap": CLASSIC[:4] + b"\x03\x00" + CLASSIC[6:]}
    got = in_ranges(spark, tmp_path, files, 300)
    for name, data in files.items():
        assert got.get(name, []) == ([] if name == "empty" else sorted(whole(data))), name
    assert got["broken.pcap"] == [(0, None, None, None, "invalid_length")] and got["junk"][0][4] == got["v3.pcap"][0][4] == "unsupported_capture"
    assert got["cut.pcap"][-1][4] == "truncated" and len(got["cut.pcap"]) == 120 and "short.pcap" not in got


def block(kind, body, o="<"):
    return C._block(o, kind, body)


def test_interfaces_of_blocks():
    section = block(C.SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    link = lambda code=None, kind=1: block(C.INTERFACE, struct.pack("<HHI", kind, 0, 0) + (b"" if code is None else struct.pack("<HHB3x", 9, 1, code)))
    packet = lambda i, units, data=b"x" * 5: block(C.PACKET, struct.pack("<IIIII", i, units >> 32, units & 0xFFFFFFFF, len(data), len(data)) + data)
    rows = whole(section + link() + link(0x80 | 1) + block(5, b"stat") + packet(1, 7) + block(3, b"simple") + packet(0, 7))
    assert [r[1] for r in rows] == [3_500_000, 7]
    problem = lambda data: whole(data)[-1][4]
    assert problem(section + packet(0, 1)) == "invalid_block"  # no interface yet
    assert problem(section + link() + section + packet(0, 1)) == "invalid_block"  # a section forgets them
    assert problem(section + link(64)) == "invalid_block" and problem(section + link(kind=113)) == "unsupported_capture"
    assert problem(section + struct.pack("<II", 6, 13) + b"\0" * 9) == "invalid_block"
    assert problem(section[:8] + b"zzzz" + section[12:]) == "invalid_block"
    assert whole(section + link(0) + packet(0, 1 << 62))[0][1] is None  # a stamp beyond 64 bits


def test_a_range_far_into_a_large_file():
    """Positions beyond 2 and 4 GB; the file is described, not stored."""

    class Far(io.RawIOBase):
        """Records of 1,016 bytes without end, each numbered by its second."""

        def seek(self, pos, whence=0):
            self.pos = pos
            return pos

        def read(self, n=-1):
            first = (self.pos - 24) // 1016
            data = b"".join(struct.pack("<IIII", 1_000_000 + i, 1, 1000, 1000) + b"\0" * 1000 for i in range(first, first + n // 1016 + 2))
            skip = (self.pos - 24) % 1016
            return data[skip : skip + n]

    size = 24 + 1016 * 6_000_000
    view = C.View(Far(), size)
    start = 5 << 30
    first = C.sync_classic(view, start, start + 100_000, "<", False, 65535)
    assert first >= start and (first - 24) % 1016 == 0
    rows = list(C.walk_classic(view, first, start + 100_000, "<", False, 65535))
    assert rows[0][1] == (1_000_000 + (first - 24) // 1016) * 1_000_000 + 1 and rows[-1][0] >= start + 100_000


def test_small_ranges_share_tasks(spark):
    """A task per range of a few kilobytes would spend its time on starting; large ranges keep a task each."""
    ranges = lambda n, size: spark.range(n).select((F.col("id") * size).alias("start"), ((F.col("id") + 1) * size).alias("end"))
    few = 4 * spark.sparkContext.defaultParallelism
    assert C._spread(ranges(500, 40_000)).rdd.getNumPartitions() == few
    assert C._spread(ranges(50, C.SPLIT)).rdd.getNumPartitions() == 50
    assert C._spread(ranges(500, C.TASK // 4)).rdd.getNumPartitions() == 125
    assert C._spread(ranges(500, 40_000).withColumnRenamed("start", "first")).count() == 500
    assert C._spread(ranges(0, 1)).count() == 0

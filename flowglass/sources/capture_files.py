"""Capture files read in byte ranges and written back as files, on any file system that pyarrow opens.

A record says where the next one starts, so a file looks like one long chain.  It is read in parallel in three steps:

1. Survey.  Every range looks for its first record by itself: an offset from which a chain of plausible headers starts.  It follows the
   chain to the first record beyond its end and reports where it entered and left, its number of frames and, for block captures, sections
   and interfaces.
2. Stitching.  A range must be entered where the one before was left.  Where a guess was wrong (a capture carried inside a frame,
   say) the range is surveyed again from the right place, until all agree; so guesses cost time, never rows.  Running sums give each range the number
   of its first frame, and the last section's interfaces so far.
3. Reading.  Every range yields its frames.

What a file holds after a damaged record is not read; one row names the problem."""
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import cut

FRAMES = "path string, idx long, ts_us long, frame binary, original long, problem string"
SPLIT = 64 << 20
TASK = 8 << 20
BUFFER = 4 << 20
CHAIN = 16  # headers in a row that make an offset plausible
MAX_RECORD = 16 << 20
MAX_BLOCK = (16 << 20) + 4096
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
#: First bytes of a classic capture: byte order and whether stamps are nanoseconds. Fixed values of the format.
CLASSIC = {b"\xa1\xb2\xc3\xd4": (">", False), b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\x3c\x4d": (">", True), b"\x4d\x3c\xb2\xa1": ("<", True)}


def store_of(path: str):
    """(file system, path in it) of a URI or an absolute local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class View:
    """Bytes of an open file by position, read ahead in buffers."""

    def __init__(self, f, size: int):
        self.f, self.size, self.start, self.data = f, size, 0, b""

    @classmethod
    def of(cls, data: bytes) -> "View":
        v = cls(io.BytesIO(data), len(data))
        v.data = data
        return v

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos; fewer at the end of the file."""
        k = pos - self.start
        if k < 0 or k + n > len(self.data):
            if k == 0 and len(self.data) == self.size:
                return self.data[:n]
            self.f.seek(min(pos, self.size))
            self.start, self.data = pos, self.f.read(max(n, BUFFER))
            k = 0
        return self.data[k : k + n]


@dataclass
class Section:
    """What a block capture carries from block to block."""

    order: str | None = None
    codes: list = None  # resolution code of each interface
    fresh: bool = False  # a section started here, so all its interfaces are known
    needs: int = 0  # interfaces that must have been declared before


def format_of(view: View):
    """('blocks', ...) or ('classic', order, nano, snap); None if the file is neither."""
    head = view.at(0, 24)
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        return ("blocks",)
    if len(head) < 24 or head[:4] not in CLASSIC:
        return None
    order, nano = CLASSIC[head[:4]]
    major, minor, _, _, snap, link = struct.unpack(order + "HHiIII", head[4:24])
    return ("classic", order, nano, snap) if (major, minor) == (2, 4) and link == 1 and 1 <= snap <= 1 << 24 else None


def walk_classic(view: View, pos: int, stop: int, order: str, nano: bool, snap: int, bodies=True):
    """(next position, stamp, frame, original length, problem) of the records that start in [pos, stop)."""
    header = struct.Struct(order + "IIII")
    while pos < min(stop, view.size):
        head = view.at(pos, 16)
        if len(head) < 16:
            yield None, None, None, None, "truncated"
            return
        sec, part, kept, full = header.unpack(head)
        if kept > snap or kept > full:
            yield None, None, None, None, "invalid_length"
            return
        if pos + 16 + kept > view.size:
            yield None, None, None, None, "truncated"
            return
        frame = view.at(pos + 16, kept) if bodies else b""
        pos += 16 + kept
        yield pos, sec * 1_000_000 + (part // 1000 if nano else part), frame, full, None


def ticks(code: int) -> int:
    return 2 ** (code & 127) if code & 128 else 10**code


def resolution(body: bytes, order: str) -> int:
    """The resolution code among the options of an interface block; 6 where none is given."""
    code, at = 6, 8
    while at + 4 <= len(body):
        option, n = struct.unpack_from(order + "HH", body, at)
        if option == 0:
            break
        if option == 9 and n and at + 4 < len(body):
            code = body[at + 4]
        at += 4 + (n + 3) // 4 * 4
    return code


def block_at(view: View, pos: int, order: str | None):
    """(order, kind, total) of a sound block at pos, else None."""
    head = view.at(pos, 12)
    if len(head) < 12:
        return None
    if head[:4] == b"\x0a\x0d\x0d\x0a":
        order = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}.get(head[8:12])
    if order is None:
        return None
    kind, total = struct.unpack_from(order + "II", head)
    if total < 12 or total % 4 or total > MAX_BLOCK or pos + total > view.size or struct.unpack(order + "I", view.at(pos + total - 4, 4))[0] != total:
        return None
    return order, kind, total


def walk_blocks(view: View, pos: int, stop: int, s: Section, open_=False, bodies=True):
    """As `walk_classic`; `s` follows the sections.  `open_`: interfaces declared before `pos` are unknown, frames only note what they need."""
    while pos < min(stop, view.size):
        if view.size - pos < 12:
            yield None, None, None, None, "truncated"
            return
        block = block_at(view, pos, s.order)
        if block is None:
            yield None, None, None, None, "invalid_block"
            return
        s.order, kind, total = block
        if kind == SECTION:
            s.codes, s.fresh = [], True
        elif kind == INTERFACE:
            body = view.at(pos + 8, total - 12)
            code = resolution(body, s.order) if len(body) >= 8 else 255
            if len(body) < 8 or code & 127 > 63 or struct.unpack_from(s.order + "H", body)[0] != 1:
                yield None, None, None, None, "invalid_block" if len(body) < 8 or code & 127 > 63 else "unsupported_capture"
                return
            s.codes.append(code)
        elif kind == PACKET:
            body = view.at(pos + 8, total - 12 if bodies else min(20, total - 12))
            fields = struct.unpack_from(s.order + "IIIII", body) if len(body) >= 20 else None
            unknown = fields and fields[0] >= len(s.codes)
            if not fields or fields[3] > fields[4] or 20 + fields[3] > total - 12 or (unknown and (s.fresh or not open_)):
                yield None, None, None, None, "invalid_block"
                return
            stamp = None
            if unknown:
                s.needs = max(s.needs, fields[0] - len(s.codes) + 1)
            else:
                stamp = (fields[1] << 32 | fields[2]) * 1_000_000 // ticks(s.codes[fields[0]])
            yield pos + total, stamp if stamp is None or stamp < 1 << 63 else None, body[20 : 20 + fields[3]] if bodies else b"", fields[4], None
        pos += total
        if kind != PACKET:
            yield pos, None, None, None, None  # no frame, but the chain goes on


def walk(view: View):
    """(stamp, frame, original length, problem) of a whole file."""
    form = format_of(view)
    if form is None:
        yield None, None, None, "unsupported_capture"
        return
    rows = walk_blocks(view, 0, view.size, Section(codes=[])) if form[0] == "blocks" else walk_classic(view, 24, view.size, *form[1:])
    for _, stamp, frame, full, problem in rows:
        if frame is not None or problem:
            yield stamp, frame, full, problem


def _numbers(data: bytes, at: int, step: int, order: str, n: int) -> np.ndarray:
    """The 32-bit numbers at `at`, `at + step`, ... of which there are n."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    cells = [b[at + i : at + i + (n - 1) * step + 1 : step] for i in range(4)]
    return sum(c << np.uint32(8 * (3 - i if order == ">" else i)) for i, c in enumerate(cells))


def sync_classic(view: View, start: int, stop: int, order: str, nano: bool, snap: int) -> int | None:
    """The first offset in the range from which `CHAIN` plausible records follow each other, or as many as the file has left."""
    header, limit = struct.Struct(order + "IIII"), 1_000_000_000 if nano else 1_000_000

    def plausible(pos):
        for _ in range(CHAIN):
            if pos == view.size:
                return True
            head = view.at(pos, 16)
            if len(head) < 16:
                return False
            sec, part, kept, full = header.unpack(head)
            if not (sec and part < limit and kept <= snap and kept <= full and pos + 16 + kept <= view.size):
                return False
            pos += 16 + kept
        return True

    window = 1 << 16
    for low in range(start, min(stop, view.size - 15), window):
        data = view.at(low, window + 16)
        n = min(window, len(data) - 15, stop - low)
        if n <= 0:
            break
        sec, part, kept, full = (_numbers(data, k, 1, order, n) for k in (0, 4, 8, 12))
        for i in np.flatnonzero((sec > 0) & (part < limit) & (kept > 0) & (kept <= snap) & (kept <= full) & (full <= MAX_RECORD)):
            if plausible(low + int(i)):
                return low + int(i)
    return None


def sync_blocks(view: View, start: int, stop: int) -> tuple[int, str] | None:
    """The first offset in the range from which `CHAIN` sound blocks follow each other, with the byte order."""

    def sound(pos, order):
        for _ in range(CHAIN):
            if pos == view.size:
                return True
            block = block_at(view, pos, order)
            if block is None:
                return False
            order, pos = block[0], pos + block[2]
        return True

    window = 1 << 16
    for low in range(-(-start // 4) * 4, min(stop, view.size - 11), window):
        data = view.at(low, window + 12)
        n = min(window // 4, (len(data) - 8) // 4, -(-(stop - low) // 4))
        if n <= 0:
            break
        found = set()
        for order in "<>":
            total = _numbers(data, 4, 4, order, n)
            found |= {(low + 4 * int(i), order) for i in np.flatnonzero((total >= 12) & (total <= MAX_BLOCK) & (total % 4 == 0) & (total <= view.size))}
        for pos, order in sorted(found):
            if sound(pos, order):
                return pos, (block_at(view, pos, order) or (order,))[0]
    return None


SURVEY = "path string, size long, no long, start long, end long, first long, order string, after long, last_order string, frames long, fresh boolean, codes array<int>, needs long, stopped boolean"


def survey_range(view: View, no: int, start: int, end: int, first: int | None, order: str | None) -> tuple:
    """(first, order, after, last_order, frames, fresh, codes, needs, stopped); all null if no record starts in the range."""
    form = format_of(view)
    if form is None:
        return (0, None, None, None, 0, False, [], 0, True) if no == 0 else (None, None, None, None, 0, False, [], 0, False)
    blocks = form[0] == "blocks"
    if no == 0:
        first = 0 if blocks else 24
    elif first is None:
        got = sync_blocks(view, start, end) if blocks else sync_classic(view, start, end, *form[1:])
        first, order = got if blocks and got else (got, None) if not blocks else (None, None)
    if first is None or first >= end and no:
        return None, None, None, None, 0, False, [], 0, False
    s = Section(order, [])
    rows = walk_blocks(view, first, end, s, open_=no > 0, bodies=False) if blocks else walk_classic(view, first, end, *form[1:], bodies=False)
    after, frames, stopped = first, 0, False
    for pos, _, frame, _, problem in rows:
        if problem:
            stopped = True
            break
        after, frames = pos, frames + (frame is not None)
    return first, order, after, s.order if blocks else None, frames, s.fresh, s.codes, s.needs, stopped


def ranges_of(spark: SparkSession, path: str, split: int) -> DataFrame:
    """Every file below `path` cut into ranges; only names and sizes are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    no = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / split)))).alias("no")
    r = files.select("path", "size", no).withColumns({"start": F.col("no") * split, "end": F.least("size", (F.col("no") + 1) * split)})
    return r.withColumns({"first": F.lit(None).cast("long"), "order": F.lit(None).cast("string")})


def _opened(path: str, size: int):
    fs, inner = store_of(path)
    return View(fs.open_input_file(inner), int(size))


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SURVEY.split(", ")]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            first, order = None if pd.isna(r.first) else int(r.first), None if pd.isna(r.order) else r.order
            out.append((r.path, r.size, r.no, r.start, r.end, *survey_range(_opened(r.path, r.size), r.no, r.start, r.end, first, order)))
        yield pd.DataFrame(out, columns=names).astype({"first": "Int64", "after": "Int64"})


def _spread(ranges: DataFrame) -> DataFrame:
    """One task per range, up to some ten thousand; ranges of few bytes share tasks of about `TASK`, so that starting them is not the work."""
    begin = F.col("start") if "start" in ranges.columns else F.col("first")
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - begin), F.lit(0))).first()
    least = 4 * ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, 20_000, max(least, -(-size // TASK)))))


def surveyed(spark: SparkSession, path: str, split=SPLIT) -> DataFrame:
    """The ranges of all files, each entered where the one before was left."""
    cols = ["path", "size", "no", "start", "end", "first", "order"]
    s = cut(_spread(ranges_of(spark, path, split)).select(*cols).mapInPandas(_survey, SURVEY))
    before = W.partitionBy("path").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    while True:
        told = s.withColumns({"_at": F.last("after", True).over(before), "_order": F.last("last_order", True).over(before), "_over": F.coalesce(F.max("stopped").over(before), F.lit(False))})
        inside = F.col("_at") < F.col("end")
        wrong = (F.col("no") > 0) & ~F.col("_over") & F.when(inside, ~F.col("first").eqNullSafe(F.col("_at")) | ~F.col("order").eqNullSafe(F.col("_order"))).otherwise(F.col("first").isNotNull())
        told = told.withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
        # of neighbours that disagree the first one is certainly wrong; the others may only follow from it
        told = told.withColumn("_again", F.col("_wrong") & ~F.coalesce(F.lag("_wrong").over(W.partitionBy("path").orderBy("no")), F.lit(False)))
        told = cut(told)
        again = told.filter("_again")
        if again.isEmpty():
            return told.filter("not _over").select(*[c.split()[0] for c in SURVEY.split(", ")])
        mended = _spread(again.select("path", "size", "no", "start", "end", F.col("_at").alias("first"), F.col("_order").alias("order"))).mapInPandas(_survey, SURVEY)
        s = cut(told.filter("not _again").select(*s.columns).unionByName(mended))


def read_ranges(spark: SparkSession, path: str, split=SPLIT) -> DataFrame:
    """Frames of every capture file below `path` in file order: path, idx, ts_us, frame, original, problem."""
    s = surveyed(spark, path, split)
    order = W.partitionBy("path").orderBy("no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"base": F.coalesce(F.sum("frames").over(before), F.lit(0)), "_section": F.sum(F.col("fresh").cast("long")).over(order)})
    known = F.flatten(F.collect_list(F.when(F.size("codes") > 0, F.col("codes"))).over(W.partitionBy("path", "_section").orderBy("no")))  # of the section so far; only ranges that declare some
    s = s.withColumn("_known", known).withColumn("known", F.coalesce(F.lag("_known").over(order), F.array().cast("array<int>")))
    s = s.withColumn("_short", ((F.col("needs") > F.size("known")) | F.col("stopped")).cast("int")).withColumn("_over", F.coalesce(F.max("_short").over(before), F.lit(0)))
    todo = cut(s.filter("_over = 0 and first is not null").select("path", "size", "no", "first", "order", "end", "base", "known"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in FRAMES.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                view = _opened(r["path"], r["size"])
                form = format_of(view)
                if form is None:
                    rows = iter([(None, None, None, None, "unsupported_capture")])
                elif form[0] == "blocks":
                    rows = walk_blocks(view, r["first"], r["end"], Section(r["order"], list(r["known"])))
                else:
                    rows = walk_classic(view, r["first"], r["end"], *form[1:])
                out, held, idx = [], 0, r["base"]
                for _, stamp, frame, full, problem in rows:
                    if frame is None and not problem:
                        continue
                    out.append((r["path"], idx, stamp, frame, full, problem))
                    idx, held = idx + 1, held + len(frame or b"")
                    if held > BUFFER or len(out) == 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return _spread(todo).mapInArrow(read, FRAMES)


def _block(order: str, kind: int, body: bytes) -> bytes:
    total = struct.pack(order + "I", 12 + len(body) + -len(body) % 4)
    return struct.pack(order + "I", kind) + total + body + b"\0" * (-len(body) % 4) + total


class _Classic:
    """Bytes of one classic capture, microsecond stamps."""

    def __init__(self, options):
        self.order = options.get("order", "<")

    def start(self) -> bytes:
        return struct.pack(self.order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 1)

    def frame(self, ts_us, frame, original, _) -> bytes:
        return struct.pack(self.order + "IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), original) + frame


class _Blocks:
    """Bytes of one block capture: a new section every `section` frames (0: one only), byte orders in turn, interfaces by resolution code."""

    def __init__(self, options):
        self.codes = [int(x) for x in options.get("resolutions", "6").split(",")]
        self.every, self.orders, self.count = int(options.get("section", 0)), options.get("order", "<"), 0

    def start(self) -> bytes:
        o = self.order = self.orders[(self.count // self.every if self.every else 0) % len(self.orders)]
        out = [_block(o, SECTION, struct.pack(o + "IHHq", 0x1A2B3C4D, 1, 0, -1))]
        for c in self.codes:
            option = b"" if c == 6 else struct.pack(o + "HH", 9, 1) + bytes([c, 0, 0, 0]) + struct.pack(o + "HH", 0, 0)
            out.append(_block(o, INTERFACE, struct.pack(o + "HHI", 1, 0, 0) + option))
        return b"".join(out)

    def frame(self, ts_us, frame, original, interface) -> bytes:
        head = self.start() if self.every and self.count and self.count % self.every == 0 else b""
        self.count += 1
        units = -(-ts_us * ticks(self.codes[interface]) // 1_000_000)  # rounded up, so that reading rounds back to the stamp
        body = struct.pack(self.order + "IIIII", interface, units >> 32, units & 0xFFFFFFFF, len(frame), original) + frame
        return head + _block(self.order, PACKET, body)


@dataclass
class Written(WriterCommitMessage):
    names: tuple


class CaptureWriter(DataSourceArrowWriter):
    """Takes file, ts_us, frame, original, interface; the rows of a file stand together and in order.  Files appear when all tasks are done."""

    def __init__(self, options):
        self.options = dict(options)

    def _root(self):
        fs, root = store_of(self.options["path"])
        return fs, root.rstrip("/")

    def write(self, iterator):
        fs, root = self._root()
        fs.create_dir(f"{root}/_temporary", recursive=True)
        names, out, form, here = [], None, None, None
        for b in iterator:
            for r in b.to_pylist():
                if r["file"] != here:
                    if out:
                        out.close()
                    here = r["file"]
                    names.append((f"{uuid.uuid4().hex}", here))
                    out = fs.open_output_stream(f"{root}/_temporary/{names[-1][0]}", compression=None)
                    form = _Blocks(self.options) if self.options.get("form") == "blocks" else _Classic(self.options)
                    out.write(form.start())
                out.write(form.frame(r["ts_us"], r["frame"], len(r["frame"]) if r["original"] is None else r["original"], r["interface"] or 0))
        if out:
            out.close()
        return Written(tuple(names))

    def commit(self, messages):
        fs, root = self._root()
        fs.create_dir(root, recursive=True)
        for temporary, name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/_temporary/{temporary}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, root = self._root()
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class CaptureFiles(DataSource):
    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return "file string, ts_us long, frame binary, original long, interface int"

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options)


def write_captures(frames: DataFrame, path: str, **options) -> None:
    """One capture file per `file`, frames by (ts_us, seq); options: form=classic|blocks, order, resolutions, section."""
    frames.sparkSession.dataSource.register(CaptureFiles)
    rows = frames.repartition("file").sortWithinPartitions("file", "ts_us", "seq").select("file", "ts_us", "frame", "original", "interface")
    rows.write.format("captures").options(path=path, **{k: str(v) for k, v in options.items()}).mode("append").save()

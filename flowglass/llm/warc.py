"""WARC archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing.  Each task writes its own file (a new one after `file_bytes`) under a temporary name; the files get their names
when all tasks have committed, so a retried task leaves no double records.  Every record is a gzip member of its own whose
extra field `sl` holds the member's length.

Reading.  Files are planned into partitions of about `partition_bytes`.  A record's headers are parsed first, from the head of
its member; predicates on header columns are pushed down to that point, and a record that fails them, or whose payload is not
in the schema asked for, is skipped by its length without inflating the rest.  Members without the extra field and plain
archives are read too.  A payload that does not have its stated SHA-1 raises an error.  A file is not split.

Columns: see SCHEMA; any subset can be asked for with `spark.read.schema`.  `page_id` is the number in a record id written here.

`archive` writes pages: null html is an empty payload, a null url leaves the header out, a null page_id an id without number.
Of pages with equal payloads of at least `min_bytes` the one with the smallest page_id is a response and the others revisit it;
rows of equal page_id and payload are all responses, or all revisits.  An empty table gives an archive without records."""
import base64
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from ..plans.catalog import query
from ..plans.views import table
from .store import folder, written

SCHEMA = ("record_id string, record_type string, page_id bigint, target_uri string, warc_date string, payload_digest string, refers_to string, refers_to_page bigint, "
          "content_length bigint, payload_bytes bigint, payload binary")
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PAGE = "<urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = 2048


def store_of(path: str):
    """(file system, path in it) of a URI or an absolute local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_number(record_id: str | None) -> int | None:
    tail = record_id[len(PAGE) : -1] if record_id and record_id.startswith(PAGE) else ""
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = lambda i: f"{PAGE}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with the skip lengths (its own and the data's) in the extra field `sl`; 0 where they don't fit."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 24 + len(body) + 8
    sizes = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *sizes) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


class _Plain:
    """Records of an uncompressed archive: `head(n)` gives the first n bytes of a record, `rest()` all, `skip(n)` moves on."""

    def __init__(self, f, size):
        self.f, self.size, self.at = f, size, 0

    def more(self):
        return self.at < self.size

    def head(self, n):
        return self.f.read_at(min(n, self.size - self.at), self.at)

    def rest(self, n):
        return self.head(n)

    def skip(self, n):
        self.at += n


class _Gzip:
    """The same for gzip members; a member with skip lengths is only read as far as it is wanted."""

    def __init__(self, f, size):
        self.f, self.size, self.at, self.whole = f, size, 0, None

    def more(self):
        return self.at < self.size

    def _start(self):
        h = self.f.read_at(min(64, self.size - self.at), self.at)
        if h[3] & 4:
            (extra,) = struct.unpack("<H", h[10:12])
            if extra == 12 and h[12:14] == b"sl":
                return struct.unpack("<I", h[16:20])[0]
        return 0

    def head(self, n):
        if self.whole is None:
            self.length = self._start()
            if not self.length:
                self.rest(None)
            else:
                data = self.f.read_at(min(self.length, n), self.at)
                return zlib.decompressobj(31).decompress(data, n)
        return self.whole[:n]

    def rest(self, _):
        if self.whole is None:
            z, parts, at = zlib.decompressobj(31), [], self.at
            while not z.eof and at < self.size:
                data = self.f.read_at(min(self.length or 1 << 16, self.size - at), at)
                at += len(data)
                parts.append(z.decompress(data))
            if not z.eof:
                raise ValueError("a gzip member is cut off")
            self.whole, self.length = b"".join(parts), at - len(z.unused_data) - self.at
        return self.whole

    def skip(self, _):
        self.at += self.length
        self.whole = None


@dataclass
class Files(InputPartition):
    files: tuple


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.types = [f.dataType.simpleString() for f in schema.fields]
        self.path, self.limit = options["path"], int(options.get("partition_bytes", 64 << 20))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            ops = {EqualTo: "eq", In: "in", StringStartsWith: "starts", IsNotNull: "set", IsNull: "unset"}
            if column in HEADER and type(f) in ops:
                self.tests.append((HEADER[column], ops[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = store_of(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        found = sorted(((i.path, i.size) for i in found if i.path.endswith((".warc", ".warc.gz")) and not i.base_name.startswith(("_", "."))), key=lambda x: -x[1])
        parts, size = [[]], 0
        for path, n in found:
            if parts[-1] and size + n > self.limit:
                parts.append([])
                size = 0
            parts[-1].append((path, n))
            size += n
        return [Files(tuple(p)) for p in parts]

    def wanted(self, h) -> bool:
        for name, op, value in self.tests:
            got = h.get(name)
            if op == "unset" and got is not None or op != "unset" and got is None:
                return False
            if op == "eq" and got != value or op == "in" and got not in value or op == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition):
        fs, _ = store_of(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                for row in self.records((_Gzip if path.endswith(".gz") else _Plain)(f, size)):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > 8 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in zip(self.names, self.types)], self.names)

    def records(self, source):
        while source.more():
            n = HEAD
            while (end := (head := source.head(n)).find(b"\r\n\r\n")) < 0:
                if len(head) < n and n > 1 << 24:
                    raise ValueError("a record has no end of headers")
                n *= 4
            h = parse_headers(head[:end])
            block, begin = int(h["content-length"]), end + 4
            if self.wanted(h):
                yield self.row(h, source, head, begin, block)
            source.skip(begin + block + 4)

    def row(self, h, source, head, begin, block):
        out = {c: h.get(k) for c, k in HEADER.items()} | {"page_id": page_number(h.get("warc-record-id")), "refers_to_page": page_number(h.get("warc-refers-to")), "content_length": block}
        http = h.get("content-type", "").startswith("application/http")
        full = "payload" in self.names and h["warc-type"] in ("response", "resource")
        inner = -1
        if http:
            n = HEAD
            while (inner := head.find(b"\r\n\r\n", begin, begin + block)) < 0 and len(head) < begin + block:
                n *= 4
                head = source.head(begin + n)
            said = parse_headers(head[begin : max(inner, begin)]).get("content-length")
            out["payload_bytes"] = int(said) if said else None
        if full:
            data = source.rest(begin + block)[begin : begin + block]
            out["payload"] = data = data[inner + 4 - begin :] if inner >= 0 else data
            out["payload_bytes"] = len(data)
            digest = h.get("warc-payload-digest", "")
            if digest.startswith("sha1:") and digest[5:] != base32_sha1(data):
                raise ValueError(f"payload of {h.get('warc-record-id')} does not have its digest")
        return out


@dataclass
class Written(WriterCommitMessage):
    files: tuple


class WarcWriter(DataSourceArrowWriter):
    """Takes columns record_type, page_id, url, payload (binary) and refers_to."""

    def __init__(self, options):
        self.path = options["path"]
        self.level, self.roll = int(options.get("level", 6)), int(options.get("file_bytes", 256 << 20))

    def write(self, iterator):
        fs, root = store_of(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        files, out, size, name = [], None, 0, uuid.uuid4().hex
        for b in iterator:
            for r in b.to_pylist():
                if out is None or size > self.roll:
                    if out:
                        out.close()
                    files.append(f"{name}-{len(files):04d}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/_temporary/{files[-1]}", compression=None), 0
                payload = r["payload"] or b""
                data = member(record(r["record_type"], r["page_id"], r["url"], payload, base32_sha1(payload), r["refers_to"]), self.level)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(tuple(files))

    def commit(self, messages):
        fs, root = store_of(self.path)
        fs.create_dir(root, recursive=True)
        for f in (f for m in messages if m for f in m.files):
            fs.move(f"{root}/_temporary/{f}", f"{root}/part-{f}")
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")

    def abort(self, messages):
        fs, root = store_of(self.path)
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def columns(*names: str) -> str:
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def archive(pages: DataFrame, path: str, min_bytes=0) -> None:
    """Writes one record per row of `pages` (page_id, url, html); equal payloads are stored once.

    Only digests are grouped (with partial counts); they are written before the join
    back, so both sides are dealt anew and Spark can split a hot digest."""
    spark = ready(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"_digest": F.sha1("payload"), "_bytes": F.length("payload")})
    first = written(p.groupBy("_digest", "_bytes").agg(F.min("page_id").alias("_first")), "digests")
    again = (F.col("_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    out = p.join(first, ["_digest", "_bytes"]).select(F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url",
                                                     F.col("payload"), F.when(again, F.col("_first")).alias("refers_to"))
    out.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, *names: str) -> DataFrame:
    return ready(spark).read.format("warc").schema(columns(*names) if names else SCHEMA).load(path)


# SHA-1 in base32: every five hexadecimal digits are four characters.
_B32 = ("array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: "
        "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, cast(1 + 5 * i as bigint), 5) as bigint) >> s) & 31), 1)), '')), '')")


@query("op1_warc", f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(encode(coalesce(html, ''))) as h from pages),
f as (select *, min(page_id) over (partition by h) as first_id from p)
select page_id, payload_bytes, {_B32} as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to from f""")
def op1_warc(spark, sf):
    path = folder(spark, "warc")
    archive(table(spark, sf, "pages"), path)
    common = ["page_id", "payload_bytes", F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type"]
    # Responses are read whole and checked against their digests; of revisits only the headers are read.
    whole = read(spark, path, "record_type", "page_id", "payload_digest", "payload_bytes", "payload").filter("record_type = 'response'")
    heads = read(spark, path, "record_type", "page_id", "payload_digest", "refers_to_page", "payload_bytes").filter("record_type = 'revisit'")
    return whole.select(*common, F.lit(None).cast("long").alias("refers_to")).unionByName(heads.select(*common, F.col("refers_to_page").alias("refers_to")))

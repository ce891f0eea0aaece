"""Byte-level decoding: frame headers by arithmetic over batches, messages as column expressions over BINARY columns."""
import socket
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tls
from ..functions.text import col


def u(b, off, n: int) -> Column:
    """Unsigned big-endian integer of `n` bytes at byte offset `off`; null past the end."""
    b, off = col(b), (F.lit(off) if isinstance(off, int) else off).cast("int")
    return F.when((off >= 0) & (F.length(b) >= off + n), F.conv(F.hex(F.substr(b, off + 1, F.lit(n))), 16, 10).cast("long"))


def cut_bytes(b, off, n) -> Column:
    off, n = (F.lit(x) if isinstance(x, int) else x for x in (off, n))
    return F.substr(col(b), off.cast("int") + 1, F.greatest(n, F.lit(0)).cast("int"))


def stage(df: DataFrame, cols: dict) -> DataFrame:
    """Adds columns behind a Generate node.

    Filters on decoded fields are then not substituted back through every earlier
    step, which would multiply the byte expressions."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def ipv4(b, off) -> Column:
    off = F.lit(off) if isinstance(off, int) else off
    return F.concat_ws(".", *[u(b, off + i, 1).cast("string") for i in range(4)])


def ipv6(b, off) -> Column:
    """Canonical compressed text; addresses ending in an embedded IPv4 part print it dotted."""
    off = F.lit(off) if isinstance(off, int) else off
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(u(b, off + 2 * i, 2))))
    s = F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":"))
    text = F.substr(s, F.lit(2), F.length(s) - 2)
    for n in range(2, 9):
        run = ":0" * n + ":"
        at = F.locate(run, s)
        left = F.regexp_replace(F.substr(s, F.lit(1), at - 1), "^:", "")
        right = F.regexp_replace(F.substr(s, at + len(run), F.length(s)), ":$", "")
        text = F.when(at > 0, F.concat(left, F.lit("::"), right)).otherwise(text)
    high = F.lower(F.hex(cut_bytes(b, off, 12)))
    dotted = ipv4(b, off + 12)
    sixth = u(b, off + 12, 2)
    return F.when(high == "0" * 20 + "ffff", F.concat(F.lit("::ffff:"), dotted)).when((high == "0" * 24) & (sixth > 0), F.concat(F.lit("::"), dotted)).otherwise(text)


DECODED = T.StructType([T.StructField(n, t) for n, t in (
    ("status", T.StringType()), ("src_ip", T.StringType()), ("dst_ip", T.StringType()), ("src_port", T.IntegerType()), ("dst_port", T.IntegerType()), ("tcp_flags", T.IntegerType()),
    ("tcp_seq", T.LongType()), ("tcp_window", T.IntegerType()), ("payload", T.BinaryType()), ("protocol", T.IntegerType()), ("ip_bytes", T.LongType()))])


def _ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray, known: np.ndarray) -> pa.Array:
    """Binary values data[start:start + size], null where not known."""
    size = np.where(known, np.maximum(size, 0), 0)
    off = np.concatenate([[0], np.cumsum(size)])
    body = data[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    mask = pa.array(known).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [mask, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.binary())


def _address_text(packed: np.ndarray, known: np.ndarray, family: int) -> np.ndarray:
    """Text of addresses given as rows of bytes; each different one is written once."""
    out = np.full(len(packed), None, object)
    if known.any():
        different, which = np.unique(packed[known], axis=0, return_inverse=True)
        out[known] = np.array([socket.inet_ntop(family, x.tobytes()) for x in different], object)[which.ravel()]
    return out


def _decoded(frame: pa.Array) -> list[pa.Array]:
    """The columns of `DECODED` for a batch of frames, by array arithmetic over all bytes; -1 stands for a number past the end."""
    a = frame.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
    start, size = off[:-1], np.diff(off)

    def num(at, n):
        inside = (at >= 0) & (at + n <= size)
        first = np.where(inside, start + at, 0)
        value = np.zeros(len(size), np.int64)
        for i in range(n):
            value = value << 8 | data[np.minimum(first + i, len(data) - 1)]
        return np.where(inside, value, -1)

    zero = np.zeros(len(size), np.int64)
    eth = num(zero + 12, 2)
    tagged = eth == 0x8100
    l3 = np.where(tagged, 18, 14)
    kind = np.where(tagged, num(zero + 16, 2), eth)
    v4, v6 = kind == 0x0800, kind == 0x86DD
    first = num(l3, 1)
    total = np.where(v4, num(l3 + 2, 2), num(l3 + 4, 2))
    protocol = np.where(v4, num(l3 + 9, 1), np.where(v6, num(l3 + 6, 1), -1))
    head = np.where(v4, (first & 15) * 4, 40)
    l4 = l3 + head
    ip_bytes = np.where(v4, np.minimum(total, size - l3), 40 + total)
    end = np.minimum(size, l3 + ip_bytes)
    tcp, udp = protocol == 6, protocol == 17
    of, length = num(l4 + 12, 2), num(l4 + 4, 2)
    tcp_head = (of >> 12) * 4
    bad4 = (head < 20) | (first >> 4 != 4) | (total < head) | (size < l3 + head)
    cases = [(size < 14, "SHORT_FRAME"), (v4 & (size < l3 + 20), "SHORT_IPV4"), (v4 & bad4, "INVALID_IHL"), (v4 & (num(l3 + 6, 2) & 0x3FFF != 0), "unsupported"), (v6 & (size < l3 + 40), "SHORT_IPV6"),
             (~(v4 | v6), "unsupported"), (tcp & (end < l4 + 20), "SHORT_TCP"), (tcp & ((tcp_head < 20) | (l4 + tcp_head > end)), "INVALID_TCP_LENGTH"),
             (udp & (end < l4 + 8), "SHORT_UDP"), (udp & ((length < 8) | (l4 + length > end)), "INVALID_UDP_LENGTH")]
    status = np.select([c for c, _ in cases], np.arange(len(cases)), len(cases))
    ok = status == len(cases)
    whole = lambda value, known, t: pa.array(value, t, mask=~known)
    texts = []
    for at4, at6 in ((12, 8), (16, 24)):
        text = np.full(len(size), None, object)
        for family, here, at, n in ((socket.AF_INET, ok & v4, at4, 4), (socket.AF_INET6, ok & v6, at6, 16)):
            place = np.where(here, start + l3 + at, 0)[:, None] + np.arange(n)
            text = np.where(here, _address_text(data[np.minimum(place, len(data) - 1)], here, family), text)
        texts.append(pa.array(text, pa.string()))
    ports = ok & (tcp | udp)
    t = ok & tcp
    body = np.where(tcp, l4 + tcp_head, l4 + 8)
    names = np.array([n for _, n in cases] + ["ok"], object)
    return [pa.array(names[status], pa.string()), *texts, whole(num(l4, 2), ports, pa.int32()), whole(num(l4 + 2, 2), ports, pa.int32()), whole(of & 0x1FF, t, pa.int32()), whole(num(l4 + 4, 4), t, pa.int64()),
            whole(num(l4 + 14, 2), t, pa.int32()), _ranges(data, start + body, np.where(tcp, end, l4 + length) - body, ports), whole(protocol, ok, pa.int32()), whole(ip_bytes, ok, pa.int64())]


def decode_frames(frames: DataFrame, frame="frame") -> DataFrame:
    """Ethernet (one VLAN tag), IPv4/IPv6, TCP/UDP headers.

    Adds `status` ('ok', 'unsupported' or a corruption reason), addresses, ports, flags,
    window, TCP sequence number, IP length and `payload`.  A batch is decoded at once, by arithmetic over the bytes of all its frames."""
    kept = [f for f in frames.schema.fields if f.name not in DECODED.names]
    at = next(i for i, f in enumerate(kept) if f.name == frame)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *_decoded(b.column(at).fill_null(b""))], [*b.schema.names, *DECODED.names])

    return frames.select(*[f.name for f in kept]).mapInArrow(run, T.StructType(kept + DECODED.fields))


def dns_name(p, start=12) -> Column:
    """Struct (name, next, ok) of a wire name: backward compression pointers only, at most 128 hops, wire length at most 255."""
    p = col(p)
    init = F.struct(F.lit(start).alias("pos"), F.lit(-1).alias("nxt"), F.lit(1).alias("wire"), F.lit("").alias("name"), F.lit(0).alias("st"))

    def step(s, _):
        n, pos = u(p, s["pos"], 1).cast("int"), s["pos"]
        target = u(p, pos, 2).bitwiseAND(F.lit(0x3FFF)).cast("int")
        pointer = n.bitwiseAND(F.lit(0xC0)) == 0xC0
        label = cut_bytes(p, pos + 1, n).cast("string")
        fits = (F.length(p) >= pos + 1 + n) & label.rlike("^[!-\\-/-~]*$") & (s["wire"] + n + 1 <= 255)
        go = lambda **k: F.struct(*[k.get(f, s[f]).alias(f) for f in ("pos", "nxt", "wire", "name", "st")])
        bad = go(st=F.lit(-1))
        return (F.when(s["st"] != 0, s).when(n.isNull(), bad)
                .when(pointer, F.when(target.isNull() | (target >= pos), bad).otherwise(go(pos=target, nxt=F.when(s["nxt"] < 0, pos + 2).otherwise(s["nxt"]))))
                .when(n >= 64, bad).when(n == 0, go(st=F.lit(1), nxt=F.when(s["nxt"] < 0, pos + 1).otherwise(s["nxt"])))
                .when(fits, go(pos=pos + 1 + n, wire=s["wire"] + n + 1, name=F.when(s["name"] == "", label).otherwise(F.concat(s["name"], F.lit("."), label)))).otherwise(bad))

    return F.aggregate(F.sequence(F.lit(1), F.lit(128)), init, step, lambda s: F.struct(s["name"].alias("name"), s["nxt"].alias("next"), (s["st"] == 1).alias("ok")))


def decode_dns(rows: DataFrame) -> DataFrame:
    """Adds `dns` (name, qtype, response, rcode) for port-53 payloads with a complete first question, null elsewhere.

    Over TCP the two-byte length prefix is honoured."""
    ask = ((F.col("src_port") == 53) | (F.col("dst_port") == 53)) & F.col("protocol").isin(6, 17)
    n = u("payload", 0, 2)
    body = F.when(F.col("protocol") == 17, F.col("payload")).when(F.length("payload") >= 2 + n, cut_bytes("payload", 2, n))
    r = stage(rows, {"_p": F.when(ask, body)})
    r = stage(r, {"_n": F.when((F.length("_p") >= 12) & (u("_p", 4, 2) > 0), dns_name("_p"))})
    good = F.col("_n.ok") & (F.col("_n.name") != "") & (F.length("_p") >= F.col("_n.next") + 4)
    flags = u("_p", 2, 2)
    resp = flags >= 0x8000
    d = F.struct(F.lower(F.col("_n.name")).alias("name"), u("_p", F.col("_n.next"), 2).cast("int").alias("qtype"), resp.alias("response"),
                 F.when(resp, flags.bitwiseAND(F.lit(15)).cast("int")).alias("rcode"))
    return stage(r, {"dns": F.when(good, d)}).drop("_p", "_n")


HELLO = T.StructType([T.StructField(n, t) for n, t in (
    ("hello", T.StringType()), ("version", T.IntegerType()), *((n, T.ArrayType(T.IntegerType())) for n in ("ciphers", "extension_types", "groups", "points", "versions", "signatures")),
    ("alpn", T.BinaryType()), ("sni", T.BinaryType()), ("ja3", T.StringType()), ("ja4", T.StringType()), ("ja3s", T.StringType()))])


def _hello(p: bytes | None, protocol: int | None) -> tuple | None:
    """The values of `HELLO` for one payload; None if it does not hold a whole hello."""
    n = len(p or b"")
    if protocol != 6 or n < 43 or p[0] != 0x16:
        return None
    two = lambda at: p[at] << 8 | p[at + 1]
    end = two(3) + 5
    client = p[5] == 1 and end >= 45
    if n < end or not client and (p[5] != 2 or end < 43) or n < 44:
        return None
    i1 = 44 + p[43]
    if client:
        count = (n - i1 - 2) // 2
        if i1 + 2 <= n:
            count = min((two(i1) + 1) // 2, count)
        at, limit = i1 + 2 + 2 * count, n
        if at >= n:
            return None
        at += 1 + p[at]
    else:
        at, limit = i1 + 3, end
        if at > limit:
            return None
    found = []  # (type, position, bytes of it that are there)
    if at + 2 <= limit:
        stop, pos = min(at + 2 + two(at), limit), at + 2
        while pos + 4 <= stop:
            size = two(pos + 2)
            found.append((two(pos), pos + 4, min(size, n - pos - 4)))
            pos += 4 + size
    numbers = lambda start, k: list(struct.unpack_from(f"!{k}H", p, start)) if k > 0 else []
    version, kinds = two(9), [t for t, _, _ in found]
    if not client:
        cipher = two(i1)
        return "server", version, [cipher], kinds, None, None, None, None, None, None, None, None, tls.ja3s_of(version, cipher, kinds)
    lists = {10: [], 11: [], 13: [], 43: []}
    first = {}
    for t, pos, have in found:
        first.setdefault(t, (pos, have))
        if t in (10, 13) and have > 2:
            lists[t] += numbers(pos + 2, min(two(pos), have - 2) // 2)
        elif t == 43 and have > 1:
            lists[t] += numbers(pos + 1, min(p[pos], have - 1) // 2)
        elif t == 11 and have > 1:
            lists[t] += p[pos + 1 : pos + 1 + min(p[pos], have - 1)]
    (name_at, name), (alpn_at, offered) = first.get(0, (0, 0)), first.get(16, (0, 0))
    sni = p[name_at + 5 : name_at + 5 + two(name_at + 3)] if name > 5 else None
    alpn = p[alpn_at + 3 : alpn_at + 3 + p[alpn_at + 2]] if offered >= 3 else None
    ciphers = numbers(i1 + 2, count)
    return ("client", version, ciphers, kinds, lists[10], lists[11], lists[43], lists[13], alpn, sni,
            tls.ja3_of(version, ciphers, kinds, lists[10], lists[11]), tls.ja4_of("t", version, ciphers, kinds, lists[43], alpn, lists[13]), None)


def decode_tls(rows: DataFrame, payload="payload") -> DataFrame:
    """Adds `hello` ('client', 'server' or null) with version, ciphers, extension types, groups, points, versions, signatures, alpn, sni, and ja3, ja4, ja3s.

    A hello is walked once, in batches; walked by column expressions, each list would be taken apart again for every number made from it."""
    kept = [f for f in rows.schema.fields if f.name not in HELLO.names]
    names = [f.name for f in kept]
    kinds = [pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 6, pa.binary(), pa.binary(), *[pa.string()] * 3]
    none = (None,) * len(kinds)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            got = [_hello(p, k) or none for p, k in zip(b.column(names.index(payload)).to_pylist(), b.column(names.index("protocol")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(zip(*got), kinds)]], [*b.schema.names, *HELLO.names])

    return rows.select(*names).mapInArrow(run, T.StructType(kept + HELLO.fields)).withColumn("sni", F.col("sni").cast("string"))


def quic_initial(payload) -> Column:
    """Fingerprint of the clear long header of an Initial packet; null for anything else."""
    p = col(payload)
    d = u(p, 5, 1)
    s = u(p, 6 + d, 1)
    t = u(p, 7 + d + s, 1)
    token = ((t.bitwiseAND(F.lit(0xC0)) != 0) | (t.bitwiseAND(F.lit(0x3F)) > 0)).cast("int")
    version = u(p, 1, 4)
    ok = (F.length(p) >= 7) & (u(p, 0, 1).bitwiseAND(F.lit(0xF0)) == 0xC0) & (version != 0) & (d <= 20) & (s <= 20) & t.isNotNull()
    text = F.concat(F.lit("q"), F.lpad(F.lower(F.hex(version)), 8, "0"), F.lit(".d"), d.cast("string"), F.lit(".s"), s.cast("string"), F.lit(".t"), token.cast("string"), F.lit(".l"), F.length(p).cast("string"))
    return F.when(ok, text)


def packet_events(rows: DataFrame) -> DataFrame:
    """Decoded packets to events (needs decode_frames, decode_dns and decode_tls columns)."""
    tcp = F.col("protocol") == 6
    fl = F.coalesce("tcp_flags", F.lit(0))
    bit = lambda m: fl.bitwiseAND(F.lit(m)) != 0
    p443 = (F.coalesce("dst_port", F.lit(0)) == 443) | (F.coalesce("src_port", F.lit(0)) == 443)
    hello = F.col("hello").isNotNull()
    udp443 = (F.col("protocol") == 17) & p443
    return rows.filter("status = 'ok'").select(
        "seq", "ts_us", F.floor(F.col("ts_us") / 1_000_000).cast("long").alias("sec"), "src_ip", "dst_ip", F.coalesce("src_port", F.lit(0)).alias("src_port"), F.coalesce("dst_port", F.lit(0)).alias("dst_port"), "protocol",
        F.lit(1).cast("long").alias("packets"), F.col("ip_bytes").alias("bytes"), bit(2).alias("syn"), F.when(tcp, (bit(2) & ~bit(16)).cast("long")).alias("syn_packets"),
        F.col("dns.name").alias("dns_name"), F.coalesce(F.col("dns.qtype"), F.lit(1)).alias("dns_type"), (hello | p443).alias("encrypted"),
        F.when(hello, "TLS").when((F.col("protocol") == 17) & (F.col("dst_port") == 443), "QUIC").otherwise("IP").alias("transport"),
        F.col("ja3").alias("tls_fingerprint"), F.col("ja3s").alias("tls_server_fingerprint"), F.col("ja4").alias("tls_ja4"), F.when(tcp & bit(5), True).alias("tcp_fin_rst"),
        F.when(tcp, F.col("tcp_window")).alias("tcp_window"), F.when(udp443, quic_initial("payload")).alias("quic_fingerprint"),
        F.lit(None).cast("long").alias("reverse_bytes"), F.lit(False).alias("reverse_observed"))

"""The batch decoder against a frame-by-frame one."""
import random
import socket
import struct

from pyspark.sql import functions as F

from flowglass.functions import tls
from flowglass.sources import wire

FIELDS = ("status", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_window", "payload", "protocol", "ip_bytes")


def plain(f):
    """One frame, read in the order of its layers."""
    bad = lambda status: dict.fromkeys(FIELDS) | {"status": status}
    if len(f) < 14:
        return bad("SHORT_FRAME")
    kind, l3 = struct.unpack("!H", f[12:14])[0], 14
    if kind == 0x8100:
        kind, l3 = (struct.unpack("!H", f[16:18])[0] if len(f) >= 18 else None), 18
    if kind == 0x0800:
        if len(f) < l3 + 20:
            return bad("SHORT_IPV4")
        head, total = (f[l3] & 15) * 4, struct.unpack("!H", f[l3 + 2 : l3 + 4])[0]
        if head < 20 or f[l3] >> 4 != 4 or total < head or len(f) < l3 + head:
            return bad("INVALID_IHL")
        if struct.unpack("!H", f[l3 + 6 : l3 + 8])[0] & 0x3FFF:
            return bad("unsupported")
        protocol, size, family, at, n = f[l3 + 9], min(total, len(f) - l3), socket.AF_INET, l3 + 12, 4
    elif kind == 0x86DD:
        if len(f) < l3 + 40:
            return bad("SHORT_IPV6")
        head, protocol, size = 40, f[l3 + 6], 40 + struct.unpack("!H", f[l3 + 4 : l3 + 6])[0]
        family, at, n = socket.AF_INET6, l3 + 8, 16
    else:
        return bad("unsupported")
    l4, end = l3 + head, min(len(f), l3 + size)
    out = bad("ok") | {"src_ip": socket.inet_ntop(family, f[at : at + n]), "dst_ip": socket.inet_ntop(family, f[at + n : at + 2 * n]), "protocol": protocol, "ip_bytes": size}
    if protocol == 6:
        if end < l4 + 20:
            return bad("SHORT_TCP")
        src, dst, seq, _, of, window = struct.unpack("!HHIIHH", f[l4 : l4 + 16])
        if (of >> 12) * 4 < 20 or l4 + (of >> 12) * 4 > end:
            return bad("INVALID_TCP_LENGTH")
        out |= {"src_port": src, "dst_port": dst, "tcp_seq": seq, "tcp_flags": of & 0x1FF, "tcp_window": window, "payload": f[l4 + (of >> 12) * 4 : end]}
    elif protocol == 17:
        if end < l4 + 8:
            return bad("SHORT_UDP")
        src, dst, length = struct.unpack("!HHH", f[l4 : l4 + 6])
        if length < 8 or l4 + length > end:
            return bad("INVALID_UDP_LENGTH")
        out |= {"src_port": src, "dst_port": dst, "payload": f[l4 + 8 : l4 + length]}
    return out


def some(rng):
    body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 40])))
    protocol = rng.choice([6, 6, 17, 17, 1, 58])
    if protocol == 6:
        l4 = struct.pack("!HHIIHHHH", rng.randrange(65536), 443, rng.getrandbits(32), 0, (rng.choice([5, 5, 6, 3, 15]) << 12) | rng.randrange(512), rng.randrange(65536), 0, 0) + body
    else:
        l4 = struct.pack("!HHHH", 53, rng.randrange(65536), 8 + len(body) + rng.choice([0, 0, 0, 5, -9 if len(body) < 2 else -1]) & 0xFFFF, 0) + body
    word = lambda: rng.choice([0, 0, 1, 0xFFFF, rng.randrange(65536)])
    if rng.random() < 0.5:
        options = bytes(rng.choice([0, 0, 4, 8]))
        first = rng.choice([0x45 + len(options) // 4] * 8 + [0x65, 0x41])
        ip = struct.pack("!BBHHHBBH", first, 0, 20 + len(options) + len(l4) + rng.choice([0, 0, 0, 3, -30 if rng.random() < 0.1 else 0]) & 0xFFFF, 0, rng.choice([0, 0, 0x4000, 0x2000, 1]), 64, protocol, 0)
        ip, kind = ip + bytes(rng.choice([10, 192, 0, 255]) for _ in range(8)) + options, 0x0800
    else:
        ip = struct.pack("!IHBB", 0x60000000, len(l4) + rng.choice([0, 0, 4]), protocol, 64) + b"".join(struct.pack("!H", word()) for _ in range(16))
        kind = 0x86DD
    tag = b"\x81\x00\x00\x05" if rng.random() < 0.3 else b""
    f = bytes(12) + tag + struct.pack("!H", rng.choice([kind] * 9 + [0x0806, 0x8100])) + ip + l4
    return f[: rng.randrange(len(f))] if rng.random() < 0.3 else f


def test_batches_decode_like_single_frames(spark):
    rng = random.Random(7)
    frames = [some(rng) for _ in range(4000)] + [b"", b"\0" * 13, b"\xff" * 200]
    df = spark.createDataFrame([(i, bytearray(f), "kept", 9) for i, f in enumerate(frames)] + [(-1, None, "kept", 9)], "seq long, frame binary, note string, src_port int")
    out = wire.decode_frames(df)
    assert out.columns == ["seq", "frame", "note", *wire.DECODED.names]
    rows = {r.seq: r for r in out.collect()}
    seen = set()
    for i, f in enumerate(frames):
        want = plain(f)
        got = {k: bytes(v) if k == "payload" and v is not None else v for k, v in rows[i].asDict().items() if k in FIELDS}
        assert got == want, (i, f.hex())
        seen.add(want["status"])
    assert len(seen) == 10 and rows[-1].status == "SHORT_FRAME"
    assert wire.decode_frames(df.limit(0)).count() == 0


def hello(rng):
    """A hello of either side with odd lists and lengths, as a TLS record, sometimes cut."""
    words = lambda k: b"".join(struct.pack("!H", rng.choice([0x0A0A, 0x1A1A, 772, 771, 0, 16, rng.randrange(65536)])) for _ in range(rng.randrange(k)))
    extensions = b""
    for _ in range(rng.randrange(8)):
        kind = rng.choice([0, 10, 11, 13, 16, 43, 0x1A1A, rng.randrange(65536)])
        if kind == 0:
            body = struct.pack("!HBH", 13, 0, 10) + b"example.or"
        elif kind == 16:
            body = b"\0\x03" + rng.choice([b"\x02h2", b"\x08http/1.1", b"\x02\x01\xff", b"\0"])
        else:
            items = words(5)
            body = {10: struct.pack("!H", len(items)) + items, 13: struct.pack("!H", len(items) + rng.choice([0, 1, 9])) + items, 11: bytes([2, 0, 1]), 43: bytes([len(items)]) + items}.get(kind, items)
        extensions += struct.pack("!HH", kind, len(body)) + body
    side, ciphers = rng.choice([1, 1, 2]), words(6)
    middle = struct.pack("!H", len(ciphers)) + ciphers + b"\1\0" if side == 1 else struct.pack("!HB", rng.randrange(65536), 0)
    body = b"\3\3" + bytes(32) + b"\0" + middle + struct.pack("!H", len(extensions)) + extensions
    message = bytes([side]) + len(body).to_bytes(3, "big") + body
    record = b"\x16\3\1" + struct.pack("!H", len(message)) + message
    return record[: rng.randrange(len(record))] if rng.random() < 0.1 else record


def test_hellos_are_walked_once(spark):
    rng = random.Random(3)
    rows = [(i, 6, bytearray(hello(rng))) for i in range(1500)] + [(-1, 6, None), (-2, 17, bytearray(hello(rng))), (-3, None, bytearray(hello(rng))), (-4, 6, bytearray())]
    d = wire.decode_tls(spark.createDataFrame(rows, "seq long, protocol int, payload binary"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan  # lists are not taken apart again for every number made from them
    assert d.columns == ["seq", "protocol", "payload", *wire.HELLO.names] and dict(d.dtypes)["sni"] == "string"
    sni = F.array_contains("extension_types", 0)
    same = d.select("*", F.when(F.col("hello") == "client", tls.ja3("version", "ciphers", "extension_types", "groups", "points")).alias("_3"), F.when(F.col("hello") == "server", tls.ja3s("version", F.col("ciphers")[0], "extension_types")).alias("_s"),
                    F.when(F.col("hello") == "client", tls.ja4(F.lit("t"), "version", "ciphers", "extension_types", "versions", sni, "alpn", "signatures")).alias("_4")).collect()
    assert all((r.ja3, r.ja4, r.ja3s) == (r._3, r._4, r._s) for r in same)
    assert all(r.hello is None and r.version is None and r.ja3 is None for r in same if r.seq < 0)
    assert min(sum(r.hello == k for r in same) for k in ("client", "server", None)) > 30 and {r.sni for r in same} == {None, "example.or"}
    assert wire.decode_tls(d.select("seq", "protocol", "payload").limit(0)).count() == 0

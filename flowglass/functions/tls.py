"""Handshake fingerprints from integer array columns, and the same from plain lists for decoders that walk a message."""
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Protocol version -> two-character code of the client fingerprint.
VERSION_CODES = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3",
                 0x0002: "s2", 0xFEFF: "d1", 0xFEFD: "d2", 0xFEFC: "d3"}
NO_HASH = "000000000000"


def is_grease(v) -> Column:
    return col(v).bitwiseAND(F.lit(0x0F0F)) == 0x0A0A


def without_grease(values) -> Column:
    return F.filter(F.coalesce(col(values), F.array().cast("array<int>")), lambda v: ~is_grease(v))


def _dashed(values) -> Column:
    return F.array_join(without_grease(values).cast("array<string>"), "-")


def ja3_text(version, ciphers, extensions, groups, points) -> Column:
    return F.concat_ws(",", col(version).cast("string"), *[_dashed(a) for a in (ciphers, extensions, groups, points)])


def ja3(*parts) -> Column:
    return F.md5(ja3_text(*parts))


def ja3s_text(version, cipher, extensions) -> Column:
    return F.concat_ws(",", col(version).cast("string"), col(cipher).cast("string"), _dashed(extensions))


def ja3s(*parts) -> Column:
    return F.md5(ja3s_text(*parts))


def _hex4(values) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")), ",")


def _short_hash(text) -> Column:
    return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, 12)).otherwise(F.lit(NO_HASH))


def ja4(transport, version, ciphers, extensions, versions, has_sni, alpn, signatures) -> Column:
    """`alpn` is the first offered protocol as BINARY (null when absent)."""
    cs, es, vs, sg = (without_grease(a) for a in (ciphers, extensions, versions, signatures))
    top = F.coalesce(F.array_max(vs), col(version))
    code = F.lit("00")
    for v, text in VERSION_CODES.items():
        code = F.when(top == v, text).otherwise(code)
    a = col(alpn)
    first, last = F.substring(a, 1, 1).cast("string"), F.substr(a, F.length(a), F.lit(1)).cast("string")
    hexed = F.lower(F.hex(a))
    alnum = first.rlike("^[0-9A-Za-z]$") & last.rlike("^[0-9A-Za-z]$")
    alpn_code = (F.when(a.isNull() | (F.length(a) == 0), "00").when(alnum, F.concat(first, last))
                 .otherwise(F.concat(F.substring(hexed, 1, 1), F.right(hexed, F.lit(1)))))
    count = lambda x: F.lpad(F.least(F.size(x), F.lit(99)).cast("string"), 2, "0")
    part_a = F.concat(col(transport), code, F.when(col(has_sni), "d").otherwise("i"), count(cs), count(es), alpn_code)
    part_b = _short_hash(_hex4(F.array_sort(cs)))
    kept = F.array_sort(F.filter(es, lambda e: ~e.isin(0x0000, 0x0010)))
    tail = F.when((F.size(kept) > 0) & (F.size(sg) > 0), F.concat(F.lit("_"), _hex4(sg))).otherwise(F.lit(""))
    part_c = _short_hash(F.concat(_hex4(kept), tail))
    return F.concat_ws("_", part_a, part_b, part_c)


def _plain(values) -> list:
    return [v for v in values if v & 0x0F0F != 0x0A0A]


def _joined(values) -> str:
    return "-".join(map(str, _plain(values)))


def ja3_of(version: int, *lists) -> str:
    """`ja3` of one client hello given as lists: ciphers, extensions, groups, points."""
    return hashlib.md5(",".join([str(version), *map(_joined, lists)]).encode()).hexdigest()


def ja3s_of(version: int, cipher: int, extensions) -> str:
    return hashlib.md5(f"{version},{cipher},{_joined(extensions)}".encode()).hexdigest()


def ja4_of(transport: str, version: int, ciphers, extensions, versions, alpn: bytes | None, signatures) -> str:
    """`ja4` of one client hello given as lists."""
    cs, es, vs, sg = map(_plain, (ciphers, extensions, versions, signatures))
    code = VERSION_CODES.get(max(vs, default=version), "00")
    ends = "00"
    if alpn:
        first, last = alpn[:1], alpn[-1:]
        ends = (first + last).decode() if first.isalnum() and last.isalnum() else alpn.hex()[0] + alpn.hex()[-1]
    short = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12] if text else NO_HASH
    hexed = lambda values: ",".join(f"{v:04x}" for v in values)
    kept = sorted(e for e in es if e not in (0x0000, 0x0010))
    tail = "_" + hexed(sg) if kept and sg else ""
    return f"{transport}{code}{'d' if 0 in extensions else 'i'}{min(len(cs), 99):02d}{min(len(es), 99):02d}{ends}_{short(hexed(sorted(cs)))}_{short(hexed(kept) + tail)}"

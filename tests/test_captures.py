"""Messages that span segments: sizes, repetitions, holes, silence and closing flags."""
from flowglass.sources import captures

HELLO = bytes([0x16, 3, 1, 0, 20]) + bytes(range(20))
DNS = (10).to_bytes(2, "big") + b"0123456789"


def run(spark, rows, **limit):
    """rows: ms, port, flags, tcp_seq, payload"""
    data = [(i, ms * 1000, "a", "b", 5000, port, 6, flags, q & 0xFFFFFFFF, p) for i, (ms, port, flags, q, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, tcp_flags int, tcp_seq long, payload binary")
    out = captures.assemble(df, **limit)
    assert out.count() == len(rows)
    if limit:
        return [(None if r.message is None else bytes(r.message), r.oversized) for r in out.orderBy("seq").collect()]
    assert not any(r.oversized for r in out.collect())
    return [None if r.message is None else bytes(r.message) for r in out.orderBy("seq").collect()]


def test_parts_repetitions_and_wrapping(spark):
    a, b, c = HELLO[:8], HELLO[8:16], HELLO[16:]
    start = 2**32 - 10
    assert run(spark, [(0, 443, 16, start, a), (1, 443, 16, start, a), (2, 443, 16, start + 8, b), (3, 443, 16, start + 16, c), (4, 443, 16, start + 25, b"next")]) == [None, None, None, HELLO, b"next"]
    assert run(spark, [(0, 53, 16, 7, DNS[:1]), (1, 53, 16, 8, b"\0\0")]) == [DNS[:1], b"\0\0"]  # no length to go by
    assert run(spark, [(0, 53, 16, 7, DNS[:5]), (1, 53, 16, 12, DNS[5:] + b"xx")]) == [None, DNS]
    assert run(spark, [(0, 443, 16, 7, b"plain"), (1, 443, 16, 7, b"plain")]) == [b"plain", b"plain"]


def test_holes_silence_and_ends(spark):
    a, b = HELLO[:8], HELLO[8:]
    assert run(spark, [(0, 443, 16, 0, a), (1, 443, 16, 9, b)]) == [None, b]
    assert run(spark, [(0, 443, 16, 0, a), (10_001, 443, 16, 8, b)]) == [None, b]
    assert run(spark, [(0, 443, 16, 0, a), (10_000, 443, 16, 8, b)]) == [None, HELLO]
    assert run(spark, [(0, 443, 16, 0, a), (1, 443, 17, 8, b), (2, 443, 16, 25, b"z")]) == [None, b, b"z"]
    big = bytes([0x16, 3, 1, 0, 200]) + b"x" * 30
    assert run(spark, [(0, 443, 16, 0, big), (1, 443, 16, 35, b"y")], limit=204) == [(big, True), (b"y", False)]


def test_longest_messages_of_the_formats(spark):
    record = bytes([0x16, 3, 1, 0x40, 0]) + b"r" * 16_384
    name = (65_535).to_bytes(2, "big") + b"n" * 65_535
    rows = [(i, 443, 16, 9_000 * i, record[9_000 * i : 9_000 * (i + 1)]) for i in range(2)] + [(10 + i, 53, 16, 20_000 * i, name[20_000 * i : 20_000 * (i + 1)]) for i in range(4)]
    assert run(spark, rows) == [None, record, None, None, None, name]


def test_one_connection_has_many_runs(spark):
    rows = []
    for k in range(40):
        rows += [(k * 20_000, 443, 16, k * 1000, HELLO[:8]), (k * 20_000 + 1, 443, 16, k * 1000 + 8, HELLO[8:])]
    assert run(spark, rows) == [None, HELLO] * 40

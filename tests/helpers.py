from flowglass.schema import EVENT

T0 = 1_700_000_000_000_000


def event(seq, ms, **kw):
    """One event `ms` milliseconds after a fixed instant, with plain defaults."""
    ts = T0 + int(round(ms * 1000))
    row = dict(seq=seq, ts_us=ts, sec=ts // 1_000_000, src_ip="10.0.0.1", dst_ip="198.51.100.1", src_port=50000, dst_port=80, protocol=6, packets=1, bytes=100, syn=False,
               syn_packets=None, dns_name=None, dns_type=1, encrypted=False, transport="IP", tls_fingerprint=None, tls_server_fingerprint=None, tls_ja4=None, tcp_fin_rst=None,
               tcp_window=None, quic_fingerprint=None, reverse_bytes=None, reverse_observed=False, flow_id=None)
    row.update(kw)
    return tuple(row[f.name] for f in EVENT.fields)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def by_seq(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.select("seq", *cols).collect()}

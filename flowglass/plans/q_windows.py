"""Registered queries: causal window features and sequential folds."""
from pyspark.sql import functions as F

from ..operators import beacons, connections, history, rates, sessions
from ..operators.ordered import running_max
from ..operators.throttle import throttle
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import CONTACTS, TRAFFIC, WEB, over

PAST = "(b.ts_us, b.seq) <= (a.ts_us, a.seq)"


@query("global_rates", over(TRAFFIC, f""", c as (
  select a.seq, b.src_ip, count(*) c, sum(b.packets) p, sum(b.bytes) y from traffic a join traffic b
  on b.sec between a.sec - 10 and a.sec and {PAST} group by 1, 2)
select seq, round(sum(p) / 10.0, 6) packet_rate, round(sum(y) / 10.0, 6) byte_rate,
  round(greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)), 6) source_entropy, count(*) source_count,
  count(*) > 100 source_entropy_partial from c group by seq"""))
def global_rates(spark, sf):
    out = rates.global_rates(V.traffic(spark, sf), cap=100, sub_us=50_000)
    return rounded(out.select("seq", "packet_rate", "byte_rate", "source_entropy", "source_count", "source_entropy_partial"))


TARGET_SQL = f""", t as (select *, case when protocol <> 6 then 0 when syn_packets is not null then syn_packets when packets = 1 then cast(syn as int) else 0 end sc,
  case when protocol = 6 and packets = 1 and syn and syn_packets = 0 then 1 else 0 end ac,
  case when protocol = 6 and packets > 1 and syn_packets is null then packets else 0 end uk from traffic),
c as (select a.seq, b.src_ip, sum(b.packets) p, sum(b.bytes) y, sum(b.sc) sc, sum(b.ac) ac, sum(b.uk) uk, sum(case when b.packets > 1 then 1 else 0 end) sm,
  sum(b.bytes * b.bytes / b.packets) sq from t a join t b on b.dst_ip = a.dst_ip and b.protocol = a.protocol and b.sec between a.sec - 10 and a.sec and {PAST} group by 1, 2),
g as (select seq, sum(p) p, sum(y) y, sum(sc) sc, sum(ac) ac, sum(uk) uk, sum(sm) sm, sum(sq) sq, count(*) n,
  greatest(0.0, log2(sum(p)) - sum(p * log2(p)) / sum(p)) h from c group by seq)"""


@query("syn_target_window", over(TRAFFIC, TARGET_SQL + """
select g.seq, round(p / 10.0, 6) syn_target_packet_rate, round(case when uk = 0 then sc / p end, 6) syn_target_fraction,
  round(case when uk = 0 then ac / p end, 6) syn_target_ack_fraction,
  case when uk > 0 then 'unavailable' when sm > 0 then 'declared_summary_counts' else 'packet_exact' end syn_target_fraction_basis,
  round(h, 6) syn_target_source_entropy, n syn_target_source_count from g join traffic using (seq) where protocol = 6"""))
def syn_target_window(spark, sf):
    t = V.traffic(spark, sf).filter("protocol = 6")
    out = rates.target_rates(t)
    return rounded(out.select("seq", "syn_target_packet_rate", "syn_target_fraction", "syn_target_ack_fraction", "syn_target_fraction_basis",
                              "syn_target_source_entropy", "syn_target_source_count"))


@query("udp_target_window", over(TRAFFIC, TARGET_SQL + f""", w as (select a.seq, sum(b.packets) wp from traffic a join traffic b
  on b.sec between a.sec - 10 and a.sec and {PAST} where a.protocol = 17 group by 1)
select g.seq, round(p / 10.0, 6) udp_target_packet_rate, round(y / 10.0, 6) udp_target_byte_rate, round(h, 6) udp_target_source_entropy,
  n udp_target_source_count, round(p / wp, 6) udp_destination_concentration, round(y / p, 6) udp_packet_size_mean,
  round(sqrt(greatest(0.0, sq / p - (y / p) * (y / p))) / (y / p), 6) udp_packet_size_cv,
  case when sm > 0 then 'summary_mean_proxy' else 'packet_exact' end udp_packet_size_basis
from g join traffic using (seq) join w using (seq) where protocol = 17"""))
def udp_target_window(spark, sf):
    t = V.traffic(spark, sf)
    out = rates.target_rates(rates.global_rates(t, base=t), base=t).filter("protocol = 17").withColumn("udp_destination_concentration", rates.concentration())
    return rounded(out.select("seq", "udp_target_packet_rate", "udp_target_byte_rate", "udp_target_source_entropy", "udp_target_source_count",
                              "udp_destination_concentration", "udp_packet_size_mean", "udp_packet_size_cv", "udp_packet_size_basis"))


@query("forward_bytes", over(TRAFFIC, f"""
select a.seq, cast(sum(b.bytes) as bigint) source_forward_bytes_60s,
  round(sum(case when b.sec >= a.sec - 10 then b.bytes else 0 end) / 10.0, 6) source_forward_byte_rate_10s
from traffic a join traffic b on b.src_ip = a.src_ip and b.sec between a.sec - 60 and a.sec and {PAST} group by a.seq"""))
def forward_bytes(spark, sf):
    return rounded(rates.forward_bytes(V.traffic(spark, sf)).select("seq", "source_forward_bytes_60s", "source_forward_byte_rate_10s"))


HIST_SQL = f""", h as (select a.seq, a.ts_us now, a.dst_ip adst, a.dst_port aport, b.* exclude (seq), b.seq bseq from traffic a join traffic b on b.src_ip = a.src_ip
  and b.ts_us >= a.ts_us - 60000000 and {PAST})"""


@query("source_fanout", over(TRAFFIC, HIST_SQL + """
select seq, cast(count(distinct case when ts_us >= now - 10000000 then dst_ip end) as int) destination_count,
  cast(count(distinct case when ts_us >= now - 10000000 then dst_port end) as int) port_count,
  round(sum(case when ts_us >= now - 10000000 and syn and (syn_packets is null or syn_packets <> 0) then 1 else 0 end)
    / sum(case when ts_us >= now - 10000000 then 1 else 0 end), 6) syn_fraction from h group by seq"""))
def source_fanout(spark, sf):
    return rounded(history.source_history(V.traffic(spark, sf), families=("source",)).select("seq", "destination_count", "port_count", "syn_fraction"))


@query("source_retained_bytes", over(TRAFFIC, HIST_SQL + """
select seq, cast(sum(bytes) as bigint) egress_bytes, max(now) - min(ts_us) < 60000000 window_partial from h group by seq"""))
def source_retained_bytes(spark, sf):
    return history.source_history(V.traffic(spark, sf), families=("source",)).select("seq", "egress_bytes", "window_partial")


@query("peer_regularity", over(TRAFFIC, HIST_SQL + """, p as (select *, (ts_us - lag(ts_us) over (partition by seq order by ts_us, bseq)) / 1e6 gap
  from h where dst_ip = adst and dst_port = aport)
select seq, cast(count(*) as int) history_count, round(coalesce(avg(gap), 0), 9) iat_mean,
  round(case when count(gap) < 2 then 0 else stddev_pop(gap) / greatest(avg(gap), 1e-9) end, 9) iat_cv,
  round(case when count(*) < 2 then 0 else stddev_pop(bytes / packets) / greatest(avg(bytes / packets), 1e-9) end, 9) size_cv,
  cast(max(case when tls_fingerprint = md5('771,49195-49199,0-23-65281,29-23-24,0') then 1 else 0 end) as int) fingerprint_risk
from p group by seq"""))
def peer_regularity(spark, sf):
    return rounded(history.source_history(V.traffic(spark, sf), families=("peer",)).select("seq", "history_count", "iat_mean", "iat_cv", "size_cv", "fingerprint_risk"), 9)


@query("dns_base_activity", over(TRAFFIC, """, q as (select seq, ts_us, src_ip, lower(dns_name) nm, string_split(lower(dns_name), '.') l from traffic
  where dns_name is not null and dst_port = 53 and protocol in (6, 17)),
f as (select *, array_to_string(l[-2:], '.') base, array_to_string(l[:len(l) - 2], '') enc, coalesce(list_max(list_transform(l[:len(l) - 2], lambda x: length(x))), 0) mx from q),
n as (select *, length(enc) tot, case when length(enc) = 0 then 0.0 else list_sum(list_transform(list_distinct(string_split(enc, '')),
  lambda c: -((length(enc) - length(replace(enc, c, ''))) / length(enc)) * log2((length(enc) - length(replace(enc, c, ''))) / length(enc)))) end ent from f),
m as (select a.seq, a.mx, a.tot, a.ent, len(a.l) nl, b.nm, b.mx >= 24 and b.tot >= 32 and b.ent >= 3.5 ok
  from n a join n b on a.src_ip = b.src_ip and a.base = b.base and b.ts_us >= a.ts_us - 10000000 and (b.ts_us, b.seq) <= (a.ts_us, a.seq))
select seq, cast(max(nl) as int) dns_label_count, cast(max(mx) as int) dns_encoded_max_label_length, cast(max(tot) as int) dns_encoded_total_length,
  round(max(ent), 6) dns_encoded_entropy, cast(count(*) as int) dns_base_queries_10s, round(count(distinct nm) / count(*), 6) dns_base_unique_ratio_10s,
  cast(count(*) filter (ok) as int) dns_base_encoded_queries_10s from m group by seq"""))
def dns_base_activity(spark, sf):
    out = history.source_history(V.traffic(spark, sf), families=("question",)).filter("dns_query_visible = 1")
    return rounded(out.select("seq", "dns_label_count", "dns_encoded_max_label_length", "dns_encoded_total_length", "dns_encoded_entropy",
                              "dns_base_queries_10s", "dns_base_unique_ratio_10s", "dns_base_encoded_queries_10s"))


FLOW_SQL = """, f as (select seq, ts_us, src_ip, concat('10.9.0.', cast(seq % 2 as varchar)) dst_ip, 40000 src_port, 443 dst_port, protocol from traffic),
g as (select *, lag(ts_us) over w pt from f window w as (partition by src_ip, dst_ip, protocol order by ts_us, seq)),
s as (select *, max(case when pt is null or ts_us - pt >= 60000000 then ts_us end) over (partition by src_ip, dst_ip, protocol order by ts_us, seq rows unbounded preceding) st from g)"""


@query("flow_identity", over(TRAFFIC, FLOW_SQL + """
select seq, st flow_start_us, substr(sha256(concat(src_ip, ':', cast(src_port as varchar), '->', dst_ip, ':', cast(dst_port as varchar), ':',
  cast(protocol as varchar), ':', printf('%.1f', st / 1000.0))), 1, 32) flow_id from s"""))
def flow_identity(spark, sf):
    f = V.traffic(spark, sf).selectExpr("seq", "ts_us", "src_ip", "concat('10.9.0.', cast(seq % 2 as string)) as dst_ip", "40000 as src_port", "443 as dst_port", "protocol")
    return sessions.flow_identity(f).select("seq", "flow_start_us", "flow_id")


def _tls_rows(spark, sf):
    return (V.traffic(spark, sf).withColumn("d", F.expr("concat('10.9.0.', cast(seq % 2 as string))")).withColumn("c", F.col("src_ip"))
            .withColumns({"src_ip": F.expr("if(seq % 3 = 0, d, c)"), "dst_ip": F.expr("if(seq % 3 = 0, c, d)"),
                          "src_port": F.expr("cast(if(seq % 3 = 0, 443, 50000) as int)"), "dst_port": F.expr("cast(if(seq % 3 = 0, 50000, 443) as int)"),
                          "tls_server_fingerprint": F.expr("if(seq % 6 = 0, md5(cast(seq % 5 as string)), null)")}).drop("c", "d"))


TLS_SQL = """, x as (select seq, ts_us, src_ip client, concat('10.9.0.', cast(seq % 2 as varchar)) server, packets, bytes / packets size, tls_fingerprint fp,
  case when seq % 6 = 0 then md5(cast(seq % 5 as varchar)) end js from traffic where encrypted),
g as (select *, lag(ts_us) over (partition by client, server order by ts_us, seq) pt from x),
s as (select *, sum(case when pt is null or ts_us - pt > 60000000 then 1 else 0 end) over (partition by client, server order by ts_us, seq rows unbounded preceding) sid from g),
k as (select *, case when row_number() over u > 1 then (ts_us - pt) / 1e6 end gap, first_value(ts_us) over u st,
  last_value(fp ignore nulls) over (partition by client, server, sid order by ts_us, seq rows between unbounded preceding and current row) ja3,
  last_value(js ignore nulls) over (partition by client, server, sid order by ts_us, seq rows between unbounded preceding and current row) ja3s
  from s window u as (partition by client, server, sid order by ts_us, seq))"""


@query("tls_sessions", over(TRAFFIC, TLS_SQL + """
select seq, ja3 tls_ja3, ja3s tls_ja3s, cast(sum(packets) over (partition by client, server, sid order by ts_us, seq rows unbounded preceding) as bigint) tls_session_packets,
  round((ts_us - st) / 1e6, 9) tls_session_duration_s, round(avg(size) over v, 9) tls_session_mean_bytes,
  round(case when count(*) over v < 2 then 0 else stddev_pop(size) over v / greatest(avg(size) over v, 1e-9) end, 9) tls_session_size_cv,
  round(avg(case when size < 200 then 1.0 else 0.0 end) over v, 9) tls_session_small_fraction,
  round(coalesce(avg(gap) over z, 0), 9) tls_session_iat_mean_s,
  round(case when count(gap) over z < 2 then 0 else stddev_pop(gap) over z / greatest(avg(gap) over z, 1e-9) end, 9) tls_session_iat_cv
from k window v as (partition by client, server, sid order by ts_us, seq rows between 63 preceding and current row),
  z as (partition by client, server, sid order by ts_us, seq rows between 62 preceding and current row)"""))
def tls_sessions(spark, sf):
    out = sessions.tls_sessions(_tls_rows(spark, sf))
    return rounded(out.select("seq", "tls_ja3", "tls_ja3s", "tls_session_packets", "tls_session_duration_s", "tls_session_mean_bytes", "tls_session_size_cv",
                              "tls_session_small_fraction", "tls_session_iat_mean_s", "tls_session_iat_cv"), 9)


@query("fingerprint_rarity", over(TRAFFIC, TLS_SQL + """, o as (select fp, client, min(ts_us) t from x where fp is not null group by 1, 2),
o2 as (select o.fp, o.client, o.t, min(x.seq) q from o join x on x.fp = o.fp and x.client = o.client and x.ts_us = o.t group by 1, 2, 3),
c as (select client, min(ts_us) t from x where fp is not null group by 1),
c2 as (select c.client, c.t, min(x.seq) q from c join x on x.client = c.client and x.ts_us = c.t and x.fp is not null group by 1, 2)
select k.seq, cast((select count(*) from o2 where o2.fp = k.ja3 and (o2.t, o2.q) <= (k.ts_us, k.seq)) as int) tls_fingerprint_clients,
  (select count(*) from c2 where (c2.t, c2.q) <= (k.ts_us, k.seq)) tls_client_population from k"""))
def fingerprint_rarity(spark, sf):
    return sessions.tls_features(_tls_rows(spark, sf)).select("seq", "tls_fingerprint_clients", "tls_client_population")


@query("slow_contact_series", over(CONTACTS, """, r as (select src_ip, dst_ip, dst_port, min(ts_us) t from contacts group by 1, 2, 3
  union all select c.src_ip, c.dst_ip, c.dst_port, min(c.ts_us) from r join contacts c on c.src_ip = r.src_ip and c.dst_ip = r.dst_ip and c.dst_port = r.dst_port
  and c.ts_us >= r.t + 2000000 group by 1, 2, 3),
g as (select *, t - lag(t) over w gap from r window w as (partition by src_ip, dst_ip, dst_port order by t)),
s as (select *, sum(case when gap > 7200000000 then 1 else 0 end) over (partition by src_ip, dst_ip, dst_port order by t) sid from g),
k as (select *, row_number() over w n from s window w as (partition by src_ip, dst_ip, dst_port, sid order by t)),
st as (select *, avg(gap / 1e6) over w m, stddev_pop(gap / 1e6) over w sd from k window w as (partition by src_ip, dst_ip, dst_port, sid order by t rows between 8 preceding and current row))
select c.seq, cast(st.n as int) slow_beacon_events, round(case when st.n >= 10 then m else 0 end, 6) slow_beacon_mean_s,
  round(case when st.n >= 10 and m > 0 then sd / m else 9.0 end, 6) slow_beacon_cv
from contacts c asof join st on c.src_ip = st.src_ip and c.dst_ip = st.dst_ip and c.dst_port = st.dst_port and c.ts_us >= st.t""", recursive=True))
def slow_contact_series(spark, sf):
    out = beacons.slow_contacts(V.contacts(spark, sf))
    return rounded(out.select("seq", "slow_beacon_events", "slow_beacon_mean_s", "slow_beacon_cv"))


def _conn_sql(touch, close, amount, slow, tail):
    return over(WEB, f""", r as (select seq, ts_us, client, server, cport, case when {close} then -1 when {touch} then 1 else 0 end act, cast({amount} as bigint) amt from web),
a as (select *, sum(case when act = -1 then 1 else 0 end) over (partition by client, server, cport order by ts_us, seq rows unbounded preceding) ep from r where act <> 0),
t as (select *, lag(ts_us) over (partition by client, server, cport, ep order by ts_us, seq) pt from a where act = 1),
u as (select *, sum(case when pt is null or ts_us - pt > 120000000 then 1 else 0 end) over (partition by client, server, cport, ep order by ts_us, seq rows unbounded preceding) sid from t),
v as (select seq, first_value(ts_us) over w f, sum(amt) over w tot from u window w as (partition by client, server, cport, ep, sid order by ts_us, seq rows unbounded preceding)),
l as (select e.seq, e.ts_us now, a.cport, max((a.ts_us, a.seq)) mx from r e join a on a.client = e.client and a.server = e.server
  and a.ts_us >= e.ts_us - 120000000 and (a.ts_us, a.seq) <= (e.ts_us, e.seq) group by 1, 2, 3),
o as (select l.seq, (l.now - v.f) / 1e6 age, v.tot / greatest((l.now - v.f) / 1e6, 1.0) rate, a.amt from l join a on a.seq = l.mx[2] and a.act = 1 join v on v.seq = a.seq),
z as (select r.seq, cast(count(o.seq) filter ({slow}) as bigint) slow, count(o.seq) op, coalesce(avg(age), 0) age, coalesce(avg(rate), 0) rate, coalesce(avg(o.amt), 0) amt
  from r left join o using (seq) group by r.seq)
select seq, {tail} from z""")


@query("slow_senders", _conn_sql("from_client and bytes >= 61", "fin_rst", "bytes", "age >= 5 and rate <= 100",
       "slow slow_http_connections, op slow_http_open_connections, round(age, 9) slow_http_mean_age_s, round(case when slow > 0 then rate else 0 end, 9) slow_http_mean_client_rate_bps"))
def slow_senders(spark, sf):
    return rounded(connections.slow_senders(V.web(spark, sf), min_age_s=5), 9)


@query("slow_readers", _conn_sql("from_client and tcp_window <= 256 and not fin_rst", "fin_rst or (from_client and tcp_window > 256)", "tcp_window", "age >= 5",
       "slow slow_read_connections, op slow_read_open_connections, round(age, 9) slow_read_mean_age_s, round(amt, 9) slow_read_mean_window"))
def slow_readers(spark, sf):
    return rounded(connections.slow_readers(V.web(spark, sf), min_age_s=5), 9)


@query("repeat_suppression", over(TRAFFIC, HIST_SQL + """, hits as (select seq, any_value(src_ip) src_ip, any_value(now) ts_us from h group by seq
  having count(distinct case when ts_us >= now - 10000000 then dst_ip end) >= 5 or count(distinct case when ts_us >= now - 10000000 then dst_port end) >= 5),
r as (select src_ip, min(ts_us) t from hits group by 1 union all
  select x.src_ip, min(x.ts_us) from r join hits x on x.src_ip = r.src_ip and x.ts_us >= r.t + 30000000 group by 1)
select src_ip, ts_us, min(seq) seq from hits join r on hits.src_ip = r.src_ip and hits.ts_us = r.t group by hits.src_ip, ts_us""", recursive=True).replace("select src_ip, ts_us, min(seq)", "select hits.src_ip, ts_us, min(seq)"))
def repeat_suppression(spark, sf):
    f = history.source_history(V.traffic(spark, sf), families=("source",)).filter("greatest(destination_count, port_count) >= 5")
    return throttle(f.select("src_ip", "ts_us", "seq"), ["src_ip"], 30_000_000).filter("kept").select("src_ip", "ts_us", "seq")


@query("late_events", over(TRAFFIC, """, d as (select seq, ts_us - case when seq % 7 = 0 then 3000000 else 0 end ts_us from traffic),
m as (select *, max(ts_us) over (order by seq rows between unbounded preceding and 1 preceding) wm from d)
select seq, ts_us, wm is not null and ts_us < wm late from m"""))
def late_events(spark, sf):
    """Arrival order is `seq`; a row behind the running maximum of event time is late."""
    d = V.traffic(spark, sf).selectExpr("seq", "ts_us - if(seq % 7 = 0, 3000000, 0) as ts_us")
    m = running_max(d, "ts_us", "wm", block_rows=4096)
    return m.select("seq", "ts_us", (F.col("ts_us") < F.col("wm")).alias("late"))


@query("singleton_sources", over(TRAFFIC, f""", c as (select a.seq, b.src_ip, count(*) c, sum(case when b.packets > 1 then 1 else 0 end) sm
  from traffic a join traffic b on b.dst_ip = a.dst_ip and b.sec between a.sec - 10 and a.sec and {PAST} group by 1, 2)
select seq, count(*) unique_sources, round(count(*) filter (c = 1) / count(*), 6) singleton_fraction, round(sum(sm) / 10.0, 6) summary_rate from c group by seq"""))
def singleton_sources(spark, sf):
    return rounded(rates.singleton_sources(V.traffic(spark, sf)).select("seq", "unique_sources", "singleton_fraction", "summary_rate"))


@query("reserved_source_share", over(TRAFFIC, """, t as (select *, case when seq % 9 = 0 then concat('127.0.0.', cast(seq % 200 as varchar)) else src_ip end s from traffic),
a as (select distinct dst_ip, protocol, sec from t),
g as (select a.dst_ip, a.protocol, a.sec, count(distinct s) n, count(distinct case when s like '127.%' then s end) r
  from a join t on t.dst_ip = a.dst_ip and t.protocol = a.protocol and t.sec between a.sec - 10 and a.sec group by 1, 2, 3)
select dst_ip, protocol, sec, n tracked_sources, case when n >= 4 and r > 0 then r end source_reserved_count,
  round(case when n >= 4 and r > 0 then r / n end, 4) source_reserved_fraction from g"""))
def reserved_source_share(spark, sf):
    t = V.traffic(spark, sf).withColumn("src_ip", F.expr("if(seq % 9 = 0, concat('127.0.0.', cast(seq % 200 as string)), src_ip)"))
    return rates.reserved_share(t)

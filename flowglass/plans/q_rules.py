"""Registered queries: detection rules (thresholds lowered to the scale of the test tables)."""
from pyspark.sql import functions as F

from ..functions import ip, text
from ..operators import beacons, connections, history, rates, sessions
from ..session import dealt
from . import detect as D
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import CONTACTS, NAMES, TRAFFIC, WEB, over
from .q_scalars import ENT, SURPRISE, VARIED, VOWELS, varied
from .q_windows import HIST_SQL, PAST, TARGET_SQL, TLS_SQL, _conn_sql, _tls_rows

TH = D.Thresholds(flood_rate=20.0, flood_share=0.3, recon_fanout=5, recon_floor=3, recon_min_syn=0.1, exfil_bytes=300_000, c2_min_history=3,
                  slow_connections=3, slow_min_age_s=5.0, slow_c2_events=10, slow_c2_max_cv=0.8, slow_c2_excluded_ports=(6005,), tunnel_label=30,
                  tls_min_packets=8, tls_max_size_cv=0.9, tls_max_iat_cv=0.9, tls_max_mean_bytes=900.0, tls_max_clients=64, tls_min_population=5,
                  amplifier_sources=4)


def _targets(spark, sf):
    t = V.traffic(spark, sf)
    return rates.target_rates(rates.global_rates(t, base=t), base=t).withColumn("udp_destination_concentration", rates.concentration())


@query("syn_flood_hits", over(TRAFFIC, TARGET_SQL + """ select g.seq, dst_ip, case when uk = 0 and sc / p >= 0.3 then 'syn' else 'syn_ack' end subtype
  from g join traffic using (seq) where protocol = 6 and p / 10.0 >= 20 and uk = 0 and (sc / p >= 0.3 or ac / p >= 0.3)"""))
def syn_flood_hits(spark, sf):
    t = V.traffic(spark, sf).filter("protocol = 6")
    b = D.blocks(TH)
    f = rates.target_rates(t).filter(b["syn_only"] | b["syn_ack"])
    return f.select("seq", "dst_ip", F.when(b["syn_only"], "syn").otherwise("syn_ack").alias("subtype"))


@query("udp_flood_hits", over(TRAFFIC, TARGET_SQL + """ select g.seq, dst_ip, n >= 4 and y / p >= 512 amplification_like from g join traffic using (seq)
  where protocol = 17 and p / 10.0 >= 20"""))
def udp_flood_hits(spark, sf):
    t = V.traffic(spark, sf).filter("protocol = 17")
    f = rates.target_rates(t).filter(D.blocks(TH)["udp_flood"])
    amp = (F.col("udp_target_source_count") >= TH.amplifier_sources) & (F.col("udp_packet_size_mean") >= TH.amplifier_mean_bytes)
    return f.select("seq", "dst_ip", amp.alias("amplification_like"))


@query("other_protocol_floods", over(TRAFFIC, f""" select a.seq, round(sum(b.packets) / 10.0, 6) packet_rate from traffic a join traffic b
  on b.sec between a.sec - 10 and a.sec and {PAST} where a.seq % 5 = 0 group by 1 having sum(b.packets) / 10.0 >= 600"""))
def other_protocol_floods(spark, sf):
    t = V.traffic(spark, sf).withColumn("protocol", F.expr("if(seq % 5 = 0, 1, protocol)"))
    th = TH.with_(flood_rate=600.0)
    f = rates.global_rates(t, base=t).withColumns({c: F.lit(False) for c in ("syn_flood", "slow_http", "slow_read", "udp_flood")})
    return rounded(f.filter(~F.col("protocol").isin(6, 17) & D.rule_conditions(th)["DDOS"]).select("seq", "packet_rate"))


@query("slow_exhaustion_hits", _conn_sql("from_client and bytes >= 61", "fin_rst", "bytes", "age >= 5 and rate <= 100", "slow slow_http_connections, slow >= 3 hit").replace("from z", "from z where slow >= 3"))
def slow_exhaustion_hits(spark, sf):
    f = connections.slow_senders(V.web(spark, sf), min_age_s=TH.slow_min_age_s).withColumn("protocol", F.lit(6))
    return f.filter(D.blocks(TH)["slow_http"]).select("seq", "slow_http_connections", F.lit(True).alias("hit"))


@query("reconnaissance_hits", over(TRAFFIC, HIST_SQL + """, f as (select seq, count(distinct case when ts_us >= now - 10000000 then dst_ip end) d, count(distinct case when ts_us >= now - 10000000 then dst_port end) p,
  sum(case when ts_us >= now - 10000000 and syn and (syn_packets is null or syn_packets <> 0) then 1 else 0 end) / sum(case when ts_us >= now - 10000000 then 1 else 0 end) s from h group by seq)
  select f.seq, cast(greatest(d, p) as int) fanout, round(s, 6) syn_fraction from f join traffic t using (seq) where greatest(d, p) >= 5 and transport = 'IP' and not (s < 0.1 and (protocol = 6 or s > 0))"""))
def reconnaissance_hits(spark, sf):
    f = history.source_history(V.traffic(spark, sf), families=("source",)).withColumn("fanout", D.blocks(TH)["fanout"])
    return rounded(f.filter(D.rule_conditions(TH)["RECONNAISSANCE"] & D.guard_conditions(TH)["RECONNAISSANCE"]).select("seq", "fanout", "syn_fraction"))


BEACON_SQL = """, t as (select seq, ts_us, src_ip, concat('198.51.100.', cast(seq % 2 as varchar)) dst_ip, dst_port, protocol, bytes, packets from traffic),
  h as (select a.seq, b.ts_us, b.seq bseq from t a join t b on b.src_ip = a.src_ip and b.ts_us >= a.ts_us - 60000000 and (b.ts_us, b.seq) <= (a.ts_us, a.seq) and b.dst_ip = a.dst_ip and b.dst_port = a.dst_port),
  p as (select *, (ts_us - lag(ts_us) over (partition by seq order by ts_us, bseq)) / 1e6 gap from h)"""


@query("fast_beacon_hits", over(TRAFFIC, BEACON_SQL + """, g as (select seq, count(*) n, avg(gap) m, case when count(gap) < 2 then 0 else stddev_pop(gap) / greatest(avg(gap), 1e-9) end v from p group by seq)
  select g.seq, cast(n as int) history_count, round(v, 6) iat_cv from g join t using (seq) where n >= 3 and m >= 1 and v < 0.3 and not (dst_port = 53 and protocol = 17)"""))
def fast_beacon_hits(spark, sf):
    t = V.traffic(spark, sf).withColumn("dst_ip", F.expr("concat('198.51.100.', cast(seq % 2 as string))"))
    f = history.source_history(t, families=("peer",)).withColumn("slow_beacon", F.lit(False))
    return rounded(f.filter(D.blocks(TH)["fast_beacon"] & D.guard_conditions(TH)["BOTNET_C2"]).select("seq", "history_count", "iat_cv"))


@query("slow_beacon_hits", over(CONTACTS, """, r as (select src_ip, dst_ip, dst_port, min(ts_us) t from contacts group by 1, 2, 3
  union all select c.src_ip, c.dst_ip, c.dst_port, min(c.ts_us) from r join contacts c on c.src_ip = r.src_ip and c.dst_ip = r.dst_ip and c.dst_port = r.dst_port
  and c.ts_us >= r.t + 2000000 group by 1, 2, 3), k as (select *, (t - lag(t) over w) / 1e6 gap, row_number() over w n from r window w as (partition by src_ip, dst_ip, dst_port order by t)),
st as (select *, avg(gap) over w m, stddev_pop(gap) over w sd from k window w as (partition by src_ip, dst_ip, dst_port order by t rows between 8 preceding and current row))
select c.seq, c.dst_port, round(sd / m, 6) slow_beacon_cv from contacts c asof join st on c.src_ip = st.src_ip and c.dst_ip = st.dst_ip and c.dst_port = st.dst_port and c.ts_us >= st.t
where st.n >= 10 and m between 8 and 1800 and sd / m <= 0.8 and c.dst_port <> 6005""", recursive=True))
def slow_beacon_hits(spark, sf):
    f = beacons.slow_contacts(V.contacts(spark, sf))
    return rounded(f.filter(D.blocks(TH)["slow_beacon"]).select("seq", "dst_port", "slow_beacon_cv"))


@query("tunnel_hits", over(TRAFFIC, """ select seq, dns_name from traffic where dns_name is not null and dns_type in (10, 16) and length(string_split(dns_name, '.')[1]) >= 30"""))
def tunnel_hits(spark, sf):
    f = D.name_features(V.traffic(spark, sf))
    return f.filter(D.rule_conditions(TH)["DNS_TUNNELLING"] & D.guard_conditions(TH)["DNS_TUNNELLING"]).select("seq", "dns_name")


QUESTIONS = """, q as (select seq, ts_us, user_id % 3 u, case when k % 3 = 0 then concat(substr(md5(cast(seq as varchar)), 1, 26), '.', substr(md5(cast(seq + 1 as varchar)), 1, 26), '.t.example')
  else concat(md5(cast(seq as varchar)), substr(md5(cast(k as varchar)), 1, 10), '.t.example') end nm from (select event_id seq, ts_us, user_id, event_type, k from e) where event_type = 'signup')"""


@query("tunnel_candidates", over(TRAFFIC, QUESTIONS + f""", f as (select *, string_split(nm, '.') l from q), n as (select *, array_to_string(l[:len(l) - 2], '') j, list_max(list_transform(l[:len(l) - 2], lambda x: length(x))) mx from f),
  z as (select *, length(j) tot, {ENT.replace('{c}', 'j')} ent from n),
  m as (select a.seq, a.mx, a.tot, a.ent, len(a.l) nl, b.nm, b.mx >= 24 and b.tot >= 32 and b.ent >= 3.5 ok from z a join z b
    on a.u = b.u and b.ts_us >= a.ts_us - 10000000 and (b.ts_us, b.seq) <= (a.ts_us, a.seq)),
  g as (select seq, max(nl) nl, max(mx) mx, max(tot) tot, max(ent) ent, count(*) c, count(distinct nm) / count(*) u, count(*) filter (ok) k from m group by seq)
  select seq, case when mx >= 40 and ent >= 3.5 then 'repeated_long_encoded_label' else 'repeated_multi_label_encoding' end pattern from g
  where c >= 5 and u >= 0.8 and k >= 4 and ((mx >= 40 and ent >= 3.5) or (nl >= 4 and mx >= 24 and tot >= 48 and ent >= 3.7))"""))
def tunnel_candidates(spark, sf):
    t = V.traffic(spark, sf)
    e = V.events(spark, sf).filter("event_type = 'signup'").selectExpr("seq", "concat('10.7.0.', cast(user_id % 3 as string)) as src_ip", """case when k % 3 = 0
        then concat(substr(md5(cast(seq as string)), 1, 26), '.', substr(md5(cast(seq + 1 as string)), 1, 26), '.t.example')
        else concat(md5(cast(seq as string)), substr(md5(cast(k as string)), 1, 10), '.t.example') end as dns_name""")
    q = t.drop("src_ip", "dns_name").join(e, "seq")
    f = history.source_history(q, families=("question",)).withColumn("pattern", D.tunnel_pattern())
    return f.filter("pattern is not null").select("seq", "pattern")


@query("generated_name_hits", over(VARIED, f""", v as (select seq, case when y = 1 then concat(substr(md5(cast(seq as varchar)), 1, 3), translate(md5(cast(seq + 3 as varchar)), '0123456789', 'kwzxqvjhgy'), '.test') else cl end nm from m),
  p as (select seq, nm, string_split(nm, '.') p from v), g as (select seq, nm, case when len(p) <= 2 then p[1] when length(p[-1]) = 2 and p[-2] in ('co','com','org','net','gov','edu','ac','or','ne','go') then p[-3] else p[-2] end lb from p)
  select seq, lb from g where {ENT.replace('{c}', 'lb')} >= 3.5 and {SURPRISE.replace('{c}', 'lb')} >= 0.8 and length(lb) >= 20 and {VOWELS.replace('{c}', 'lb')} < 0.36 and not starts_with(nm, 'xn--')"""))
def generated_name_hits(spark, sf):
    v = varied(spark, sf).selectExpr("seq", """case when y = 1 then concat(substr(md5(cast(seq as string)), 1, 3), translate(md5(cast(seq + 3 as string)), '0123456789', 'kwzxqvjhgy'), '.test')
        else nm end as dns_name""", "1 as dns_type")
    f = D.name_features(v).withColumn("generated", D.generated_name(TH))
    return f.filter(D.guard_conditions(TH)["DGA_DOMAINS"]).select("seq", F.col("_rl").alias("lb"))


@query("encrypted_session_hits", over(TRAFFIC, TLS_SQL + """, c as (select client, min((ts_us, seq)) f from x where fp is not null group by 1), o as (select fp, client, min((ts_us, seq)) f from x where fp is not null group by 1, 2),
  s1 as (select seq, ts_us, ja3, sum(packets) over (partition by client, server, sid order by ts_us, seq rows unbounded preceding) pk, avg(size) over v mean,
    case when count(*) over v < 2 then 0 else stddev_pop(size) over v / greatest(avg(size) over v, 1e-9) end scv, case when count(gap) over z < 2 then 0 else stddev_pop(gap) over z / greatest(avg(gap) over z, 1e-9) end icv from k
    window v as (partition by client, server, sid order by ts_us, seq rows between 63 preceding and current row), z as (partition by client, server, sid order by ts_us, seq rows between 62 preceding and current row))
  select seq, ja3 tls_ja3 from s1 where ja3 is not null and pk >= 8 and scv <= 0.9 and icv <= 0.9 and mean <= 900 and (select count(*) from c where (c.f[1], c.f[2]) <= (s1.ts_us, s1.seq)) >= 5
    and (select count(*) from o where o.fp = s1.ja3 and (o.f[1], o.f[2]) <= (s1.ts_us, s1.seq)) <= 64"""))
def encrypted_session_hits(spark, sf):
    f = sessions.tls_features(_tls_rows(spark, sf)).withColumn("encrypted", F.lit(True))
    return f.filter(D.blocks(TH)["tls_regular"]).select("seq", "tls_ja3")


@query("indicator_hits", over(TRAFFIC, TLS_SQL + """ select seq, case when ja3 in (md5('1'), md5('4')) then 'ja3' else 'ja3s' end kind, case when ja3 = md5('1') then 'first' when ja3 = md5('4') then 'second' else 'server' end note
  from k where ja3 in (md5('1'), md5('4')) or ja3s = md5('2')"""))
def indicator_hits(spark, sf):
    import hashlib

    m = lambda v: hashlib.md5(v.encode()).hexdigest()
    th = TH.with_(indicators={"ja3": {m("1"): "first", m("4").upper(): "second"}, "ja3s": {m("2"): "server"}})
    f = sessions.tls_sessions(_tls_rows(spark, sf)).withColumn("hit", D.indicator(th)).filter("hit is not null")
    return f.select("seq", "hit.kind", "hit.note")


@query("exfiltration_hits", over(TRAFFIC, f""" select a.seq, cast(sum(b.bytes) as bigint) source_forward_bytes_60s from traffic a join traffic b on b.src_ip = a.src_ip
  and b.sec between a.sec - 60 and a.sec and {PAST} group by a.seq having sum(b.bytes) > 300000"""))
def exfiltration_hits(spark, sf):
    f = rates.forward_bytes(V.traffic(spark, sf))
    return f.filter(D.rule_conditions(TH)["DATA_EXFILTRATION"]).select("seq", "source_forward_bytes_60s")


@query("spoof_diagnostic_hits", over(TRAFFIC, TARGET_SQL + f""", w as (select a.seq, sum(b.packets) wp, sum(case when b.dst_ip = a.dst_ip and b.protocol = a.protocol then b.packets else 0 end) tp from traffic a join traffic b
  on b.sec between a.sec - 10 and a.sec and {PAST} where a.protocol = 17 group by 1),
  c as (select a.seq, b.src_ip, count(*) c from traffic a join traffic b on b.dst_ip = a.dst_ip and b.sec between a.sec - 10 and a.sec and {PAST} group by 1, 2),
  s as (select seq, count(*) n, count(*) filter (c = 1) / count(*) one from c group by seq)
  select g.seq from g join traffic using (seq) join w using (seq) join s using (seq) where protocol = 17 and g.p / 10.0 >= 5 and s.n >= 4 and g.h >= 1.5 and s.one >= 0.75 and w.tp / w.wp >= 0.01""".replace("g as (select seq, sum(p) p", "g as (select seq, sum(p) p")).replace("c as (select a.seq, b.src_ip, count(*) c from traffic a", "c2 as (select a.seq, b.src_ip, count(*) c from traffic a").replace("one from c group", "one from c2 group"))
def spoof_diagnostic_hits(spark, sf):
    """UDP floods whose window holds many one-time sources concentrated on one destination."""
    t = V.traffic(spark, sf)
    f = rates.singleton_sources(_targets(spark, sf), base=t)
    return D.spoof_diagnostic(f, rate=5.0, sources=4, entropy=1.5, singleton=0.75, concentration=0.01).select("seq")


def typed_events(spark, sf):
    """The typed event table, written once: the detection plan reads it about fifteen times, and
    deriving it from the raw rows each time costs more than reading it back."""
    return dealt(V.traffic(spark, sf).repartition("seq"), "seq")


def _alerts(spark, sf):
    return D.alerts(typed_events(spark, sf), TH.with_(exfil_bytes=1_000_000))


@query("detection_alerts")
def detection_alerts(spark, sf):
    return _alerts(spark, sf)


@query("alert_summary")
def alert_summary(spark, sf):
    """Suppressed alerts per class and detector: the whole path from typed events to alerts."""
    return _alerts(spark, sf).groupBy("threat_class", "detector").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("src_ip").alias("sources"))

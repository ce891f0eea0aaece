"""The traffic-shaped views as SQL text for the comparison engine."""

EVENTS = """e as (select event_id, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as int) k,
  1704067200000000 + cast(floor((epoch_us(ts) - 1704067200000000) / {c}) as bigint) ts_us from events)"""

TRAFFIC = EVENTS.replace("{c}", "10000") + """, traffic as (
select event_id as seq, ts_us, cast(floor(ts_us / 1000000) as bigint) as sec,
  concat('10.0.', cast(cast(floor(user_id / 256) as bigint) as varchar), '.', cast(user_id % 256 as varchar)) as src_ip,
  concat('198.51.100.', cast(k % 32 as varchar)) as dst_ip,
  cast(49152 + event_id % 64 as int) as src_port,
  case event_type when 'click' then 80 when 'view' then 443 when 'purchase' then 443 when 'signup' then 53 else 1000 + k end as dst_port,
  case when event_type in ('purchase','signup') then 17 else 6 end as protocol,
  cast(1 + floor(value) as bigint) as packets, cast(1 + floor(value) as bigint) * (40 + 14 * k) as bytes,
  (event_type = 'error' or (event_type in ('click','view') and k % 5 = 0)) as syn,
  case when event_type in ('purchase','signup') then null when k % 7 = 0 then null
       when event_type = 'error' or k % 5 = 0 then cast(1 + floor(value) as bigint) else cast(0 as bigint) end as syn_packets,
  case when event_type = 'signup' then case when k >= 50 then concat(substr(md5(cast(event_id as varchar)), 1, 8 + k % 40), '.example.test')
       else concat('www', cast(k as varchar), '.example.org') end else null end as dns_name,
  case when k % 4 = 0 then 16 else 1 end as dns_type, event_type in ('view','purchase') as encrypted,
  case event_type when 'view' then 'TLS' when 'purchase' then 'QUIC' else 'IP' end as transport,
  case when event_type = 'view' then md5(cast(k % 10 as varchar)) else null end as tls_fingerprint,
  event_type = 'click' and k % 9 = 0 as tcp_fin_rst from e)"""

WEB = EVENTS.replace("{c}", "10000") + """, web as (
select event_id as seq, ts_us, concat('c', cast(user_id as varchar)) as client, concat('s', cast(k % 2 as varchar)) as server, 80 as service,
  cast(40000 + event_id % 6 as int) as cport, event_type <> 'view' as from_client, cast(40 + k as bigint) as bytes,
  event_type = 'error' and k % 3 = 0 as fin_rst, case when event_type = 'purchase' then 128 else 4096 end as tcp_window from e)"""

CONTACTS = EVENTS.replace("{c}", "1000") + """, contacts as (
select event_id as seq, ts_us, concat('10.0.0.', cast(user_id % 256 as varchar)) as src_ip,
  concat('198.51.100.', cast(length(event_type) as varchar)) as dst_ip, 6 as protocol, cast(6000 + length(event_type) as int) as dst_port from e)"""

NAMES = """names as (
select page_id as seq, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as name, 0 as y, 'pages' as family from pages
union all
select 1000000 + doc_id, concat(substr(md5(cast(doc_id as varchar)), 1, cast(8 + doc_id % 24 as int)), '.test'), 1, source from documents)"""

SCORED = """scored as (
select d.doc_id, l.quality as y, d.source as family, d.lang as lang, cast(d.n_chars % 1000 as double) / 1000 as score
from documents d join labels l on d.doc_id = l.doc_id)"""

EPISODES = TRAFFIC + """, episodes as (
select concat('ep-', src_ip) as id, src_ip as host,
  case when min(seq) % 3 = 0 then 'BENIGN' when min(seq) % 3 = 1 then 'RECONNAISSANCE' else 'BOTNET_C2' end as label,
  1 as priority, min(ts_us) + 20000000 as start_us, min(ts_us) + 140000000 as end_us from traffic group by src_ip
union all select 'ep-dst', '198.51.100.3', 'DATA_EXFILTRATION', 2, 1704067200000000, 1704067260000000)"""

HANDSHAKES = EVENTS.replace("{c}", "10000") + """, handshakes as (
select event_id as seq, 771 as version, [4865 + k % 5, 2570, 4866, 49195 + k % 3] as ciphers, [0, 23, 14906, 65281, 10, 11] as extensions,
  [29, 23] as groups, [0] as points, [772 - k % 2, 771, 2570] as versions, [1027, 2052 + k % 4] as signatures, k % 3 > 0 as has_sni,
  case when k % 4 > 0 then case when k % 4 = 1 then 'h2' else 'http/1.1' end end as alpn from e)"""


def over(view: str, body: str, recursive=False) -> str:
    return ("with recursive " if recursive else "with ") + view + body

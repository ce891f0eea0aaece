"""Registered queries: scalar functions over names, handshakes, addresses, numbers and times."""
from pyspark.sql import functions as F

from ..functions import alerts, ip, numbers, text, times, tls
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import HANDSHAKES, NAMES, TRAFFIC, over

VARIED = NAMES + """, n as (select seq, y, family, case seq % 6 when 0 then concat(name, '.') when 1 then upper(name) when 2 then concat('my-', name)
  when 3 then replace(name, 'example.com', 'site.co.uk') when 4 then concat('x', cast(seq as varchar), '.', name) else name end nm from names),
l as (select *, regexp_replace(lower(nm), '[.]+$', '') cl from n), m as (select *, string_split(cl, '.') p, string_split(cl, '.')[1] lb from l)"""
BIG = ", ".join(f"'{b}'" for b in text.COMMON_BIGRAMS)
ENT = """case when length({c}) = 0 then 0.0 else greatest(0.0, list_sum(list_transform(list_distinct(string_split({c}, '')),
  lambda c: -((length({c}) - length(replace({c}, c, ''))) / length({c})) * log2((length({c}) - length(replace({c}, c, ''))) / length({c}))))) end"""
SURPRISE = """case when length({c}) < 2 then 0.0 else len(list_filter(range(1, length({c})), lambda i: substr({c}, i, 2) not in (""" + BIG + """))) / greatest(1, length({c}) - 1) end"""
VOWELS = "length(regexp_replace({c}, '[^aeiou]', '', 'g')) / greatest(1, length({c}))"
RUN = "coalesce(list_max(list_transform(regexp_extract_all({c}, '{p}'), lambda x: length(x))), 0) / greatest(1, length({c}))"
CONS = RUN.replace("{p}", "[bcdfghjklmnpqrstvwxyz]+")


def varied(spark, sf):
    return V.names(spark, sf).withColumn("nm", F.expr(
        """case seq % 6 when 0 then concat(name, '.') when 1 then upper(name) when 2 then concat('my-', name)
        when 3 then replace(name, 'example.com', 'site.co.uk') when 4 then concat('x', cast(seq as string), '.', name) else name end"""))


@query("registrable_names", over(VARIED, """ select seq, lb first_label, case when len(p) <= 2 then cl
  when length(p[-1]) = 2 and p[-2] in ('co','com','org','net','gov','edu','ac','or','ne','go') then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end registrable from m"""))
def registrable_names(spark, sf):
    return varied(spark, sf).select("seq", text.first_label("nm").alias("first_label"), text.registrable_name("nm").alias("registrable"))


@query("well_formed_labels", over(VARIED, """, w as (select seq, case seq % 5 when 0 then concat('-', nm) when 1 then replace(nm, '.', '..') when 2 then concat('_', nm) else nm end v from m),
  v as (select seq, regexp_replace(lower(trim(v)), '[.]+$', '') t from w)
  select seq, case when length(t) <= 253 and regexp_full_match(t, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+')
  then string_split(t, '.')[1] else '' end label from v"""))
def well_formed_labels(spark, sf):
    v = varied(spark, sf).withColumn("v", F.expr("case seq % 5 when 0 then concat('-', nm) when 1 then replace(nm, '.', '..') when 2 then concat('_', nm) else nm end"))
    return v.select("seq", text.domain_label("v").alias("label"))


@query("label_entropy_and_surprise", over(VARIED, f" select seq, round({ENT.replace('{c}', 'lb')}, 6) entropy, round({SURPRISE.replace('{c}', 'lb')}, 6) surprise from m"))
def label_entropy_and_surprise(spark, sf):
    return rounded(varied(spark, sf).withColumn("lb", text.first_label("nm")).select("seq", text.char_entropy("lb").alias("entropy"), text.bigram_surprise("lb").alias("surprise")))


@query("lexical_numbers", over(VARIED, f""" select seq, round(ln(1 + length(lb)), 6) log_length, round({ENT.replace('{c}', 'lb')}, 6) entropy,
  round(length(regexp_replace(lb, '[^0-9]', '', 'g')) / greatest(1, length(lb)), 6) digit_ratio, round({VOWELS.replace('{c}', 'lb')}, 6) vowel_ratio,
  round(length(regexp_replace(lb, '[^-]', '', 'g')) / greatest(1, length(lb)), 6) hyphen_ratio, round(len(list_distinct(string_split(lb, ''))) / greatest(1, length(lb)), 6) unique_ratio,
  round({CONS.replace('{c}', 'lb')}, 6) consonant_run, round({RUN.replace('{p}', '[0-9]+').replace('{c}', 'lb')}, 6) digit_run,
  round(len(list_filter(range(1, length(lb)), lambda i: regexp_matches(substr(lb, i, 1), '[0-9]') <> regexp_matches(substr(lb, i + 1, 1), '[0-9]'))) / greatest(1, length(lb)), 6) digit_transitions,
  round(len(list_filter(range(1, length(lb)), lambda i: substr(lb, i, 1) = substr(lb, i + 1, 1))) / greatest(1, length(lb)), 6) repeat_ratio from m where length(lb) > 0"""))
def lexical_numbers(spark, sf):
    v = varied(spark, sf).withColumn("lb", text.first_label("nm")).filter("length(lb) > 0")
    return rounded(v.select("seq", *[c.alias(k) for k, c in text.lexical_features("lb").items()]))


@query("label_token_counts", over(VARIED, """, g as (select seq, concat('^', lb, '$') s from m), t as (select seq, unnest(list_concat(
  list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) token from g)
  select seq, token, count(*) n from t group by 1, 2"""))
def label_token_counts(spark, sf):
    s = F.concat(F.lit("^"), text.first_label("nm"), F.lit("$"))
    v = varied(spark, sf).select("seq", s.alias("s")).select("seq", F.explode(F.concat(text.ngrams("s", 2), text.ngrams("s", 3))).alias("token"))
    return v.groupBy("seq", "token").agg(F.count("*").alias("n"))


@query("lexical_rules", over(VARIED, f""", f as (select seq, length(lb) n, {ENT.replace('{c}', 'lb')} e, {SURPRISE.replace('{c}', 'lb')} s, {VOWELS.replace('{c}', 'lb')} v, {CONS.replace('{c}', 'lb')} r from m)
  select seq, e >= 3.5 and s >= 0.8 and n >= 20 conservative, (n between 8 and 15 and e >= 2.5 and s >= 0.9 and v <= 0.2 and r >= 0.35) or (n >= 16 and e >= 3.4 and s >= 0.8 and v <= 0.3) two_band from f"""))
def lexical_rules(spark, sf):
    v = varied(spark, sf).withColumn("lb", text.first_label("nm"))
    v = v.select("seq", *[c.alias(k) for k, c in text.guard_features("lb").items()])
    f = {k: F.col(k) for k in v.columns if k != "seq"}
    return v.select("seq", text.conservative_rule(f).alias("conservative"), text.validation_rule(f).alias("two_band"))


WORDS = ["small", "large", "red", "blue", "hot", "cold", "new", "old", "ring", "rod", "gear"]
READ = """, q as (select p_partkey, case p_partkey % 4 when 0 then replace(p_name, ' ', '') when 1 then replace(p_name, ' ', '-') when 2 then string_split(p_name, ' ')[1] else concat(replace(p_name, ' ', ''), '7') end lb from part)"""


@query("readable_labels", "with a as (select 1)" + READ + f"""
  select p_partkey, lb, regexp_full_match(lb, '[a-z-]+') and regexp_full_match(lb, '-*({'|'.join(WORDS)})+(-+({'|'.join(WORDS)})+)*-*')
  and (contains(lb, '-') or lb not in ({', '.join(repr(w) for w in WORDS)})) readable from q""")
def readable_labels(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey", """case p_partkey % 4 when 0 then replace(p_name, ' ', '') when 1 then replace(p_name, ' ', '-')
        when 2 then split(p_name, ' ')[0] else concat(replace(p_name, ' ', ''), '7') end as lb""")
    return p.select("p_partkey", "lb", text.is_readable("lb", WORDS).alias("readable"))


@query("label_shapes", over(VARIED, """, v as (select seq, case seq % 7 when 0 then cast(seq * 7919 as varchar) when 1 then substr(md5(lb), 1, 12) else lb end lb from m)
  select case when regexp_full_match(lb, '[0-9]+') then 'digits_only' when contains(lb, '-') then 'hyphenated'
  when length(lb) >= 8 and regexp_matches(lb, '[0-9]') and regexp_full_match(lb, '[0-9a-f]*') then 'hexadecimal_shaped' when regexp_matches(lb, '[0-9]') then 'mixed_alphanumeric'
  when length(lb) < 12 then 'letters_only_short' else 'letters_only_long' end shape, count(*) n from v group by 1"""))
def label_shapes(spark, sf):
    v = varied(spark, sf).withColumn("lb", text.first_label("nm"))
    v = v.withColumn("lb", F.expr("case seq % 7 when 0 then cast(seq * 7919 as string) when 1 then substr(md5(lb), 1, 12) else lb end"))
    return v.groupBy(text.label_shape("lb").alias("shape")).agg(F.count("*").alias("n"))


@query("guard_failures", over(VARIED, f""", f as (select length(lb) n, {ENT.replace('{c}', 'lb')} e, {SURPRISE.replace('{c}', 'lb')} s from m where y = 1)
  select case when n >= 20 and e >= 3.5 and s >= 0.8 then 'passes' else array_to_string(list_filter([case when n < 20 then 'length' end, case when e < 3.5 then 'entropy' end,
  case when s < 0.8 then 'bigram_surprise' end], lambda x: x is not null), '+') end failed, count(*) n from f group by 1"""))
def guard_failures(spark, sf):
    v = varied(spark, sf).filter("y = 1").withColumn("lb", text.first_label("nm"))
    v = v.select(F.length("lb").alias("l"), text.char_entropy("lb").alias("e"), text.bigram_surprise("lb").alias("s"))
    return v.groupBy(text.guard_failures("l", "e", "s").alias("failed")).agg(F.count("*").alias("n"))


@query("query_name_parts", over(VARIED, f""", w as (select seq, p, array_to_string(p[-2:], '.') base, array_to_string(p[:len(p) - 2], '') j from m)
  select seq, base dns_base, cast(len(p) as int) dns_label_count, cast(coalesce(list_max(list_transform(p[:len(p) - 2], lambda x: length(x))), 0) as int) dns_encoded_max_label_length,
  cast(length(j) as int) dns_encoded_total_length, round({ENT.replace('{c}', 'j')}, 6) dns_encoded_entropy from w"""))
def query_name_parts(spark, sf):
    return rounded(varied(spark, sf).select("seq", *[c.alias(k) for k, c in text.tunnel_name("nm").items()]))


@query("canonical_log_names", over(VARIED, """, w as (select seq, case seq % 4 when 0 then concat(repeat('a', 60 + cast(seq % 8 as int)), '.', nm) when 1 then replace(nm, 'e', 'é') when 2 then replace(nm, '.', '..') else nm end v from m),
  b as (select seq, v, lower(case when v like '%.' then substr(v, 1, length(v) - 1) else v end) t from w)
  select seq, case when v in ('', '.') then '.' when length(t) <= 253 and regexp_full_match(t, '[\\x00-\\x7F]+') and regexp_full_match(t, '[^.]{1,63}([.][^.]{1,63})*') then t end canonical from b"""))
def canonical_log_names(spark, sf):
    v = varied(spark, sf).withColumn("v", F.expr("""case seq % 4 when 0 then concat(repeat('a', cast(60 + seq % 8 as int)), '.', nm)
        when 1 then replace(nm, 'e', 'é') when 2 then replace(nm, '.', '..') else nm end"""))
    return v.select("seq", text.canonical_log_name("v").alias("canonical"))


CLEAN = "list_filter({a}, lambda x: (x & 3855) <> 2570)"
DASH = "array_to_string(list_transform(" + CLEAN + ", lambda x: cast(x as varchar)), '-')"


@query("client_fingerprint_md5", over(HANDSHAKES, f" select seq, md5(concat(cast(version as varchar), ',', {DASH.replace('{a}', 'ciphers')}, ',', {DASH.replace('{a}', 'extensions')}, ',', {DASH.replace('{a}', 'groups')}, ',', {DASH.replace('{a}', 'points')})) ja3 from handshakes"))
def client_fingerprint_md5(spark, sf):
    return V.handshakes(spark, sf).select("seq", tls.ja3("version", "ciphers", "extensions", "groups", "points").alias("ja3"))


@query("server_fingerprint_md5", over(HANDSHAKES, f" select seq, md5(concat(cast(version as varchar), ',', cast(ciphers[1] as varchar), ',', {DASH.replace('{a}', 'extensions')})) ja3s from handshakes"))
def server_fingerprint_md5(spark, sf):
    return V.handshakes(spark, sf).select("seq", tls.ja3s("version", F.col("ciphers")[0], "extensions").alias("ja3s"))


HEX4 = "array_to_string(list_transform({a}, lambda x: printf('%04x', x)), ',')"


@query("client_fingerprint_sorted", over(HANDSHAKES, f""", c as (select seq, has_sni, alpn, version, {CLEAN.replace('{a}', 'ciphers')} cs, {CLEAN.replace('{a}', 'extensions')} es, {CLEAN.replace('{a}', 'versions')} vs, {CLEAN.replace('{a}', 'signatures')} sg from handshakes)
  select seq, concat('t', case coalesce(list_max(vs), version) when 772 then '13' when 771 then '12' else '00' end, case when has_sni then 'd' else 'i' end, printf('%02d', least(99, len(cs))), printf('%02d', least(99, len(es))),
  case when alpn is null then '00' else concat(substr(alpn, 1, 1), substr(alpn, length(alpn), 1)) end, '_', substr(sha256({HEX4.replace('{a}', 'list_sort(cs)')}), 1, 12), '_',
  substr(sha256(concat({HEX4.replace('{a}', 'list_sort(list_filter(es, lambda x: x not in (0, 16)))')}, '_', {HEX4.replace('{a}', 'sg')})), 1, 12)) ja4 from c"""))
def client_fingerprint_sorted(spark, sf):
    return V.handshakes(spark, sf).select("seq", tls.ja4(F.lit("t"), "version", "ciphers", "extensions", "versions", "has_sni", "alpn", "signatures").alias("ja4"))


@query("grease_values", over(HANDSHAKES, ", v as (select unnest(list_concat(ciphers, extensions)) v from handshakes) select v, (v & 3855) = 2570 grease, count(*) n from v group by 1, 2"))
def grease_values(spark, sf):
    v = V.handshakes(spark, sf).select(F.explode(F.concat("ciphers", "extensions")).alias("v"))
    return v.groupBy("v", tls.is_grease("v").alias("grease")).agg(F.count("*").alias("n"))


@query("hash_splits", """with b as (select doc_id, cast(('0x' || substr(sha256(concat('docs:', cast(doc_id as varchar))), 1, 8)) as bigint) % 10 b from documents)
  select doc_id, b bucket, case when b < 6 then 'train' when b < 8 then 'validation' else 'test' end split from b""")
def hash_splits(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", numbers.hash_bucket("doc_id", 10, "docs:").alias("bucket"))
    return d.select("*", numbers.family_split("bucket").alias("split"))


ADDR = """case seq % 12 when 0 then '10.' when 1 then '127.' when 2 then '169.254.' when 3 then '224.' when 4 then '241.' when 5 then '192.168.' when 6 then '172.20.' when 7 then '0.0.'
  when 8 then '198.18.' when 9 then '203.0.113.' when 10 then '192.0.0.' else '8.8.' end"""
TAIL = "case when seq % 12 in (0, 1, 3, 4) then concat(cast(cast(floor(user_id / 256) as bigint) % 256 as {s}), '.', cast(k % 32 as {s}), '.', cast(seq % 256 as {s})) when seq % 12 in (9, 10) then cast(seq % 256 as {s}) else concat(cast(k % 32 as {s}), '.', cast(seq % 256 as {s})) end"


@query("address_classes", over(TRAFFIC, f""", q as (select event_id seq, user_id, k from e), a as (select seq, concat({ADDR}, {TAIL.replace('{s}', 'varchar')}) ip from q),
  s as (select seq, ip, string_split(ip, '.') p from a), n as (select seq, ip, cast(p[1] as bigint) * 16777216 + cast(p[2] as bigint) * 65536 + cast(p[3] as bigint) * 256 + cast(p[4] as bigint) v from s)
  select seq, ip, v between 3758096384 and 4026531839 multicast, v between 2130706432 and 2147483647 loopback, v between 2851995648 and 2852061183 link_local, v = 0 unspecified,
  v >= 4026531840 reserved, (v between 0 and 16777215 or v between 167772160 and 184549375 or v between 2130706432 and 2147483647 or v between 2851995648 and 2852061183 or v between 2886729728 and 2887778303
   or v between 3221225472 and 3221225727 or v between 3221225984 and 3221226239 or v between 3232235520 and 3232301055 or v between 3323068416 and 3323199487 or v between 3325256704 and 3325256959
   or v between 3405803776 and 3405804031 or v >= 4026531840) and v not in (3221225481, 3221225482) private,
  v // 256 = (3232235520 + 12) // 256 + 0 same_24 from n"""))
def address_classes(spark, sf):
    e = V.events(spark, sf)
    a = e.select("seq", F.expr(f"concat({ADDR}, {TAIL.replace('{s}', 'string')})").alias("ip"))
    return a.select("seq", "ip", ip.is_multicast("ip").alias("multicast"), ip.is_loopback("ip").alias("loopback"), ip.is_link_local("ip").alias("link_local"),
                    ip.is_unspecified("ip").alias("unspecified"), ip.is_reserved("ip").alias("reserved"), ip.is_private("ip").alias("private"),
                    (F.shiftright(ip.v4_number("ip"), 8) == F.shiftright(ip.v4_number(F.lit("192.168.0.12")), 8)).alias("same_24"))


@query("same_network_pairs", over(TRAFFIC, """ select src_ip, dst_ip, protocol, count(*) n from traffic where src_ip like '10.%' group by 1, 2, 3"""))
def same_network_pairs(spark, sf):
    t = V.traffic(spark, sf)
    return t.filter(ip.same_local_network("src_ip", "dst_ip")).groupBy("src_ip", "dst_ip", "protocol").agg(F.count("*").alias("n"))


@query("log_vectors", """select l_orderkey, l_linenumber, l_partkey, round(ln(1 + greatest(0, l_quantity - 10)), 6) a, round(ln(1 + greatest(0, l_extendedprice)), 6) b,
  round(1 / (1 + exp(-greatest(-700, least(700, l_quantity * 100 - 2500)))), 6) p from lineitem""")
def log_vectors(spark, sf):
    l = V.table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity") - 10).withColumn("v", numbers.log_vector("q", "l_extendedprice"))
    return rounded(l.select("l_orderkey", "l_linenumber", "l_partkey", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), numbers.logistic(F.col("l_quantity") * 100 - 2500).alias("p")))


@query("variation_guards", """with g as (select l_orderkey, count(*) n, avg(l_quantity - 25) m, stddev_pop(l_quantity - 25) s from lineitem group by 1)
  select l_orderkey, round(log10(1 + case when n < 2 then 0 else s / greatest(m, 1e-9) end), 6) tiny_guard, round(case when abs(m) > 1e-12 then s / m else 9.0 end, 4) nine_guard,
  round(case when abs(m) > 1e-12 then s / m else 0 end, 4) zero_guard from g""")
def variation_guards(spark, sf):
    x = F.col("l_quantity") - 25
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    zero = F.abs("m") <= 1e-12
    ratio = F.col("s") / F.col("m")
    return rounded(g.select("l_orderkey", F.round(F.log10(1 + numbers.moment_cv(F.col("n"), F.col("s1"), F.col("s2"))), 6).alias("tiny_guard"),
                            F.round(F.when(zero, 9.0).otherwise(ratio), 4).alias("nine_guard"), F.round(F.when(zero, 0.0).otherwise(ratio), 4).alias("zero_guard")))


@query("evidence_text", over(TRAFFIC, """ select seq, concat('bytes=', cast(bytes as varchar), '; mean=', regexp_replace(regexp_replace(printf('%.4f', round(bytes / packets, 4)), '0+$', ''), '[.]$', '.0'),
  '; encrypted=', case when encrypted then 'True' else 'False' end, '; name=', coalesce(dns_name, 'None')) narrative,
  case when protocol = 17 then 'CRITICAL' when encrypted then 'HIGH' else 'MEDIUM' end severity from traffic"""))
def evidence_text(spark, sf):
    t = V.traffic(spark, sf).withColumns({"mean": F.col("bytes") / F.col("packets"), "threat": F.expr("case when protocol = 17 then 'DDOS' when encrypted then 'BOTNET_C2' else 'DGA_DOMAINS' end")})
    return t.select("seq", alerts.narrative([("bytes", "bytes", "int"), ("mean", "mean", "float"), ("encrypted", "encrypted", "bool"), ("name", "dns_name", "text")]).alias("narrative"),
                    alerts.severity("threat").alias("severity"))


@query("time_texts", """with s as (select event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') base from events)
  select event_id, case event_id % 3 when 0 then epoch_us(ts) / 1000.0 when 1 then (epoch_us(ts) - 7200000000) / 1000.0 end iso_ms,
  epoch_us(ts) * 1000 ns, epoch_us(ts) // 1000000 syslog_s, case when event_id % 4 < 3 then strftime(ts, '%Y-%m-%d') end day_text from s""")
def time_texts(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("b"), V.micros("ts").alias("us"), "ts")
    iso = F.expr("case event_id % 3 when 0 then concat(b, 'Z') when 1 then concat(b, '+02:00') else b end")
    day = F.expr("case event_id % 4 when 0 then date_format(ts, 'yyyyMMdd-HH') when 1 then date_format(ts, 'yyMMdd') when 2 then date_format(ts, 'yyMMddHH') else '201399xx' end")
    return e.select("event_id", times.iso_ms(iso).alias("iso_ms"),
                    times.decimal_ns((F.col("us").cast("decimal(20,0)") / F.lit(1000000).cast("decimal(8,0)")).cast("decimal(26,6)").cast("string")).alias("ns"),
                    times.syslog_seconds(F.date_format("ts", "MMM dd HH:mm:ss"), 2024).alias("syslog_s"), times.sample_day(day).alias("day_text"))


@query("float_normalisation", """select vec_id, label, round(cast(embedding[1] as double) / 3, 9) a, round(cast(embedding[2] as double) / 7, 9) b from embeddings""")
def float_normalisation(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return rounded(e.select("vec_id", "label", (F.col("embedding")[0].cast("double") / 3).alias("a"), (F.col("embedding")[1].cast("double") / 7).alias("b")), 9)


@query("stream_digests", """select conv_id, count(*) n, sha256(concat('[', string_agg(concat('{"turn":', cast(turn as varchar), ',"role":"', role, '","n":', cast(length(text) as varchar), '}'), ',' order by turn), ']')) digest
  from conversations group by conv_id""")
def stream_digests(spark, sf):
    c = V.table(spark, sf, "conversations").withColumn("n", F.length("text"))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_"), numbers.record_digest("role", "n", order="turn").alias("digest")).withColumnRenamed("n_", "n")


@query("training_weights", over(VARIED, """ select seq, case when y = 0 and length(lb) >= 12 and regexp_full_match(lb, '[a-z]+') then cast(3 as double) else cast(1 as double) end weight from m"""))
def training_weights(spark, sf):
    return varied(spark, sf).withColumn("lb", text.first_label("nm")).select("seq", alerts.training_weight("lb", "y").alias("weight"))


@query("family_exclusion", """select doc_id, starts_with(source, 'src1') or source in ('src7', 'src9') excluded from documents""")
def family_exclusion(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", alerts.excluded_family(F.concat(F.upper("source"), F.lit("-_")), ["src1"], ["src7", "src9"]).alias("excluded"))

"""Registered queries: joins, set operations, sampling."""
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers, text
from ..operators import joins
from ..sources import tables
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import EPISODES, NAMES, TRAFFIC, over


@query("episode_matching", over(EPISODES, """, m as (select t.seq, e.id, e.label, row_number() over (partition by t.seq order by priority, id) r, count(*) over (partition by t.seq) n
  from traffic t join episodes e on t.ts_us between e.start_us and e.end_us and (t.src_ip = e.host or t.dst_ip = e.host))
  select t.seq, m.id episode, m.label, coalesce(m.n, 0) matches from traffic t left join (select * from m where r = 1) m using (seq)"""))
def episode_matching(spark, sf):
    t, e = V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "dst_ip"), V.episodes(spark, sf)
    m = joins.match_networks(t, e.withColumn("hosts", F.array("host")))
    return m.select("seq", "episode", "label", "matches")


@query("network_episode_matching", over(TRAFFIC, """, c as (select 'lan-a' id, 1 priority, 'BENIGN' label, 1704067200000000 start_us, 1704067330000000 end_us, 167772160 lo, 167772287 hi union all
  select 'lan-b', 2, 'DDOS', 1704067230000000, 1704067400000000, 3325256704, 3325256711),
  n as (select seq, ts_us, list_reduce(list_transform(string_split(src_ip, '.'), lambda x: cast(x as bigint)), lambda a, x: a * 256 + x) s, list_reduce(list_transform(string_split(dst_ip, '.'), lambda x: cast(x as bigint)), lambda a, x: a * 256 + x) d from traffic),
  m as (select n.seq, id, label, row_number() over (partition by n.seq order by priority, id) r, count(*) over (partition by n.seq) k from n join c on ts_us between start_us and end_us and (s between lo and hi or d between lo and hi))
  select n.seq, m.id episode, m.label, coalesce(m.k, 0) matches from n left join (select * from m where r = 1) m using (seq)"""))
def network_episode_matching(spark, sf):
    t = V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "dst_ip")
    rows = [("lan-a", 1, "BENIGN", V.EPOCH, V.EPOCH + 130_000_000, ["10.0.0.5/25"]), ("lan-b", 2, "DDOS", V.EPOCH + 30_000_000, V.EPOCH + 200_000_000, ["198.51.100.0/29"])]
    e = spark.createDataFrame(rows, "id string, priority int, label string, start_us long, end_us long, hosts array<string>")
    return joins.match_networks(t, e).select("seq", "episode", "label", "matches")


LABELLED = over(TRAFFIC, """, a as (select seq, ts_us, seq % 2 v6, cast(split_part(src_ip, '.', 3) as int) o3, cast(split_part(src_ip, '.', 4) as int) o4, cast(split_part(dst_ip, '.', 4) as int) d4 from traffic),
  h as (select o3, o4, min(ts_us) s, min(seq) q from a group by all),
  l as (select *, concat('ep-', cast(o3 as varchar), '-', cast(o4 as varchar)) id, case when o4 % 50 = 7 then 'bad' when o4 % 50 = 9 then 'any' when o4 % 5 = 4 then 'half' else cast(o4 % 5 as varchar) end kind, o4 % 9 priority,
    case when o4 % 2 = 0 then 'DDOS' else 'BENIGN' end label, (s - 20000000) // 1000 * 1000 a_us, (s + (case when o4 % 50 = 9 then 1 else 60 end + case when o4 % 7 = 0 then 100000000 else 0 end) * cast(1000000 as bigint)) // 1000 * 1000 b_us from h),
  m as (select a.seq, l.id, l.label, row_number() over (partition by a.seq order by l.priority, l.id) r, count(*) over (partition by a.seq) n from a join l on a.ts_us between a_us and b_us and (
    kind = 'any' or (kind = '0' and v6 = 0 and a.o3 = l.o3 and a.o4 = l.o4) or (kind = '1' and v6 = 0 and a.o3 = l.o3 and a.o4 // 4 = l.o4 // 4)
    or (kind = '2' and v6 = 1 and a.o4 % 8 = l.o4 % 8) or (kind = '3' and ((v6 = 1 and a.o4 % 8 = l.o4 % 8 and (a.d4 % 8) // 2 = (l.o4 % 8) // 2) or a.d4 = l.o4 % 32))
    or (kind = 'half' and v6 = 1 and a.o4 % 8 >= 4 and l.o4 % 25 = 4)))
  select a.seq, m.id episode, m.label, coalesce(m.n, 0) matches from a left join (select * from m where r = 1) m using (seq)""")


@query("labelled_network_episodes", LABELLED)
def labelled_network_episodes(spark, sf):
    """Events of both address families against label files whose hosts are addresses and networks of either; files with a bad host are left out."""
    t = V.traffic(spark, sf).select("seq", "ts_us", "src_ip", "dst_ip")
    octet = lambda c, i: F.element_at(F.split(c, "[.]"), i).cast("int")
    part = lambda x: F.lower(F.hex(x))
    v6 = F.concat(F.lit("2001:db8:"), part(32764 + octet("src_ip", 4) % 8), F.lit(":"), part(octet("dst_ip", 4) % 8), F.lit("::"), part(F.col("seq") % 65536))
    events = t.withColumn("src_ip", F.when(F.col("seq") % 2 == 1, v6).otherwise(F.col("src_ip")))
    h = t.groupBy(octet("src_ip", 3).alias("o3"), octet("src_ip", 4).alias("o4"), "src_ip").agg(F.min("ts_us").alias("s"))
    text = F.concat(F.lit("2001:DB8:"), part(32764 + F.col("o4") % 8))
    hosts = (F.when(F.col("o4") % 50 == 7, F.array(F.lit("10.0.0.300"))).when(F.col("o4") % 50 == 9, F.array().cast("array<string>")).when(F.col("o4") % 25 == 4, F.array(F.lit("2001:db8:8000::/33")))
             .when(F.col("o4") % 5 == 4, F.array(F.lit("fd00::/8"), F.lit("10.9.9.9"))).when(F.col("o4") % 5 == 0, F.array("src_ip")).when(F.col("o4") % 5 == 1, F.array(F.concat("src_ip", F.lit("/255.255.255.252")), F.lit("ff02::1")))
             .when(F.col("o4") % 5 == 2, F.array(F.concat(text, F.lit("::/48")))).otherwise(F.array(F.concat(text, F.lit(":"), part(F.col("o4") % 8), F.lit("::/63")), F.concat(F.lit("198.51.100."), (F.col("o4") % 32).cast("string")))))
    seconds = F.when(F.col("o4") % 50 == 9, 1).otherwise(60) + F.when(F.col("o4") % 7 == 0, 100_000_000).otherwise(0)
    ms = lambda us: F.floor(us / 1000).cast("double")
    one = F.struct(F.concat_ws("-", F.lit("ep"), "o3", "o4").alias("id"), F.when(F.col("o4") % 2 == 0, "DDOS").otherwise("BENIGN").alias("label"), ms(F.col("s") - 20_000_000).alias("start_ms"), ms(F.col("s") + seconds.cast("long") * 1_000_000).alias("end_ms"), hosts.alias("hosts"))
    # one file per rank, so that an episode's place in its file is its priority
    files = h.select(F.concat(F.lit("net-"), "o3", F.lit("-"), F.floor(F.col("o4") / 9).cast("string")).alias("capture"), F.struct("o4", one.alias("e")).alias("x")).groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("x.o4", F.to_json("x.e").alias("j")))).alias("e"), F.max("x.o4").alias("top"))
    # places without an episode hold an unusable entry
    slots = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.coalesce(F.get(F.filter("e", lambda y: y["o4"] % 9 == i), F.lit(0))["j"], F.lit('{"id": null}')))
    doc = F.concat(F.lit('{"format":"x","split":"train","capture":"'), "capture", F.lit('","episodes":['), F.array_join(slots, ","), F.lit("]}"))
    parsed = files.select(F.from_json(doc, tables.LABEL_FILE).alias("j")).select("j.*")
    episodes = tables.label_episodes(parsed, allowed=["DDOS", "BENIGN"]).filter(F.size("errors") == 0)
    return joins.match_networks(events, episodes).select("seq", "episode", "label", "matches")


ASOF = """with o as (select o_custkey % 1000 u, cast(epoch_us(o_orderdate) as bigint) t, max(o_orderkey) k from orders group by 1, 2),
  e as (select event_id, user_id u, epoch_us(ts) - 757382400000000 t from events)"""


@query("latest_template", ASOF + """ select event_id seq, e.u, o.k last_template from e asof left join o on e.u = o.u and e.t >= o.t""")
def latest_template(spark, sf):
    """As-of join: each event sees the newest earlier definition of its scope (orders stand in, shifted 24 years)."""
    o = V.table(spark, sf, "orders").select((F.col("o_custkey") % 1000).alias("u"), V.micros("o_orderdate").alias("ts_us"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("template"))
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("u"), (V.micros("ts") - 757382400000000).alias("ts_us"), F.col("event_id").alias("seq"))
    j = joins.asof_latest(e, o, ["u"], ["template"])
    return j.select("seq", "u", "last_template")


TUPLE = """, w as (select seq uid, src_ip, dst_ip, protocol, ts_us start_us, ts_us + (bytes % 20) * 1000000 end_us from traffic where seq % 3 = 0), p as (select seq, src_ip, dst_ip, protocol, ts_us from traffic where seq % 3 > 0),
  m as (select p.seq, min(w.uid) uid, count(*) candidates from p join w on w.src_ip = p.src_ip and w.dst_ip = p.dst_ip and w.protocol = p.protocol and p.ts_us between w.start_us - 1000000 and w.end_us + 1000000 group by 1)"""


@query("handshake_in_connection", over(TRAFFIC, TUPLE + " select seq, uid, candidates from m where candidates = 1"))
def handshake_in_connection(spark, sf):
    t = V.traffic(spark, sf)
    w = t.filter("seq % 3 = 0").selectExpr("seq as uid", "src_ip", "dst_ip", "protocol", "ts_us as start_us", "ts_us + (bytes % 20) * 1000000 as end_us")
    p = t.filter("seq % 3 > 0").select("seq", "src_ip", "dst_ip", "protocol", "ts_us")
    return joins.single_interval_match(p, w, ["src_ip", "dst_ip", "protocol"], 1_000_000).filter("candidates = 1")


@query("clock_offset_hypotheses", over(TRAFFIC, """, w as (select dst_ip, min(ts_us) start_us, min(ts_us) + 40000000 end_us from traffic where protocol = 17 group by 1)
  select w.dst_ip, count(*) filter (t.ts_us between start_us and end_us) as_is, count(*) filter (t.ts_us + 30000000 between start_us and end_us) shifted from traffic t join w using (dst_ip) where t.protocol = 6 group by 1"""))
def clock_offset_hypotheses(spark, sf):
    """Events inside a labelled window under two clock offsets."""
    t = V.traffic(spark, sf)
    w = t.filter("protocol = 17").groupBy("dst_ip").agg(F.min("ts_us").alias("start_us")).withColumn("end_us", F.col("start_us") + 40_000_000)
    inside = lambda off: F.count_if((F.col("ts_us") + off).between(F.col("start_us"), F.col("end_us")))
    return t.filter("protocol = 6").select("dst_ip", "ts_us").join(w, "dst_ip").groupBy("dst_ip").agg(inside(0).alias("as_is"), inside(30_000_000).alias("shifted"))


MARKER = """with m as (select o_orderkey id, o_custkey % 400 name, date_part('hour', o_orderdate) + o_orderkey % 24 h, count(*) over (partition by o_custkey % 400, date_part('hour', o_orderdate) + o_orderkey % 24) multi from orders),
  q as (select user_id % 400 name, date_part('hour', ts) h, event_type qtype, event_id % 3 src from events)
  select m.id, coalesce(count(*) filter (q.h = m.h and qtype <> 'view'), 0) wrong_type, count(*) filter (q.h = m.h and qtype = 'view' and src <> 0) other_source, count(*) filter (q.h = m.h and qtype = 'view' and src = 0) eligible,
  count(*) filter (q.h <> m.h and src = 0) other_second, case when count(*) filter (q.h = m.h and qtype = 'view' and src = 0) = 0 then 'UNMATCHED' when count(*) filter (q.h = m.h and qtype = 'view' and src = 0) > 1 or any_value(multi) > 1 then 'AMBIGUOUS' else 'EXACT_MARKER_JOIN' end status
  from m left join q on q.name = m.name group by m.id"""


@query("marker_join", MARKER)
def marker_join(spark, sf):
    """Join on (name, second, type, source) with near-miss counters.

    Observations are counted per (name, second) before the join, so a frequent name costs one row per second."""
    q = V.table(spark, sf, "events").select((F.col("user_id") % 400).alias("name"), F.hour("ts").alias("h"), (F.col("event_type") == "view").alias("a"), (F.col("event_id") % 3 == 0).alias("s"))
    q = q.groupBy("name", "h").agg(F.count_if(~F.col("a")).alias("wt"), F.count_if(F.col("a") & ~F.col("s")).alias("os"), F.count_if(F.col("a") & F.col("s")).alias("el"), F.count_if("s").alias("src"))
    m = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 400).alias("name"), (F.hour("o_orderdate") + F.col("o_orderkey") % 24).alias("mh"))
    multi = m.groupBy("name", "mh").agg(F.count(F.lit(1)).alias("multi"))
    # One row per (name, second) on the second itself, and the name's total for the other seconds.
    total = q.groupBy("name").agg(F.sum("src").alias("all"))
    j = m.join(multi, ["name", "mh"]).join(q.withColumnRenamed("h", "mh"), ["name", "mh"], "left").join(total, "name", "left")
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = j.select("id", at("wt").alias("wrong_type"), at("os").alias("other_source"), at("el").alias("eligible"), (at("all") - at("src")).alias("other_second"), "multi")
    status = F.when(F.col("eligible") == 0, "UNMATCHED").when((F.col("eligible") > 1) | (F.col("multi") > 1), "AMBIGUOUS").otherwise("EXACT_MARKER_JOIN")
    return g.select("id", "wrong_type", "other_source", "eligible", "other_second", status.alias("status"))


@query("uid_label_errors", """with s as (select l_orderkey % 9000 uid, l_quantity q, l_discount d from lineitem), l as (select o_orderkey uid, cast(o_orderkey % 50 + 1 as double) q, o_orderkey % 11 / 100.0 d from orders),
  sg as (select uid, count(*) n, min(q) q, min(d) d from s group by 1), lg as (select uid, count(*) n, min(q) q, min(d) d from l group by 1),
  j as (select coalesce(sg.uid, lg.uid) uid, array_to_string(list_filter([case when sg.n > 1 then 'duplicate_source' end, case when lg.n > 1 then 'duplicate_label' end, case when lg.n is null then 'unlabelled' end, case when sg.n is null then 'unmatched_label' end,
    case when sg.n is not null and lg.n is not null and sg.q is distinct from lg.q then 'q_differs' end, case when sg.n is not null and lg.n is not null and sg.d is distinct from lg.d then 'd_differs' end], lambda x: x is not null), '+') reason from sg full join lg on sg.uid = lg.uid)
  select uid, reason from j where reason <> ''""")
def uid_label_errors(spark, sf):
    s = V.table(spark, sf, "lineitem").selectExpr("l_orderkey % 9000 as uid", "l_quantity as q", "l_discount as d")
    l = V.table(spark, sf, "orders").selectExpr("o_orderkey as uid", "cast(o_orderkey % 50 + 1 as double) as q", "cast(o_orderkey % 11 as double) / 100 as d")
    return joins.label_errors(s, l, ["q", "d"])


@query("contamination_removed", """with dev as (select distinct sha256(text) h from benchmark union select distinct sha256(text) from documents where source = 'src0')
  select source, count(*) total, count(*) filter (sha256(text) in (select h from dev)) dropped from documents where source <> 'src0' group by 1""")
def contamination_removed(spark, sf):
    """Evaluation rows whose text occurs in the development union, dropped and counted per source."""
    d = V.table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"))
    dev = V.table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("h")).unionByName(d.filter("source = 'src0'").select("h")).distinct().withColumn("seen", F.lit(1))
    return d.filter("source <> 'src0'").join(dev, "h", "left").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("seen").alias("dropped"))


@query("unseen_vectors", """with r as (select l_orderkey * 10 + l_linenumber id, l_linenumber ln, sha256(concat(cast(cast(l_quantity as int) as varchar), '|', cast(cast(l_discount * 100 as int) as varchar), '|', cast(cast(floor(l_extendedprice / 500) as int) as varchar), '|', l_returnflag)) sig from lineitem)
  select min(id) id from r where ln > 2 and sig not in (select sig from r where ln <= 2) group by sig""")
def unseen_vectors(spark, sf):
    r = V.table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_linenumber as ln", "cast(l_quantity as int) as q", "cast(round(l_discount * 100) as int) as d", "cast(floor(l_extendedprice / 500) as int) as p", "l_returnflag as f")
    return joins.unseen_vectors(r.filter("ln > 2"), r.filter("ln <= 2"), ["q", "d", "p", "f"], "id")


@query("aligned_pairs", """with a as (select l_orderkey k, l_linenumber p, max(l_quantity) q, max(l_returnflag) f from lineitem where l_orderkey % 2 = 0 group by 1, 2), b as (select l_orderkey - 1 k, l_linenumber p, max(l_quantity) q, max(l_returnflag) f from lineitem where l_orderkey % 2 = 1 group by 1, 2),
  j as (select coalesce(a.k, b.k) k, coalesce(a.p, b.p) p, a.q is distinct from b.q or a.k is null or b.k is null dq, a.f is distinct from b.f or a.k is null or b.k is null df from a full join b on a.k = b.k and a.p = b.p)
  select k, count(*) positions, cast(sum(cast(dq as int)) as bigint) q_differs, cast(sum(cast(df as int)) as bigint) f_differs, coalesce(min(case when dq or df then p end), max(p) + 1) first_difference from j group by k""")
def aligned_pairs(spark, sf):
    l = V.table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("p")).agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    a = l.filter("l_orderkey % 2 = 0").withColumn("k", F.col("l_orderkey"))
    b = l.filter("l_orderkey % 2 = 1").withColumn("k", F.col("l_orderkey") - 1)
    return joins.aligned_differences(a, b, ["k"], "p", ["q", "f"])


@query("feature_parity", """with x as (select l_orderkey * 100 + l_linenumber id, l_extendedprice p, l_extendedprice + case when l_linenumber = 3 then 0.5 else 0 end p2, l_tax t from lineitem), g as (select id, sum(p) p, sum(p2) p2, sum(t) t from x group by id)
  select 'price' feature, count(*) compared, cast(count(*) filter (abs(p - p2) > 1e-10 * greatest(1, abs(p), abs(p2))) as bigint) changed, round(max(abs(p - p2)), 4) max_delta from g union all select 'tax', count(*), 0, 0 from g""")
def feature_parity(spark, sf):
    x = V.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id")).agg(
        F.sum("l_extendedprice").alias("price"), F.sum(F.col("l_extendedprice") + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0)).alias("p2"), F.sum("l_tax").alias("tax"))
    return rounded(joins.feature_parity(x, x.drop("price").withColumnRenamed("p2", "price"), "id", ["price", "tax"]), 4)


@query("false_positive_context", """with s as (select d.doc_id, d.lang, d.source, substr(d.text, 1, 0) z, d.n_chars % 1000 / 1000.0 score, l.quality y from documents d join labels l using (doc_id)), f as (select * from s where y = 0 and score >= 0.5)
  select source, count(*) false_positives, array_to_string(list_sort(list(distinct lang)), ',') langs from f group by 1""")
def false_positive_context(spark, sf):
    """False positives joined back to their original rows, with the distinct types seen."""
    fp = V.scored(spark, sf).filter("y = 0 and score >= 0.5").select("doc_id")
    d = V.table(spark, sf, "documents").select("doc_id", "source", "lang")
    return d.join(fp, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("false_positives"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("label_union", """select lower(name) name from (select c_mktsegment name from customer union select p_type from part union select split_part(n_name, '_', 1) from nation)""")
def label_union(spark, sf):
    a = V.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("name"))
    b = V.table(spark, sf, "part").select(F.lower("p_type").alias("name"))
    c = V.table(spark, sf, "nation").select(F.lower(F.split_part("n_name", F.lit("_"), F.lit(1))).alias("name"))
    return a.unionByName(b).unionByName(c).distinct()


SPLIT = """with d as (select doc_id, text t, cast(('0x' || substr(sha256(concat('s:', cast(doc_id as varchar))), 1, 8)) as bigint) % 10 b from documents), s as (select doc_id, t, case when b < 6 then 'train' when b < 8 then 'validation' else 'test' end split from d)"""


def _splits(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("t"), numbers.hash_bucket("doc_id", 10, "s:").alias("b"))
    return d.select("doc_id", "t", numbers.family_split("b").alias("split"))


@query("split_overlaps", SPLIT + """, u as (select distinct t, split from s) select a.split a, b.split b, count(*) shared from u a join u b on a.t = b.t and a.split < b.split group by 1, 2""")
def split_overlaps(spark, sf):
    return joins.pair_overlap(_splits(spark, sf), "split", "t")


@query("label_conflicts", """with d as (select concat(lang, '-', cast(n_chars as varchar)) t, quality from documents join labels using (doc_id)) select t from d where quality = 1 intersect select t from d where quality = 0""")
def label_conflicts(spark, sf):
    """Labels that occur with both classes."""
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id").select(F.concat_ws("-", "lang", "n_chars").alias("t"), "quality")
    return d.filter("quality = 1").select("t").intersect(d.filter("quality = 0").select("t"))


@query("unseen_labels", SPLIT + """ select distinct sha256(t) t from s where split = 'test' except select sha256(t) from s where split = 'train' except select sha256(t) from s where split = 'validation'""")
def unseen_labels(spark, sf):
    s = _splits(spark, sf)
    part = lambda x: s.filter(F.col("split") == x).select("t")
    return part("test").exceptAll(part("train")).join(part("train"), "t", "left_anti").join(part("validation"), "t", "left_anti").distinct()


@query("crossing_labels", SPLIT + " select sha256(t) t, count(distinct split) splits from s group by t having count(distinct split) > 1")
def crossing_labels(spark, sf):
    return joins.crossing(_splits(spark, sf), "t", "split")


@query("reporting_family", """select sha256(text) t, arg_max(source, doc_id) source from documents group by text""")
def reporting_family(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("t"), "source")
    return joins.last_family(d, "t", "source", "doc_id")


@query("hash_ordered_sample", """select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha256(cast(doc_id as varchar)), doc_id) r from documents) where r <= 20""")
def hash_ordered_sample(spark, sf):
    return joins.hash_top(V.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 20)


@query("seeded_family_sample", """select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by sha256(concat('seed-7:', cast(doc_id as varchar))), doc_id) r from documents) where r <= 50""")
def seeded_family_sample(spark, sf):
    """Capped uniform sample per family: order by a seeded hash instead of a one-pass reservoir."""
    return joins.hash_top(V.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50, seed="seed-7:")


@query("one_in_twenty", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where cast(('0x' || substr(sha256(concat(cast(l_orderkey as varchar), '|', cast(l_linenumber as varchar))), 1, 8)) as bigint) % 20 = 0""")
def one_in_twenty(spark, sf):
    l = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.filter(numbers.hash_bucket(F.concat_ws("|", "l_orderkey", "l_linenumber"), 20) == 0)


ALERTS = """, al as (select seq as sequence, ts_us, src_ip, dst_ip, case when protocol = 17 then 'DDOS' when syn then 'RECONNAISSANCE' when encrypted then 'ENCRYPTED_MALWARE' else 'DATA_EXFILTRATION' end threat,
  case when packets > 20 then 'HIGH' else 'MEDIUM' end severity, case when seq % 3 = 0 then 'ML' else 'RULE' end engine from traffic)"""


def alert_rows(spark, sf):
    return V.traffic(spark, sf).selectExpr("seq as sequence", "ts_us", "src_ip", "dst_ip", "case when protocol = 17 then 'DDOS' when syn then 'RECONNAISSANCE' when encrypted then 'ENCRYPTED_MALWARE' else 'DATA_EXFILTRATION' end as threat",
                                           "case when packets > 20 then 'HIGH' else 'MEDIUM' end as severity", "case when seq % 3 = 0 then 'ML' else 'RULE' end as engine")


@query("alert_page", over(TRAFFIC, ALERTS + " select sequence, threat from al where sequence > 100 and threat = 'DDOS' order by sequence limit 50"))
def alert_page(spark, sf):
    """Cursor read: alerts after a sequence number, optionally one class, oldest first, limited."""
    return alert_rows(spark, sf).filter("sequence > 100 and threat = 'DDOS'").select("sequence", "threat").orderBy("sequence").limit(50)


@query("alert_search", over(TRAFFIC, ALERTS + """ select sequence from al where severity = 'HIGH' and engine = 'RULE' and threat in ('DDOS', 'RECONNAISSANCE')
  and contains(lower(concat_ws(' ', threat, severity, engine, src_ip, dst_ip)), '100.1')"""))
def alert_search(spark, sf):
    a = alert_rows(spark, sf).filter("severity = 'HIGH' and engine = 'RULE' and threat in ('DDOS', 'RECONNAISSANCE')")
    return a.filter(F.lower(F.concat_ws(" ", "threat", "severity", "engine", "src_ip", "dst_ip")).contains("100.1")).select("sequence")


@query("latest_alerts", over(TRAFFIC, ALERTS + """ select sequence, threat, cast((row_number() over (order by sequence desc) - 1) // 10 as int) page from al order by sequence desc limit 200"""))
def latest_alerts(spark, sf):
    """Newest first, one row per sequence, capped at 200, pages of ten."""
    a = alert_rows(spark, sf)
    top = a.unionByName(a.filter("sequence % 2 = 0")).dropDuplicates(["sequence"]).orderBy(F.desc("sequence")).limit(200).select("sequence", "threat")
    return top.withColumn("page", F.floor((F.row_number().over(W.orderBy(F.desc("sequence"))) - 1) / 10).cast("int"))


@query("preset_records", over(TRAFFIC, " select seq, src_ip from traffic order by seq limit 2000"))
def preset_records(spark, sf):
    return V.traffic(spark, sf).select("seq", "src_ip").orderBy("seq").limit(2000)


@query("time_slice_report", over(TRAFFIC, """, b as (select min(ts_us) lo, max(ts_us) hi from traffic), s as (select seq, ts_us, least(7, cast(floor((ts_us - lo) / ((hi - lo) / 8.0)) as int)) part from traffic, b)
  select part, count(*) n, min(ts_us) first_us, max(ts_us) last_us from s group by 1"""))
def time_slice_report(spark, sf):
    """A recording cut into eight equal time slices, the last bound included."""
    from ..operators.dataprep import time_slices

    return time_slices(V.traffic(spark, sf), 8).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))

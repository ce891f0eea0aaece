"""Registered queries: name models scored from tables, and name rules with a model and a word table."""
from pyspark.sql import functions as F

from ..functions import text
from ..operators import portable
from ..operators.lexical_model import NUMBERS
from . import detect as D
from . import views as V
from .catalog import query, rounded
from .fixtures_sql import NAMES, over
from .q_scalars import CONS, ENT, RUN, VOWELS

LABEL = """case when length(t) <= 253 and regexp_full_match(t, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+') then string_split(t, '.')[1] else '' end"""
_on = lambda s: s.replace("{c}", "label")
NUMBER_SQL = {
    "log_length": "ln(1 + length(label))", "entropy": _on(ENT), "digit_ratio": "length(regexp_replace(label, '[^0-9]', '', 'g')) / greatest(1, length(label))", "vowel_ratio": _on(VOWELS),
    "hyphen_ratio": "length(regexp_replace(label, '[^-]', '', 'g')) / greatest(1, length(label))", "unique_ratio": "len(list_distinct(string_split(label, ''))) / greatest(1, length(label))",
    "consonant_run": _on(CONS), "digit_run": _on(RUN.replace("{p}", "[0-9]+")),
    "digit_transitions": "len(list_filter(range(1, length(label)), lambda i: regexp_matches(substr(label, i, 1), '[0-9]') <> regexp_matches(substr(label, i + 1, 1), '[0-9]'))) / greatest(1, length(label))",
    "repeat_ratio": "len(list_filter(range(1, length(label)), lambda i: substr(label, i, 1) = substr(label, i + 1, 1))) / greatest(1, length(label))"}
GRAMS = "unnest(list_concat(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)), list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))))"


def _model_sql(asked: str) -> str:
    """CTEs that fit the closed-form model on `names` and score the labels of the CTE `asked` as sc(label, logit, score)."""
    n = len(NUMBERS)
    mean = lambda j: f"(round(m_{NUMBERS[j]}, 6) + 3e-7)"
    weight = lambda j: f"((a_{NUMBERS[j]} - b_{NUMBERS[j]}) / sc_{NUMBERS[j]})"
    tree = lambda j: (f"0.5 * {weight(j)} * (case when {NUMBERS[j]} <= {mean(j)} then case when {NUMBERS[(j + 1) % n]} <= {mean((j + 1) % n)} then -1.0 else -0.5 end "
                      f"else case when logit <= 0 then 0.5 else 1.0 end end)")
    return f""", tr as (select seq, y, {LABEL} as label from (select seq, y, regexp_replace(lower(trim(name)), '[.]+$', '') t from names)), trn as (select * from tr where label <> ''),
  num as (select seq, y, {', '.join(f'{v} as {k}' for k, v in NUMBER_SQL.items())} from trn),
  st as (select count(*) cn, sum(y) c1, {', '.join(f"avg({f}) m_{f}, case when stddev_pop({f}) > 1e-9 then stddev_pop({f}) else 1.0 end sc_{f}, avg({f}) filter (y = 1) a_{f}, avg({f}) filter (y = 0) b_{f}" for f in NUMBERS)} from num),
  tg as (select seq, y, {GRAMS} as token from (select seq, y, concat('^', label, '$') s from trn)),
  tc as (select token, count(*) filter (y = 0) c0, count(*) filter (y = 1) c1, count(distinct seq) df from tg group by 1),
  tt as (select count(*) v, sum(c0) t0, sum(c1) t1 from tc),
  terms as (select token, ln((tc.c1 + 1.0) / (t1 + v)) - ln((tc.c0 + 1.0) / (t0 + v)) w, ln((1.0 + cn) / (1.0 + df)) + 1 idf from tc, tt, st),
  ask as (select distinct label from {asked} where label <> ''),
  ag as (select label, token, count(*) tf from (select label, {GRAMS} as token from (select label, concat('^', label, '$') s from ask)) group by 1, 2),
  ac as (select label, sum(w * (1 + ln(tf)) * idf) dot, sum(((1 + ln(tf)) * idf) ** 2) nrm from ag join terms using (token) group by 1),
  an as (select label, {', '.join(f'{v} as {k}' for k, v in NUMBER_SQL.items())} from ask),
  lg as (select an.*, st.*, ln(c1 / (cn - c1)) + case when nrm > 0 then dot / sqrt(nrm) else 0 end + {' + '.join(f"{weight(j)} * ({f} - m_{f}) / sc_{f}" for j, f in enumerate(NUMBERS))} as logit
    from an left join ac using (label), st),
  sc as (select label, logit, 1 / (1 + exp(-(0.1 + {' + '.join(tree(j) for j in range(n))}))) as score from lg)"""


def _named(spark, sf):
    return V.names(spark, sf).select("seq", text.domain_label("name").alias("label"), "y").filter("label <> ''")


@query("portable_scores", over(NAMES, _model_sql("trn") + " select seq, round(logit, 6) logit, round(score, 6) score from trn join sc using (label)"))
def portable_scores(spark, sf):
    """A model that is counted instead of solved, exported as tables and scored from them."""
    rows = _named(spark, sf)
    return rounded(portable.score(rows, portable.fit_counts(rows)).select("seq", "logit", "score"))


ASKED = """, q as (select seq, name from names union all select 5000000 + p_partkey, case p_partkey % 4 when 0 then concat(replace(p_name, ' ', ''), '.example') when 1 then concat(upper(replace(p_name, ' ', '-')), '.example.')
    when 2 then concat('xn--', replace(p_name, ' ', ''), '.example') else concat(replace(p_name, ' ', 'q'), '7.co.uk') end from part),
  ql as (select seq, name, t, string_split(t, '.') p, """ + LABEL + """ as label from (select *, regexp_replace(lower(trim(name)), '[.]+$', '') t from q)),
  rg as (select *, case when len(p) <= 2 then p[1] when length(p[-1]) = 2 and p[-2] in ('co','com','org','net','gov','edu','ac','or','ne','go') then p[-3] else p[-2] end rl from ql),
  wd as (select string_agg(w, '|') ws, list(w) l from (select distinct unnest(string_split(p_name, ' ')) w from part))"""


@query("model_name_hits", over(NAMES, ASKED + _model_sql("ql") + """ select seq, rg.label, round(score, 6) score from rg join sc on sc.label = rg.label, wd where score >= 0.4 and not starts_with(t, 'xn--')
  and not (regexp_full_match(rl, '[a-z-]+') and regexp_full_match(rl, concat('-*(', ws, ')+(-+(', ws, ')+)*-*')) and (contains(rl, '-') or not list_contains(l, rl)))"""))
def model_name_hits(spark, sf):
    """The generated-name class decided by the name model, with encodings and readable names (the words of part names) let off."""
    p = V.table(spark, sf, "part").selectExpr("5000000 + p_partkey as seq", """case p_partkey % 4 when 0 then concat(replace(p_name, ' ', ''), '.example') when 1 then concat(upper(replace(p_name, ' ', '-')), '.example.')
        when 2 then concat('xn--', replace(p_name, ' ', ''), '.example') else concat(replace(p_name, ' ', 'q'), '7.co.uk') end as dns_name""")
    rows = V.names(spark, sf).selectExpr("seq", "name as dns_name").unionByName(p).withColumn("dns_type", F.lit(1))
    words = V.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    th = D.Thresholds(name_model=portable.fit_counts(_named(spark, sf)), word_table=words, name_score=0.4)
    f = D.name_features(rows).join(D.name_decisions(rows, th), "dns_name", "left").withColumn("generated", D.generated_name(th))
    hit = f.filter(D.guard_conditions(th)["DGA_DOMAINS"])
    return rounded(hit.select("seq", text.domain_label("dns_name").alias("label"), F.col("_name_score").alias("score")))

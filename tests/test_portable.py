"""Name models as tables: the same scores as the fitted model, as plain SQL over the exported tables, and in the rules."""
import itertools
import random

import duckdb
from pyspark.sql import functions as F

from flowglass.functions import text
from flowglass.operators import lexical_model, portable, readable
from flowglass.plans import detect as D

DUCK = """
with recursive g as (select label, unnest(list_concat(list_transform(range(1, length(label) + 2), lambda i: substr('^' || label || '$', i, 2)), list_transform(range(1, length(label) + 1), lambda i: substr('^' || label || '$', i, 3)))) token from asked),
c as (select label, token, count(*) n from g group by all),
d as (select label, sum(weight * (1 + ln(n)) * idf) / sqrt(sum(((1 + ln(n)) * idf) ** 2)) dot from c join terms using (token) group by 1),
l as (select asked.label, x, intercept + coalesce(dot, 0) + (select sum(weight * (value - mean) / scale) from (select unnest(x) value, unnest(names) name) join numbers using (name)) logit from asked left join d using (label), settings),
w as (select label, tree, 0 node, [logit] || x as inp from l, (select distinct tree from nodes)
  union all select label, w.tree, case when inp[feature + 1] <= threshold then n."left" else n."right" end, inp from w join nodes n on n.tree = w.tree and n.node = w.node where n."left" >= 0)
select label, any_value(logit), 1 / (1 + exp(-any_value(link) * (any_value(boosted) + sum(value)))) from w join nodes n using (tree, node) join l using (label), settings where n."left" < 0 group by label
"""


def test_exported_weights_score_alike_everywhere(spark, tmp_path):
    rng = random.Random(1)
    vowels = ["".join(rng.choice(x) for x in itertools.islice(itertools.cycle(["bcdfglmnprst", "aeiou"]), rng.randrange(4, 14))) for _ in range(250)]
    noise = ["".join(rng.choice("0123456789abcdefxyz-") for _ in range(rng.randrange(8, 24))) for _ in range(250)]
    rows = spark.createDataFrame([(x, 0) for x in vowels] + [(x, 1) for x in noise], "label string, y int")
    train = lexical_model.weighted(lexical_model.prepare(rows))
    m = lexical_model.fit(train, trees=12, leaf=5)
    p = portable.export(m, spark)
    assert 1 <= p.depth() <= 3 and len(p.trees) == 12
    portable.save(p, str(tmp_path / "m"))
    again = portable.load(spark, str(tmp_path / "m"))
    asked = rows.unionByName(spark.createDataFrame([("unseen-zz9", 0), ("q", 1), ("aaaaaa", 0)], "label string, y int"))
    want = {r.label: (r.logit, r.score) for r in m.score(lexical_model.prepare(asked)).select("label", "logit", "score").collect()}
    got = {r.label: (r.logit, r.score) for r in portable.score(asked.unionByName(spark.createDataFrame([("", 0), (None, 1)], "label string, y int")), again).collect()}
    assert got.pop("") == (None, None) and got.pop(None) == (None, None)
    con = duckdb.connect()
    for t in ("terms", "numbers", "nodes", "settings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/m/{t}/*.parquet'")
    x = lexical_model.prepare(asked.select("label").distinct()).select("label", F.array(*lexical_model.NUMBERS).alias("x"), F.array(*[F.lit(n) for n in lexical_model.NUMBERS]).alias("names")).toPandas()  # noqa: F841
    con.register("frame", x)
    con.execute("create table asked as select * from frame")
    duck = {r[0]: r[1:] for r in con.execute(DUCK).fetchall()}
    assert set(want) == set(got) == set(duck)
    for k, v in want.items():
        assert max(abs(a - b) for a, b in zip(v, got[k])) < 1e-9 and max(abs(a - b) for a, b in zip(v, duck[k])) < 1e-9, k


def test_labels_made_of_words(spark):
    words = ["a", "click", "here", "now", "he", "rent", "the", "then", "Over", "x"]
    labels = ["clickherenow", "clickhere", "click", "now-here", "nowx", "a", "a-a", "he", "herent", "therent", "thenow", "overover", "OVER", "", "-", "click-", "here2now", "clickherenowz", "aa", "über", "the-x", None]
    rule = [w.lower() for w in words]

    def want(label):
        parts = [p for p in label.lower().split("-") if p]

        def splits(t):
            return not t or any(t[:i] in rule and splits(t[i:]) for i in range(2, len(t) + 1))

        return bool(parts) and all(p.isalpha() and splits(p) for p in parts) and (len(parts) >= 2 or label.lower() not in rule)

    df = spark.createDataFrame([(x,) for x in labels + labels[:3]], "label string")
    got = {r.label: r.readable for r in readable.readable_labels(df, spark.createDataFrame([(w,) for w in words * 2], "word string")).collect()}
    assert got == {x: want(x) for x in labels if x is not None}
    inline = df.filter("label is not null").select("label", text.is_readable("label", rule).alias("r"))
    assert {r.label: r.r for r in inline.collect()} == got
    assert not any(r.readable for r in readable.readable_labels(df, spark.createDataFrame([], "word string")).collect())


def test_the_model_takes_the_place_of_the_rule(spark):
    names = [(1, "kqzxvjwpqzkxjvqw.example", 1), (2, "clickherenow.example", 1), (3, "xn--kqzxvjwpqzkx.example", 1), (4, None, 1), (5, "bad..name", 1), (6, "www.kqzxvjwpqzkxjvqw.example", 1)]
    rows = spark.createDataFrame(names, "seq long, dns_name string, dns_type int")
    terms = spark.createDataFrame([("kq", 3.0, 1.0), ("cl", 3.0, 1.0), ("n-", 3.0, 1.0)], "token string, weight double, idf double")
    model = portable.Portable(terms, [(n, 0.0, 0.0, 1.0) for n in lexical_model.NUMBERS], -1.0)
    words = spark.createDataFrame([("click",), ("here",), ("now",)], "word string")
    hits = {}
    for name, th in {"model": D.Thresholds(name_model=model, word_table=words), "bare": D.Thresholds(name_model=model)}.items():
        f = D.name_features(rows).join(D.name_decisions(rows, th), "dns_name", "left").withColumn("generated", D.generated_name(th))
        hits[name] = sorted(r.seq for r in f.filter(D.guard_conditions(th)["DGA_DOMAINS"]).collect())
    assert hits == {"model": [1], "bare": [1, 2]}


def test_the_whole_path_takes_model_and_words(spark):
    from helpers import event, frame

    names = ["kqzxvjwpqzkxjvqw.example", "clickherenow.example", "plain.example", None]
    rows = [event(i, 1000 * i, dns_name=n, dst_port=53, protocol=17) for i, n in enumerate(names)]
    terms = spark.createDataFrame([("kq", 3.0, 1.0), ("cl", 3.0, 1.0)], "token string, weight double, idf double")
    th = D.Thresholds(name_model=portable.Portable(terms, [(n, 0.0, 0.0, 1.0) for n in lexical_model.NUMBERS], -1.0), word_table=spark.createDataFrame([("click",), ("here",), ("now",)], "word string"))
    found = [(r.seq, r.threat_class, r.detector, round(r.score, 3)) for r in D.hits(D.all_features(frame(spark, rows), th), th).select("seq", "threat_class", "detector", "score").collect()]
    assert found == [(0, "DGA_DOMAINS", "ML", 0.881)]

from pyspark.sql import functions as F

from flowglass.operators import lexical_model
from flowglass.plans import q_models

SF = "/root/testdata/sf0.001"


def test_registered_fits_take_every_gram_and_100_trees(spark, monkeypatch):
    seen, models = [], []
    fit_base, fit = lexical_model.fit_base, lexical_model.fit

    def base(rows, *a, **k):
        m = fit_base(rows, *a, **k)
        seen.append((set(m.terms.stages[0].vocabulary), {r[0] for r in rows.select(F.explode("tokens")).distinct().collect()}))
        return m

    monkeypatch.setattr(lexical_model, "fit_base", base)
    monkeypatch.setattr(lexical_model, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    assert q_models.lexical_classifier(spark, SF).count() > 0 and q_models.out_of_fold_logits(spark, SF).count() > 0
    assert len(seen) == 4 and all(have == grams for have, grams in seen)
    assert models[0].trees.getNumTrees == 100 and all(t.depth <= 3 for t in models[0].trees.trees)


def test_rare_and_many_grams_stay_terms(spark):
    rows = spark.range(25_000).selectExpr("id as seq", "lower(conv(cast(shiftrightunsigned(xxhash64(id), 1) as string), 10, 36)) as label", "cast(id % 2 as int) as y")
    rows = lexical_model.balanced(lexical_model.prepare(rows))
    n = rows.select(F.explode("tokens").alias("t")).select("t").distinct().count()
    m = lexical_model.fit_base(rows, max_iter=2, converge=False)
    assert len(m.terms.stages[0].vocabulary) == n > 40_000


def test_a_fit_without_convergence_is_refused(spark):
    import pytest

    rows = lexical_model.balanced(lexical_model.prepare(spark.range(200).selectExpr("sha2(cast(id as string), 256) as label", "cast(id % 2 as int) as y")))
    with pytest.raises(ValueError, match="converge"):
        lexical_model.fit_base(rows, max_iter=2)

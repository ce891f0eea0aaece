"""Character n-gram classifier: TF-IDF plus composition numbers, logistic regression, then boosted trees.

Every distinct gram of the training rows is a term, however rare.  Numbers differ from other libraries' solvers; the model
shape is the same."""
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alerts, numbers, text
from ..sources.wire import stage

NUMBERS = ["log_length", "entropy", "digit_ratio", "vowel_ratio", "hyphen_ratio", "unique_ratio", "consonant_run", "digit_run", "digit_transitions", "repeat_ratio"]
ALL_TERMS = 2**31 - 1  # the vectorizer takes the distinct grams it counts where they are fewer


@F.udf(VectorUDT())
def damped(v):
    """Counts to 1 + ln(count)."""
    import math

    return SparseVector(v.size, v.indices, [1.0 + math.log(x) for x in v.values])


def prepare(rows: DataFrame, label="label") -> DataFrame:
    wrapped = F.concat(F.lit("^"), F.col(label), F.lit("$"))
    r = stage(rows, {"_w": wrapped})
    return stage(r, {"tokens": F.concat(text.ngrams("_w", 2), text.ngrams("_w", 3)), **text.lexical_features(label)}).drop("_w")


def balanced(rows: DataFrame, y="y", extra=None) -> DataFrame:
    """Adds `weight`: inverse class share, times an optional shape weight."""
    n = {r[y]: r["count"] for r in rows.groupBy(y).count().collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for k, c in n.items():
        w = F.when(F.col(y) == k, total / (len(n) * c)).otherwise(w)
    return rows.withColumn("weight", w * extra if extra is not None else w)


class LexicalModel:
    def __init__(self, terms: PipelineModel, vectors: PipelineModel, base, trees):
        self.terms, self.vectors, self.base, self.trees = terms, vectors, base, trees

    def logits(self, rows: DataFrame) -> DataFrame:
        r = self.vectors.transform(self.terms.transform(rows).withColumn("damped", damped("counts")))
        return self.base.transform(r).withColumn("logit", vector_to_array("rawPrediction")[1])

    def score(self, rows: DataFrame) -> DataFrame:
        keep = rows.columns
        r = self.logits(rows).select(*keep, "logit")
        r = VectorAssembler(inputCols=["logit", *NUMBERS], outputCol="tree_in").transform(r)
        r = self.trees.transform(r).withColumn("score", vector_to_array("probability")[1])
        return r.select(*keep, "logit", "score")


def fit_base(rows: DataFrame, vocab=ALL_TERMS, max_iter=300, converge=True) -> LexicalModel:
    """Terms and the linear model; with `converge` a fit that needs all its iterations is refused."""
    terms = Pipeline(stages=[CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocab, minDF=1.0)]).fit(rows)
    seen = terms.transform(rows).withColumn("damped", damped("counts"))
    vectors = Pipeline(stages=[IDF(inputCol="damped", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="normed"),
                               VectorAssembler(inputCols=NUMBERS, outputCol="raw_numbers"), StandardScaler(inputCol="raw_numbers", outputCol="scaled", withMean=True),
                               VectorAssembler(inputCols=["normed", "scaled"], outputCol="features")]).fit(seen)
    base = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=max_iter, regParam=0.01).fit(vectors.transform(seen))
    if converge and base.summary.totalIterations >= max_iter:
        raise ValueError(f"the linear model did not converge in {max_iter} iterations")
    return LexicalModel(terms, vectors, base, None)


def fit(rows: DataFrame, trees=100, depth=3, rate=0.08, vocab=ALL_TERMS, logits: DataFrame | None = None, leaf=1000) -> LexicalModel:
    """Fits the base model and the trees over (logit, numbers); `logits` replaces in-sample logits by out-of-fold ones, `leaf` is the least number of rows in a leaf."""
    m = fit_base(rows, vocab)
    r = (logits if logits is not None else m.logits(rows)).select("y", "weight", "logit", *NUMBERS)
    r = VectorAssembler(inputCols=["logit", *NUMBERS], outputCol="tree_in").transform(r)
    m.trees = GBTClassifier(featuresCol="tree_in", labelCol="y", weightCol="weight", maxDepth=depth, maxIter=trees, stepSize=rate, minInstancesPerNode=leaf, seed=7).fit(r)
    return m


def out_of_fold(rows: DataFrame, group: str, folds=3, vocab=ALL_TERMS) -> DataFrame:
    """Every row scored by a base model that never saw its group."""
    r = rows.withColumn("fold", numbers.hash_bucket(group, folds, "fold:"))
    parts = [fit_base(r.filter(F.col("fold") != k), vocab).logits(r.filter(F.col("fold") == k)).select(*r.columns, "logit") for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted(rows: DataFrame) -> DataFrame:
    return balanced(rows, extra=alerts.training_weight("label", "y"))

"""Column functions over numbers, arrays and hashes."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def xlog2x(c) -> Column:
    c = col(c)
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def array_mean(a) -> Column:
    a = col(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_std(a, mean) -> Column:
    a = col(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))


def array_cv(a) -> Column:
    """Population std over mean; fewer than two values give 0; the mean is floored at 1e-9."""
    a = col(a)
    m = array_mean(a)
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(array_std(a, m) / F.greatest(m, F.lit(1e-9)))


def moment_cv(n, s1, s2, floor=1e-9) -> Column:
    """The same statistic from count, sum and sum of squares."""
    m = s1 / n
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), s2 / n - m * m)) / F.greatest(m, F.lit(floor)))


def gaps_seconds(times_us) -> Column:
    """Consecutive differences of a time array, in seconds."""
    t = col(times_us)
    n = F.size(t)
    return F.when(n >= 2, F.zip_with(F.slice(t, 2, F.greatest(n - 1, F.lit(1))), F.slice(t, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: (b - a) / 1e6)).otherwise(
        F.array().cast("array<double>"))


def hash_bucket(value, modulus: int, namespace="") -> Column:
    """First 32 bits of sha256(namespace + value) modulo `modulus`."""
    digest = F.sha2(F.concat(F.lit(namespace), col(value).cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(modulus))


def family_split(bucket) -> Column:
    """Ten buckets: 0-5 train, 6-7 validation, 8-9 test."""
    b = col(bucket)
    return F.when(b < 6, "train").when(b < 8, "validation").otherwise("test")


def logistic(d) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), col(d)))))


def log_vector(*cols) -> Column:
    return F.array(*[F.log1p(F.greatest(F.lit(0.0), col(c).cast("double"))) for c in cols])


def record_digest(*fields, order="seq") -> Column:
    """Aggregate: order-stable sha256 of the records of a group (small groups such as one scenario)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return F.sha2(F.to_json(rows), 256)

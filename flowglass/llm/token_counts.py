"""Exact length histogram: documents per encoded length, and what it answers for every context limit.

The histogram has one row per distinct length, so its size follows the longest text, not the number of documents.
Sums over it are taken in two steps (inside blocks of lengths, then over the blocks), so no task reads it whole.

Null and empty texts have length 0 and count as documents.  Repeated rows each count.  An empty table gives an empty
histogram, `quantile` then gives None and the totals 0.  Only the text column is read, so other columns may have any name."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.catalog import query
from ..plans.views import table
from .store import written
from .tokens import count_column

BLOCK = 1024


def histogram(docs: DataFrame, vocabulary: str | None = None, column: str = "text") -> DataFrame:
    """length, n_docs: documents whose text has exactly that many ids; partial counts precede the shuffle."""
    return count_column(docs, vocabulary, column).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds to every length, for any limit c with previous length < c <= length:

    docs_at_least and tokens_at_least (documents that long or longer), docs_below and tokens_below,
    truncated_total = tokens_below + length * docs_at_least (all texts cut to this length), lost_tokens,
    quantile = share of documents not longer.  For a limit c between two lengths the same sums hold:
    tokens_below + c * docs_at_least."""
    h = hist.select("length", "n_docs", F.floor(F.col("length") / BLOCK).alias("_block"), (F.col("length") * F.col("n_docs")).alias("_tokens"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_n"), F.sum("_tokens").alias("_t"))
    up = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("_block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c + "_before") for c in ("_n", "_t")],
                           *[F.sum(c).over(every).alias(c + "_all") for c in ("_n", "_t")])
    inside = W.partitionBy("_block").orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    j = h.join(blocks, "_block")
    below = lambda c, b: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(b)
    j = j.withColumns({"docs_below": below("n_docs", "_n_before"), "tokens_below": below("_tokens", "_t_before")})
    j = j.withColumns({"docs_at_least": F.col("_n_all") - F.col("docs_below"), "tokens_at_least": F.col("_t_all") - F.col("tokens_below")})
    return j.select("length", "n_docs", "docs_below", "tokens_below", "docs_at_least", "tokens_at_least",
                    (F.col("tokens_below") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
                    (F.col("tokens_at_least") - F.col("length") * F.col("docs_at_least")).alias("lost_tokens"),
                    ((F.col("docs_below") + F.col("n_docs")) / F.col("_n_all")).alias("quantile"))


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Ids left when every text is cut to `limit` ids."""
    return hist.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs"))).first()[0] or 0


def quantile(sums: DataFrame, q: float):
    """Smallest length that at least a share `q` of the documents does not exceed."""
    return sums.filter(F.col("quantile") >= q - 1e-12).agg(F.min("length")).first()[0]


@query("op7_token_counts")
def op7_token_counts(spark, sf):
    return suffix_sums(written(histogram(table(spark, sf, "documents")), "lengths"))

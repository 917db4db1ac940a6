"""Exact token-length histogram with suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of one window task; the totals of the spans meet in one place.
SPAN = 4096


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens, docs: documents of each encoded length, 0 included. Map-side sums leave one row a length and task."""
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_table(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: docs, docs_over and tokens_over of longer documents, docs_upto and tokens_upto
    of those up to L, tokens_at_limit = tokens if every document is cut to L, quantile = the share up to L.

    A window runs within a span of lengths; spans are joined by their own running totals, whose number is the
    longest document's tokens / SPAN. So no task reads more than that or SPAN rows. An empty table gives no rows.
    """
    h = hist.withColumn("__span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    spans = h.groupBy("__span").agg(F.sum("docs").alias("__d"), F.sum("tokens").alias("__t"))
    later = Window.orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select("__span", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("__d", "__t")], *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("__d", "__t")])
    own = Window.partitionBy("__span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"__{c}_after") for c in ("docs", "tokens")]).join(spans, "__span")
    h = h.withColumn("docs_over", F.col("__d_later") + F.col("__docs_after")).withColumn("tokens_over", F.col("__t_later") + F.col("__tokens_after"))
    h = h.withColumn("docs_upto", F.col("__d_all") - F.col("docs_over")).withColumn("tokens_upto", F.col("__t_all") - F.col("tokens_over"))
    h = h.withColumn("tokens_at_limit", F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_over"))
    return h.select("n_tokens", "docs", "docs_over", "tokens_over", "docs_upto", "tokens_upto", "tokens_at_limit", (F.col("docs_upto") / F.col("__d_all")).alias("quantile"))


def truncated_total(suffix: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to the limit: any limit, whether or not a document has that length."""
    below = suffix.where(F.col("n_tokens") <= limit).agg(F.sum(F.col("n_tokens") * F.col("docs"))).first()[0] or 0
    over = suffix.where(F.col("n_tokens") > limit).agg(F.sum("docs")).first()[0] or 0
    return int(below + limit * over)


def quantile(suffix: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed; None for an empty table."""
    return suffix.where(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]

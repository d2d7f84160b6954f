"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length (map-side first, so a length that a third of all documents
share is no hot key), and sums over the histogram answer every question about a context limit. With T
tokens in all there are at most sqrt(2 T) distinct lengths, which one task can order at any size.

Edge cases: null and empty texts have length 0; texts of any length are encoded whole; repeated rows
count as often as they occur; an empty table gives an empty histogram, no quantiles and zero totals;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bpe


def length_histogram(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``n_tokens`` and ``docs``, one row a distinct length."""
    return bpe.token_lengths(docs, path, text=text).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens of at least that length, the tokens
    left when all documents are truncated to it, the tokens lost, and the share of documents that
    are no longer than it (whose inverse are the quantiles)."""
    tail = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("docs")
    sums = histogram.select(
        "n_tokens",
        "docs",
        F.sum("docs").over(tail).alias("docs_at_least"),
        F.sum(tokens).over(tail).alias("tokens_at_least"),
        F.sum("docs").over(every).alias("all_docs"),
        F.sum(tokens).over(every).alias("all_tokens"),
    )
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return sums.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least", "all_docs", "all_tokens",
        kept.alias("truncated_tokens"),
        (F.col("all_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens that are left when documents are truncated, and documents cut, for any limits."""
    each = [F.struct(F.lit(n).cast("long").alias("context_limit"), F.coalesce(F.sum(F.least("n_tokens", F.lit(n)) * F.col("docs")), F.lit(0)).alias("truncated_tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > n, F.col("docs"))), F.lit(0)).alias("docs_cut")) for n in limits]
    return histogram.agg(F.array(*each).alias("each")).select(F.inline("each"))


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of documents does not exceed."""
    each = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*each).alias("each")).select(F.inline("each")).filter("n_tokens is not null")

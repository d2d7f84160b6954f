"""Checks of an archive against the URLs that it should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import whatwg_url


def counters(records: DataFrame) -> DataFrame:
    """One row: records, those without headers, without content, and with a URL that does not parse."""
    return records.agg(
        F.count("*").alias("records"),
        F.count_if(F.coalesce(F.size("headers"), F.lit(0)) <= 0).alias("no_headers"),
        F.count_if(F.coalesce("content", F.lit("")) == "").alias("no_content"),
        F.count_if(whatwg_url("url").isNull()).alias("invalid_urls"),
    )


def missing(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Expected URLs that no record has, both normalised."""
    want = expected.select(whatwg_url("url").alias("url")).filter("url is not null").distinct()
    return want.join(records.select(whatwg_url("url").alias("url")).distinct(), "url", "left_anti")


def report(expected: DataFrame, records: DataFrame) -> DataFrame:
    """The counters, the number of missing URLs, and whether the archive is valid."""
    gone = missing(expected, records).agg(F.count("*").alias("missing"))
    both = counters(records).join(F.broadcast(gone))  # two single rows
    return both.withColumn("valid", (F.col("invalid_urls") == 0) & (F.col("no_headers") == 0) & (F.col("no_content") == 0) & (F.col("missing") == 0))

"""Parsed archives: gzip files of one document a line, as RON or JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftline.schemas import PARSED
from weftline.sources import ron

#: Links are not written.
WRITTEN = StructType([f for f in PARSED.fields if f.name != "links"])


def format_of(path: str) -> str:
    """"json" where the file name says so, else "ron"."""
    return "json" if ".jsonl.gz" in path.rsplit("/", 1)[-1] else "ron"


@F.pandas_udf(StructType([*WRITTEN.fields, StructField("corrupt", WRITTEN.fields[0].dataType)]))
def from_ron(lines: pd.Series) -> pd.DataFrame:
    out = []
    for line in lines:
        try:
            d = ron.loads(line)
            out.append((d.get("canonical_url"), d["content"], d["content_hash"], d["description"], dict(d.get("meta") or {}), d.get("title"), None))
        except (ron.RonError, KeyError, TypeError, AttributeError, ValueError):
            out.append((None, None, None, None, None, None, line))
    return pd.DataFrame(out, columns=[*WRITTEN.names, "corrupt"])


@F.pandas_udf(WRITTEN.fields[0].dataType)
def to_ron(rows: pd.DataFrame) -> pd.Series:
    def one(r) -> str:
        def maybe(x):
            return ron.Some(x) if x is not None else None

        return ron.dumps({"canonical_url": maybe(r["canonical_url"]), "content": r["content"], "content_hash": r["content_hash"], "description": r["description"], "meta": ron.Map(r["meta"] or {}), "title": maybe(r["title"])})

    return pd.Series([one(r) for r in rows.to_dict("records")], dtype=object)


def write_parsed(docs: DataFrame, path: str, format: str = "ron") -> None:
    """One gzip line a document."""
    rows = docs.select(*WRITTEN.names)
    if format == "json":
        rows.write.mode("overwrite").option("compression", "gzip").json(path)
    else:
        rows.select(to_ron(F.struct(*WRITTEN.names)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_parsed(spark: SparkSession, path: str, *, format: str | None = None, stop_at_first_error: bool = False) -> DataFrame:
    """Documents of a parsed archive. Damaged lines are dropped, or end the file that holds them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    if (format or format_of(path)) == "json":
        schema = StructType([*WRITTEN.fields, StructField("corrupt", WRITTEN.fields[0].dataType)])
        rows = lines.select("file", "line", F.from_json("value", schema, {"columnNameOfCorruptRecord": "corrupt"}).alias("d"))
    else:
        rows = lines.select("file", "line", from_ron("value").alias("d"))
    if stop_at_first_error:
        bad = rows.filter("d.corrupt is not null").groupBy("file").agg(F.min("line").alias("end"))
        rows = rows.join(bad, "file", "left").filter("end is null or line < end")
    return rows.filter("d.corrupt is null").select(*(f"d.{n}" for n in WRITTEN.names))

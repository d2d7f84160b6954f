"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.

Edge cases are those of the operators; in short: null texts count as empty, rows with a null id go
through every stage (they are never linked to others), repeated rows are copies and one stays, rows
with one id and different texts are documents of their own, texts of any length count whole, an empty
table gives no rows, and further columns are carried along up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import dedup, jaccard, linear, pack, secrets
from weftline.llm.registry import tokenizer_path
from weftline.session import shared_dir

#: Scores from which documents pass.
QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return linear.passing(docs, linear.fit(docs, labels, "quality", *linear.QUALITY), QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies. Where ids repeat, each row is
    a document, and of rows with the smallest id one stays."""
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = jaccard.jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # docs is a written table, so its rows have the same numbers whenever they are read
    number = F.struct("doc_id", F.monotonically_increasing_id().alias("row"))
    rows = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), number))
    gone = jaccard.jaccard_components(rows, key="__row").filter("__row <> component_id").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked and ``n_chars`` follows the text."""
    found = secrets.masked(secrets.with_spans(docs))
    changed = F.size("secret_spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 4096 tokens."""
    return pack.best_fit_pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", packed),
]

#: SQL cannot tokenize, so the result is compared with a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; tables between them lie in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        # packing has cut its result off, so the tables between are no longer needed
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

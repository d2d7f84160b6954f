"""Exact dedup: groups by a 128-bit content hash, checked byte by byte.

1. Each row is reduced to its id, length and hashes; this slim table is cut off in the shared folder.
2. Rows are grouped by hash, map-side first, so a text that a third of all rows share is no hot key.
3. Only texts whose hash occurs again are moved. Within each hash they are compared by their smallest
   and largest text, which is one comparison of all bytes and can be taken part by part: groups are
   salted by their size first, with what each input partition holds of them, so that rows that are
   alike in id and text are split too. Where the two differ, different texts have one hash, and the
   groups of that hash are told apart by the texts themselves.
4. The slim rows are joined with the groups of more than one row; Spark splits hot keys of that join.

Texts are equal when equal after deleting blanks. Of equal texts the row with the most code points
stays, then the smallest id.

Edge cases: a null text counts as empty, and all empty texts form a group; a null id comes after all
others; of repeated rows one stays (where they differ in other columns, the one with the smallest hash
of all its columns); texts of any length count whole; an empty table gives no rows; other columns are
never read but for that choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, prepare

#: What is deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of a group whose texts one task compares.
SALT_ROWS = 200


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def content_hash(content: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(content))


def collisions(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes under which the bytes are not all the same. texts: hash, content, row_key and place, the
    number of the row's input partition (a partition has the same rows if it is run again); groups: hash, n."""
    members = texts.join(groups.hint("shuffle_hash"), "hash")
    salt = F.pmod(F.xxhash64("row_key", "place"), F.ceil(F.col("n") / SALT_ROWS))
    dealt = members.withColumn("salt", salt).repartition("hash", "salt")
    parts = dealt.groupBy("hash", "salt").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    whole = parts.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.filter("low <> high").select("hash")


def exact_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", hasher=content_hash) -> DataFrame:
    """One row a document: the key, keep_id, group_size, kept, text_sha256 and chars."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("row_key"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"), normalised(text).alias("content"))
    rows = rows.withColumn("hash", hasher(F.col("content")))
    slim = cut(rows.select("row_key", "chars", "hash", F.sha2("content", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    best = F.min(F.struct(-F.col("chars"), F.col("row_key").isNull(), F.col("row_key").alias("keep_id"), F.col("row").alias("keep_row"))).alias("best")

    def grouped(by: list[str], table: DataFrame) -> DataFrame:
        found = table.groupBy(*by).agg(F.count("*").alias("n"), best).filter("n > 1")
        return cut(found.select(*by, "n", "best.keep_id", "best.keep_row"))

    groups = grouped(["hash"], slim)
    by = ["hash"]
    clashing = cut(collisions(rows.select("hash", "content", "row_key", F.spark_partition_id().alias("place")), groups.select("hash", "n")))
    if not clashing.isEmpty():  # tell the texts of one hash apart by their bytes
        marked = rows.join(clashing.withColumn("clash", F.lit(True)), "hash", "left")
        slim = cut(marked.select("row_key", "chars", "hash", F.sha2("content", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"), F.when(F.col("clash"), F.col("content")).otherwise("").alias("apart")))
        by = ["hash", "apart"]
        groups = grouped(by, slim)
    joined = slim.join(groups, by, "left")
    return joined.select(
        F.col("row_key").alias(key),
        F.when(F.col("n").isNull(), F.col("row_key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        "chars",
    )


def kept_rows(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay. Only ids are joined where they tell rows
    apart; else one row is chosen of those with the id, text and length of a row that stays."""
    found = cut(exact_dedup(docs, text=text, key=key))
    if found.groupBy(key).count().filter("count > 1").isEmpty():
        gone = found.filter("not kept").select(F.col(key).alias("__gone"))
        return docs.join(gone, docs[key].eqNullSafe(gone["__gone"]), "left_anti")
    # one row of each id, text and length stays at most
    stay = found.filter("kept").select(F.col(key).alias("__key"), F.col("text_sha256").alias("__sha"), F.col("chars").alias("__chars"))
    marked = docs.withColumn("__own_sha", F.sha2(normalised(text), 256)).withColumn("__own_chars", F.length(F.coalesce(F.col(text), F.lit(""))))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own_sha") == F.col("__sha")) & (F.col("__own_chars") == F.col("__chars"))
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    least = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(*hashed), F.col(text))).alias("__row")
    return marked.join(stay, same).groupBy("__key", "__sha", "__chars").agg(least).select("__row.*")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256, chars
FROM t WINDOW w AS (PARTITION BY content ORDER BY chars DESC, doc_id)
"""

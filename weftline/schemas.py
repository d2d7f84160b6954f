"""Schemas of the entities."""

from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
#: A fetched page. Headers keep their order and repeats, so they are no map.
RECORD = T.StructType([T.StructField("status", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("headers", HEADERS), T.StructField("content", T.StringType())])
#: An extracted document; links are not written to archives.
PARSED = T.StructType(
    [
        T.StructField("canonical_url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("title", T.StringType()),
    ]
)
SITE = "origin string, domain string, feeds array<struct<title:string,feed_type:string,url:string>>, robots_txt string, sitemaps array<string>"

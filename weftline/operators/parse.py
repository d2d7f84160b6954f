"""HTML pages to extracted documents: one Arrow pass that derives all fields from one parse."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions import html
from weftline.functions.text import blake2s_hex
from weftline.schemas import PARSED
from weftline.session import prepare


def _extracted(url: str | None, text: str | None, **how) -> tuple[html.Page, str | None]:
    """The page, or an empty one and what went wrong: one page must not end a job."""
    try:
        return html.extract(url, text, **how), None
    except Exception as e:
        return html.Page(url, "", blake2s_hex(""), "", []), f"{type(e).__name__}: {e}"[:200]


def parse_pages(pages: DataFrame, *, url: str = "url", content: str = "html", keep: tuple[str, ...] = (), errors: str | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns and the fields of the extracted document, a row a page, in place; with
    ``errors``, a column of that name tells why a page could not be read (else null). Character
    references are those of the HTML standard, or only those of ``names`` (as of ``html.extract``)."""
    prepare(pages.sparkSession)
    rows = pages.select(*keep, F.col(url).alias("__url"), F.col(content).alias("__html"))
    schema = StructType([*rows.schema.fields[: len(keep)], *PARSED.fields, *([StructField(errors, StringType())] if errors else [])])
    arrow = to_arrow_schema(PARSED)
    how = {} if names is None else {"names": names}

    def work(batches):
        for batch in batches:
            both = [_extracted(u, h, **how) for u, h in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)]
            found = [p for p, _ in both]
            columns = [pa.array([list(p.meta.items()) if f.name == "meta" else getattr(p, f.name) for p in found], f.type) for f in arrow]
            if errors:
                columns.append(pa.array([e for _, e in both], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return rows.mapInArrow(work, schema)


def split_body(body):
    """Header lines and content of an archived HTTP message, as built-in functions.

    Lines are trimmed; before the first blank line, lines with a colon are headers and others are
    dropped; after it, non-blank lines are joined without a separator (so line ends are lost).
    """
    from weftline.functions.text import unicode_trim

    lines = F.transform(F.split(F.regexp_replace(body, r"\r?\n$", ""), r"\r?\n"), unicode_trim)
    blank = F.coalesce(F.array_position(lines, ""), F.lit(0)).cast("int")
    top = F.when(blank > 0, F.slice(lines, F.lit(1), F.greatest(blank - 1, F.lit(0)))).otherwise(lines)
    rest = F.when(blank > 0, F.slice(lines, F.greatest(blank, F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))
    colons = F.filter(top, lambda line: line.contains(":"))
    headers = F.transform(
        colons,
        lambda line: F.struct(
            unicode_trim(F.substring_index(line, ":", 1)).alias("name"),
            unicode_trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
        ),
    )
    return F.struct(headers.alias("headers"), F.array_join(F.filter(rest, lambda line: line != ""), "").alias("content"))


def build_body(headers, content):
    """The HTTP message that is archived: a constant status line, the headers, a blank line, the content."""
    lines = F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\n")))
    return F.concat(F.lit("HTTP/1.1 200 OK\n"), F.array_join(lines, ""), F.lit("\n"), content)

"""Text functions: trimming as Unicode defines white space, word limits and hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The letters of Unicode's White_Space property, for ``str.strip``.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE) + "]"


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_CLASS}+|{_CLASS}+$", "")


def first_words(text: Column, n: int = 256) -> Column:
    """The first n parts between single blanks; empty parts count."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def blake2s_hex(text: str) -> str:
    return hashlib.blake2s(text.encode("utf-8", "surrogatepass"), digest_size=32).hexdigest()


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    return text.map(blake2s_hex, na_action="ignore")


def gunzip_text(data: bytes) -> str | None:
    """UTF-8 text of gzip data, None where either is damaged."""
    import gzip
    import zlib

    try:
        return gzip.decompress(data).decode("utf-8")
    except (OSError, EOFError, UnicodeDecodeError, zlib.error):
        return None


def compression(before: Column, after: Column) -> Column:
    """Per cent of ``before`` bytes that are saved; 0 of none."""
    return F.when(before > 0, 100 * (before - after) / before).otherwise(F.lit(0.0))

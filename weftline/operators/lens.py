"""Lenses: rule files that name domains, URL prefixes and URL rules, as column predicates.

How names become patterns is our own reading: a domain ``d`` allows ``d`` and ``www.d`` on http and
https, a URL allows what begins with it, and a URL that ends in ``$`` allows itself alone. Skip rules
are wildcard patterns. Look-around and back-references are refused, so that all regex dialects agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources import ron


@dataclass
class Lens:
    name: str
    version: str = "1"
    author: str = ""
    description: str | None = None
    domains: list[str] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    skips: list[str] = field(default_factory=list)
    sanitise: list[tuple[str, bool]] = field(default_factory=list)

    def allowed(self) -> list[str]:
        found = [rf"^https?://(www\.)?{re.escape(d)}(/.*)?$" for d in self.domains]
        return found + ["^" + re.escape(u.rstrip("$")) + ("$" if u.endswith("$") else "") for u in self.urls]

    def skipped(self) -> list[str]:
        return ["^" + ".*".join(map(re.escape, s.split("*"))) + "$" for s in self.skips]

    def seeds(self) -> list[str]:
        return [f"http://{d}/" for d in self.domains] + [u.rstrip("$") for u in self.urls]

    def prefixes(self) -> list[str]:
        return [u for u in self.urls if not u.endswith("$")]


def load(text: str) -> Lens:
    """A lens from its file's text."""
    data = ron.loads(text)
    known = {f: data[f] for f in Lens.__dataclass_fields__ if f in data}
    return Lens(**known)


def read(path: str, fetch=None) -> Lens:
    """A lens from a local file, or by ``fetch(url) -> text`` where the path begins with http."""
    if path.startswith("http"):
        if fetch is None:
            raise ValueError("a lens on the network needs a transport")
        return load(fetch(path))
    with open(path, encoding="utf-8") as f:
        return load(f.read())


def dump(lens: Lens) -> str:
    fields = {"version": lens.version, "name": lens.name, "author": lens.author, "description": ron.Some(lens.description) if lens.description is not None else None, "domains": lens.domains, "urls": lens.urls}
    return ron.dumps(fields)


def checked(patterns: list[str]) -> list[str]:
    for p in patterns:
        if re.search(r"\(\?[=!<]|\\[1-9]", p):
            raise ValueError(f"look-around and back-references are not allowed: {p}")
        re.compile(p)
    return patterns


def matches_any(url: Column, patterns: list[str]) -> Column:
    """Unanchored match with any pattern; no pattern matches nothing. One alternation, one pass."""
    if not patterns:
        return F.lit(False)
    return url.rlike("|".join(f"(?:{p})" for p in checked(patterns)))


def allow_deny(url: Column, allowed: list[str], skipped: list[str]) -> Column:
    return matches_any(url, allowed) & ~matches_any(url, skipped)


def seed_rows(urls: DataFrame, url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """seed and exact: a URL that ends in ``$`` is a seed itself and is not searched for more."""
    return urls.select(*keep, F.regexp_replace(url, r"\$+$", "").alias("seed"), F.col(url).endswith("$").alias("exact"))


def thin_prefixes(found: DataFrame, prefixes: DataFrame, least: int = 1, url: str = "url") -> DataFrame:
    """Prefixes (column prefix) that at most ``least`` found URLs begin with.

    Both sides are cut at the length of each distinct prefix length, so the join is on equal keys and
    its sides are grouped before: no prefix is compared with every URL.
    """
    sizes = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    if not sizes:
        return prefixes.select("prefix", F.lit(0).cast("long").alias("n"))
    heads = found.select(F.explode(F.array(*(F.when(F.length(url) >= n, F.substring(url, 1, n)) for n in sizes))).alias("prefix")).filter("prefix is not null")
    counts = heads.groupBy("prefix").agg(F.count("*").alias("n"))
    return prefixes.select("prefix").distinct().join(counts, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") <= least)

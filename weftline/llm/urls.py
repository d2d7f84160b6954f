"""URL filters: glob rules packed into multiword Shift-And masks.

Every glob is a chain of states, one bit each; all globs stand side by side in one row of 64-bit words.
For a letter c the next states are ``(states << 1) & STEP[c] | states & STAY[c]``: a step to the next
element, or a stay where a wildcard allows c. One row a URL, one vectorised step a letter, whatever the
number of globs. ``*`` stands for any letters but ``/`` and ``**`` for any letters.

The canonical URL is the host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z
lower-cased) and the path (up to ``?``, ``#`` or the end).

Edge cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict;
empty and very long URLs are simulated whole (a letter at a time, only the URLs that still have one);
repeated rows are judged alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.session import prepare

ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
HOST = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and the start of a path; the longest rule that fits wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = HOST.match(url, at + 3)
    return host[0].translate(ASCII_LOWER), PATH.match(url, host.end())[0]


class Automaton:
    """All globs of a rule list as one bit-parallel automaton over UTF-8 bytes."""

    def __init__(self, globs: list[tuple[str, int]]) -> None:
        """globs: pattern and priority; of several that match, the highest priority counts."""
        bits: list[tuple[int | None, bool, bool, int]] = []  # byte, stays inside a label path, stays always, priority
        for glob, priority in globs:
            bits.append((None, False, False, -1))
            first = len(bits) - 1
            for part in re.findall(r"\*\*|\*|[^*]+", glob):
                if part == "**":
                    bits[-1] = (bits[-1][0], True, True, -1)
                elif part == "*":
                    bits[-1] = (bits[-1][0], True, bits[-1][2], -1)
                else:
                    bits += [(b, False, False, -1) for b in part.encode()]
            bits[-1] = (*bits[-1][:3], priority)
            assert bits[first][0] is None
        self.words = max(1, -(-len(bits) // 64))
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        self.stay = np.zeros((256, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.final = np.zeros(self.words, dtype=np.uint64)
        self.priority = np.full(self.words * 64, -1)
        for i, (byte, label, always, priority) in enumerate(bits):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if byte is None:
                self.start[word] |= bit
            else:
                self.step[byte, word] |= bit
            if label:
                self.stay[:, word] |= bit
            if label and not always:
                self.stay[ord("/"), word] &= ~bit
            if priority >= 0:
                self.final[word] |= bit
                self.priority[i] = priority

    def match(self, texts: list[bytes]) -> np.ndarray:
        """The highest priority among the globs that match each text, or -1."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        longest_first = sizes[order]
        states = np.tile(self.start, (n, 1))
        one, last = np.uint64(1), np.uint64(63)
        live = n
        for t in range(int(sizes.max()) if n else 0):
            live = int(np.searchsorted(-longest_first[:live], -t, side="left"))
            byte = flat[starts[:live] + t]
            now = states[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> last
            states[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        hit = np.flatnonzero((states & self.final).any(axis=1))
        best = np.full(n, -1)
        if len(hit):
            ends = np.ascontiguousarray((states[hit] & self.final).astype("<u8")).view(np.uint8)
            flags = np.unpackbits(ends, axis=1, bitorder="little").astype(bool)
            best[order[hit]] = np.where(flags, self.priority, -1).max(axis=1)
        return best


def url_filter(pages: DataFrame, rules: list[Rule], *, globs: tuple[tuple[str, str], ...] = (), default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row, in place: the key, host, path, rule and verdict.

    ``globs`` (pattern, verdict) are judged where no rule fits, later ones first; ``default`` is the
    verdict where none matches either.
    """
    prepare(pages.sparkSession)
    kept = pages.select(key, url)
    kind = kept.schema[0].dataType.simpleString()
    ranked = [*((g, v, None) for g, v in globs), *((g, r.verdict, r.name) for r in sorted(rules, key=lambda r: len(r.name)) for g in r.globs())]
    automaton = Automaton([(g, i) for i, (g, _, _) in enumerate(ranked)])

    def work(batches):
        for batch in batches:
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            # without a host and path nothing is judged, so not even ** may match
            best = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts]).tolist()
            best = [i if h or p else -1 for i, (h, p) in zip(best, parts, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(0),
                    "host": pa.array([h for h, _ in parts], pa.string()),
                    "path": pa.array([p for _, p in parts], pa.string()),
                    "rule": pa.array([ranked[i][2] if i >= 0 else None for i in best], pa.string()),
                    "verdict": pa.array([ranked[i][1] if i >= 0 else default for i in best], pa.string()),
                }
            )

    return kept.mapInArrow(work, f"`{key}` {kind}, host string, path string, rule string, verdict string")


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def _fits(rule: Rule) -> str:
    return f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"


_RANKED = sorted(RULES, key=lambda r: -len(r.name))
SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _RANKED)} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in _RANKED)} ELSE 'allow' END AS verdict FROM ruled
"""

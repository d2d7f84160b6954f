"""Secret scans over a trigram inverted index, in DataFrame operations only.

1. From each rule's regex a Boolean query over trigrams is derived: an OR of ANDs of trigrams that
   every match must hold. A rule without such trigrams has no query.
2. One scan finds which of the queries' trigrams each text holds and writes the postings, grouped by
   trigram within blocks of a bounded number of documents.
3. The queries are answered by intersecting and uniting posting lists, block by block.
4. Candidates are joined back to their texts and verified by the regex itself, with the places of all
   matches. Rules without a query are run over every text.

Index letters are lower-cased, so a query finds a superset of the documents that its rule matches; a
document's posting key is a hash of its id and text, and two documents with one key only make each
other candidates. Verification decides, so neither changes a result.

Edge cases: a null text counts as empty; null ids and repeated rows are scanned like any other row;
texts of any length are scanned whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as op  # noqa: PLC2701  the standard library's own regex parser
from re import _parser as parser  # noqa: PLC2701

from weftline.session import prepare

#: Documents in a block of the index, about.
BLOCK_DOCS = 4096
#: Strings that a part of a regex may stand for before it is cut into trigrams.
MOST_STRINGS = 64
#: Letters of a class that are still listed as strings.
MOST_LETTERS = 4


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: The rules in their listed order. Runs of one class are maximal, so a least length
#: on the whole match is the same as a least number of repeats.
RULES = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
]

Query = frozenset[frozenset[str]]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of_strings(strings: frozenset[str]) -> Query | None:
    """OR over strings of their trigrams; None (anything) if one is too short for a trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    found = {_trigrams(s) for s in strings}
    return frozenset(c for c in found if not any(d < c for d in found))


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a if b is None else b
    found = {x | y for x in a for y in b}
    return frozenset(c for c in found if not any(d < c for d in found))


def _walk(tree) -> tuple[frozenset[str] | None, Query | None]:
    """The strings that a part stands for, if few, and what every match of it must hold."""
    strings: frozenset[str] = frozenset([""])
    whole, query = True, None

    def flush() -> None:
        nonlocal strings, query, whole
        query = _both(query, _of_strings(strings))
        strings, whole = frozenset([""]), False

    for kind, value in tree:
        exact: frozenset[str] | None = None
        inner: Query | None = None
        if kind is op.LITERAL:
            exact = frozenset([chr(value).lower()])
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len({chr(v).lower() for _, v in value}) <= MOST_LETTERS:
            exact = frozenset(chr(v).lower() for _, v in value)
        elif kind is op.SUBPATTERN:
            exact, inner = _walk(value[3])
        elif kind is op.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(e is not None for e, _ in parts):
                exact = frozenset().union(*(e for e, _ in parts))
            else:
                queries = [q if e is None else _of_strings(e) for e, q in parts]
                inner = None if any(q is None for q in queries) else frozenset().union(*queries)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            e, q = _walk(body)
            if e is not None and high == 1:
                exact = e | {""} if low == 0 else e
            elif low >= 1:
                inner = q if e is None else _of_strings(e)
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = frozenset(a + b for a in strings for b in exact)
        elif exact is not None:
            flush()
            strings = exact
        else:
            flush()
            query = _both(query, inner)
    if whole:
        return strings, None
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query | None:
    """An OR of ANDs of lower-case trigrams, or None where a match need not hold any."""
    exact, query = _walk(parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def _pattern_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def postings(docs: DataFrame, grams: list[str], blocks: int, *, text: str, key: str) -> DataFrame:
    """The inverted index: block, gram (its number) and the posting list of document keys."""
    rows = docs.select(_pattern_key(key, text).alias("posting"), F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    # rows that are alike in key and text have one posting, so they are joined map-side first
    found = rows.select("posting", held.alias("grams")).filter(F.size("grams") > 0).groupBy("posting").agg(F.first("grams").alias("grams"))
    found = found.withColumn("block", F.pmod(F.col("posting"), F.lit(blocks)))
    return found.select("posting", "block", F.explode("grams").alias("gram")).repartition("block").groupBy("block", "gram").agg(F.collect_set("posting").alias("postings"))


def _marked(bit: int):
    return lambda p: F.struct(p.alias("posting"), F.lit(bit).alias("bit"))


def _is_kind(kind: str):
    return lambda s: s.kind == kind


def candidates(index: DataFrame, grams: list[str], queries: dict[int, Query]) -> DataFrame:
    """posting and the bits of the rules whose queries it answers."""
    number = {g: i for i, g in enumerate(grams)}
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "postings"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def of(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(number[gram])), none)

    answers = []
    for rule, query in queries.items():
        clauses = [reduce(F.array_intersect, [of(g) for g in sorted(clause)]) for clause in sorted(query, key=sorted)]
        answers.append(F.transform(reduce(F.array_union, clauses), _marked(1 << rule)))
    found = lists.select(F.explode(F.concat(*answers)).alias("hit"))
    return found.groupBy("hit.posting").agg(F.bit_or("hit.bit").alias("bits"))


def matches(rule: Rule, text: Column, order: int) -> Column:
    """Matches in ``text`` with their places: array of struct<start, kind_order, kind, end>.

    The places come from the lengths of the texts between matches and of the matches themselves.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    each = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>").alias("found"))

    def add(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        keep = F.coalesce(x.tested >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc.found, one)).otherwise(acc.found).alias("found"))

    return F.aggregate(each, zero, add).found


def with_spans(docs: DataFrame, rules: list[Rule] = RULES, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``secret_spans``, ordered by start and then by rule; all rows and columns stay."""
    prepare(docs.sparkSession)
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")
    bits = F.lit(0)
    if queries:
        blocks = max(1, -(-docs.count() // BLOCK_DOCS))
        found = candidates(postings(docs, grams, blocks, text=text, key=key), grams, queries)
        docs = docs.withColumn("__posting", _pattern_key(key, text)).join(found.withColumnsRenamed({"posting": "__posting", "bits": "__bits"}).hint("shuffle_hash"), "__posting", "left")
        bits = F.coalesce("__bits", F.lit(0))
    content = F.coalesce(F.col(text), F.lit(""))
    spans = []
    for i, rule in enumerate(rules):
        wanted = bits.bitwiseAND(F.lit(1 << i)) != 0 if i in queries else content.rlike(rule.pattern)
        spans.append(F.when(wanted, matches(rule, content, i)).otherwise(none))
    return docs.withColumn("secret_spans", F.array_sort(F.concat(*spans))).drop("__posting", "__bits")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def secret_scan(docs: DataFrame, rules: list[Rule] = RULES, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: the key, the number of matches of each base rule, the digest of the base
    spans, and all spans as ``kind:start:end``."""
    spans = with_spans(docs.select(key, text), rules, text=text, key=key).select(key, "secret_spans")
    base = [r.kind for r in rules if r.base]
    own = F.filter("secret_spans", lambda s: s.kind.isin(base))
    counts = [F.size(F.filter("secret_spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return spans.select(key, *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


def masked(docs: DataFrame, *, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Texts with every span of ``secret_spans`` masked; overlapping spans are masked as one."""
    spans = F.col("secret_spans")
    content = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        new = s.start >= acc.at
        part = F.array(F.substring(content, acc.at + 1, s.start - acc.at), F.lit(mask))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(new, F.concat(acc.parts, part)).otherwise(acc.parts).alias("parts"))

    done = F.aggregate(spans, zero, add)
    rest = F.substring(content, done.at + 1, F.length(content))
    changed = F.concat(F.array_join(done.parts, ""), rest)
    return docs.withColumn(text, F.when(F.size(spans) > 0, changed).otherwise(content))


def _sql(rules: list[Rule]) -> str:
    """The same by plain regex scans in SQL."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        tested = f"regexp_extract_all(text, '{p}', {r.group})"
        parts.append(f"""
          SELECT doc_id, '{r.kind}' AS kind, {i} AS kind_order, list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'size': length(m[i]), 'tested': length(g[i])}}) AS found
          FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s, {tested} AS g FROM t)""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in rules)
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    label = "kind || ':' || CAST(f.start AS BIGINT) || ':' || CAST(f.start + f.size AS BIGINT)"
    return f"""
      WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      each AS ({" UNION ALL ".join(parts)}),
      spans AS (SELECT doc_id, kind, kind_order, f FROM (SELECT doc_id, kind, kind_order, unnest(found) AS f FROM each) WHERE f.tested >= CASE kind {least} END)
      SELECT t.doc_id, {counts},
        sha256(coalesce(string_agg({label}, ',' ORDER BY f.start, kind_order) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
        coalesce(string_agg({label}, ',' ORDER BY f.start, kind_order), '') AS spans
      FROM t LEFT JOIN spans ON t.doc_id IS NOT DISTINCT FROM spans.doc_id GROUP BY t.doc_id"""


SQL = _sql(RULES)

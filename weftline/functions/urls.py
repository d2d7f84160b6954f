"""URLs by the WHATWG standard: parsing, serialising, resolving; and what is derived from them.

Deviation: internationalised hosts are encoded by the standard library (IDNA 2003).
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Special schemes and their default ports.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_FORBIDDEN = set("\x00\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(c) for c in range(0x20)}
_PRINTED = "".join(map(chr, range(0x21, 0x7F)))


def _encode(text: str, unsafe: str) -> str:
    """Percent-encode controls, letters beyond ASCII, blanks and ``unsafe``; '%' stays."""
    return quote(text, safe="".join(c for c in _PRINTED if c not in unsafe), errors="replace")


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: str = ""  # opaque where host is None and it does not begin with '/'
    query: str | None = None
    fragment: str | None = None

    @property
    def opaque(self) -> bool:
        return self.host is None and not self.path.startswith("/")

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            login = self.user + (f":{self.password}" if self.password else "")
            out += "//" + (f"{login}@" if login else "") + self.host + ("" if self.port is None else f":{self.port}")
        elif self.path.startswith("//"):
            out += "/."
        out += self.path
        out += "" if self.query is None else f"?{self.query}"
        return out + ("" if self.fragment is None else f"#{self.fragment}")


def _number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" and part.isdigit() else int(part) if part.isdigit() else None
    except ValueError:
        return None


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1])}]" if text.endswith("]") else None
        except ValueError:
            return None
    if not special:
        return None if set(text) & (_FORBIDDEN - {"%"}) else _encode(text, "")
    from urllib.parse import unquote

    text = unquote(text)
    if not text.isascii():
        try:
            text = text.encode("idna").decode()
        except UnicodeError:
            return None
    text = text.lower()
    if not text or set(text) & _FORBIDDEN:
        return None
    parts = text.removesuffix(".").split(".")
    last = parts[-1]
    if last.isdigit() or re.fullmatch("0x[0-9a-f]*", last):
        numbers = [_number(p) for p in parts]
        if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        return str(ipaddress.IPv4Address(sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1])) + numbers[-1]))
    return text


def _path(text: str, base: list[str], special: bool) -> str:
    if special:
        text = text.replace("\\", "/")
    out = list(base)
    parts = text.split("/")
    for i, part in enumerate(parts):
        plain = re.sub("%2e", ".", part, flags=re.I)
        last = i == len(parts) - 1
        if plain == "..":
            out = out[:-1]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(part, '"#<>?`{}^'))
    return "/" + "/".join(out)


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """A URL, resolved against ``base`` where it has no scheme; None where it is none."""
    if text is None:
        return None
    text = re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    fragment = query = None
    if "#" in text:
        text, fragment = text.split("#", 1)
        fragment = _encode(fragment, '"<>`')
    found = _SCHEME.match(text)
    scheme = found[1].lower() if found else None
    rest = text[found.end() :] if found else text
    if scheme is None and base is None:
        return None
    if scheme is not None and base is not None and scheme == base.scheme and scheme in PORTS and not rest.replace("\\", "/").startswith("/"):
        scheme = None  # special schemes without slashes are relative
    inherits = scheme is None
    if inherits:
        scheme = base.scheme
        if base.opaque:
            return replace(base, fragment=fragment) if rest == "" and fragment is not None else None
    special = scheme in PORTS
    if "?" in rest:
        rest, query = rest.split("?", 1)
        query = _encode(query, "\"<>'" if special else '"<>')
    slashed = rest.replace("\\", "/") if special else rest
    if inherits and not slashed.startswith("//"):
        if rest == "":
            return replace(base, query=base.query if query is None else query, fragment=fragment)
        folder = [] if slashed.startswith("/") else base.path.split("/")[1:-1]
        return replace(base, path=_path(rest[1:] if slashed.startswith("/") else rest, folder, special), query=query, fragment=fragment)
    if special and scheme != "file":
        rest = re.sub(r"^[/\\]*", "", rest)
    elif slashed.startswith("//"):
        rest = rest[2:]
    else:
        if special or rest.startswith("/"):
            return Url(scheme, host="" if special else None, path=_path(rest.lstrip("/\\") if special else rest[1:], [], special), query=query, fragment=fragment)
        return Url(scheme, path=_encode(rest, ""), query=query, fragment=fragment)
    end = re.search(r"[/\\]" if special else "/", rest)
    authority, path = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    user = password = ""
    if "@" in authority:
        login, authority = authority.rsplit("@", 1)
        user, _, password = login.partition(":")
        user, password = (_encode(x, '"#<>?`{}/:;=@[]^|\\') for x in (user, password))
    port = None
    if m := re.search(r":(\d*)$", authority):
        authority = authority[: m.start()]
        if m[1]:
            port = int(m[1])
            if port > 65535:
                return None
            port = None if PORTS.get(scheme) == port else port
    elif ":" in authority and not authority.startswith("["):
        return None
    host = _host(authority, special) if authority or scheme != "file" else ""
    if host is None or (host == "" and special and scheme != "file"):
        return None
    path = _path(path[1:], [], special) if path or special else ""
    return Url(scheme, user, password, host, port, path, query, fragment)


def normalise(text: str | None) -> str | None:
    found = parse(text)
    return None if found is None else str(found)


def without_fragment(text: str | None) -> str | None:
    found = parse(text)
    return None if found is None else str(replace(found, fragment=None))


def normalise_href(page: str, href: str) -> str | None:
    """A link as it is crawled: https where it names a host, else resolved against the page."""
    base = parse(page)
    if base is None:
        return None
    if href.startswith("//"):
        found = parse("https:" + href)
    elif href.startswith(("http://", "https://")):
        found = parse(href)
        if found is not None and found.scheme == "http":
            found = replace(found, scheme="https", port=None if found.port == 443 else found.port)
    else:
        found = parse(href, base)
    return None if found is None else str(found)


@F.pandas_udf(StringType())
def whatwg_url(text: pd.Series) -> pd.Series:
    return text.map(normalise)


@F.pandas_udf(StringType())
def crawl_link(page: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([normalise_href(p, h) if p is not None and h is not None else None for p, h in zip(page, href, strict=True)], dtype=object)


# On normalised URLs, built-in functions are enough.


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def drop_query(url: Column) -> Column:
    return F.regexp_replace(defragment(url), r"\?.*$", "")


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, "^[a-z]+://[^/?#]+", 0), F.lit("/"))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)


def archive_copy(url: Column, as_of: Column, web: str = "https://web.archive.org/web") -> Column:
    """Where an archive keeps its copy of a page, unchanged, as of a day (UTC)."""
    return F.concat(F.lit(web + "/"), F.date_format(as_of, "yyyyMMdd"), F.lit("000000id_/"), url)


def sanitise(url: Column, rules: list[tuple[str, bool]]) -> Column:
    """Rules in turn: where a regex matches the URL as it is by then, its query is removed."""
    for pattern, remove_query in rules:
        if remove_query:
            url = F.when(url.rlike(pattern), F.regexp_replace(url, r"\?[^#]*", "")).otherwise(url)
    return url

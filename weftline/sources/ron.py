"""RON, Rusty Object Notation, as far as records need it: structs, options, strings, numbers, lists,
tuples, maps, unit-like names. Structs become dicts, ``Some(x)`` becomes x, ``None`` and ``()`` None."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Some:
    value: Any


class Map(dict):
    """A dict that is written as a map, not as a struct."""


_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"[+-]?(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d*)?(?:[eE][+-]?\d+)?|inf|NaN)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\", '"': '"', "'": "'"}


class RonError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def blank(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def take(self, mark: str) -> bool:
        if self.blank() and self.text.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise RonError(f"expected {mark!r} at {self.at}")

    def string(self) -> str:
        if m := re.compile(r'r(#*)"').match(self.text, self.at):
            end = self.text.find('"' + m[1], m.end())
            if end < 0:
                raise RonError("a raw string does not end")
            out, self.at = self.text[m.end() : end], end + 1 + len(m[1])
            return out
        self.need('"')
        out = []
        while True:
            m = re.compile(r'[^"\\]*').match(self.text, self.at)
            out.append(m[0])
            self.at = m.end()
            c = self.text[self.at : self.at + 1]
            if c == "":
                raise RonError("a string does not end")
            self.at += 1
            if c == '"':
                return "".join(out)
            e = self.text[self.at : self.at + 1]
            self.at += 1
            if e in _ESCAPES:
                out.append(_ESCAPES[e])
            elif e == "x":
                out.append(chr(int(self.text[self.at : self.at + 2], 16)))
                self.at += 2
            elif e == "u" and (m := re.compile(r"\{([0-9a-fA-F]+)\}").match(self.text, self.at)):
                out.append(chr(int(m[1], 16)))
                self.at = m.end()
            else:
                raise RonError(f"unknown escape at {self.at}")

    def several(self, end: str, one) -> list:
        out = []
        while not self.take(end):
            out.append(one())
            if not self.take(","):
                self.need(end)
                break
        return out

    def pair(self) -> tuple:
        key = self.value()
        self.need(":")
        return key, self.value()

    def body(self) -> Any:
        """After '(': a struct, a tuple or unit."""
        if self.take(")"):
            return None
        mark = self.at
        self.blank()
        m = _NAME.match(self.text, self.at)
        if m:
            self.at = m.end()
            if self.blank() == ":":
                self.at = mark
                return dict(self.several(")", self.entry))
        self.at = mark
        return tuple(self.several(")", self.value))

    def entry(self) -> tuple:
        self.blank()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise RonError(f"expected a field at {self.at}")
        self.at = m.end()
        self.need(":")
        return m[0], self.value()

    def value(self) -> Any:
        c = self.blank()
        if c == "":
            raise RonError("the text ends early")
        if c == '"' or re.compile(r'r#*"').match(self.text, self.at):
            return self.string()
        if self.take("["):
            return self.several("]", self.value)
        if self.take("{"):
            return Map(self.several("}", self.pair))
        if self.take("("):
            return self.body()
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            text = m[0].replace("_", "")
            return float(text) if re.search(r"[.eEiN]", text) and "x" not in text else int(text, 0)
        if m := _NAME.match(self.text, self.at):
            self.at = m.end()
            if m[0] in ("true", "false"):
                return m[0] == "true"
            if m[0] == "None":
                return None
            if self.take("("):
                inner = self.body()
                return inner[0] if m[0] == "Some" and isinstance(inner, tuple) and len(inner) == 1 else inner
            return m[0]
        raise RonError(f"unexpected {c!r} at {self.at}")


def loads(text: str) -> Any:
    reader = _Reader(text)
    found = reader.value()
    if reader.blank():
        raise RonError(f"more text at {reader.at}")
    return found


def dumps(value: Any) -> str:
    """Plain dicts are structs, ``Map`` maps, ``Some`` options."""
    if value is None:
        return "None"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Some):
        return f"Some({dumps(value.value)})"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\\b", "\\u{8}").replace("\\f", "\\u{c}") if not re.search(r"[\x00-\x07\x0b\x0e-\x1f\\\x08\x0c]", value) else '"' + "".join(_escape(c) for c in value) + '"'
    if isinstance(value, Map):
        return "{" + ",".join(f"{dumps(k)}:{dumps(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, dict):
        return "(" + ",".join(f"{k}:{dumps(v)}" for k, v in value.items()) + ")"
    if isinstance(value, tuple):
        return "(" + ",".join(map(dumps, value)) + ")"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return repr(value)


def _escape(c: str) -> str:
    known = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"'}
    return known.get(c) or (f"\\u{{{ord(c):x}}}" if c < " " else c)

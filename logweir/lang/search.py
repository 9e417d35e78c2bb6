"""The search language: keywords, field comparisons; OR binds tighter than AND."""

from __future__ import annotations

import re

from .ast import Compare, Junction, OneOf, QueryError, Word
from .expressions import unquote

_TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<op>!=|<=|>=|==|[=<>(),])|(?P<word>(?:[^\s"()=<>!,\\]|\\.|!(?!=))+))""", re.X)


class _Tokens:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected character in search at {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def next(self):
        self.at += 1
        return self.items[self.at - 1]


def parse_search(text: str):
    """A tree, or None for an empty search (everything)."""
    t = _Tokens(text)
    if not t.items:
        return None
    tree = _and(t)
    if t.peek()[0] != "end":
        raise QueryError(f"unexpected {t.peek()[1]!r} in search {text!r}")
    return tree


def _is(t: _Tokens, word: str) -> bool:
    kind, text = t.peek()
    return kind == "word" and text.lower() == word


def _and(t: _Tokens):
    parts = [_or(t)]
    while t.peek()[0] != "end" and t.peek() != ("op", ")"):
        if _is(t, "and"):
            t.next()
        parts.append(_or(t))
    return parts[0] if len(parts) == 1 else Junction("and", tuple(parts))


def _or(t: _Tokens):
    parts = [_not(t)]
    while _is(t, "or"):
        t.next()
        parts.append(_not(t))
    return parts[0] if len(parts) == 1 else Junction("or", tuple(parts))


def _not(t: _Tokens):
    if _is(t, "not"):
        t.next()
        return Junction("not", (_not(t),))
    return _primary(t)


def _primary(t: _Tokens):
    kind, text = t.next() if t.peek()[0] != "end" else ("end", "")
    if (kind, text) == ("op", "("):
        inner = _and(t)
        if t.peek() != ("op", ")"):
            raise QueryError("missing ) in search")
        t.next()
        return inner
    if kind == "string":
        if t.peek() not in (("op", "="), ("op", "!="), ("op", "==")):
            return Word(unquote(text), True)
        text = unquote(text)
    elif kind != "word":
        raise QueryError(f"unexpected {text or 'end'!r} in search")
    low, (k, op) = text.lower(), t.peek()
    if low in ("case", "term") and (k, op) == ("op", "("):
        t.next()
        kind, inner = t.next()
        if t.peek() != ("op", ")"):
            raise QueryError(f"{text} needs one term")
        t.next()
        return Word(unquote(inner) if kind == "string" else inner, True, low)
    if k == "op" and op in ("=", "==", "!=", "<", "<=", ">", ">="):
        t.next()
        if t.peek()[0] not in ("word", "string"):
            raise QueryError(f"{text}{op} needs a value")
        kind, value = t.next()
        return Compare(text.strip("'"), "=" if op == "==" else op, unquote(value) if kind == "string" else value, kind == "string")
    if _is(t, "in") and t.peek(1) == ("op", "("):
        t.at += 2
        values = []
        while True:
            kind, value = t.next()
            values.append(unquote(value) if kind == "string" else value)
            if t.next() == ("op", ")"):
                return OneOf(text, tuple(values))
    return Word(text)

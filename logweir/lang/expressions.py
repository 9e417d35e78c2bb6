"""Lexer and precedence parser of expressions, and a token stream that commands share."""

from __future__ import annotations

import re

from .ast import Agg, Bin, Call, Field, FString, Glob, Lit, QueryError, Test, Time, Un

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<fstring>f"(?:[^"\\]|\\.)*")
  | (?P<string>"(?:[^"\\]|\\.)*")
  | (?P<quoted>'(?:[^'\\]|\\.)*')
  | (?P<time>@\d{4}-\d\d-\d\d(?:T[\d:.]+(?:Z|[+-]\d\d:?\d\d)?)?)
  | (?P<duration>\d+(?:mon|min|sec|hr|ms|s|m|h|d|w)(?:@[a-z]+[0-6]?)?\b)
  | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
  | (?P<param>\$[A-Za-z_][\w.]*)
  | (?P<ident>[A-Za-z_][\w]*(?:(?:\.|::?)[A-Za-z_0-9*][\w]*|[*?](?=[\w*])[\w]*|\*(?=\.)|\*|\[\*?\d*\])*)
  | (?P<op>\?\?|\?\.|=~|!~|==|!=|<=|>=|\.\.|[-+*/%=<>(),.?@!|:\[\]&])
    )""",
    re.VERBOSE,
)

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def unquote(text: str) -> str:
    """Known escapes are resolved; a backslash before anything else stays (regular expressions rely on it)."""
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S)


class Tokens:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected character at {text[at : at + 20]!r}")
            kind = m.lastgroup
            self.items.append((kind, m[kind], m.start(kind), m.end()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.items[i][:2] if i < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def done(self) -> bool:
        return self.at >= len(self.items)

    def word(self, *names: str) -> bool:
        """Whether the next token is one of these words, in any case; it is taken."""
        kind, text = self.peek()
        if kind == "ident" and text.lower() in names:
            self.at += 1
            return True
        return False

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        if kind == "op" and text in ops:
            self.at += 1
            return text
        return None

    def need(self, *ops: str) -> str:
        got = self.op(*ops)
        if got is None:
            raise QueryError(f"expected {' or '.join(ops)} near {self.rest()[:30]!r} in {self.text!r}")
        return got

    def rest(self) -> str:
        return self.text[self.items[self.at][2] :] if not self.done() else ""

    def gap_before(self) -> bool:
        """Whether white space stands before the next token."""
        return not self.done() and (self.at == 0 or self.items[self.at][2] > self.items[self.at - 1][3])

    def name(self) -> str:
        kind, text = self.next()
        if kind == "quoted":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "string":
            return unquote(text)
        if kind == "op" and text == "*":
            return "*" + self.next()[1] if self.peek()[0] == "ident" and not self.gap_before() else "*"
        if kind not in ("ident", "param"):
            raise QueryError(f"expected a name, found {text!r} in {self.text!r}")
        return text

    def names(self) -> list[str]:
        out = [self.name()]
        while True:
            if self.op(","):
                out.append(self.name())
            elif self.peek()[0] in ("quoted",):
                out.append(self.name())
            else:
                return out

    def value(self) -> str:
        """A literal as text: string, number, duration, word or a signed number."""
        sign = self.op("-", "+") or ""
        kind, text = self.next()
        if kind == "string":
            return unquote(text)
        if kind == "quoted":
            return text[1:-1]
        if kind in ("number", "duration", "ident", "time"):
            return sign + text
        raise QueryError(f"expected a value, found {text!r} in {self.text!r}")

    def integer(self, default: int | None = None) -> int:
        kind, text = self.peek()
        if kind == "number":
            self.next()
            return int(float(text))
        if default is None:
            raise QueryError(f"expected a number near {self.rest()[:30]!r}")
        return default

    def option(self, *names: str) -> str | None:
        """name=value with one of these names; gives the value as text, and the name in self.last."""
        kind, text = self.peek()
        if kind == "ident" and text.lower() in names and self.peek(1) == ("op", "="):
            self.at += 2
            self.last = text.lower()
            return self.value()
        return None


def expression(t: Tokens):
    left = _or(t)
    while t.word("xor"):
        left = Bin("xor", left, _or(t))
    return left


def _or(t: Tokens):
    left = _and(t)
    while t.word("or"):
        left = Bin("or", left, _and(t))
    return left


def _and(t: Tokens):
    left = _not(t)
    while t.word("and"):
        left = Bin("and", left, _not(t))
    return left


def _not(t: Tokens):
    if t.word("not") or t.op("!"):
        return Un("not", _not(t))
    return _comparison(t)


def _comparison(t: Tokens):
    left = _coalesce(t)
    if op := t.op("=", "==", "!=", "<=", ">=", "<", ">"):
        right = _time_or(t)
        return Bin("=" if op == "==" else op, left, right)
    if op := t.op("=~", "!~"):
        return Test("regex", left, (_coalesce(t),), op == "!~")
    negated = t.peek()[1].lower() == "not" and t.peek(1)[1].lower() in ("like", "in", "between") and t.word("not")
    if t.word("like"):
        return Test("like", left, (_coalesce(t),), negated)
    if t.word("in"):
        t.need("(")
        return Test("in", left, tuple(_list(t)), negated)
    if t.word("between"):
        low = _time_or(t)
        if not t.word("and"):
            raise QueryError("BETWEEN needs AND")
        return Test("between", left, (low, _time_or(t)), negated)
    if t.peek()[1].lower() == "is" and t.peek(1)[1].lower() in ("null", "not"):
        t.next()
        negated = t.word("not")
        if not t.word("null"):
            raise QueryError("IS needs NULL or NOT NULL")
        return Test("null", left, (), negated)
    return left


def _time_or(t: Tokens):
    """A relative time (-1h, +5m@m), or an expression."""
    kind, text = t.peek()
    if kind == "op" and text in "+-" and t.peek(1)[0] == "duration":
        t.at += 2
        return Time(text + t.items[t.at - 1][1])
    if kind == "op" and text == "@" and t.peek(1)[0] == "ident":
        t.at += 2
        return Time("@" + t.items[t.at - 1][1])
    return _coalesce(t)


def _coalesce(t: Tokens):
    left = _additive(t)
    while t.op("??"):
        left = Call("coalesce", (left, _additive(t)))
    return left


def _additive(t: Tokens):
    left = _multiplicative(t)
    while op := t.op("+", "-", ".") if t.peek()[1] != "." or t.gap_before() else None:
        left = Bin("concat" if op == "." else op, left, _multiplicative(t))
    return left


def _multiplicative(t: Tokens):
    left = _unary(t)
    while op := t.op("*", "/", "%"):
        left = Bin(op, left, _unary(t))
    return left


def _unary(t: Tokens):
    if t.op("-"):
        arg = _unary(t)
        return Lit(-arg.value) if isinstance(arg, Lit) and isinstance(arg.value, (int, float)) else Un("-", arg)
    if t.op("+"):
        return _unary(t)
    return _postfix(t)


def _postfix(t: Tokens):
    x = _primary(t)
    while True:
        if t.op("?."):
            x = Field(f"{x.name}.{t.name()}") if isinstance(x, Field) else Call("json_extract", (x, Lit(t.name())))
        elif t.peek() == ("op", "?") and isinstance(x, Field):
            t.next()
            x = Test("null", x, (), True)
        else:
            return x


def _list(t: Tokens) -> list:
    out = []
    if t.op(")"):
        return out
    while True:
        out.append(expression(t))
        if t.need(",", ")") == ")":
            return out


def _primary(t: Tokens):
    kind, text = t.next()
    if kind == "op" and text == "(":
        x = expression(t)
        t.need(")")
        return x
    if kind == "number":
        return Lit(int(text) if text.isdigit() else float(text))
    if kind == "duration":
        return Time(text)
    if kind == "time":
        return Time(text[1:])
    if kind == "string":
        return Lit(unquote(text))
    if kind == "fstring":
        return fstring(text[1:])
    if kind == "quoted":
        return Field(re.sub(r"\\(.)", r"\1", text[1:-1]))
    if kind == "param":
        return Field(text)
    if kind == "ident":
        low = text.lower()
        if t.peek() == ("op", "("):
            t.next()
            return Call(low, tuple(_list(t)))
        if low in ("true", "false"):
            return Lit(low == "true")
        if low == "null":
            return Lit(None)
        return Glob(text) if "*" in text and "[" not in text else Field(text)
    if kind == "op" and text == "*":
        return Glob("*" + t.next()[1] if t.peek()[0] == "ident" and not t.gap_before() else "*")
    raise QueryError(f"unexpected {text or 'end'!r} in {t.text!r}")


def fstring(quoted: str) -> FString:
    """f"…{expr}…"; doubled braces stand for themselves."""
    text, parts, at, plain = unquote(quoted), [], 0, ""
    while at < len(text):
        c = text[at]
        if text[at : at + 2] in ("{{", "}}"):
            plain, at = plain + c, at + 2
        elif c == "{":
            end = text.find("}", at)
            if end < 0:
                raise QueryError("f-string without a closing brace")
            if plain:
                parts.append(Lit(plain))
                plain = ""
            t = Tokens(text[at + 1 : end])
            parts.append(expression(t))
            at = end + 1
        else:
            plain, at = plain + c, at + 1
    if plain or not parts:
        parts.append(Lit(plain))
    return FString(tuple(parts))


_PERCENTILE = re.compile(r"(?:p|perc|percentile|exactperc|upperperc)(\d+(?:\.\d+)?)$")
AGGREGATES = frozenset(
    "count sum sumsq avg mean min max dc distinct_count estdc estdc_error values list mode first last stdev stdevp var varp range "
    "earliest latest earliest_time latest_time per_second per_minute per_hour per_day rate median perc percentile exactperc upperperc c".split()
)


def is_aggregate(name: str) -> bool:
    return name.lower() in AGGREGATES or bool(_PERCENTILE.match(name.lower()))


def aggregate(t: Tokens) -> Agg:
    kind, text = t.next()
    func = text.lower()
    if kind != "ident" or not is_aggregate(func):
        raise QueryError(f"unknown aggregate {text!r} in {t.text!r}")
    start = t.at
    args: tuple = ()
    if t.op("("):
        args = () if t.op(")") else tuple(_list(t))
    shown = t.text[t.items[start][2] : t.items[t.at - 1][3]].replace(" ", "") if t.at > start and args else ""
    level = None
    if m := _PERCENTILE.match(func):
        level = float(m[1]) / 100
    elif func == "median":
        level = 0.5
    elif func in ("perc", "percentile", "exactperc", "upperperc"):
        if len(args) != 2 or not isinstance(args[1], Lit):
            raise QueryError(f"{func} needs a field and a level")
        level, args = float(args[1].value) / 100, args[:1]
    alias = t.name() if t.word("as") else func + shown
    if func == "c":
        func = "count"
    return Agg(func, args, alias, level)


def aggregates(t: Tokens) -> list[Agg]:
    out = [aggregate(t)]
    while True:
        comma = t.op(",")
        kind, text = t.peek()
        if kind == "ident" and is_aggregate(text) and (comma or t.peek(1)[1] != "="):
            out.append(aggregate(t))
        elif comma:
            raise QueryError(f"expected an aggregate near {t.rest()[:30]!r}")
        else:
            return out


def by(t: Tokens) -> list[str]:
    return t.names() if t.word("by") else []

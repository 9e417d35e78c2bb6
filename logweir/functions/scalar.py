"""Scalar functions by name: (compiler, argument trees) to Val."""

from __future__ import annotations

import ipaddress
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Lit, QueryError
from . import times
from .coerce import Val, common, number, text
from .patterns import java_regex, java_replacement, quote

def null() -> Val:
    return Val(F.lit(None).cast("string"), "null")


def constant(e) -> object:
    if not isinstance(e, Lit):
        raise QueryError("a constant is needed here")
    return e.value


def need(args: tuple, low: int, high: int | None = None) -> None:
    if len(args) < low or high is not None and len(args) > high:
        raise QueryError(f"wrong number of arguments: {len(args)}")


# conditions
def _if(c, args):
    need(args, 3, 3)
    (a, b), kind = common([c(args[1]), c(args[2])])
    return Val(F.when(c.truth(args[0]), a).otherwise(b), kind)


def _case(c, args):
    need(args, 2)
    pairs = list(zip(args[::2], args[1::2], strict=False))
    vals = [c(v) for _, v in pairs] + ([c(args[-1])] if len(args) % 2 else [])
    cols, kind = common(vals)
    out = None
    for (cond, _), v in zip(pairs, cols, strict=False):
        out = F.when(c.truth(cond), v) if out is None else out.when(c.truth(cond), v)
    return Val(out.otherwise(cols[-1]) if len(args) % 2 else out, kind)


def _validate(c, args):
    need(args, 2)
    out = None
    for cond, v in zip(args[::2], args[1::2], strict=False):
        m = text(c(v))
        out = F.when(~c.truth(cond), m) if out is None else out.when(~c.truth(cond), m)
    return Val(out, "string")


def _coalesce(c, args):
    need(args, 1)
    cols, kind = common([c(a) for a in args])
    return Val(F.coalesce(*cols), kind)


def _nullif(c, args):
    need(args, 2, 2)
    a, b = c(args[0]), c(args[1])
    return Val(F.when(~c.compare("=", a, b), a.col), a.kind)


def _in(c, args):
    need(args, 2)
    x = c(args[0])
    out = F.lit(False)
    for a in args[1:]:
        out = out | c.compare("=", x, c(a))
    return Val(out, "bool")


# numbers
def _math(f, domain=None):
    def make(c, args):
        need(args, 1, 1)
        x = number(c(args[0]))
        y = f(x)
        y = F.when(domain(x), y) if domain else y
        return Val(F.when(F.isnan(y), None).otherwise(y), "float")

    return make


def _keep_int(f):
    def make(c, args):
        need(args, 1, 1)
        v = c(args[0])
        return Val(f(v.col), "int") if v.kind == "int" else Val(f(number(v)).cast("double"), "float")

    return make


def _round(c, args):
    need(args, 1, 2)
    d = int(constant(args[1])) if len(args) == 2 else 0
    return Val(F.round(number(c(args[0])), d).cast("double"), "float")


def _log(c, args):
    need(args, 1, 2)
    x = number(c(args[0]))
    b = number(c(args[1])) if len(args) == 2 else F.lit(10.0)
    return Val(F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.ln(b) if len(args) == 2 else F.log10(x)), "float")


def _pow(c, args):
    need(args, 2, 2)
    y = F.pow(number(c(args[0])), number(c(args[1])))
    return Val(F.when(~F.isnan(y), y), "float")


def _two(f):
    def make(c, args):
        need(args, 2, 2)
        return Val(f(number(c(args[0])), number(c(args[1]))), "float")

    return make


def _extreme(least: bool):
    def make(c, args):
        need(args, 1)
        cols, kind = common([c(a) for a in args])
        if len(cols) == 1:
            return Val(cols[0], kind)
        if kind == "string":
            pairs = [F.struct(number(Val(x, "string")).alias("n"), x.alias("s")) for x in cols]
            out = (F.least if least else F.greatest)(*pairs)["s"]
        else:
            out = (F.least if least else F.greatest)(*cols)
        if least:  # null is the smallest value
            missing = F.lit(False)
            for x in cols:
                missing = missing | x.isNull()
            out = F.when(~missing, out)
        return Val(out, kind)

    return make


# strings
def _string(f, low=1, high=1):
    def make(c, args):
        need(args, low, high)
        return Val(f(*(text(c(a)) for a in args)), "string")

    return make


def _test(f):
    def make(c, args):
        need(args, 2, 2)
        return Val(F.coalesce(f(text(c(args[0])), text(c(args[1]))), F.lit(False)), "bool")

    return make


def _substr(c, args):
    need(args, 2, 3)
    s, start = text(c(args[0])), number(c(args[1])).cast("int")
    n = number(c(args[2])).cast("int") if len(args) == 3 else F.length(s)
    return Val(F.substring(s, F.greatest(start, F.lit(1)), F.greatest(n, F.lit(0))), "string")


def _match(c, args):
    need(args, 2, 2)
    return Val(F.coalesce(text(c(args[0])).rlike(java_regex(str(constant(args[1])))), F.lit(False)), "bool")


def _replace(c, args):
    need(args, 3, 3)
    return Val(F.regexp_replace(text(c(args[0])), java_regex(str(constant(args[1]))), java_replacement(str(constant(args[2])))), "string")


def _trim(side):
    def make(c, args):
        need(args, 1, 2)
        s = text(c(args[0]))
        if len(args) == 1:
            left, right = r"^\s+", r"\s+$"
        else:
            chars = "[" + "".join("\\" + x if x in "\\]^-[&" else x for x in str(constant(args[1]))) + "]"
            left, right = f"^{chars}+", f"{chars}+$"
        if side in "lb":
            s = F.regexp_replace(s, left, "")
        if side in "rb":
            s = F.regexp_replace(s, right, "")
        return Val(s, "string")

    return make


def _split(c, args):
    need(args, 2, 2)
    return Val(F.split(text(c(args[0])), quote(str(constant(args[1]))), -1), "array")


def _printf(c, args):
    need(args, 1)
    fmt, vals, i = str(constant(args[0])), [c(a) for a in args[1:]], iter(range(len(args)))
    cols: list[Column] = []

    def verb(m):
        flags, kind = m[1], m[2]
        if kind == "%":
            return "%%"
        v = vals[next(i)]
        if kind in "di":
            cols.append(number(v).cast("long"))
            return f"%{flags}d"
        if kind in "feEgG":
            cols.append(number(v))
            return f"%{flags}{kind}"
        if kind in "xXo":
            cols.append(number(v).cast("long"))
            return f"%{flags}{kind}"
        cols.append(F.concat(F.lit('"'), F.replace(F.replace(text(v), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) if kind == "q" else text(v))
        return f"%{flags}s"

    out = re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)([a-zA-Z%])", verb, fmt)
    return Val(F.format_string(out, *cols) if cols else F.lit(out.replace("%%", "%")), "string")


def _like(c, args):
    need(args, 2, 2)
    return Val(F.coalesce(text(c(args[0])).ilike(str(constant(args[1]))), F.lit(False)), "bool")


# conversions
def _tonumber(c, args):
    need(args, 1, 2)
    v = c(args[0])
    if len(args) == 2 and int(constant(args[1])) != 10:
        return Val(F.conv(text(v), int(constant(args[1])), 10).try_cast("double"), "float")
    return v if v.numeric else Val(number(v), "float")


def _tobool(c, args):
    need(args, 1, 1)
    v = c(args[0])
    if v.kind == "bool":
        return v
    if v.numeric:
        return Val(v.col != 0, "bool")
    s = F.lower(text(v))
    return Val(F.when(s.isin("true", "t", "yes", "y", "1"), True).when(s.isin("false", "f", "no", "n", "0"), False), "bool")


# time
def _strftime(c, args):
    need(args, 2, 2)
    v = c(args[0])
    t = v.col if v.kind == "time" else F.timestamp_seconds(number(v))
    return Val(F.date_format(t, times.java_format(str(constant(args[1])))), "string")


def _strptime(c, args):
    need(args, 2, 2)
    t = F.try_to_timestamp(text(c(args[0])), F.lit(times.java_format(str(constant(args[1])))))
    return Val(F.unix_seconds(t), "int")


# multivalues
def array(v: Val) -> Column:
    return v.col.cast("array<string>") if v.kind == "array" else F.when(v.col.isNotNull(), F.array(text(v)))


def _mvappend(c, args):
    need(args, 1)
    empty = F.array().cast("array<string>")
    return Val(F.concat(*[F.coalesce(array(c(a)), empty) for a in args]), "array")


def _mvjoin(c, args):
    need(args, 2, 2)
    return Val(F.array_join(array(c(args[0])), str(constant(args[1]))), "string")


def _mvdedup(c, args):
    need(args, 1, 1)
    return Val(F.array_distinct(array(c(args[0]))), "array")


def _mvcount(c, args):
    need(args, 1, 1)
    return Val(F.coalesce(F.size(array(c(args[0]))), F.lit(0)).cast("long"), "int")


# json
def json_path(path: str) -> str:
    """a.b[0].c, a[*].b or $.a as a JSON path with quoted names."""
    out = "$"
    for part in re.findall(r"\[[^\]]*\]|\{\d*\}|[^.\[\]{}]+", path.removeprefix("$").lstrip(".")):
        if part[0] == "[":
            out += part
        elif part[0] == "{":
            out += f"[{part[1:-1] or '*'}]"
        else:
            out += f"['{part}']"
    return out


def to_json_text(v: Val) -> Column:
    if v.kind == "null":
        return F.lit("null")
    if v.kind in ("array", "other"):
        return F.coalesce(F.to_json(v.col), F.lit("null"))
    if v.kind in ("int", "float"):
        return F.coalesce(text(v), F.lit("null"))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("string"), F.lit("null"))
    s = text(v)
    looks = s.rlike(r"^\s*[\[{]") & F.try_parse_json(s).isNotNull()
    return F.when(s.isNull(), F.lit("null")).when(looks, s).otherwise(F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""))


def _json_extract(c, args):
    need(args, 1, 2)
    x = text(c(args[0]))
    return Val(F.get_json_object(x, json_path(str(constant(args[1])))) if len(args) == 2 else x, "string")


def _at(c, args):
    x = text(c(args[0]))
    return F.get_json_object(x, json_path(str(constant(args[1])))) if len(args) == 2 else x


def _json_type(c, args):
    need(args, 1, 2)
    kind = F.schema_of_variant(F.try_parse_json(_at(c, args)))
    out = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
    return Val(F.when(kind.isNotNull(), out.otherwise("number")), "string")


def _json_object(c, args):
    need(args, 0)
    items = [F.concat(F.to_json(F.array(text(c(k)))).substr(F.lit(2), F.length(F.to_json(F.array(text(c(k))))) - 2), F.lit(":"), to_json_text(c(v))) for k, v in zip(args[::2], args[1::2], strict=True)]
    return Val(F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}")), "string")


def _json_array(c, args):
    return Val(F.concat(F.lit("["), F.concat_ws(",", *[to_json_text(c(a)) for a in args]), F.lit("]")), "string")


def _steps(path: str) -> list:
    return [int(p) if re.fullmatch(r"-?\d+", p) else p for p in re.findall(r"[^.\[\]]+", path.removeprefix("$").lstrip("."))]


def _edit(doc: str, path: str, value, remove: bool):
    try:
        root = json.loads(doc)
    except (TypeError, ValueError):
        return None
    at, steps = root, _steps(path)
    for step, nxt in zip(steps[:-1], steps[1:], strict=False):
        if isinstance(at, list) and isinstance(step, int) and -len(at) <= step < len(at):
            at = at[step]
        elif isinstance(at, dict):
            if step not in at:
                if remove:
                    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)
                at[step] = [] if isinstance(nxt, int) else {}
            at = at[step]
        else:
            return json.dumps(root, separators=(",", ":"), ensure_ascii=False)
    last = steps[-1] if steps else None
    if isinstance(at, dict) and last is not None:
        if remove:
            at.pop(str(last), None)
        else:
            at[str(last)] = value
    elif isinstance(at, list) and isinstance(last, int):
        if remove and -len(at) <= last < len(at):
            at.pop(last)
        elif not remove and -len(at) <= last < len(at):
            at[last] = value
        elif not remove:
            at.append(value)
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def _json_set(c, args):
    need(args, 3, 3)
    path = str(constant(args[1]))

    @F.pandas_udf("string")
    def put(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_edit(d, path, json.loads(v), False) for d, v in zip(docs, values, strict=True)])

    return Val(put(text(c(args[0])), to_json_text(c(args[2]))), "string")


def _json_remove(c, args):
    need(args, 2)
    paths = [str(constant(a)) for a in args[1:]]

    @F.pandas_udf("string")
    def cut(docs: pd.Series) -> pd.Series:
        out = []
        for d in docs:
            for p in paths:
                d = _edit(d, p, None, True) if d is not None else None
            out.append(d)
        return pd.Series(out)

    return Val(cut(text(c(args[0]))), "string")


def _json_merge(c, args):
    need(args, 2, 2)

    @F.pandas_udf("string")
    def merge(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                x, y = json.loads(x), json.loads(y)
                out.append(json.dumps({**x, **y}, separators=(",", ":"), ensure_ascii=False))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out)

    return Val(merge(text(c(args[0])), text(c(args[1]))), "string")


# types
def _is(kind):
    def make(c, args):
        need(args, 1, 1)
        v = c(args[0])
        there = v.col.isNotNull() if v.kind != "null" else F.lit(False)
        if kind == "num":
            out = there & F.lit(v.numeric) if v.kind != "string" else number(v).isNotNull()
        elif kind == "int":
            out = there & F.lit(v.kind == "int") if v.kind != "string" else F.coalesce(v.col.rlike(r"^[+-]?\d+$"), F.lit(False))
        elif kind == "bool":
            out = there & F.lit(v.kind == "bool") if v.kind != "string" else F.coalesce(F.lower(v.col).isin("true", "false"), F.lit(False))
        elif kind == "str":
            out = there & F.lit(v.kind == "string")
        elif kind in ("array", "object"):
            first = r"^\s*\[" if kind == "array" else r"^\s*\{"
            out = there & F.lit(v.kind == "array" and kind == "array") if v.kind != "string" else F.coalesce(v.col.rlike(first) & F.try_parse_json(v.col).isNotNull(), F.lit(False))
        return Val(out, "bool")

    return make


def _typeof(c, args):
    need(args, 1, 1)
    v = c(args[0])
    if v.kind == "null":
        return Val(F.lit("null"), "string")
    name = {"time": "timestamp", "other": "object"}.get(v.kind, v.kind)
    out = F.when(v.col.isNull(), "null")
    if v.kind == "string":
        valid = F.try_parse_json(v.col).isNotNull()
        out = out.when(v.col.rlike(r"^\s*\[") & valid, "array").when(v.col.rlike(r"^\s*\{") & valid, "object")
    return Val(out.otherwise(name), "string")


# addresses
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)$"


def ipv4(c: Column) -> Column:
    return F.when(c.rlike(IPV4), F.aggregate(F.split(c, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.try_cast("long")))


def _ipmask(c, args):
    need(args, 2, 2)
    mask = int(ipaddress.IPv4Address(str(constant(args[0]))))
    n = ipv4(text(c(args[1]))).bitwiseAND(F.lit(mask))
    shown = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return Val(F.when(n.isNotNull(), shown), "string")


def _cidrmatch(c, args):
    need(args, 2, 2)
    ip = text(c(args[1]))
    try:
        net = ipaddress.ip_network(str(constant(args[0])), strict=False)
    except ValueError:
        raise QueryError(f"not a network: {constant(args[0])!r}") from None
    if net.version == 4:
        n = ipv4(ip).bitwiseAND(F.lit(int(net.netmask)))
        return Val(F.coalesce(n == F.lit(int(net.network_address)), F.lit(False)), "bool")

    @F.pandas_udf("boolean")
    def inside(ips: pd.Series) -> pd.Series:
        out = []
        for x in ips:
            try:
                out.append(ipaddress.ip_address(x) in net)
            except ValueError:
                out.append(False)
        return pd.Series(out)

    return Val(F.coalesce(inside(ip), F.lit(False)), "bool")


def _searchmatch(c, args):
    from ..lang.search import parse_search

    return Val(c.search(parse_search(str(constant(args[0])))), "bool")


def _now(c, args):
    """Seconds since the epoch; what the query's relative times count from, where that is given."""
    return Val(F.unix_seconds(F.lit(c.now).cast("timestamp_ntz").cast("timestamp")) if c.now else F.unix_seconds(F.current_timestamp()), "int")


def _eval(c, args):
    need(args, 1, 1)
    return c(args[0])


_trig = {n: _math(getattr(F, n), d) for n, d in {
    "acos": lambda x: F.abs(x) <= 1, "asin": lambda x: F.abs(x) <= 1, "acosh": lambda x: x >= 1, "atanh": lambda x: F.abs(x) < 1,
    "asinh": None, "atan": None, "cos": None, "cosh": None, "sin": None, "sinh": None, "tan": None, "tanh": None}.items()}

FUNCTIONS = {
    "if": _if, "case": _case, "validate": _validate, "coalesce": _coalesce, "null": lambda c, a: null(), "nullif": _nullif, "searchmatch": _searchmatch, "in": _in,
    "isnull": lambda c, a: Val(c(a[0]).col.isNull(), "bool"), "isnotnull": lambda c, a: Val(c(a[0]).col.isNotNull(), "bool"),
    "tonumber": _tonumber, "todouble": lambda c, a: Val(number(c(a[0])), "float"), "toint": lambda c, a: Val(number(c(a[0])).try_cast("long"), "int"),
    "tostring": lambda c, a: Val(text(c(a[0])), "string"), "tobool": _tobool, "printf": _printf, "ipmask": _ipmask, "round": _round,
    "ln": _math(F.ln, lambda x: x > 0), "log": _log, "exp": _math(F.exp), "pow": _pow, "sqrt": _math(F.sqrt, lambda x: x >= 0), **_trig,
    "atan2": _two(F.atan2), "hypot": _two(F.hypot), "pi": lambda c, a: Val(F.pi(), "float"), "random": lambda c, a: Val(F.floor(F.rand() * 2147483648).cast("long"), "int"),
    "abs": _keep_int(F.abs), "ceil": _keep_int(F.ceil), "ceiling": _keep_int(F.ceil), "floor": _keep_int(F.floor), "max": _extreme(False), "min": _extreme(True),
    "len": lambda c, a: Val(F.octet_length(text(c(a[0]))).cast("long"), "int"), "lower": _string(F.lower), "upper": _string(F.upper), "substr": _substr, "match": _match,
    "replace": _replace, "trim": _trim("b"), "ltrim": _trim("l"), "rtrim": _trim("r"), "urldecode": _string(F.try_url_decode), "split": _split,
    "startswith": _test(F.startswith), "endswith": _test(F.endswith), "contains": _test(F.contains), "like": _like, "ilike": _like,
    "md5": _string(lambda s: F.md5(s.cast("binary"))), "sha1": _string(lambda s: F.sha1(s.cast("binary"))), "sha256": _string(lambda s: F.sha2(s.cast("binary"), 256)), "sha512": _string(lambda s: F.sha2(s.cast("binary"), 512)),
    "strftime": _strftime, "strptime": _strptime, "mvappend": _mvappend, "mvjoin": _mvjoin, "mvdedup": _mvdedup, "mvcount": _mvcount,
    "json_extract": _json_extract, "spath": _json_extract, "json_valid": lambda c, a: Val(F.try_parse_json(text(c(a[0]))).isNotNull(), "bool"),
    "json_keys": lambda c, a: Val(F.json_object_keys(_at(c, a)), "array"), "json_array_length": lambda c, a: Val(F.json_array_length(_at(c, a)).cast("long"), "int"),
    "json_object": _json_object, "json_array": _json_array, "json_type": _json_type, "json_set": _json_set, "json_remove": _json_remove, "json_merge": _json_merge,
    "isnum": _is("num"), "isint": _is("int"), "isbool": _is("bool"), "isarray": _is("array"), "isobject": _is("object"), "isstr": _is("str"), "typeof": _typeof,
    "cidrmatch": _cidrmatch, "eval": _eval, "now": _now, "time": _now,
}

"""Filters, projections and other operators that look at one row at a time."""

from __future__ import annotations

import fnmatch
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, times
from ..functions.compiler import Compiler
from ..functions.patterns import glob_to_regex, is_glob, named_groups, required_literal
from ..lang.ast import QueryError


def c_(name: str) -> Column:
    return F.col(f"`{name}`")


def where(df: DataFrame, expr) -> DataFrame:
    return df.filter(Compiler(df).condition(expr))


def search(df: DataFrame, tree) -> DataFrame:
    return df if tree is None else df.filter(Compiler(df).search(tree))


def time_bounds(df: DataFrame, earliest: datetime | None, latest: datetime | None) -> DataFrame:
    """Both ends belong to the range. A plain comparison, so that it reaches the scan."""
    kind = df.schema["_time"].dataType if "_time" in df.columns else None
    if kind is None:
        return df
    cast = "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"
    if earliest is not None:
        df = df.filter(F.col("_time") >= F.lit(earliest).cast("timestamp_ntz").cast(cast))
    if latest is not None:
        df = df.filter(F.col("_time") <= F.lit(latest).cast("timestamp_ntz").cast(cast))
    return df


def regex(df: DataFrame, field: str, pattern: str, negated: bool = False) -> DataFrame:
    c = Compiler(df)
    v = c.raw() if field == "_raw" else coerce.text(c.field(field))
    hit = c.regex(v, pattern)
    return df.filter(~hit if negated else hit)


def evaluate(df: DataFrame, assign: list) -> DataFrame:
    """Later assignments see earlier ones."""
    for name, expr in assign:
        v = Compiler(df)(expr)
        df = df.withColumn(name, v.col.cast("string") if v.kind == "null" else v.col)
    return df


def _expand(df: DataFrame, names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        found = [x for x in df.columns if fnmatch.fnmatchcase(x, n)] if is_glob(n) else [n]
        out += [x for x in found if x not in out]
    return out


def fields(df: DataFrame, names: list[str], drop: bool = False) -> DataFrame:
    """Keep or drop columns; globs are allowed; an unknown name makes a null column."""
    names = _expand(df, names)
    if drop:
        return df.drop(*names)
    c = Compiler(df)
    return df.select(*[c.field(n).col.alias(n) for n in names])


def table(df: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    c, out = Compiler(df), []
    for n, alias in names:
        out += [c_(x) for x in _expand(df, [n])] if is_glob(n) else [c.field(n).col.alias(alias)]
    return df.select(*out)


def rename(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A renamed column replaces one that already has its new name."""
    for old, new in pairs:
        if old in df.columns and old != new:
            df = df.drop(new).withColumnRenamed(old, new)
    return df


def rex(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """Named groups of the first match become columns; without a match a column that existed keeps its value."""
    java, names = named_groups(pattern)
    if not names:
        raise QueryError("rex needs a named group")
    c = Compiler(df)
    s = c.raw() if field == "_raw" and "_raw" not in df.columns else coerce.text(c.field(field))
    hit, part = s.rlike(java), required_literal(pattern)
    hit = F.contains(s, F.lit(part)) & hit if part else hit
    cols = {n: F.when(hit, F.regexp_extract(s, java, i)).otherwise(coerce.text(c.field(n)) if n in df.columns else F.lit(None).cast("string")) for n, i in names}
    return df.withColumns(cols)


def replace(df: DataFrame, pairs: list[tuple[str, str]], names: list[str] | None = None) -> DataFrame:
    """Whole values are replaced; a * in the old value matches anything, and in the new one takes what it matched."""
    names = names or [n for n in df.columns if not n.startswith("_")]
    c, cols = Compiler(df), {}
    for n in names:
        if n not in df.columns:
            continue
        v = c.field(n)
        s = coerce.text(v)
        out = F.when(F.lit(False), s)
        for old, new in pairs:
            if "*" in old:
                groups = glob_to_regex(old).replace(".*", "(.*)")
                filled, i = "", 0
                for ch in new:
                    if ch == "*":
                        i += 1
                        filled += f"${{{i}}}"
                    else:
                        filled += "\\" + ch if ch in "\\$" else ch
                out = out.when(s.rlike(f"(?s)^{groups}$"), F.regexp_replace(s, f"(?s)^{groups}$", filled.replace("${", "$").replace("}", "") if i else filled))
            else:
                out = out.when(s == F.lit(old), F.lit(new))
        cols[n] = out.otherwise(s)
    return df.withColumns(cols) if cols else df


def fillnull(df: DataFrame, value: str = "", names: list[str] | None = None) -> DataFrame:
    """Nulls get the value, as a number where the column is one and the value too; missing columns are made."""
    cols = {}
    c = Compiler(df)
    for n in names or df.columns:
        if n not in df.columns:
            cols[n] = F.lit(value)
            continue
        v = c.field(n)
        if v.numeric:
            try:
                number = float(value)
                whole = v.kind == "int" and number.is_integer()
                cols[n] = F.coalesce(v.col, F.lit(int(number) if whole else number).cast("long" if whole else "double"))
                continue
            except ValueError:
                pass
        if v.kind == "bool" and value.lower() in ("true", "false"):
            cols[n] = F.coalesce(v.col, F.lit(value.lower() == "true"))
            continue
        cols[n] = F.coalesce(coerce.text(v), F.lit(value))
    return df.withColumns(cols)


def bucket(df: DataFrame, field: str, span: str) -> Column:
    """The start of the value's bucket: time spans from the epoch (months by calendar), number spans from 0."""
    v = Compiler(df).field(field)
    if v.kind == "time":
        if n := times.months(span):
            month = F.year(v.col) * 12 + F.month(v.col) - 1
            first = month - month % n
            return F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
        width = times.micros(span)
        return _floor_time(v.col, width, df.schema[field].dataType if field in df.columns else None)
    if v.kind == "string" and not span.replace(".", "", 1).isdigit():  # times as text
        return _floor_time(v.col.try_cast("timestamp"), times.micros(span), None)
    n = coerce.number(v)
    width = float(span) if span.replace(".", "", 1).isdigit() else None
    if width is None:
        return v.col
    if width <= 0:
        raise QueryError("a span must be positive")
    low = F.floor(n / width)
    return (low * int(width)).cast("long") if v.kind == "int" and width.is_integer() else low * width


def _floor_time(c: Column, width: int, kind: T.DataType | None) -> Column:
    us = coerce.micros(c)
    start = F.timestamp_micros(us - F.pmod(us, F.lit(width)))
    return start if isinstance(kind, T.TimestampType) else start.cast("timestamp_ntz")


def bin_(df: DataFrame, field: str, span: str = "1h", alias: str | None = None) -> DataFrame:
    v = Compiler(df).field(field)
    if v.kind == "null":
        return df
    return df.withColumn(alias or field, bucket(df, field, span))


def json(df: DataFrame, field: str = "_raw", paths: list[tuple[str, str]] | None = None, limit: int = 10_000) -> DataFrame:
    """Paths become columns; without paths, all scalar keys of all rows do, nested ones dotted."""
    from ..functions.scalar import json_path

    s = coerce.text(Compiler(df).field(field))
    if not paths:
        paths = [(p, p) for p in json_keys(df, s, limit)]
    return df.withColumns({alias: F.get_json_object(s, json_path(p)) for p, alias in paths}) if paths else df


def json_keys(df: DataFrame, s: Column, limit: int = 10_000) -> list[str]:
    """Dotted paths of the scalars (and arrays) in all documents that are objects, sorted."""
    rows = df.select(F.try_parse_json(s).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT<"))
    schema = rows.agg(F.schema_of_variant_agg("v").alias("s")).first()
    found = schema["s"] if schema else None
    paths = sorted(_variant_paths(found)) if found and found.startswith("OBJECT<") else []
    if len(paths) > limit:
        raise QueryError(f"the documents have more than {limit} different keys")
    return paths


def _variant_paths(text: str, prefix: str = "") -> list[str]:
    out, body = [], text[len("OBJECT<") : -1]
    depth, start, quoted = 0, 0, False
    parts = []
    for i, ch in enumerate(body):
        if ch == "`":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth == 0:
                parts.append(body[start:i])
                start = i + 1
    parts.append(body[start:])
    for p in parts:
        name, _, kind = p.strip().partition(": ")
        name = name.strip("`")
        if kind.startswith("OBJECT<"):
            out += _variant_paths(kind, f"{prefix}{name}.")
        elif name:
            out.append(prefix + name)
    return out


def pack(df: DataFrame, names: list[str], into: str) -> DataFrame:
    """A JSON object of the fields that are not null; all but internal ones if none are named."""
    names = _expand(df, names) if names else [n for n in df.columns if not n.startswith("_")]
    return df.withColumn(into, F.to_json(F.struct(*[c_(n) for n in names if n in df.columns])))

"""Multivalues: expanding, splitting, joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.compiler import Compiler
from ..functions.patterns import java_regex, quote
from ..functions.scalar import array
from .rows import json_keys


def _values(df: DataFrame, name: str):
    """The field as an array of strings: an array column, or a JSON array; null otherwise (also for empty ones)."""
    v = Compiler(df).field(name)
    a = v.col.cast("array<string>") if v.kind == "array" else F.from_json(coerce.text(v), T.ArrayType(T.StringType()))
    if v.kind != "array":
        a = F.when(coerce.text(v).rlike(r"^\s*\["), a)
    return F.when(F.size(a) > 0, a)


def unroll(df: DataFrame, names: list[str], limit: int | None = None, alias: str | None = None, spread: bool = True) -> DataFrame:
    """A row for each element; rows whose field is no array, or empty, stay as they are. Several fields are expanded side by
    side where their arrays are equally long. Keys of elements that are objects become columns field.key."""
    arrays = [_values(df, n) for n in names]
    if limit:
        arrays = [F.slice(a, 1, limit) for a in arrays]
    temp = [f"_a{i}" for i in range(len(names))]
    d = df.withColumns(dict(zip(temp, arrays, strict=True)))
    same = F.lit(True)
    for t in temp:
        same = same & F.col(t).isNotNull() & (F.size(t) == F.size(temp[0]))
    z = F.when(same, F.arrays_zip(*temp))
    d = d.withColumn("_z", F.explode_outer(z))
    cols = {}
    for n, t in zip(names, temp, strict=True):
        old = coerce.text(Compiler(df).field(n))
        cols[alias if alias and len(names) == 1 else n] = F.when(F.col("_z").isNotNull(), F.col(f"_z.{t}")).otherwise(old)
    d = d.withColumns(cols).drop("_z", *temp)
    if not spread:
        return d
    for n in cols:
        s = F.col(f"`{n}`")
        keys = json_keys(d.where(s.rlike(r"^\s*\{")), s)
        if keys:
            d = d.withColumns({f"{n}.{k}": F.get_json_object(s, "$" + "".join(f"['{x}']" for x in k.split("."))) for k in keys})
    return d


def makemv(df: DataFrame, field: str, delim: str = " ", tokenizer: str | None = None, allowempty: bool = False) -> DataFrame:
    s = coerce.text(Compiler(df).field(field))
    if tokenizer:
        java = java_regex(tokenizer)
        a = F.regexp_extract_all(s, F.lit(java), F.lit(1 if "(" in java.replace("\\(", "").replace("(?:", "") else 0))
    else:
        a = F.split(s, quote(delim), -1)
    return df.withColumn(field, a if allowempty else F.filter(a, lambda x: x != ""))


def mvcombine(df: DataFrame, field: str) -> DataFrame:
    """Rows that agree in all other columns become one; its values are sorted."""
    others = [n for n in df.columns if n != field]
    v = array(Compiler(df).field(field))
    r = df.withColumn(field, v).groupBy(*[F.col(f"`{n}`") for n in others]).agg(F.array_sort(F.flatten(F.collect_list(F.col(f"`{field}`")))).alias(field))
    return r.select(*[F.col(f"`{n}`") for n in df.columns])


def nomv(df: DataFrame, field: str) -> DataFrame:
    """Values joined by line feeds."""
    v = Compiler(df).field(field)
    a = _values(df, field)
    return df.withColumn(field, F.when(a.isNotNull(), F.array_join(a, "\n")).otherwise(coerce.text(v)))

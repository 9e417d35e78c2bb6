"""Joins, unions and comparisons of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.compiler import Compiler
from .order import Order, columns


def join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", lookup: bool = False) -> DataFrame:
    """Equality on one field, as strings where the types differ; nulls match nothing; left columns win clashes.

    No side is broadcast by force: the engine does so where it knows a side to be small.
    """
    a, b = Compiler(left).field(key), Compiler(right).field(key)
    if a.kind == "null" or b.kind == "null":
        right = right.limit(0)
    same = (a.kind, b.kind) if a.kind == b.kind else None
    right_key = (b.col if same else coerce.text(b)).alias("_right_key")
    extra = [n for n in right.columns if n not in left.columns and n != key]
    r = right.select(right_key, *[F.col(f"`{n}`") for n in extra])
    left_key = a.col if same else coerce.text(a)
    out = left.withColumn("_left_key", left_key).join(r, F.col("_left_key") == F.col("_right_key"), {"inner": "inner", "left": "left", "outer": "full"}[how])
    shown = [F.coalesce(F.col(f"`{n}`").cast("string") if not same else F.col(f"`{n}`"), F.col("_right_key")).alias(n) if n == key and how == "outer" else F.col(f"`{n}`") for n in left.columns]
    return out.select(*shown, *[F.col(f"`{n}`") for n in extra])


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name; columns of different types become strings, and columns differ in any way."""
    kinds: dict[str, T.DataType] = {}
    for p in parts:
        for f in p.schema.fields:
            had = kinds.get(f.name)
            if had is None or isinstance(had, T.NullType):
                kinds[f.name] = f.dataType
            elif had != f.dataType and not isinstance(f.dataType, T.NullType):
                number = isinstance(had, T.NumericType) and isinstance(f.dataType, T.NumericType)
                kinds[f.name] = T.DoubleType() if number and isinstance(T.DoubleType(), type(had)) or number and isinstance(f.dataType, T.DoubleType) else T.LongType() if number else T.StringType()
    out = []
    for p in parts:
        have = {f.name: f.dataType for f in p.schema.fields}
        cols = []
        for n, t in kinds.items():
            c: Column = F.col(f"`{n}`") if n in have else F.lit(None)
            if n in have and have[n] != t and isinstance(t, T.StringType):
                c = coerce.text(coerce.Val(c, coerce.kind_of(have[n])))
            cols.append(c.cast(t).alias(n))
        out.append(p.select(*cols))
    return reduce(DataFrame.unionAll, out)


def appendcols(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order, override: bool = False, maxout: int | None = None) -> DataFrame:
    """Rows side by side by position; internal fields of the right are left out, as are its rows beyond the left's."""
    if maxout:
        right = right.orderBy(*columns(right, right_order)).limit(maxout)
    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.orderBy(*columns(df, o))))
    a, b = number(left, left_order), number(right, right_order)
    take = [n for n in right.columns if not n.startswith("_") and (override or n not in left.columns)]
    b = b.select("_n", *[F.col(f"`{n}`").alias(f"_new_{n}") for n in take])
    j = a.join(b, "_n", "left")
    cols = [F.coalesce(F.col(f"`_new_{n}`"), F.col(f"`{n}`")).alias(n) if n in take else F.col(f"`{n}`") for n in left.columns]
    return j.select(*cols, *[F.col(f"`_new_{n}`").alias(n) for n in take if n not in left.columns])


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """now with previous_X and change_X for each numeric X, matched on all other columns (null matches null)."""
    numeric = [f.name for f in now.schema.fields if isinstance(f.dataType, T.NumericType)]
    keys = [n for n in now.columns if n not in numeric and n in before.columns]
    b = before.select(*[F.col(f"`{n}`").alias(f"_k_{n}") for n in keys], *[F.col(f"`{n}`").alias(f"previous_{n}") for n in numeric if n in before.columns])
    if keys:
        cond = reduce(lambda x, y: x & y, [now[f"`{n}`"].eqNullSafe(F.col(f"`_k_{n}`")) for n in keys])
        j = now.join(b, cond, "left")
    else:
        j = now.join(F.broadcast(b.limit(1)), F.lit(True), "left")
    j = j.drop(*[f"_k_{n}" for n in keys])
    return j.withColumns({f"change_{n}": F.col(f"`{n}`") - F.col(f"`previous_{n}`") for n in numeric if n in before.columns})

"""Grouping, time charts, roll-ups and the window family."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce, times
from ..functions.aggregates import compile_aggregate
from ..functions.compiler import Compiler
from ..lang.ast import Agg, QueryError
from .order import Order, columns
from .rows import bucket


def stats(df: DataFrame, aggs: list[Agg], by: list[str], order: Order | None = None, span: float | None = None) -> DataFrame:
    """One row per group (null is a group); one row of all rows without `by`."""
    c = Compiler(df)
    levels: dict = {}
    for a in aggs:
        if a.level is not None and a.level not in levels.setdefault(a.args, []):
            levels[a.args].append(a.level)
    keys = [c.field(n).col.alias(n) for n in by]
    column = lambda a: compile_aggregate(a, c, order or [], span=span, levels=levels).alias(a.alias)
    # beside a distinct count all others are kept for each of its values, and a sketch takes 13 KB
    apart = [a for a in aggs if a.func == "estdc"] if any(a.func in ("dc", "distinct_count") for a in aggs) else []
    if not apart or len({a.alias for a in aggs} | set(by)) < len(aggs) + len(by):
        return df.groupBy(*keys).agg(*[column(a) for a in aggs])
    exact = df.groupBy(*keys).agg(*[column(a) for a in aggs if a not in apart])
    names = [f"__key_{i}" for i in range(len(by))]
    sketched = df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[column(a) for a in apart])
    if by:
        same = [exact[f"`{n}`"].eqNullSafe(F.col(k)) for n, k in zip(by, names, strict=True)]
        both = exact.join(sketched, reduce(and_, same), "left")
    else:
        both = exact.crossJoin(F.broadcast(sketched))
    return both.select(*[F.col(f"`{n}`") for n in [*by, *[a.alias for a in aggs]]])


def timechart(df: DataFrame, span: str, aggs: list[Agg], by: list[str], order: Order | None = None) -> DataFrame:
    """Long form, in order of time and group; empty buckets are left out."""
    width = None if times.months(span) else times.micros(span) / 1e6
    d = df.withColumn("_time", bucket(df, "_time", span))
    # aggregates that read _time need the original
    needs = {"earliest", "latest", "earliest_time", "latest_time", "rate", "first", "last", "list"}
    if any(a.func in needs for a in aggs):
        d = df.withColumn("_bucket", bucket(df, "_time", span))
        r = stats(d, aggs, ["_bucket", *by], order, width).withColumnRenamed("_bucket", "_time")
    else:
        r = stats(d, aggs, ["_time", *by], order, width)
    return r.orderBy(F.col("_time").asc_nulls_first(), *[F.col(f"`{n}`").asc_nulls_first() for n in by])


def pivot_values(df: DataFrame, col: str, limit: int = 10_000) -> list[str]:
    """Distinct values of a column that becomes columns, sorted; more than the limit is an error."""
    found = [r[0] for r in df.select(F.col(col).cast("string")).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise QueryError(f"{col} has more than {limit} different values; they would all become columns")
    return sorted(found)


def chart(df: DataFrame, aggs: list[Agg], keys: list[str], order: Order | None = None) -> DataFrame:
    """Rows by the first key; a second one makes columns if there is one aggregate, and a column otherwise."""
    if len(keys) < 2 or len(aggs) > 1:
        return stats(df, aggs, keys, order)
    long = stats(df, aggs, keys[:2], order)
    c = Compiler(long)
    long = long.select(F.col(f"`{keys[0]}`"), coerce.text(c.field(keys[1])).alias("_y"), F.col(f"`{aggs[0].alias}`").alias("_v"))
    return long.groupBy(f"`{keys[0]}`").pivot("_y", pivot_values(long, "_y")).agg(F.first("_v")).orderBy(F.col(f"`{keys[0]}`").asc_nulls_first())


def rollup(df: DataFrame, spans: list[str], by: list[str]) -> DataFrame:
    """Counts at several resolutions in one pass: each row is expanded by span, then combined before the shuffle."""
    c = Compiler(df)
    stacks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("_resolution"), bucket(df, "_time", s).alias("_bucket")) for i, s in enumerate(spans)])
    d = df.select(F.explode(stacks).alias("r"), *[c.field(n).col.alias(n) for n in by])
    keys = [f"`{n}`" for n in by]
    position = "__order_span"
    r = d.groupBy(F.col("r.i").alias(position), F.col("r._resolution").alias("_resolution"), F.col("r._bucket").alias("_bucket"), *keys).agg(F.count(F.lit(1)).alias("count"))
    return r.orderBy(position, "_bucket", *[F.col(k).asc_nulls_first() for k in keys])


def eventstats(df: DataFrame, aggs: list[Agg], by: list[str], order: Order | None = None) -> DataFrame:
    """Every row gets its group's aggregates.

    The groups are aggregated (combined before the shuffle) and joined back, so that a group of any size is never
    collected in one task, as a window would; null keys match each other.
    """
    c = Compiler(df)
    names = [f"_g{i}" for i in range(len(by))]
    groups = stats(df, aggs, by, order)
    groups = groups.toDF(*names, *[f"_a{i}" for i in range(len(aggs))])
    replaced = {a.alias for a in aggs}
    if by:
        cond = None
        for n, g in zip(by, names, strict=True):
            one = c.field(n).col.eqNullSafe(F.col(g))
            cond = one if cond is None else cond & one
        joined = df.join(groups, cond, "left")
    else:
        joined = df.crossJoin(F.broadcast(groups))
    return joined.select(*[F.col(f"`{n}`") for n in df.columns if n not in replaced], *[F.col(f"_a{i}").alias(a.alias) for i, a in enumerate(aggs)])


def streamstats(df: DataFrame, aggs: list[Agg], by: list[str], order: Order, window: int = 0, current: bool = True) -> DataFrame:
    """Running aggregates in row order: of all rows so far or the last `window`; current=False leaves out the row itself."""
    c = Compiler(df)
    w = Window.partitionBy(*[c.field(n).col for n in by]).orderBy(*columns(df, order))
    low = Window.unboundedPreceding if window <= 0 else (-(window - 1) if current else -window)
    w = w.rowsBetween(low, 0 if current else -1)
    cols = {a.alias: compile_aggregate(a, c, order, over=lambda x: x.over(w), windowed=True, ordered_window=True) for a in aggs}
    return df.withColumns(cols)

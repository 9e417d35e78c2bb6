"""Aggregates as columns, for groupBy and for windows alike.

`over` is applied to each atomic aggregate: identity for groups, ``.over(window)`` for windows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Agg, Call, QueryError
from . import coerce
from .coerce import Val
from .compiler import Compiler

#: Relative standard error of estdc: that of 2^14 registers.
ESTDC_ERROR = 1.04 / 2**7
PER = {"per_second": 1.0, "per_minute": 60.0, "per_hour": 3600.0, "per_day": 86400.0}


def _argument(c: Compiler, a: Agg) -> Val:
    if len(a.args) != 1:
        raise QueryError(f"{a.func} needs one argument")
    arg = a.args[0]
    v = c(arg)
    if isinstance(arg, Call) and arg.name == "eval" and v.kind == "bool":
        return Val(F.when(v.col, True), "bool")  # false is skipped
    return v


def extreme_key(v: Val) -> Column:
    """What min and max compare. Strings compare as numbers where they are numbers, which come before other strings."""
    if v.kind != "string":
        return v.col
    n = coerce.number(v)
    return F.when(v.col.isNotNull(), F.struct(n.isNull().alias("word"), n.alias("n"), v.col.alias("s")))


def _extreme(v: Val, least: bool, over) -> Column:
    got = over((F.min if least else F.max)(extreme_key(v)))
    return got["s"] if v.kind == "string" else got


def order_key(order: list[tuple[str, bool]], c: Compiler) -> Column | None:
    """One comparable value for the row order: descending numbers and times are negated."""
    parts = []
    for name, desc in order:
        v = c.field(name)
        if v.kind == "null":
            continue
        if not desc:
            parts.append(v.col)
        elif v.kind in ("int", "float"):
            parts.append(-v.col)
        elif v.kind == "time":
            parts.append(-coerce.micros(v.col))
        else:
            break
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]) if parts else None


def compile_aggregate(a: Agg, c: Compiler, order: list[tuple[str, bool]], over=lambda x: x, windowed: bool = False, span: float | None = None, ordered_window: bool = False, levels: dict | None = None) -> Column:
    f = a.func
    if f == "count" and not a.args:
        return over(F.count(F.lit(1)))
    if f in ("earliest_time", "latest_time"):
        t = c.field("_time")
        return coerce.epoch(over((F.min if f == "earliest_time" else F.max)(t.col)))
    v = _argument(c, a)
    if f == "count":
        return over(F.count(v.col)) if v.kind != "null" else over(F.count(F.lit(None).cast("int")))
    if v.kind == "null":
        v = Val(F.lit(None).cast("double"), "float")
    x = coerce.number(v)
    if f == "sum":
        return F.coalesce(over(F.sum(x)), F.lit(0.0))
    if f in PER:
        return F.coalesce(over(F.sum(x)), F.lit(0.0)) * F.lit(PER[f] / span if span else 1.0)
    if f == "sumsq":
        return F.coalesce(over(F.sum(x * x)), F.lit(0.0))
    if f in ("avg", "mean"):
        return over(F.avg(x))
    if f in ("min", "max"):
        return _extreme(v, f == "min", over)
    if f == "range":
        return over(F.max(x)) - over(F.min(x))
    if f in ("dc", "distinct_count", "estdc"):
        shown = v.col if v.kind != "array" else coerce.text(v)
        if windowed:
            return F.size(over(F.collect_set(shown))).cast("long")
        return over(F.approx_count_distinct(shown, ESTDC_ERROR)) if f == "estdc" else over(F.count_distinct(shown))
    if f == "estdc_error":
        return F.when(over(F.count(v.col)) > 0, F.lit(ESTDC_ERROR)).otherwise(0.0)
    if f == "values":
        return F.array_sort(over(F.collect_set(coerce.text(v))))
    if f == "list":
        k = order_key(order, c)
        if k is None or ordered_window:
            return over(F.collect_list(coerce.text(v)))
        s = over(F.collect_list(F.when(v.col.isNotNull(), F.struct(k.alias("k"), coerce.text(v).alias("v")))))
        return F.transform(F.array_sort(s), lambda e: e["v"])
    if f == "mode":
        if windowed:
            s = over(F.collect_list(coerce.text(v)))
            counted = F.transform(F.array_distinct(s), lambda e: F.struct((-F.size(F.filter(s, lambda y: y == e))).alias("n"), e.alias("v")))
            return F.get(F.array_sort(counted), 0)["v"]
        return over(F.mode(coerce.text(v), True))
    if f in ("first", "last"):
        if ordered_window:
            return over((F.first if f == "first" else F.last)(v.col, ignorenulls=True))
        k = order_key(order, c)
        if k is None:
            return over((F.min if f == "first" else F.max)(v.col))  # without an order any value would do; this one is stable
        return over((F.min_by if f == "first" else F.max_by)(v.col, F.when(v.col.isNotNull(), k)))
    if f in ("earliest", "latest"):
        return over((F.min_by if f == "earliest" else F.max_by)(v.col, F.when(v.col.isNotNull(), c.field("_time").col)))
    if f == "rate":
        t = F.when(x.isNotNull(), c.field("_time").col)
        d = coerce.epoch(over(F.max(t))) - coerce.epoch(over(F.min(t)))
        return F.when(d > 0, (over(F.max_by(x, t)) - over(F.min_by(x, t))) / d)
    if f in ("stdev", "var"):
        return over((F.stddev_samp if f == "stdev" else F.var_samp)(x))
    if f in ("stdevp", "varp"):
        return over((F.stddev_pop if f == "stdevp" else F.var_pop)(x))
    if a.level is not None:
        together = (levels or {}).get(a.args, [])
        if len(together) > 1:  # one pass over the values for all levels of a field
            return F.get(over(F.percentile(x, F.array(*[F.lit(p) for p in together]))), together.index(a.level))
        return over(F.percentile(x, F.lit(a.level)))
    raise QueryError(f"unknown aggregate {f}")

"""Sorting, limits, top values and deduplication."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.compiler import Compiler

Order = list[tuple[str, bool]]


def _sortable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType))


def columns(df: DataFrame, order: Order, total: bool = True, flip: bool = False) -> list[Column]:
    """Sort columns: numeric strings by number, nulls smallest. For a total order ties are broken by the rows' place in
    their files (PLACE) where it is known, so that no other columns are read; else by all other columns. flip: the exact
    opposite."""
    c, out, used = Compiler(df), [], set()
    for name, desc in order:
        v = c.field(name)
        if v.kind == "null" or name in used:
            continue
        used.add(name)
        keys = [coerce.number(v).isNull() & v.col.isNotNull(), coerce.number(v), v.col] if v.kind == "string" else [v.col]
        if v.kind == "string":  # null first, then numbers, then words
            keys = [v.col.isNotNull(), *keys]
        out += [k.desc_nulls_last() if desc != flip else k.asc_nulls_first() for k in keys]
    if total and PLACE in df.columns:
        out += [F.col(PLACE).desc_nulls_last() if flip else F.col(PLACE).asc_nulls_first()]
    elif total:
        ties = [F.col(f"`{f.name}`") for f in sorted(df.schema.fields, key=lambda f: f.name) if f.name not in used and _sortable(f.dataType) and not f.name.startswith(HIDDEN)]
        ties += [F.col(n) for n in df.columns if n.startswith(HIDDEN) and n not in used]
        out += [t.desc_nulls_last() if flip else t.asc_nulls_first() for t in ties]
    return out


#: Columns that only keep a row order; results do not show them.
HIDDEN = "__order_"
#: The position of a row in its file, where a source keeps it.
POSITION = "__order_in"
#: File and row number of a row of Parquet files, which break ties only.
PLACE = "__order_place"


def placed(df: DataFrame) -> DataFrame:
    """df with PLACE if it is a plain scan of Parquet files."""
    try:
        return df.withColumn(PLACE, F.struct("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return df


def default_order(df: DataFrame) -> Order:
    """The order of the file where it is known, else newest first."""
    if POSITION in df.columns:
        return [(POSITION, False)]
    return [("_time", True)] if "_time" in df.columns else []


def sort(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*columns(df, order))


def head(df: DataFrame, order: Order, n: int = 10, offset: int = 0) -> DataFrame:
    df = df.orderBy(*columns(df, order)) if df.columns else df
    return (df.offset(offset) if offset else df).limit(n)


def offset(df: DataFrame, order: Order, n: int) -> DataFrame:
    return df.orderBy(*columns(df, order)).offset(n)


def tail(df: DataFrame, order: Order, n: int = 10) -> DataFrame:
    """The last n rows, in input order: the first n of the opposite order, sorted back."""
    return df.orderBy(*columns(df, order, flip=True)).limit(n).orderBy(*columns(df, order))


def reverse(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*columns(df, order, flip=True))


def dedup(df: DataFrame, order: Order, names: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each key in input order; a null is a key like others."""
    c = Compiler(df)
    w = Window.partitionBy(*[c.field(x).col for x in names]).orderBy(*columns(df, order))
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")


def top(df: DataFrame, field: str, n: int = 10, by: str | None = None, rare: bool = False) -> DataFrame:
    """Values by count, with their percentage of all rows (missing values count there); n rows overall."""
    c = Compiler(df)
    keys = [coerce.text(c.field(x)).alias(x) for x in ([field] + ([by] if by else []))]
    d = df.select(*keys)
    total = d.agg(F.count(F.lit(1)).alias("_total"))
    counts = d.where(F.col(f"`{field}`").isNotNull()).groupBy(*[f"`{x}`" for x in ([field] + ([by] if by else []))]).agg(F.count(F.lit(1)).alias("count"))
    r = counts.crossJoin(F.broadcast(total)).withColumn("percent", F.col("count") * 100.0 / F.col("_total")).drop("_total")
    ties = [F.col(f"`{x}`").asc_nulls_first() for x in ([field] + ([by] if by else []))]
    return r.orderBy(F.col("count").asc() if rare else F.col("count").desc(), *ties).limit(n)

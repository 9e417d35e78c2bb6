"""Sessions and transactions: rows of a key, parted by gaps, spans or markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, times
from ..functions.compiler import Compiler
from ..lang.search import parse_search
from .order import columns


def sessionize(df: DataFrame, maxpause: str = "30m", by: list[str] | None = None) -> DataFrame:
    """_session_id (numbered in order of group and start), _session_start and _session_end; a longer pause parts sessions."""
    c, by = Compiler(df), by or []
    keys = [c.field(n).col for n in by]
    time = coerce.micros(c.field("_time").col)
    w = Window.partitionBy(*keys).orderBy(*columns(df, [("_time", False)]))
    starts = F.coalesce((time - F.lag(time).over(w) > times.micros(maxpause)).cast("int"), F.lit(1))
    d = df.withColumn("_seg", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*keys, F.col("_seg"))
    d = d.withColumns({"_session_start": F.min("_time").over(s), "_session_end": F.max("_time").over(s)})
    # the running number of a session comes from the table of groups, which is small beside the rows
    groups = d.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_seg").alias("_n"))
    order = [F.col(f"_k{i}").asc_nulls_first() for i in range(len(keys))] or [F.lit(1)]
    base = groups.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    if keys:
        cond = None
        for i, k in enumerate(keys):
            one = k.eqNullSafe(F.col(f"_k{i}"))
            cond = one if cond is None else cond & one
        d = d.join(base, cond, "left")
    else:
        d = d.crossJoin(F.broadcast(base))
    d = d.withColumn("_session_id", (F.col("_before") + F.col("_seg")).cast("long"))
    return d.select(*[F.col(f"`{n}`") for n in df.columns], "_session_id", "_session_start", "_session_end")


def transaction(df: DataFrame, names: list[str], maxspan: str | None = None, maxpause: str | None = None, startswith: str | None = None, endswith: str | None = None) -> DataFrame:
    """A row for each transaction of a key: eventcount, duration (seconds), the first _time, joined _raw, and the other
    fields of its first event. A start marker opens a transaction, an end marker closes one; a pause above maxpause
    or an event later than maxspan after the opening starts another."""
    c = Compiler(df)
    keys = [c.field(n).col for n in names]
    w = Window.partitionBy(*keys).orderBy(*columns(df, [("_time", False)]))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    time = coerce.micros(c.field("_time").col)
    new = F.lag(time).over(w).isNull()
    if maxpause:
        new = new | (time - F.lag(time).over(w) > times.micros(maxpause))
    if startswith:
        new = new | c.search(parse_search(_quoted(startswith)))
    if endswith:
        new = new | F.lag(c.search(parse_search(_quoted(endswith)))).over(w)
    d = df.withColumn("_seg", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(run))
    d = _spans(d, keys, times.micros(maxspan)) if maxspan else d.withColumn("_part", F.lit(0))
    us = coerce.micros(F.col("_time"))
    rest = [n for n in df.columns if n not in names and n not in ("_time", "_raw")]
    ordered = F.struct(us.alias("t"), F.xxhash64(*[F.col(f"`{n}`").cast("string") for n in df.columns]).alias("h"))
    aggs = [F.count(F.lit(1)).alias("eventcount"), ((F.max(us) - F.min(us)) / 1e6).alias("duration"), F.min("_time").alias("_time")]
    if "_raw" in df.columns:
        lines = F.array_sort(F.collect_list(F.struct(us.alias("t"), F.col("_raw").alias("r"))))
        aggs.append(F.array_join(F.transform(lines, lambda x: x["r"]), "\n").alias("_raw"))
    aggs += [F.min_by(F.col(f"`{n}`"), ordered).alias(n) for n in rest]
    r = d.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)], "_seg", "_part").agg(*aggs)
    return r.drop("_seg", "_part")


def _spans(d: DataFrame, keys: list, width: int) -> DataFrame:
    """_part: number of the transaction within (key, _seg), where none is longer than width.

    Where a part begins depends on where the last one began, so rows sorted by key and time are walked once; the walk
    holds one batch and one start.
    """
    d = d.withColumns({"_key": F.xxhash64(*keys, F.col("_seg")), "_us": coerce.micros(F.col("_time"))})
    schema = T.StructType([*d.schema.fields, T.StructField("_part", T.IntegerType())])

    def walk(batches):
        last, start, part = None, 0, 0
        for pdf in batches:
            parts = []
            for k, t in zip(pdf["_key"].tolist(), pdf["_us"].tolist(), strict=True):
                if k != last:
                    last, start, part = k, t, 0
                elif t - start > width:
                    start, part = t, part + 1
                parts.append(part)
            yield pdf.assign(_part=parts)

    return d.repartition("_key").sortWithinPartitions("_key", "_us").mapInPandas(walk, schema).drop("_key", "_us")


def _quoted(text: str) -> str:
    return text if any(x in text for x in "=<>(") else '"' + text.replace('"', '\\"') + '"'

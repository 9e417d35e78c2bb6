"""Results to files and to text; storage upkeep."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, times
from ..lang.ast import QueryError

FORMATS = "auto table json ndjson csv tsv raw box markdown vertical line".split()
#: Columns shown first.
FIRST = ("_time", "_raw", "index", "_source", "_sourcetype", "source", "sourcetype", "host")


def tee(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows as JSON lines and passes them on."""
    df.write.mode("overwrite").json(path)
    return df


def ordered(df: DataFrame) -> DataFrame:
    names = [n for n in FIRST if n in df.columns]
    return df.select(*[F.col(f"`{n}`") for n in names + [n for n in df.columns if n not in names]])


def write(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None) -> None:
    """Distributed output."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    if fmt in ("json", "ndjson"):
        w.json(path)
    elif fmt in ("csv", "tsv"):
        flat = df.select(*[coerce.text(coerce.Val(F.col(f"`{f.name}`"), coerce.kind_of(f.dataType))).alias(f.name) for f in df.schema.fields])
        flat.write.mode("overwrite").csv(path, header=True, sep="\t" if fmt == "tsv" else ",")
    elif fmt == "raw":
        df.select(F.coalesce(F.col("_raw"), F.lit("")).alias("value")).write.mode("overwrite").text(path)
    elif fmt in ("parquet", "orc"):
        w.format(fmt).save(path)
    else:
        raise QueryError(f"unknown output format {fmt!r}")


def render(df: DataFrame, fmt: str = "auto", limit: int = 1000) -> str:
    """The first `limit` rows as text, for people."""
    if fmt not in FORMATS:
        raise QueryError(f"unknown output format {fmt!r}")
    df = ordered(df)
    rows = [[x for x in r] for r in df.limit(limit).toLocalIterator()]
    names = df.columns
    if fmt == "auto":
        fmt = "raw" if names == ["_raw"] else "table"
    show = lambda v: "" if v is None else v.isoformat(sep="T") if hasattr(v, "isoformat") else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v).lower() if isinstance(v, bool) else str(v)
    if fmt in ("json", "ndjson"):
        return "\n".join(json.dumps({n: v for n, v in zip(names, r, strict=True) if v is not None}, default=str, ensure_ascii=False) for r in rows)
    if fmt in ("csv", "tsv"):
        out = io.StringIO()
        w = csv.writer(out, delimiter="\t" if fmt == "tsv" else ",", lineterminator="\n")
        w.writerow(names)
        w.writerows([[show(v) for v in r] for r in rows])
        return out.getvalue()
    cells = [[show(v) for v in r] for r in rows]
    if fmt == "raw":
        at = names.index("_raw") if "_raw" in names else 0
        return "\n".join(r[at] for r in cells)
    if fmt == "line":
        return "\n".join(" ".join(f"{n}={v}" for n, v in zip(names, r, strict=True)) for r in cells)
    if fmt == "vertical":
        width = max(map(len, names), default=0)
        return "\n".join(f"*** {i} ***\n" + "\n".join(f"{n.rjust(width)}: {v}" for n, v in zip(names, r, strict=True)) for i, r in enumerate(cells, 1))
    widths = [max([len(n), *(len(r[i]) for r in cells)]) for i, n in enumerate(names)]
    line = lambda r, sep, edge: edge + sep.join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + edge.strip().rjust(len(edge))
    if fmt == "markdown":
        return "\n".join(["| " + " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + " |" for r in [names, ["-" * w for w in widths], *cells]])
    if fmt == "box":
        bar = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c
        body = ["│" + "│".join(f" {v.ljust(w)} " for v, w in zip(r, widths, strict=True)) + "│" for r in [names, *cells]]
        return "\n".join([bar("┌", "┬", "┐"), body[0], bar("├", "┼", "┤"), *body[1:], bar("└", "┴", "┘")])
    return "\n".join(line(r, "  ", "").rstrip() for r in [names, *cells])


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """Events by index and day, the layout that time ranges prune."""
    d = df if "index" in df.columns else df.withColumn("index", F.lit("main"))
    d.withColumn("date", F.to_date("_time")).repartition("index", "date").write.mode(mode).partitionBy("index", "date").parquet(path)


def compact(spark: SparkSession, path: str, target: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrites a partitioned folder with larger files, sorted by time within them."""
    df = spark.read.parquet(path)
    df.repartition("index", "date").sortWithinPartitions("_time").write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").partitionBy("index", "date").parquet(target)


def retain(df: DataFrame, age: str, now) -> DataFrame:
    """Rows younger than the age."""
    from datetime import timedelta

    return df.where(F.col("_time") >= F.lit(now - timedelta(seconds=times.seconds(age))).cast("timestamp_ntz"))

"""Indexes by name: paths, tables or DataFrames; globs; system tables."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import QueryError, Source
from ..operators import order, sets


class Catalog:
    """Names to DataFrames. A provider is called at each use, so that a scan's filters and columns are the query's own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.providers: dict[str, Callable[[], DataFrame]] = {}
        self.log: list[dict] = []

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame], time: str | None = None, in_order: bool = False) -> Catalog:
        """time: the column that becomes _time. in_order: rows of the file keep its order unless a query sorts them."""
        given = source if callable(source) else (lambda: source)
        make = (lambda: given().withColumn(order.POSITION, F.monotonically_increasing_id())) if in_order else given
        self.providers[name] = (lambda: _timed(make(), time)) if time else make
        return self

    def add_path(self, name: str, path: str, fmt: str = "parquet", time: str | None = None, **options) -> Catalog:
        return self.add(name, lambda: self.spark.read.format(fmt).options(**options).load(path), time)

    def add_folder(self, folder: str, names: list[str], time: dict[str, str] | None = None) -> Catalog:
        for n in names:
            self.add_path(n, f"{folder}/{n}.parquet", time=(time or {}).get(n))
        return self

    def names(self, patterns: list[str]) -> list[str]:
        """Names that a pattern matches, without those that a !pattern does, in the patterns' order."""
        known = sorted(self.providers)
        out: list[str] = []
        positive = [p for p in patterns if not p.startswith("!")] or ["*"]
        for p in positive:
            hit = [n for n in known if fnmatch.fnmatchcase(n, p)] if any(c in p for c in "*?[") else [p]
            out += [n for n in hit if n not in out]
        drop = [p[1:] for p in patterns if p.startswith("!")]
        return [n for n in out if not any(fnmatch.fnmatchcase(n, d) for d in drop)]

    def read(self, name: str) -> DataFrame:
        if name.startswith("system."):
            return self.system(name.removeprefix("system."))
        if name not in self.providers:  # an index that has no rows yet is no error
            return self.spark.createDataFrame([], "_time timestamp_ntz, _raw string, index string")
        return self.providers[name]()

    def scan(self, source: Source, placed: bool = False) -> DataFrame:
        """One index as it is; of several, or of patterns, the union with the name in the column index.

        placed: with the hidden column of the rows' places, where all of the indexes have it.
        """
        names = self.names(source.names)
        if not names:
            return self.read("")
        one = len(names) == 1 and names == source.names
        parts = [order.placed(self.read(n)) if placed else self.read(n) for n in names]
        if any(order.PLACE not in p.columns for p in parts):
            parts = [p.drop(order.PLACE) for p in parts]
        return parts[0] if one else sets.union([p.withColumn("index", F.lit(n)) for p, n in zip(parts, names, strict=True)])

    def record(self, text: str, commands: list[str]) -> None:
        self.log.append({"query_id": len(self.log) + 1, "submitted": datetime.now(UTC).replace(tzinfo=None), "query": text, "operators": commands})

    def system(self, table: str) -> DataFrame:
        if table == "columns":
            rows = [(n, f.name, f.dataType.simpleString(), f.nullable) for n in sorted(self.providers) for f in self.read(n).schema.fields]
            return self.spark.createDataFrame(rows, "index string, column string, type string, nullable boolean")
        if table == "parts":
            parts = []
            for n in sorted(self.providers):
                try:
                    parts.append(self.read(n).groupBy(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows")).withColumn("index", F.lit(n)))
                except Exception:  # noqa: BLE001  a DataFrame that is no file scan has no parts
                    continue
            return sets.union(parts) if parts else self.spark.createDataFrame([], "part string, bytes long, rows long, index string")
        if table == "queries":
            return self.spark.createDataFrame([(q["query_id"], q["submitted"], q["query"]) for q in self.log], "query_id long, submitted timestamp_ntz, query string")
        if table == "query_operators":
            return self.spark.createDataFrame([(q["query_id"], i, o) for q in self.log for i, o in enumerate(q["operators"])], "query_id long, position int, operator string")
        raise QueryError(f"unknown system table {table!r}")


def _timed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumnRenamed(column, "_time") if "_time" not in df.columns else df

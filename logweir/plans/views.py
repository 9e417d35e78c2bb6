"""Materialized views: stored results of a query, maintained from new rows, and used to answer other queries.

A view's query splits into a prefix of row commands, one `stats` (or none: a projection view), and a suffix that runs
when the view is read. An aggregate view stores partial states per group, which are added up when read, so
new rows only append partial rows. Everything is in one folder: a definition as JSON, and Parquet below it.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, times
from ..functions.aggregates import extreme_key
from ..functions.compiler import Compiler
from ..lang.ast import Agg, Bin, Command, Field, Lit, Query, QueryError, Test, Un
from ..lang.parser import parse
from ..operators import order, rows

#: Row commands that a maintained view may start with.
PREFIX = frozenset("search where eval fields table rename rex regex bin json unpack fillnull replace".split())
#: Aggregates whose states can be added up.
MERGEABLE = frozenset("count sum avg mean min max dc distinct_count sumsq range".split())


@dataclass
class Definition:
    name: str
    query: str
    kind: str  # aggregate, projection or snapshot
    retention: str | None = None
    partition_by: list[str] = field(default_factory=list)
    status: str = "active"
    cursor: str | None = None
    batches: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)


def split(q: Query) -> tuple[list[Command], Command | None, list[Command]]:
    """(prefix, stats or None, suffix); an error where a view could not be maintained from new rows alone."""
    for i, c in enumerate(q.commands):
        if c.name == "stats":
            for a in c["aggs"]:
                if a.func not in MERGEABLE or a.args and not isinstance(a.args[0], Field):
                    raise QueryError(f"{a.func} of an expression cannot be maintained")
            return q.commands[:i], c, q.commands[i + 1 :]
        if c.name not in PREFIX:
            raise QueryError(f"{c.name} cannot be part of a maintained view")
    return q.commands, None, []


def partial(df: DataFrame, aggs: list[Agg], by: list[str]) -> DataFrame:
    """Groups with the states of their aggregates: columns s<i>_<part>."""
    c, cols = Compiler(df), []
    for i, a in enumerate(aggs):
        v = c(a.args[0]) if a.args else None
        x = coerce.number(v) if v else None
        if a.func == "count":
            cols.append((F.count(v.col) if v else F.count(F.lit(1))).alias(f"s{i}_n"))
        elif a.func in ("sum", "sumsq"):
            cols.append(F.sum(x * x if a.func == "sumsq" else x).alias(f"s{i}_sum"))
        elif a.func in ("avg", "mean"):
            cols += [F.sum(x).alias(f"s{i}_sum"), F.count(x).alias(f"s{i}_n")]
        elif a.func in ("min", "max"):
            cols.append((F.min if a.func == "min" else F.max)(extreme_key(v)).alias(f"s{i}_{a.func}"))
        elif a.func == "range":
            cols += [F.min(x).alias(f"s{i}_min"), F.max(x).alias(f"s{i}_max")]
        else:
            cols.append(F.collect_set(coerce.text(v)).alias(f"s{i}_set"))
    return df.groupBy(*[c.field(n).col.alias(n) for n in by]).agg(*cols)


def merged(states: DataFrame, aggs: list[Agg], by: list[str], keep: list[tuple[int, Agg]] | None = None) -> DataFrame:
    """Adds up states by the keys `by`. keep: (position of the stored state, aggregate to show)."""
    cols = []
    for i, a in keep or list(enumerate(aggs)):
        if a.func == "count":
            c = F.coalesce(F.sum(f"s{i}_n"), F.lit(0)).cast("long")
        elif a.func in ("sum", "sumsq"):
            c = F.coalesce(F.sum(f"s{i}_sum"), F.lit(0.0))
        elif a.func in ("avg", "mean"):
            c = F.try_divide(F.sum(f"s{i}_sum"), F.sum(f"s{i}_n"))
        elif a.func in ("min", "max"):
            c = (F.min if a.func == "min" else F.max)(f"s{i}_{a.func}")
            c = c["s"] if isinstance(states.schema[f"s{i}_{a.func}"].dataType, T.StructType) else c
        elif a.func == "range":
            c = F.max(f"s{i}_max") - F.min(f"s{i}_min")
        else:
            c = F.size(F.array_distinct(F.flatten(F.collect_list(f"s{i}_set")))).cast("long")
        cols.append(c.alias(a.alias))
    return states.groupBy(*[F.col(f"`{n}`") for n in by]).agg(*cols)


def conjuncts(commands: list[Command]) -> list | None:
    """The where conditions of row commands, as a list; None if other commands are among them."""
    out = []
    for c in commands:
        if c.name != "where":
            return None
        todo = [c["expr"]]
        while todo:
            e = todo.pop()
            if isinstance(e, Bin) and e.op == "and":
                todo += [e.left, e.right]
            else:
                out.append(e)
    return out


def implied(view: object, query: list) -> bool:
    """Whether some condition of the query implies the view's: the same one, or a tighter bound on the same field."""
    if view in query:
        return True
    if not (isinstance(view, Bin) and isinstance(view.left, Field) and isinstance(view.right, Lit) and isinstance(view.right.value, (int, float))):
        return False
    for e in query:
        if isinstance(e, Bin) and e.left == view.left and isinstance(e.right, Lit) and isinstance(e.right.value, (int, float)):
            a, b = e.right.value, view.right.value
            if view.op in (">", ">=") and (e.op in (">", ">=", "=") and a > b or e.op == view.op and a == b or view.op == ">=" and e.op in (">", "=") and a == b):
                return True
            if view.op in ("<", "<=") and (e.op in ("<", "<=", "=") and a < b or e.op == view.op and a == b or view.op == "<=" and e.op in ("<", "=") and a == b):
                return True
    return False


def fields_of(e) -> set[str] | None:
    """Names of the fields that an expression reads; None where that is not plain."""
    if isinstance(e, Field):
        return {e.name}
    if isinstance(e, Lit):
        return set()
    parts = [e.left, e.right] if isinstance(e, Bin) else [e.arg] if isinstance(e, Un) else [e.arg, *e.others] if isinstance(e, Test) else None
    if parts is None:
        return None
    found = [fields_of(p) for p in parts]
    return None if any(f is None for f in found) else set().union(*found)


#: A path's scheme and slashes, which file listings and rows write in two ways.
_SCHEME = ("^([a-z0-9]+:)/+", "$1/")


def _plain_path(path: str) -> str:
    return re.sub(_SCHEME[0], r"\1/", path)


class Views:
    """A folder of views. Definitions are small JSON files, written and read through Spark's file system."""

    def __init__(self, spark: SparkSession, folder: str, engine=None):
        self.spark, self.folder, self.engine = spark, folder.rstrip("/"), engine

    # files
    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _save(self, d: Definition) -> None:
        p, fs = self._path(d.name, "definition.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(asdict(d)).encode()))
        out.close()

    def definition(self, name: str) -> Definition:
        p, fs = self._path(name, "definition.json")
        if not fs.exists(p):
            raise QueryError(f"unknown view {name!r}")
        n = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") if n else "{}"
        stream.close()
        return Definition(**json.loads(text))

    def names(self) -> list[str]:
        p, fs = self._path()
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._path(s.getPath().getName(), "definition.json")[0]))

    # life cycle
    def save(self, name: str, df: DataFrame, retention: str | None = None, partition_by: list[str] | None = None) -> None:
        """A snapshot of a result, under a name."""
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.folder}/{name}/data/snapshot")
        self._save(Definition(name, "", "snapshot", retention, partition_by or [], batches=["snapshot"]))

    def create(self, name: str, query: str, retention: str | None = None, partition_by: list[str] | None = None) -> None:
        """Checks that the query can be maintained; rows come with refresh() or a stream."""
        _, stats, _ = split(parse(query).query)
        self._save(Definition(name, query, "aggregate" if stats else "projection", retention, partition_by or []))

    def apply(self, name: str, batch: DataFrame, batch_id: str) -> None:
        """Adds a batch of source rows. A batch that was added before is replaced, so repeats do no harm."""
        d = self.definition(name)
        prefix, stats, _ = split(parse(d.query).query)
        from .engine import Run, State

        df = Run(self.engine, {}, datetime.now(UTC).replace(tzinfo=None)).commands(State(batch, []), prefix, Query(None, [])).df
        out = partial(df, stats["aggs"], stats["by"]) if stats else df
        w = out.write.mode("overwrite")
        (w.partitionBy(*d.partition_by) if d.partition_by else w).parquet(f"{self.folder}/{name}/data/{batch_id}")
        if batch_id not in d.batches:
            d.batches.append(batch_id)
        self._save(d)

    def refresh(self, name: str) -> None:
        """Adds the rows of source files that no refresh has seen, whatever their times.

        Where files that were seen are gone (the source was rewritten), or the source has none, all rows are read again.
        """
        d = self.definition(name)
        src = self.engine.catalog.scan(parse(d.query).query.source)
        files = sorted({_plain_path(f) for f in src.inputFiles()})
        new = sorted(set(files) - set(d.files))
        whole = not files or bool(set(d.files) - set(files))
        if not whole and not new:
            return
        seen = files if whole else new
        if not whole and d.files:
            added = F.broadcast(self.spark.createDataFrame([(f,) for f in new], "__view_file string"))
            src = src.join(added, F.regexp_replace(F.col("_metadata.file_path"), *_SCHEME) == F.col("__view_file"), "left_semi")
        batch = "batch-" + hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]
        top = src.agg(F.max("_time").cast("timestamp_ntz")).first()[0] if "_time" in src.columns else None
        if whole:
            d.batches = []
            self._save(d)
        self.apply(name, src, batch)
        d = self.definition(name)
        d.files = files
        d.cursor = max(filter(None, (d.cursor, top.isoformat() if top else None)), default=None)
        self._save(d)

    def rebuild(self, name: str) -> None:
        d = self.definition(name)
        d.cursor, d.batches, d.files = None, [], []
        self._save(d)
        self.refresh(name)

    def states(self, d: Definition) -> DataFrame:
        """Stored rows. Batches are read one by one, since each may hold other columns."""
        if not d.batches:
            raise QueryError(f"view {d.name!r} has no rows yet")
        return self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.folder}/{d.name}/data").parquet(*[f"{self.folder}/{d.name}/data/{b}" for b in d.batches])

    def read(self, name: str) -> DataFrame:
        d = self.definition(name)
        df = self.states(d)
        if d.retention and "_time" in df.columns:
            oldest = datetime.now(UTC).replace(tzinfo=None) - timedelta(seconds=times.seconds(d.retention))
            df = rows.time_bounds(df, oldest, None)
        if d.kind == "snapshot":
            return df
        q = parse(d.query).query
        _, stats, suffix = split(q)
        if stats:
            df = merged(df, stats["aggs"], stats["by"])
        from .engine import Run, State

        return Run(self.engine, {}, datetime.now(UTC).replace(tzinfo=None)).commands(State(df, order.default_order(df)), suffix, Query(None, [])).df

    def set_retention(self, name: str, retention: str) -> None:
        d = self.definition(name)
        d.retention = retention
        self._save(d)

    def drop(self, name: str) -> None:
        self.definition(name)
        p, fs = self._path(name)
        fs.delete(p, True)

    def table(self, name: str | None = None) -> DataFrame:
        ds = [self.definition(n) for n in ([name] if name else self.names())]
        return self.spark.createDataFrame([(d.name, d.kind, d.status, d.retention, d.cursor, d.query) for d in ds], "name string, type string, status string, retention string, cursor string, query string")

    # answering queries
    def rewrite(self, q: Query) -> tuple[DataFrame, list[Command]] | None:
        """The query over a view's states, and the commands that remain; None where no view fits.

        A view fits if it reads the same source, its conditions are implied by the query's, what the query asks beyond
        them reads only the view's keys, and its keys and aggregates cover the query's. The remaining conditions run again.
        """
        at = next((i for i, c in enumerate(q.commands) if c.name == "stats"), None)
        if at is None or q.source is None or q.source.cte or q.source.earliest:
            return None
        wanted = conjuncts(q.commands[:at])
        if wanted is None:
            return None
        stats = q.commands[at]
        for name in self.names():
            d = self.definition(name)
            if d.kind != "aggregate" or not d.batches or d.status != "active":
                continue
            v = parse(d.query).query
            prefix, have, _ = split(v)
            filters = conjuncts(prefix)
            if v.source is None or v.source.names != q.source.names or filters is None or not all(implied(f, wanted) for f in filters):
                continue
            rest = [e for e in wanted if e not in filters]
            if any((used := fields_of(e)) is None or not used <= set(have["by"]) for e in rest) or not set(stats["by"]) <= set(have["by"]):
                continue
            keep = []
            for a in stats["aggs"]:
                i = next((i for i, b in enumerate(have["aggs"]) if (b.func, b.args) == (a.func, a.args)), None)
                if i is None:
                    break
                keep.append((i, a))
            else:
                df = self.states(d)
                for e in rest:
                    df = df.filter(Compiler(df).condition(e))
                return merged(df, have["aggs"], stats["by"], keep), q.commands[at + 1 :]
        return None

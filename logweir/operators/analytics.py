"""Pivots, outliers, correlation, topology, log patterns, traces and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.aggregates import order_key
from ..functions.compiler import Compiler
from ..lang.ast import QueryError
from .aggregate import pivot_values
from .order import Order


def xyseries(df: DataFrame, x: str, y: str, v: str, order: Order | None = None) -> DataFrame:
    """A row for each x, a column for each y; the last value of a cell wins."""
    c = Compiler(df)
    key = order_key(order or [], c)
    val = c.field(v).col
    d = df.select(coerce.text(c.field(x)).alias(x), coerce.text(c.field(y)).alias("_y"), val.alias("_v"), (key if key is not None else val).alias("_o"))
    return d.groupBy(f"`{x}`").pivot("_y", pivot_values(d, "_y")).agg(F.max_by("_v", F.struct("_o", "_v"))).orderBy(f"`{x}`")


def untable(df: DataFrame, x: str, y: str, v: str) -> DataFrame:
    """All other columns become rows (x, name, value); values are strings, missing ones are left out."""
    c = Compiler(df)
    others = [n for n in df.columns if n != x]
    cells = F.array(*[F.struct(F.lit(n).alias("k"), coerce.text(c.field(n)).alias("v")) for n in others])
    d = df.select(c.field(x).col.alias(x), F.explode(cells).alias("_c"))
    return d.select(f"`{x}`", F.col("_c.k").alias(y), F.col("_c.v").alias(v)).where(F.col(f"`{v}`").isNotNull())


def outliers(df: DataFrame, field: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """_outlier and _score. iqr: distance beyond the quartiles in interquartile ranges (four values at least); zscore:
    absolute z (two); mad: 0.6745 times the distance from the median in median absolute deviations (three)."""
    if method not in ("iqr", "zscore", "mad"):
        raise QueryError(f"unknown method {method!r}")
    x = coerce.number(Compiler(df).field(field))
    d = df.withColumn("_x", x)
    if method == "iqr":
        s = quantiles(d, "_x", {"_a": 0.25, "_b": 0.75})
        width = F.col("_b") - F.col("_a")
        score = F.greatest(F.col("_a") - F.col("_x"), F.col("_x") - F.col("_b"), F.lit(0.0)) / width
        valid = (F.col("_n") >= 4) & (width != 0)
    elif method == "zscore":
        s = d.agg(F.count("_x").alias("_n"), F.avg("_x").alias("_a"), F.stddev_samp("_x").alias("_b"))
        score, valid = F.abs(F.col("_x") - F.col("_a")) / F.col("_b"), (F.col("_n") >= 2) & (F.col("_b") > 0)
    else:
        m = quantiles(d, "_x", {"_a": 0.5})
        far = d.select("_x").crossJoin(F.broadcast(m)).select(F.abs(F.col("_x") - F.col("_a")).alias("_y"))
        s = quantiles(far, "_y", {"_b": 0.5}).drop("_n").crossJoin(F.broadcast(m))
        score, valid = F.lit(0.6745) * F.abs(F.col("_x") - F.col("_a")) / F.col("_b"), (F.col("_n") >= 3) & (F.col("_b") > 0)
    d = d.crossJoin(F.broadcast(s)).withColumn("_score", F.coalesce(F.when(valid, score), F.lit(0.0)))
    d = d.withColumn("_outlier", F.col("_score") > F.lit(float(threshold)))
    return d.select(*[F.col(f"`{n}`") for n in df.columns if n not in ("_outlier", "_score")], "_outlier", "_score")


def correlate(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """One row; spearman uses average ranks of ties; no variance gives 0."""
    c = Compiler(df)
    d = df.select(coerce.number(c.field(a)).alias("a"), coerce.number(c.field(b)).alias("b")).where("a is not null and b is not null")
    if method == "spearman":
        d = d.join(_ranks(d, "a"), "a").join(_ranks(d, "b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    elif method != "pearson":
        raise QueryError(f"unknown method {method!r}")
    r = F.when((F.count("*") > 1) & (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0), F.corr("a", "b")).otherwise(0.0)
    return d.agg(r.alias("_correlation"), F.lit(method).alias("_method"), F.count("*").alias("_n"), F.lit(a).alias("_field1"), F.lit(b).alias("_field2"))


def _places(d: DataFrame, name: str, ranges: int = 64) -> DataFrame:
    """Each different value with its count, `first`, the number of smaller rows, and _n, that of all: values are counted, so only different
    ones are sorted, in ranges whose sizes are then added up. The ranges' bounds are constants of the query, so a task that
    runs again deals values as before."""
    counts = d.where(F.col(name).isNotNull()).groupBy(name).count()
    bounds = sorted(set(counts.approxQuantile(name, [i / ranges for i in range(1, ranges)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col(name)))
    counts = counts.withColumn("_p", part)
    sizes = counts.groupBy("_p").agg(F.sum("count").alias("_s"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_n", F.sum("_s").over(Window.partitionBy())).drop("_s")
    run = F.sum("count").over(Window.partitionBy("_p").orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
    r = counts.withColumn("_run", F.coalesce(run, F.lit(0))).join(F.broadcast(before), "_p")
    return r.select(name, "count", (F.col("_before") + F.col("_run")).alias("first"), "_n")


def _ranks(d: DataFrame, name: str) -> DataFrame:
    """Average rank of each value."""
    return _places(d, name).select(name, (F.col("first") + (F.col("count") + 1) / 2.0).alias(f"r{name}"))


def quantiles(d: DataFrame, name: str, levels: dict[str, float]) -> DataFrame:
    """One row: _n (values) and the exact quantiles under their names, between two values in proportion."""
    p = _places(d, name)

    def value(at: Column) -> Column:
        return F.max(F.when((F.col("first") <= at) & (at < F.col("first") + F.col("count")), F.col(name)))

    cols = [F.coalesce(F.max("_n"), F.lit(0)).alias("_n")]
    for alias, level in levels.items():
        at = F.lit(level) * (F.col("_n") - 1)
        low, high, share = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        cols.append(((1 - share) * low + share * high).alias(alias))
    return p.agg(*cols)


#: Variable parts of log lines, replaced by a wildcard in this order.
VARIABLES = (
    r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?(?![\w])",
    r"\b[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?\b",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}\b",
    r"(?<![\w.])[-+]?[0-9]+(?:\.[0-9]+)?(?![\w.])",
)


def masked(df: DataFrame, field: str = "_raw") -> DataFrame:
    """pattern, count, example of lines with their variable parts replaced: the stage whose result has no order in it."""
    c = Compiler(df)
    s = c.raw() if field == "_raw" else coerce.text(c.field(field))
    m = s
    for v in VARIABLES:
        m = F.regexp_replace(m, v, "<*>")
    m = F.trim(F.regexp_replace(m, r"\s+", " "))
    # a line without words has no pattern; asked of the line itself, so that it is masked once
    d = df.where(s.rlike(r"\S")).select(s.alias("example"), m.alias("pattern"))
    return d.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"), F.min("example").alias("example"))


class Templates:
    """Templates of masked lines of one length, most frequent first. A line joins the template that agrees with it in most of its words
    (the earliest of equals), if these are enough; words that differ become wildcards. Others become templates.

    A template that agrees in `need` of a line's words is listed under one of any (words - need + 1) of them at least. So a line
    is held only against the templates listed under its rarest words, and one without enough words against none.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.found: list[list] = []
        self.listed: dict[tuple[int, str], dict[int, None]] = {}

    def need(self, n: int) -> int:
        return next((m for m in range(1, n + 1) if m / n >= self.similarity), n + 1)

    def add(self, pattern: str, count: int, example: str) -> None:
        words = pattern.split(" ")
        fixed = [(i, w) for i, w in enumerate(words) if w != "<*>"]
        need = self.need(len(words))
        best, most = None, 0
        if len(fixed) >= need:
            rare = sorted((self.listed.get(k, {}) for k in fixed), key=len)[: len(fixed) - need + 1]
            for t in sorted(set().union(*rare)):
                same = sum(self.found[t][0][i] == w for i, w in fixed)
                if same >= need and same > most:
                    best, most = t, same
        if best is None:
            for k in fixed if len(fixed) >= need else []:
                self.listed.setdefault(k, {})[len(self.found)] = None
            self.found.append([words, count, example])
            return
        old = self.found[best]
        for i, (a, b) in enumerate(zip(old[0], words, strict=True)):
            if a != b and a != "<*>":
                del self.listed[i, a][best]
        old[0] = [a if a == b else "<*>" for a, b in zip(old[0], words, strict=True)]
        old[1] += count

    def rows(self) -> Iterator[tuple[str, int, str]]:
        return ((" ".join(words), count, example) for words, count, example in self.found)


def patterns(df: DataFrame, field: str = "_raw", max_templates: int = 50, similarity: float = 0.4) -> DataFrame:
    """Log templates by count. Masked lines are counted everywhere first; templates merge among lines of one length and first
    word, in parallel. Lines that have too few words to agree in pass as they are, from any task."""
    m = masked(df, field)
    words = F.split("pattern", " ")
    fixed = F.size(F.filter(words, lambda w: w != "<*>"))
    m = m.withColumns({"_len": F.size(words), "_first": words[0]})
    alone = (F.col("_len") == 1) | (fixed == 0) | (fixed / F.col("_len") < F.lit(float(similarity)))
    m = m.withColumn("_alone", alone)
    m = m.repartition("_len", "_first", F.when(F.col("_alone"), F.col("pattern")))
    m = m.sortWithinPartitions("_alone", "_len", "_first", F.desc("count"), "pattern")
    out = pa.schema([("pattern", pa.string()), ("count", pa.int64()), ("example", pa.string())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One after the other, as groups are not split and many have one line."""
        group, lines = None, Templates(similarity)
        merged: list[tuple] = []

        def made() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array([r[i] for r in merged], f.type) for i, f in enumerate(out)], schema=out)
            merged.clear()
            return r

        for b in batches:
            b = pa.Table.from_batches([b])
            yield from b.filter(b["_alone"]).select(out.names).cast(out).to_batches()
            b = b.filter(pc.invert(b["_alone"]))
            for n, first, *line in zip(*[b[k].to_pylist() for k in ("_len", "_first", *out.names)], strict=True):
                if group != (n, first):
                    merged += lines.rows()
                    group, lines = (n, first), Templates(similarity)
                    if len(merged) >= 10_000:
                        yield made()
                lines.add(*line)
        merged += lines.rows()
        yield made()

    t = m.mapInArrow(merge, "pattern string, count long, example string")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    r = t.crossJoin(F.broadcast(total)).select("pattern", "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent"), "example")
    return r.orderBy(F.desc("count"), "pattern").limit(max_templates)


def topology(df: DataFrame, source_field: str = "source", dest_field: str = "dest", weight_field: str | None = None, max_nodes: int = 100) -> DataFrame:
    """Edges with their counts and the rows that leave and reach their ends; the heaviest edges whose ends are among the
    max_nodes busiest nodes."""
    c = Compiler(df)
    cols = [coerce.text(c.field(source_field)).alias("_source"), coerce.text(c.field(dest_field)).alias("_destination")]
    if weight_field:
        cols.append(coerce.number(c.field(weight_field)).alias("_w"))
    d = df.select(*cols).where("_source is not null and _destination is not null and _source <> '' and _destination <> ''")
    aggs = [F.count(F.lit(1)).alias("_edge_count")] + ([F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_edge_weight")] if weight_field else [])
    edges = d.groupBy("_source", "_destination").agg(*aggs)
    out = edges.groupBy("_source").agg(F.sum("_edge_count").alias("_source_out_degree"))
    into = edges.groupBy("_destination").agg(F.sum("_edge_count").alias("_dest_in_degree"))
    ends = edges.select(F.explode(F.array_distinct(F.array("_source", "_destination"))).alias("node"), "_edge_count")
    busy = ends.groupBy("node").agg(F.sum("_edge_count").alias("n")).orderBy(F.desc("n"), "node").limit(max_nodes).select("node")
    kept = edges.join(F.broadcast(busy.withColumnRenamed("node", "_source")), "_source").join(F.broadcast(busy.withColumnRenamed("node", "_destination")), "_destination")
    r = kept.join(out, "_source").join(into, "_destination")
    names = ["_source", "_destination", "_edge_count", "_source_out_degree", "_dest_in_degree"] + (["_edge_weight"] if weight_field else [])
    return r.select(*names).orderBy(F.desc("_edge_count"), "_source", "_destination")


def trace(df: DataFrame, trace_id: str = "trace_id", span_id: str = "span_id", parent_id: str = "parent_span_id") -> DataFrame:
    """Spans of each trace as a tree, depth first, children by time; a span whose parent is missing is a root."""
    c = Compiler(df)
    pick = lambda n: c.field(n).col
    d = df.select(
        pick("_time").alias("_time"), coerce.text(c.field(trace_id)).alias("trace"), coerce.text(c.field(span_id)).alias("span"), coerce.text(c.field(parent_id)).alias("parent"),
        coerce.text(c.field("service")).alias("service"), coerce.text(c.field("operation")).alias("operation"), coerce.number(c.field("duration_ms")).alias("duration_ms"),
    ).where("trace is not null")
    time = d.schema["_time"].dataType
    schema = T.StructType([T.StructField("_time", time), *[T.StructField(n, T.StringType()) for n in ("trace", "service", "operation")], T.StructField("duration_ms", T.DoubleType()), T.StructField("_span_depth", T.IntegerType()), T.StructField("_span_tree", T.StringType())])
    # ranges of traces in order, whole and sorted by time: nothing is sorted again after the trees are made
    d = d.repartitionByRange("trace").sortWithinPartitions("trace", "_time", "span", "parent", "service", "operation", "duration_ms")
    return d.mapInArrow(span_trees, schema)


def span_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by trace and time, to trees: a trace may go over several batches, and a batch has many traces."""
    waiting: list[pa.RecordBatch] = []  # the last trace so far

    def done() -> Iterator[pa.RecordBatch]:
        if waiting:
            yield from _trees(pa.Table.from_batches(waiting))

    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("trace")
        last = b.num_rows - 1
        if waiting and waiting[0].column("trace")[0] == names[0] == names[last]:
            waiting.append(b)
            continue
        start = pc.index(names, names[last]).as_py()
        waiting.append(b.slice(0, start))
        yield from done()
        waiting = [b.slice(start)]
    yield from done()


def _trees(rows: pa.Table) -> list[pa.RecordBatch]:
    """Whole traces."""
    trace, span, parent, shown = (rows[n].to_pylist() for n in ("trace", "span", "parent", "operation"))
    order, depths, lines = [], [], []
    i = 0
    while i < len(trace):
        n = i + 1
        while n < len(trace) and trace[n] == trace[i]:
            n += 1
        for at, depth, line in span_tree(span[i:n], parent[i:n]):
            order.append(i + at)
            depths.append(depth)
            lines.append(line + (shown[i + at] or span[i + at] or ""))
        i = n
    out = rows.select(["_time", "trace", "service", "operation", "duration_ms"]).take(pa.array(order, pa.int64()))
    return out.append_column("_span_depth", pa.array(depths, pa.int32())).append_column("_span_tree", pa.array(lines, pa.string())).to_batches()


def span_tree(spans: list[str | None], parents: list[str | None]) -> list[tuple[int, int, str]]:
    """(place, depth, branches before its name) of one trace's spans, which come by time."""
    at = {s: i for i, s in enumerate(spans) if s is not None}
    children: dict[int, list[int]] = {}
    roots = []
    for i, p in enumerate(parents):
        j = at.get(p) if p else None
        if j is None or j == i:
            roots.append(i)
        else:
            children.setdefault(j, []).append(i)
    order, seen = [], set()

    def walk(root: int) -> None:
        stack = [(root, 0, "", "")]
        while stack:
            i, depth, line, below = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            order.append((i, depth, line))
            kids = children.get(i, ())
            for k in range(len(kids) - 1, -1, -1):
                last = k == len(kids) - 1
                stack.append((kids[k], depth + 1, below + ("└── " if last else "├── "), below + ("    " if last else "│   ")))

    for r in roots:
        walk(r)
    for i in range(len(spans)):  # what is left lies on cycles
        walk(i)
    return order


def glimpse(df: DataFrame, n: int = 10_000, top: int = 3) -> DataFrame:
    """A row for each column: type, coverage and nulls in percent, different values, most frequent values, min, p50, p99, max.
    Profiles the first n rows (the command's own limit), in one aggregate."""
    names = df.columns
    d = df.limit(n)
    c = Compiler(d)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        v = c.field(name)
        x, s = coerce.number(v), coerce.text(v)
        aggs += [F.count(v.col).alias(f"c{i}"), F.approx_count_distinct(s).alias(f"d{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.percentile(x, F.array(F.lit(0.5), F.lit(0.99))).alias(f"p{i}")]
    one = d.agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("field"), F.lit(d.schema[name].dataType.simpleString()).alias("type"), F.round(F.col(f"c{i}") * 100.0 / F.col("n"), 2).alias("coverage"), F.round(100.0 - F.col(f"c{i}") * 100.0 / F.col("n"), 2).alias("null_pct"), F.col(f"d{i}").alias("cardinality"), F.col(f"lo{i}").alias("min"), F.get(f"p{i}", 0).alias("p50"), F.get(f"p{i}", 1).alias("p99"), F.col(f"hi{i}").alias("max")) for i, name in enumerate(names)]))
    profile = one.select(cells.alias("s")).select("s.*")
    values = d.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), coerce.text(c.field(name)).alias("v")) for i, name in enumerate(names)])).alias("s")).select("s.i", "s.v").where("v is not null")
    counted = values.groupBy("i", "v").count().withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("count"), "v"))).where(F.col("r") <= top)
    tops = counted.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("t")).select("i", F.transform("t", lambda t: t["v"]).alias("top_values"))
    return profile.join(F.broadcast(tops), "i", "left").orderBy("i").drop("i")


def field_values(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """Most frequent values of a field."""
    return df.select(coerce.text(Compiler(df).field(field)).alias("value")).where("value is not null").groupBy("value").count().orderBy(F.desc("count"), "value").limit(n)


def histogram(df: DataFrame, span: str, by: str | None = None) -> DataFrame:
    """Rows per interval, and per value of a field."""
    from ..lang.ast import Agg
    from .aggregate import timechart

    return timechart(df, span, [Agg("count", (), "count")], [by] if by else [])

"""Runs programs: each command becomes DataFrame calls, and Spark plans the whole.

    engine = Engine(spark, Catalog(spark).add_path("events", path, time="ts"))
    engine.query('from events | where value > 50 | stats count by event_type').show()
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, formats, times
from ..functions.compiler import Compiler
from ..lang.ast import Command, Program, Query, QueryError, Source
from ..lang.parser import parse
from ..operators import aggregate, analytics, multivalue, order, rows, sessions, sets
from ..sources import sinks
from ..sources.catalog import Catalog


@dataclass
class State:
    """A DataFrame on its way through commands, with the order its rows are thought to be in."""

    df: DataFrame
    order: order.Order = field(default_factory=list)


HIDDEN = order.HIDDEN
#: Commands that look at all columns, or pass them on to where they would be seen.
ALL_COLUMNS = frozenset("describe glimpse untable mvcombine pack join append union appendpipe tee materialize compare transaction".split())


def plain(s: State) -> State:
    """Without hidden order columns."""
    hidden = [n for n in s.df.columns if n.startswith(HIDDEN)]
    return State(s.df.drop(*hidden), [o for o in s.order if o[0] not in hidden]) if hidden else s


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, views=None, default: str = "main"):
        self.spark, self.catalog, self.views, self.default = spark, catalog, views, default

    def query(self, text: str, params: dict | None = None, now: datetime | None = None, earliest: str | None = None, latest: str | None = None) -> DataFrame:
        """now: what relative times count from. earliest and latest bound all scans."""
        program = parse(text, params)
        self.catalog.record(text, [c.name for c in program.query.commands])
        return self.run(program, now, earliest, latest)

    def run(self, program: Program, now: datetime | None = None, earliest: str | None = None, latest: str | None = None) -> DataFrame:
        now = now or datetime.now(UTC).replace(tzinfo=None)
        r = Run(self, {}, now, earliest, latest)
        for name, q in program.datasets:
            r.datasets[name] = plain(r.query(q))
        return plain(r.query(program.query)).df


@dataclass
class Run:
    engine: Engine
    datasets: dict[str, State]
    now: datetime
    earliest: str | None = None
    latest: str | None = None
    shift: timedelta = timedelta()

    def query(self, q: Query) -> State:
        commands = q.commands
        if q.source is None and commands and commands[0].name in ("makeresults", "from", "multisearch", "views", "dropview"):
            state = State(self.engine.spark.range(1).select(F.lit(None).cast("string").alias("_raw")).limit(0))
        else:
            if self.engine.views is not None and q.source is not None and not self.shift:
                rewritten = self.engine.views.rewrite(q)
                if rewritten is not None:
                    df, commands = rewritten
                    return self.commands(State(df), commands, q)
            state = self.scan(q.source or Source([self.engine.default]))
        return self.commands(state, commands, q)

    def scan(self, s: Source) -> State:
        if s.cte is not None:
            if s.cte not in self.datasets:
                raise QueryError(f"unknown dataset ${s.cte}")
            return self.datasets[s.cte]
        views = self.engine.views
        if views is not None and len(s.names) == 1 and s.names[0] in views.names():
            df = views.read(s.names[0])
        else:
            df = self.engine.catalog.scan(s, placed=True)
        if self.shift and "_time" in df.columns:
            df = df.withColumn("_time", F.col("_time") + F.make_dt_interval(secs=F.lit(self.shift.total_seconds())))
        low, high = s.earliest or self.earliest, s.latest or self.latest
        df = rows.time_bounds(df, times.resolve(low, self.now) if low else None, times.resolve(high, self.now) if high else None)
        return State(df, order.default_order(df))

    def commands(self, state: State, commands: list[Command], q: Query) -> State:
        for i, c in enumerate(commands):
            if c.name in ALL_COLUMNS:
                state = plain(state)
            if c.name == "compare":
                state = self._compare(state, c, Query(q.source, commands[:i]))
                continue
            f = getattr(self, f"do_{c.name}", None)
            if f is None:
                raise QueryError(f"unknown command {c.name}")
            state = f(state, c)
        return state

    def _compare(self, state: State, c: Command, prefix: Query) -> State:
        """The prefix over rows moved forward by the shift is the previous period."""
        before = replace(self, shift=self.shift + timedelta(seconds=times.seconds(c["shift"].lstrip("+-"))))
        return State(sets.compare(state.df, plain(before.query(prefix)).df), state.order)

    # rows
    def do_search(self, s, c):
        df = s.df
        if c["index"] and "index" in df.columns:
            df = df.filter(Compiler(df)._equals(Compiler(df).field("index"), c["index"]))
        elif c["index"]:
            s = self.scan(Source([c["index"]]))
            df = s.df
        if c["earliest"] or c["latest"]:
            df = rows.time_bounds(df, *[times.resolve(c[k], self.now) if c[k] else None for k in ("earliest", "latest")])
        return State(rows.search(df, c["tree"]), s.order)

    def do_where(self, s, c):
        return State(s.df.filter(Compiler(s.df, self.now).condition(c["expr"])), s.order)

    def do_regex(self, s, c):
        return State(rows.regex(s.df, c["field"], c["pattern"], c["negated"]), s.order)

    def do_eval(self, s, c):
        df = s.df
        for name, e in c["assign"]:
            v = Compiler(df, self.now)(e)
            df = df.withColumn(name, v.col)
        return State(df, s.order)

    def _projected(self, s, project):
        """The projection, and in hidden columns what the row order needs of what it leaves out."""
        s = State(s.df, list(s.order))
        hidden = {f"{HIDDEN}{i}": n for i, (n, _) in enumerate(s.order) if not n.startswith(HIDDEN) and n in s.df.columns}
        df = s.df.withColumns({h: rows.c_(n) for h, n in hidden.items()})
        out = project(df, [n for n in df.columns if n.startswith(HIDDEN)])
        new = []
        for n, d in s.order:
            h = next((h for h, of in hidden.items() if of == n), None)
            if n in out.columns and h:
                out = out.drop(h)
                new.append((n, d))
            elif h or n in out.columns:
                new.append((h or n, d))
        return State(out, new)

    def do_fields(self, s, c):
        return self._projected(s, lambda df, hidden: rows.fields(df, c["names"] + ([] if c["drop"] else hidden), c["drop"]))

    def do_table(self, s, c):
        return self._projected(s, lambda df, hidden: rows.table(df, c["names"] + [(h, h) for h in hidden]))

    def do_rename(self, s, c):
        new = dict(c["pairs"])
        return State(rows.rename(s.df, c["pairs"]), [(new.get(n, n), d) for n, d in s.order])

    def do_rex(self, s, c):
        return State(rows.rex(s.df, c["field"], c["pattern"]), s.order)

    def do_replace(self, s, c):
        return State(rows.replace(s.df, c["pairs"], c["fields"]), s.order)

    def do_fieldformat(self, s, c):
        return s

    def do_fillnull(self, s, c):
        return State(rows.fillnull(s.df, c["value"], c["fields"]), s.order)

    def do_bin(self, s, c):
        return State(rows.bin_(s.df, c["field"], c["span"], c["alias"]), s.order)

    def do_json(self, s, c):
        return State(rows.json(s.df, c["field"], c["paths"]), s.order)

    def do_unpack(self, s, c):
        comp = Compiler(s.df)
        text = comp.raw() if c["field"] == "_raw" else coerce.text(comp.field(c["field"]))
        df = formats.unpack(s.df, c["format"], text, c["only"], c["prefix"], c["if_missing"], c["options"])
        return State(df, s.order)

    def do_pack(self, s, c):
        return State(rows.pack(s.df, c["names"], c["into"]), s.order)

    def do_describe(self, s, c):
        s.df.printSchema()
        return s

    # multivalues
    def do_unroll(self, s, c):
        return State(multivalue.unroll(s.df.drop(order.PLACE), c["names"], c["limit"], c["alias"]), s.order)

    def do_makemv(self, s, c):
        return State(multivalue.makemv(s.df, c["field"], c["delim"], c["tokenizer"], c["allowempty"]), s.order)

    def do_mvcombine(self, s, c):
        return State(multivalue.mvcombine(s.df, c["field"]))

    def do_nomv(self, s, c):
        return State(multivalue.nomv(s.df, c["field"]), s.order)

    # order
    def do_sort(self, s, c):
        o = [(k.name, k.desc) for k in c["keys"]]
        return State(order.sort(s.df, o), o)

    def do_head(self, s, c):
        return State(order.head(s.df, s.order, c["n"], c["offset"]), s.order)

    def do_offset(self, s, c):
        return State(order.offset(s.df, s.order, c["n"]), s.order)

    def do_tail(self, s, c):
        return State(order.tail(s.df, s.order, c["n"]), s.order)

    def do_reverse(self, s, c):
        o = s.order or [(n, False) for n in sorted(s.df.columns)]
        return State(order.reverse(s.df, s.order), [(n, not d) for n, d in o])

    def do_dedup(self, s, c):
        return State(order.dedup(s.df, s.order, c["names"], c["n"]), s.order)

    def do_top(self, s, c):
        return State(order.top(s.df, c["field"], c["n"], c["by"]), [("count", True)])

    def do_rare(self, s, c):
        return State(order.top(s.df, c["field"], c["n"], c["by"], rare=True), [("count", False)])

    # aggregates
    def do_stats(self, s, c):
        return State(aggregate.stats(s.df, c["aggs"], c["by"], s.order))

    def do_timechart(self, s, c):
        return State(aggregate.timechart(s.df, c["span"], c["aggs"], c["by"], s.order), [("_time", False), *[(n, False) for n in c["by"]]])

    def do_chart(self, s, c):
        return State(aggregate.chart(s.df, c["aggs"], c["keys"], s.order))

    def do_rollup(self, s, c):
        return State(aggregate.rollup(s.df, c["spans"], c["by"]), [(f"{HIDDEN}span", False), ("_bucket", False), *[(n, False) for n in c["by"]]])

    def do_eventstats(self, s, c):
        return State(aggregate.eventstats(s.df, c["aggs"], c["by"], s.order), s.order)

    def do_streamstats(self, s, c):
        return State(aggregate.streamstats(s.df, c["aggs"], c["by"], s.order, c["window"] or 0, c["current"] is not False), s.order)

    # sets
    def do_join(self, s, c):
        return State(sets.join(s.df, plain(self.query(c["query"])).df, c["key"], c["how"]), s.order)

    def do_append(self, s, c):
        return State(sets.union([s.df, *[plain(self.query(q)).df for q in c["queries"]]]))

    def do_union(self, s, c):
        parts = [plain(self.query(q)) for q in c["queries"]]
        return State(sets.union([s.df, *[order.head(p.df, p.order, c["maxout"]) if c["maxout"] else p.df for p in parts]]))

    def do_multisearch(self, s, c):
        df = sets.union([plain(self.query(q)).df for q in c["queries"]])
        return State(df, order.default_order(df))

    def do_appendcols(self, s, c):
        other = self.query(c["query"])
        return State(sets.appendcols(s.df, other.df, s.order, other.order, c["override"], c["maxout"]), s.order)

    def do_appendpipe(self, s, c):
        return State(sets.union([s.df, plain(self.commands(s, c["query"].commands, c["query"])).df]))

    def do_from(self, s, c):
        return self.scan(c["source"])

    def do_makeresults(self, s, c):
        df = self.engine.spark.range(c["n"]).select(F.lit(self.now).cast("timestamp_ntz").alias("_time"))
        if c["annotate"]:
            df = df.withColumns({n: F.lit(None).cast("string") for n in ("_raw", "host", "source", "sourcetype")})
        return State(df, [("_time", True)])

    # sessions and analytics
    def do_sessionize(self, s, c):
        return State(sessions.sessionize(s.df, c["maxpause"], c["by"]), [*[(n, False) for n in c["by"]], ("_time", False)])

    def do_transaction(self, s, c):
        df = sessions.transaction(s.df, c["names"], c["maxspan"], c["maxpause"], c["startswith"], c["endswith"])
        return State(df, [("_time", True)])

    def do_xyseries(self, s, c):
        return State(analytics.xyseries(s.df, c["x"], c["y"], c["v"], s.order))

    def do_untable(self, s, c):
        return State(analytics.untable(s.df, c["x"], c["y"], c["v"]))

    def do_outliers(self, s, c):
        return State(analytics.outliers(s.df, c["field"], c["method"], float(c["threshold"])), s.order)

    def do_correlate(self, s, c):
        return State(analytics.correlate(s.df, c["a"], c["b"], c["method"]))

    def do_patterns(self, s, c):
        return State(analytics.patterns(s.df, c["field"], int(c["max_templates"]), float(c["similarity"])))

    def do_topology(self, s, c):
        return State(analytics.topology(s.df, c["source_field"], c["dest_field"], c["weight_field"], int(c["max_nodes"])))

    def do_trace(self, s, c):
        return State(analytics.trace(s.df, c["trace_id"], c["span_id"], c["parent_id"]))

    def do_glimpse(self, s, c):
        return State(analytics.glimpse(s.df, c["n"]))

    # sinks and views
    def do_tee(self, s, c):
        return State(sinks.tee(s.df, c["name"]), s.order)

    def _views(self):
        if self.engine.views is None:
            raise QueryError("the engine has no folder for views")
        return self.engine.views

    def do_materialize(self, s, c):
        self._views().save(c["view"], s.df, c["retention"], c["partition_by"])
        return State(self._views().read(c["view"]))

    def do_views(self, s, c):
        if c["view"] and c["retention"]:
            self._views().set_retention(c["view"], c["retention"])
        return State(self._views().table(c["view"]))

    def do_dropview(self, s, c):
        self._views().drop(c["name"])
        return State(self._views().table())

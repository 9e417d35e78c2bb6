"""Live queries as structured streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..lang.ast import Query, QueryError
from ..lang.parser import parse
from ..operators import order
from ..plans.engine import Engine, Run, State

#: Commands that keep no state between rows.
ALLOWED = frozenset("search where eval fields table rename rex regex fillnull bin json unpack replace pack head".split())
CATCHUP, MOST = 100, 10_000


def check(q: Query) -> None:
    for c in q.commands:
        if c.name not in ALLOWED:
            raise QueryError(f"{c.name} cannot run on a live tail")


def stream(engine: Engine, source: DataFrame, text: str, now: datetime | None = None) -> DataFrame:
    """The query's commands over a streaming source."""
    program = parse(text)
    if program.datasets:
        raise QueryError("datasets cannot be part of a live tail")
    check(program.query)
    run = Run(engine, {}, now or datetime.now())
    # rows of a stream come in their own order, so head is a plain limit there
    state = State(source, [])
    for c in program.query.commands:
        state = State(state.df.limit(c["n"]), []) if c.name == "head" else run.commands(state, [c], Query(None, []))
    return state.df


def tail(engine: Engine, history: DataFrame, source: DataFrame, text: str, key: str, count: int = CATCHUP, since: str = "-1h", now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(catch-up rows, live stream): the newest `count` rows of history since a time, oldest first, and the stream without the
    rows that the catch-up has. The event key decides, so rows that share their time with the last one are not lost."""
    if count > MOST:
        raise QueryError(f"catch-up is limited to {MOST} rows")
    start = times.resolve(since, now)
    past = history.where(F.col("_time") >= F.lit(start).cast("timestamp_ntz"))
    newest = past.orderBy(*order.columns(past, [("_time", True)])).limit(count)
    seen = newest.select(F.col(key).alias("_seen"))
    live = source.join(F.broadcast(seen), source[key] == F.col("_seen"), "left_anti")
    caught = stream(engine, newest, text, now)
    return (caught.orderBy("_time") if "_time" in caught.columns else caught), stream(engine, live, text, now)


def windowed(source: DataFrame, aggs: list, span: str, by: list[str] | None = None, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window; rows later than the delay are dropped, and a window is emitted once it is past."""
    width = f"{times.micros(span)} microseconds"
    w = F.window("_time", width, f"{times.micros(slide)} microseconds") if slide else F.window("_time", width)
    g = source.withColumn("_time", F.col("_time").cast("timestamp")).withWatermark("_time", delay).groupBy(w.alias("_window"), *[F.col(f"`{n}`") for n in by or []]).agg(*aggs)
    return g.select(F.col("_window.start").cast("timestamp_ntz").alias("_time"), *[F.col(f"`{n}`") for n in g.columns if n != "_window"])


def sessions(source: DataFrame, aggs: list, maxpause: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Aggregates by session, which ends with a pause longer than maxpause."""
    w = F.session_window("_time", f"{times.micros(maxpause)} microseconds")
    g = source.withColumn("_time", F.col("_time").cast("timestamp")).withWatermark("_time", delay).groupBy(w.alias("_session"), *[F.col(f"`{n}`") for n in by]).agg(*aggs)
    return g.select(F.col("_session.start").cast("timestamp_ntz").alias("_session_start"), F.col("_session.end").cast("timestamp_ntz").alias("_session_end"), *[F.col(f"`{n}`") for n in g.columns if n != "_session"])


def results(df: DataFrame, batch: int = 1000):
    """Rows of a finished query one after another, without holding them all in the driver."""
    yield from df.toLocalIterator(prefetchPartitions=True)

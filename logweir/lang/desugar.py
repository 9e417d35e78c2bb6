"""Shortcut commands, written out as the commands they stand for."""

from __future__ import annotations

from .ast import Agg, Bin, Call, Command, Field, Lit, QueryError, SortKey, Test
from .expressions import Tokens, aggregate, aggregates, by, expression


def _agg(text: str) -> Agg:
    return aggregate(Tokens(text))


def top_by(group, sort_aggs, aggs, n, bottom):
    keys = [group] if group else []
    return [Command("stats", {"aggs": aggs, "by": keys}), Command("sort", {"keys": [SortKey(sort_aggs[0].alias, not bottom)]}), Command("head", {"n": n, "offset": 0})]


def latency(t: Tokens):
    f = t.name()
    span = t.value() if t.word("every") else None
    keys = by(t)
    span = span or (t.value() if t.word("every") else "5m")
    if t.word("compute"):
        aggs = []
        while True:
            n = t.name().lower()
            aggs.append(_agg("count") if n == "count" else _agg(f"{n}('{f}') as {n}"))
            if not t.op(","):
                break
    else:
        aggs = [_agg(f"{p}('{f}') as {p}") for p in ("p50", "p95", "p99")] + [_agg("count")]
    return Command("timechart", {"span": span, "aggs": aggs, "by": keys})


def errors(t: Tokens):
    keys = by(t)
    aggs = aggregates(t) if t.word("compute") else [_agg("count")]
    keep = Test("in", Field("level"), (Lit("error"), Lit("fatal")))
    return [Command("where", {"expr": keep}), Command("stats", {"aggs": aggs, "by": keys or by(t)})]


def rate(t: Tokens):
    span = t.value() if t.word("per") else "1m"
    keys = by(t)
    return Command("timechart", {"span": t.value() if t.word("per") else span, "aggs": [_agg("count as rate")], "by": keys})


def proportion(t: Tokens):
    p = expression(t)
    if not t.word("as"):
        raise QueryError("proportion needs AS")
    a = t.name()
    span = t.value() if t.word("every") else None
    keys = by(t)
    aggs = [Agg("count", (Call("eval", (p,)),), f"{a}_num"), _agg(f"count as '{a}_den'")]
    first = Command("timechart", {"span": span, "aggs": aggs, "by": keys}) if span else Command("stats", {"aggs": aggs, "by": keys})
    share = Bin("/", Bin("*", Field(f"{a}_num"), Lit(1.0)), Field(f"{a}_den"))
    return [first, Command("eval", {"assign": [(a, share)]})]


def impact(t: Tokens):
    if t.peek()[1].lower() == "by":
        a = _agg("count as n")
    else:
        a = aggregate(t)
        if t.items[t.at - 2][1].lower() != "as":
            a = Agg(a.func, a.args, "n", a.level)
    keys = by(t)
    if not keys:
        raise QueryError("impact needs BY")
    total = Agg("sum", (Field(a.alias),), f"total_{a.alias}")
    return [
        Command("stats", {"aggs": [a], "by": keys}),
        Command("eventstats", {"aggs": [total], "by": []}),
        Command("eval", {"assign": [(f"pct_{a.alias}", Bin("/", Bin("*", Field(a.alias), Lit(1.0)), Field(total.alias)))]}),
        Command("sort", {"keys": [SortKey(a.alias, True)]}),
    ]


def baseline(t: Tokens):
    f = t.name()
    window = t.option("window")
    if window is None:
        raise QueryError("baseline needs window=")
    keys = by(t)
    x = Field(f)
    aggs = [Agg("avg", (x,), f"baseline_{f}"), Agg("stdev", (x,), f"stdev_{f}")]
    delta = Bin("-", x, Field(f"baseline_{f}"))
    z = Call("if", (Bin(">", Field(f"stdev_{f}"), Lit(0)), Bin("/", Bin("*", Field(f"delta_{f}"), Lit(1.0)), Field(f"stdev_{f}")), Lit(None)))
    return [
        Command("streamstats", {"aggs": aggs, "by": keys, "window": int(window), "current": False}),
        Command("eval", {"assign": [(f"delta_{f}", delta), (f"z_{f}", z)]}),
    ]


def changes(t: Tokens):
    f = t.name()
    keys = by(t)
    before = Field(f"previous_{f}")
    differs = Bin("and", Test("null", before, (), True), Bin("!=", Field(f), before))
    return [
        Command("streamstats", {"aggs": [Agg("last", (Field(f),), f"previous_{f}")], "by": keys, "window": 0, "current": False}),
        Command("where", {"expr": differs}),
    ]


def exemplars(t: Tokens):
    n = t.integer(3)
    keys = by(t)
    newest = Command("sort", {"keys": [SortKey("_time", True)]})
    return [newest, Command("dedup", {"n": n, "names": keys}) if keys else Command("head", {"n": n, "offset": 0})]


def percentiles(t: Tokens):
    f = t.name()
    return Command("stats", {"aggs": [_agg(f"{p}('{f}') as {p}") for p in ("p50", "p75", "p90", "p95", "p99")], "by": by(t)})


def slowest(t: Tokens):
    n = t.integer(10)
    names = []
    while t.peek()[0] in ("ident", "quoted") and t.peek()[1].lower() != "by":
        names.append(t.name())
    given = by(t)
    group, dur = names, given[0] if given else "duration_ms"
    if not group:
        return [Command("sort", {"keys": [SortKey(dur, True)]}), Command("head", {"n": n, "offset": 0})]
    a = Agg("max", (Field(dur),), f"max_{dur}")
    return [Command("stats", {"aggs": [a], "by": group}), Command("sort", {"keys": [SortKey(a.alias, True)]}), Command("head", {"n": n, "offset": 0})]


#: The macros of the standard library, by name.
FRAGMENTS = {
    "parse_combined": "unpack_combined",
    "parse_syslog": "unpack_syslog",
    "parse_nginx": "parse combined(_raw) | let duration_s = duration_ms / 1000",
    "parse_json": "unpack_json",
    "parse_logfmt": "unpack_logfmt",
    "errors_only": 'where level="error" OR level="ERROR" OR severity="error"',
    "last_hour": "where _time >= now() - 1h",
    "top_sources": "stats count by source | sort -count | head 20",
    "slow_requests": "where duration_ms > 1000 | sort -duration_ms | head 50",
}


def fragment(text: str, extra: dict[str, str] | None = None):
    from .parser import parse_query

    name = text.removeprefix("@").removeprefix("stdlib/").strip()
    known = FRAGMENTS | (extra or {})
    if name not in known:
        raise QueryError(f"unknown fragment {text!r}")
    return parse_query("| " + known[name]).commands

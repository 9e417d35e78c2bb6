"""Programs and commands. Sugar commands become the plain ones they stand for (see desugar.py)."""

from __future__ import annotations

import re

from . import desugar
from .ast import Command, Field, Program, Query, QueryError, Source
from .expressions import Tokens, aggregate, aggregates, by, expression, unquote
from .search import parse_search

#: The formats that parse and unpack_ know.
FORMATS = "json logfmt syslog combined clf nginx_error cef kv docker redis apache_error postgres mysql_slow haproxy leef w3c pattern".split()
#: Accepted by the grammar, never run.
REJECTED = "addinfo convert fieldsummary flatten iplocation tags typer thru timewrap tstats mstats".split()


def split_top(text: str, sep: str) -> list[str]:
    """Pieces between separators outside quotes and brackets."""
    out, depth, start, quote, i = [], 0, 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c == '"' or c == "'" and (i == 0 or not text[i - 1].isalnum()):
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    if quote:
        raise QueryError("a quotation does not end")
    if depth:
        raise QueryError("brackets do not match")
    return [*out, text[start:]]


def parse(text: str, params: dict | None = None) -> Program:
    for k, v in (params or {}).items():
        shown = str(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
        text = re.sub(rf"\${re.escape(k)}\b", lambda _, s=shown: s, text)
    text = "\n".join(line for line in text.split("\n") if not line.lstrip().startswith(("//", "#")))
    datasets, query = [], None
    for part in split_top(text, ";"):
        if not part.strip():
            continue
        if m := re.match(r"\s*\$(\w+)\s*=(?!=)\s*(.*)", part, re.S):
            datasets.append((m[1], parse_query(m[2])))
        elif query is not None:
            raise QueryError("only one query may follow the datasets")
        else:
            query = parse_query(part)
    if query is None:
        raise QueryError("the program has no query")
    return Program(datasets, query)


def parse_query(text: str) -> Query:
    segments = [s.strip() for s in split_top(text, "|")]
    source, commands = None, []
    piped = bool(segments) and not segments[0]
    if piped:
        segments = segments[1:]
    for i, s in enumerate(segments):
        if not s:
            raise QueryError("a command between two pipes is missing")
        if i == 0:
            source, s = _source(s)
            if not s:
                continue
        commands += parse_command(s, first=i == 0 and not piped)
    return Query(source, commands)


_RANGE = re.compile(r"\s*\[([^\]\[]*)\]")


def _source(text: str) -> tuple[Source | None, str]:
    """from a, b*, !c[-1h]; index=a; index a: and what follows."""
    m = re.match(r"(from|index)\b\s*(=)?\s*", text, re.I)
    if not m or m[1].lower() == "from" and m[2]:
        return None, text
    rest, names, cte = text[m.end() :], [], None
    item = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|\$\w+|!?[\w*?][\w*?.:/-]*)""")
    while True:
        n = item.match(rest)
        if not n:
            raise QueryError(f"expected a source near {rest[:20]!r}")
        name = n[1].strip("\"'")
        if name.startswith("$"):
            cte = name[1:]
        names.append(name)
        rest = rest[n.end() :]
        comma = re.match(r"\s*,", rest)
        if not comma or m[2]:
            break
        rest = rest[comma.end() :]
    s = Source(names, cte)
    if r := _RANGE.match(rest):
        s.earliest, s.latest = time_range(r[1])
        rest = rest[r.end() :]
    return s, rest.strip()


def time_range(text: str) -> tuple[str, str | None]:
    low, dots, high = text.partition("..")
    return low.strip(), high.strip() if dots and high.strip() else None


def parse_command(text: str, first: bool = False) -> list[Command]:
    m = re.match(r"([A-Za-z_]\w*)", text)
    name = m[1].lower() if m else ""
    follows = text[m.end() :].lstrip() if m else ""
    if name in COMMANDS and not re.match(r"(=|!=|<|>|==|=~|!~)", follows) and not re.match(r"(?i)(in|like|between|is)\b", follows):
        out = COMMANDS[name](name, follows)
        return out if isinstance(out, list) else [out]
    if first:
        return [_search("search", text)]
    t = Tokens(text)
    e = expression(t)
    if isinstance(e, Field) or not t.done():
        raise QueryError(f"unknown command {text.split()[0]!r}")
    return [Command("where", {"expr": e})]


def _all(t: Tokens, out):
    if not t.done():
        raise QueryError(f"unexpected {t.rest()[:30]!r} in {t.text!r}")
    return out


def _search(name: str, text: str) -> Command:
    bounds = {}
    for key in ("earliest", "latest"):
        m = re.search(rf"(?<![\w.]){key}\s*=\s*(\"[^\"]*\"|\S+)", text)
        if m:
            bounds[key] = m[1].strip('"')
            text = text[: m.start()] + text[m.end() :]
    index = re.match(r"\s*index\s*=\s*(\"[^\"]*\"|[\w*?.:-]+)\s*", text)
    if index:
        text = text[index.end() :]
        bounds["index"] = index[1].strip('"')
    return Command("search", {"tree": parse_search(text), **bounds})


def _where(name, text):
    t = Tokens(text)
    e = expression(t)
    return _all(t, Command("where", {"expr": e}))


def _eval(name, text):
    t = Tokens(text)
    out = []
    while True:
        field = t.name()
        t.need("=")
        out.append((field, expression(t)))
        if not t.op(","):
            return _all(t, Command("eval", {"assign": out}))


def _stats(name, text):
    t = Tokens(text)
    aggs = aggregates(t)
    return _all(t, Command("stats", {"aggs": aggs, "by": by(t)}))


def _count(name, text):
    return _stats("stats", "count " + text)


def _group(name, text):
    t = Tokens(text)
    if not t.word("by"):
        raise QueryError("group needs by")
    keys = t.names()
    aggs = aggregates(t) if t.word("compute") else [aggregate(Tokens("count"))]
    return _all(t, Command("stats", {"aggs": aggs, "by": keys}))


def _every(name, text):
    t = Tokens(text)
    span = t.value()
    keys = by(t)
    t.word("compute")
    aggs = [aggregate(Tokens("count"))] if t.done() else aggregates(t)
    return _all(t, Command("timechart", {"span": span, "aggs": aggs, "by": keys or by(t)}))


def _timechart(name, text):
    t = Tokens(text)
    span = t.option("span")
    aggs = aggregates(t)
    span = span or t.option("span")
    keys = by(t)
    span = span or t.option("span")
    return _all(t, Command("timechart", {"span": span or "1h", "aggs": aggs, "by": keys}))


def _chart(name, text):
    t = Tokens(text)
    aggs = aggregates(t)
    keys: list[str] = []
    if t.word("over"):
        keys.append(t.name())
        keys += by(t)
    else:
        keys = by(t)
        while t.peek()[0] == "ident":
            keys.append(t.name())
    return _all(t, Command("chart", {"aggs": aggs, "keys": keys}))


def _sort_keys(t: Tokens):
    from .ast import SortKey

    out = []
    while not t.done():
        sign = t.op("-", "+")
        n = t.name()
        desc = sign == "-"
        if t.word("desc"):
            desc = True
        else:
            t.word("asc")
        out.append(SortKey(n, desc))
        t.op(",")
    if not out:
        raise QueryError("sort needs a field")
    return out


def _sort(name, text):
    t = Tokens(text)
    if name == "order":
        t.word("by")
    if t.peek()[0] == "number":
        t.next()
    return Command("sort", {"keys": _sort_keys(t)})


def _limit(name, text):
    t = Tokens(text)
    n = t.integer(10)
    offset = t.integer() if t.word("offset") else 0
    return _all(t, Command("head", {"n": n, "offset": offset}))


def _offset(name, text):
    t = Tokens(text)
    return _all(t, Command("offset", {"n": t.integer()}))


def _tail(name, text):
    t = Tokens(text)
    return _all(t, Command("tail", {"n": t.integer(10)}))


def _plain(name, text):
    if text.strip():
        raise QueryError(f"{name} takes no arguments")
    return Command(name)


def _fields(name, text):
    t = Tokens(text)
    sign = t.op("+", "-") if name == "fields" else None
    return _all(t, Command("fields", {"names": t.names(), "drop": name == "omit" or sign == "-"}))


def _table(name, text):
    t = Tokens(text)
    out = []
    while not t.done():
        n = t.name()
        out.append((n, t.name() if t.word("as") else n))
        t.op(",")
    return Command("table", {"names": out})


def _rename(name, text):
    t = Tokens(text)
    out = []
    while True:
        old = t.name()
        if not t.word("as"):
            raise QueryError("rename needs AS")
        out.append((old, t.name()))
        if not t.op(","):
            return _all(t, Command("rename", {"pairs": out}))


def _dedup(name, text):
    t = Tokens(text)
    n = t.integer(1)
    return _all(t, Command("dedup", {"n": n, "names": t.names()}))


def _rex(name, text):
    t = Tokens(text)
    field = t.option("field") or "_raw"
    kind, pattern = t.next()
    if kind != "string":
        raise QueryError("rex needs a quoted pattern")
    field = t.option("field") or field
    return _all(t, Command("rex", {"field": field, "pattern": unquote(pattern)}))


def _regex(name, text):
    t = Tokens(text)
    field, negated = "_raw", False
    if t.peek()[0] != "string":
        field = t.name()
        negated = t.need("=", "!=") == "!="
    kind, pattern = t.next()
    if kind != "string":
        raise QueryError("regex needs a quoted pattern")
    return _all(t, Command("regex", {"field": field, "pattern": unquote(pattern), "negated": negated}))


def _replace(name, text):
    t = Tokens(text)
    pairs = []
    while True:
        old = t.value()
        if not t.word("with"):
            raise QueryError("replace needs WITH")
        pairs.append((old, t.value()))
        if not t.op(","):
            break
    return _all(t, Command("replace", {"pairs": pairs, "fields": t.names() if t.word("in") else []}))


def _fillnull(name, text):
    t = Tokens(text)
    value = t.option("value")
    return _all(t, Command("fillnull", {"value": "" if value is None else value, "fields": [] if t.done() else t.names()}))


def _bin(name, text):
    t = Tokens(text)
    span = t.option("span")
    field = t.name()
    span = span or t.option("span")
    alias = t.name() if t.word("as") else field
    span = span or t.option("span")
    return _all(t, Command("bin", {"field": field, "span": span or "1h", "alias": alias}))


def _json(name, text):
    t = Tokens(text)
    field, paths = "_raw", []
    while not t.done():
        if (v := t.option("field", "path", "paths")) is not None:
            if t.last == "field":
                field = v
            elif t.last == "path":
                paths.append((v, t.name() if t.word("as") else v))
            else:
                paths += [(p.strip(), p.strip()) for p in v.split(",")]
        else:
            p = t.name()
            paths.append((p, t.name() if t.word("as") else p))
        t.op(",")
    return Command("json", {"field": field, "paths": paths})


def _unpack(name, text):
    t = Tokens(text)
    args: dict = {"format": name.removeprefix("unpack_"), "field": "_raw", "prefix": "", "only": [], "keep": False, "if_missing": False, "options": {}}
    if args["format"] == "pattern":
        args["options"]["pattern"] = unquote(t.next()[1])
    while not t.done():
        if t.word("from"):
            args["field"] = t.name()
        elif t.word("fields"):
            t.need("(")
            args["only"] = t.names()
            t.need(")")
        elif t.word("prefix"):
            t.op("=")
            args["prefix"] = t.name()
        elif t.word("keep_original"):
            args["keep"] = True
        elif (v := t.option("delim", "assign", "quote", "header")) is not None:
            args["options"][t.last] = v
        else:
            raise QueryError(f"unexpected {t.rest()[:20]!r} in {name}")
    return Command("unpack", args)


def _parse(name, text):
    t = Tokens(text)
    fmt = t.name().lower()
    t.need("(")
    args: dict = {"format": fmt, "field": t.name(), "prefix": "", "only": [], "keep": False, "if_missing": False, "options": {}}
    while t.op(","):
        if (v := t.option("delim", "assign", "quote", "header", "pattern")) is not None:
            args["options"][t.last] = v
        else:
            args["options"]["pattern"] = t.value()
    t.need(")")
    while not t.done():
        if t.word("as"):
            args["prefix"] = t.name() + "."
        elif t.word("extract"):
            t.need("(")
            args["only"] = t.names()
            t.need(")")
        elif t.word("if_missing"):
            args["if_missing"] = True
        else:
            raise QueryError(f"unexpected {t.rest()[:20]!r} in parse")
    if fmt == "regex":
        return Command("rex", {"field": args["field"], "pattern": args["options"].get("pattern", "")})
    if fmt not in FORMATS:
        raise QueryError(f"unknown format {fmt!r}")
    return Command("unpack", args)


def _pack(name, text):
    t = Tokens(text)
    names = [] if t.peek()[1].lower() == "into" else t.names()
    if not t.word("into"):
        raise QueryError("pack needs INTO")
    return _all(t, Command("pack", {"names": names, "into": t.name()}))


def _unroll(name, text):
    t = Tokens(text)
    f = t.option("field")
    names = [f] if f else t.names()
    return _all(t, Command("unroll", {"names": names, "limit": None, "alias": t.name() if t.word("as") else None}))


def _mvexpand(name, text):
    t = Tokens(text)
    limit = t.option("limit")
    f = t.name()
    limit = limit or t.option("limit")
    return _all(t, Command("unroll", {"names": [f], "limit": int(limit) if limit else None}))


def _makemv(name, text):
    t = Tokens(text)
    o: dict = {}
    while (v := t.option("delim", "tokenizer", "allowempty", "setsv")) is not None:
        o[t.last] = v
    return _all(t, Command("makemv", {"field": t.name(), "delim": o.get("delim", " "), "tokenizer": o.get("tokenizer"), "allowempty": o.get("allowempty", "false").lower() in ("true", "t", "1")}))


def _mvcombine(name, text):
    t = Tokens(text)
    t.option("delim")
    return _all(t, Command(name, {"field": t.name()}))


def _streamstats(name, text):
    t = Tokens(text)
    o = {"window": 0, "current": True}

    def options():
        while (v := t.option("window", "current")) is not None:
            o[t.last] = int(v) if t.last == "window" else v.lower() in ("true", "t", "1")

    options()
    aggs = aggregates(t)
    options()
    keys = by(t)
    options()
    return _all(t, Command("streamstats", {"aggs": aggs, "by": keys, **o}))


def _eventstats(name, text):
    t = Tokens(text)
    aggs = aggregates(t)
    return _all(t, Command("eventstats", {"aggs": aggs, "by": by(t)}))


def _subquery(text: str) -> tuple[str, Query]:
    """What stands before the [subsearch], and the subsearch."""
    at = text.find("[")
    if at < 0 or not text.rstrip().endswith("]"):
        raise QueryError(f"expected [subsearch] in {text!r}")
    return text[:at].strip(), parse_subsearch(text[at:].strip()[1:-1])


def parse_subsearch(text: str) -> Query:
    text = text.strip()
    if re.fullmatch(r"\$\w+", text):
        return Query(Source([text], text[1:]), [])
    return parse_query(text)


def _subqueries(text: str) -> tuple[str, list]:
    """Leading options, then names and [subsearches]."""
    out, i, lead = [], 0, ""
    for piece in re.split(r"(?=\[)", text, maxsplit=1)[:1]:
        lead = piece
    i = len(lead)
    while i < len(text):
        if text[i] == "[":
            depth, j, quote = 0, i, ""
            while j < len(text):
                c = text[j]
                if quote:
                    j += c == "\\"
                    quote = "" if c == quote else quote
                elif c == '"':
                    quote = c
                elif c == "[":
                    depth += 1
                elif c == "]":
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            out.append(parse_subsearch(text[i + 1 : j]))
            i = j + 1
        elif text[i] in ", \n\t":
            i += 1
        else:
            m = re.match(r'"[^"]*"|[$\w*?.:-]+', text[i:])
            if not m:
                raise QueryError(f"unexpected {text[i : i + 10]!r}")
            out.append(Query(_source("from " + m[0])[0], []))
            i += m.end()
    return lead, out


def _join(name, text):
    lead, q = _subquery(text)
    t = Tokens(lead)
    how = t.option("type") or "inner"
    if how not in ("inner", "left", "outer"):
        raise QueryError(f"unknown join type {how!r}")
    return _all(t, Command("join", {"how": how, "key": t.name(), "query": q}))


def _lookup(name, text):
    t = Tokens(text)
    ds = t.name()
    if not t.word("on"):
        raise QueryError("lookup needs ON")
    q = Query(Source([ds], ds[1:] if ds.startswith("$") else None), [])
    return _all(t, Command("join", {"how": "left", "key": t.name(), "query": q, "lookup": True}))


def _append(name, text):
    _, q = _subquery(text)
    return Command("append", {"queries": [q]})


def _union(name, text):
    lead, out = _subqueries(text)
    t = Tokens(lead)
    maxout = None
    while (v := t.option("maxout", "maxtime", "timeout")) is not None:
        maxout = int(v) if t.last == "maxout" else maxout
    while not t.done():
        out.insert(0, Query(_source("from " + t.name())[0], []))
        t.op(",")
    if not out:
        raise QueryError(f"{name} needs datasets")
    return Command(name, {"queries": out, "maxout": maxout})


def _appendcols(name, text):
    lead, q = _subquery(text)
    t = Tokens(lead)
    o: dict = {}
    while (v := t.option("override", "maxout", "maxtime", "timeout")) is not None:
        o[t.last] = v
    return Command("appendcols", {"query": q, "override": o.get("override", "false").lower() in ("true", "t", "1"), "maxout": int(o["maxout"]) if "maxout" in o else None})


def _appendpipe(name, text):
    _, q = _subquery(text)
    return Command("appendpipe", {"query": q})


def _transaction(name, text):
    t = Tokens(text)
    names, o = [], {}
    while not t.done():
        if (v := t.option("maxspan", "maxpause", "startswith", "endswith")) is not None:
            o[t.last] = v
        else:
            names.append(t.name())
            t.op(",")
    if not names:
        raise QueryError("transaction needs a field")
    return Command("transaction", {"names": names, **o})


def _xyseries(name, text):
    t = Tokens(text)
    out = []
    while not t.done():
        out.append(t.name())
        t.op(",")
    if len(out) != 3:
        raise QueryError(f"{name} needs three fields")
    return Command(name, {"x": out[0], "y": out[1], "v": out[2]})


def _options(defaults: dict):
    def parse_(name, text):
        t = Tokens(text)
        o = dict(defaults)
        while (v := t.option(*defaults)) is not None:
            o[t.last] = v
        return _all(t, Command(name, o))

    return parse_


def _correlate(name, text):
    t = Tokens(text)
    a = t.name()
    t.op(",")
    b = t.name()
    return _all(t, Command("correlate", {"a": a, "b": b, "method": t.option("method") or "pearson"}))


def _top(name, text):
    t = Tokens(text)
    n = t.integer(10)
    f = t.name()
    if t.word("by"):
        if is_agg_next(t):
            a = aggregate(t)
            return _all(t, desugar.top_by(f, [a], [a], n, name != "top"))
        return _all(t, Command("top" if name == "top" else "rare", {"n": n, "field": f, "by": t.name()}))
    return _all(t, Command("top" if name == "top" else "rare", {"n": n, "field": f, "by": None}))


def is_agg_next(t: Tokens) -> bool:
    from .expressions import is_aggregate

    return t.peek()[0] == "ident" and is_aggregate(t.peek()[1]) and t.peek(1) == ("op", "(")


def _topby(name, text):
    t = Tokens(text)
    n = t.integer(10)
    f = t.name()
    if t.word("using"):
        a = aggregate(t)
        more = aggregates(t) if t.word("compute") else []
        return _all(t, desugar.top_by(f, [a], [a, *more], n, name == "bottomby"))
    group = t.name() if t.word("by") else None
    a = aggregate(Tokens(f"{'max' if name == 'topby' else 'min'}({f})"))
    return _all(t, desugar.top_by(group, [a], [a], n, name == "bottomby"))


def _rank(name, text):
    t = Tokens(text)
    bottom = t.word("bottom")
    t.word("top")
    n = t.integer(10)
    if not t.word("by"):
        raise QueryError("rank needs BY")
    from .ast import SortKey

    return _all(t, [Command("sort", {"keys": [SortKey(t.name(), not bottom)]}), Command("head", {"n": n, "offset": 0})])


def _sugar(name, text):
    t = Tokens(text)
    return _all(t, getattr(desugar, name)(t))


def _rollup(name, text):
    t = Tokens(text)
    spans = [t.value()]
    while t.op(","):
        spans.append(t.value())
    return _all(t, Command("rollup", {"spans": spans, "by": by(t)}))


def _sessionize(name, text):
    t = Tokens(text)
    pause = t.option("maxpause")
    keys = by(t)
    pause = pause or t.option("maxpause") or "30m"
    return _all(t, Command("sessionize", {"maxpause": pause, "by": keys}))


def _compare(name, text):
    t = Tokens(text)
    t.word("previous")
    return _all(t, Command("compare", {"shift": t.value()}))


def _glimpse(name, text):
    t = Tokens(text)
    return _all(t, Command("glimpse", {"n": t.integer(10000)}))


def _from(name, text):
    source, rest = _source("from " + text)
    return [Command("from", {"source": source}), *(parse_command(rest) if rest else [])]


def _makeresults(name, text):
    t = Tokens(text)
    n = t.integer(1)
    annotate = False
    while (v := t.option("count", "annotate", "splunk_server", "splunk_server_group", "format", "data")) is not None:
        if t.last in ("format", "data"):
            raise QueryError(f"makeresults {t.last}= is not supported")
        n = int(v) if t.last == "count" else n
        annotate = v.lower() in ("true", "t", "1") if t.last == "annotate" else annotate
    return _all(t, Command("makeresults", {"n": n, "annotate": annotate}))


def _materialize(name, text):
    t = Tokens(text)
    o: dict = {"view": t.name(), "retention": None, "partition_by": []}
    while not t.done():
        if (v := t.option("retention")) is not None:
            o["retention"] = v
        elif t.word("partition_by"):
            t.need("=")
            o["partition_by"] = t.names()
        else:
            raise QueryError(f"unexpected {t.rest()[:20]!r} in materialize")
    return Command("materialize", o)


def _views(name, text):
    t = Tokens(text)
    return _all(t, Command("views", {"view": None if t.done() else t.name(), "retention": t.option("retention")}))


def _named(name, text):
    t = Tokens(text)
    return _all(t, Command(name, {"name": t.name()}))


def _use(name, text):
    return desugar.fragment(text.strip())


def _rejected(name, text):
    raise QueryError(f"{name} is not supported")


COMMANDS = {
    "search": _search, "where": _where, "eval": _eval, "let": _eval, "stats": _stats, "count": _count, "group": _group, "every": _every,
    "timechart": _timechart, "chart": _chart, "sort": _sort, "order": _sort, "head": _limit, "take": _limit, "limit": _limit, "offset": _offset,
    "tail": _tail, "reverse": _plain, "fields": _fields, "keep": _fields, "omit": _fields, "table": _table, "select": _table, "rename": _rename,
    "dedup": _dedup, "rex": _rex, "regex": _regex, "replace": _replace, "fieldformat": lambda n, s: Command("fieldformat"), "fillnull": _fillnull,
    "bin": _bin, "bucket": _bin, "json": _json, "parse": _parse, "pack_json": _pack, "pack": _pack, "unroll": _unroll, "explode": _unroll,
    "mvexpand": _mvexpand, "expand": _mvexpand, "makemv": _makemv, "mvcombine": _mvcombine, "nomv": _mvcombine, "streamstats": _streamstats,
    "running": _streamstats, "eventstats": _eventstats, "enrich": _eventstats, "join": _join, "lookup": _lookup, "append": _append,
    "multisearch": _union, "union": _union, "appendcols": _appendcols, "appendpipe": _appendpipe, "transaction": _transaction,
    "xyseries": _xyseries, "untable": _xyseries, "outliers": _options({"field": None, "method": "iqr", "threshold": "1.5"}), "correlate": _correlate,
    "patterns": _options({"field": "_raw", "max_templates": "50", "similarity": "0.4"}),
    "topology": _options({"source_field": "source", "dest_field": "dest", "weight_field": None, "max_nodes": "100"}),
    "trace": _options({"trace_id": "trace_id", "span_id": "span_id", "parent_id": "parent_span_id"}), "top": _top, "rare": _top, "bottom": _top,
    "topby": _topby, "bottomby": _topby, "rank": _rank, "rollup": _rollup, "sessionize": _sessionize, "compare": _compare, "glimpse": _glimpse,
    "describe": _plain, "from": _from, "makeresults": _makeresults, "materialize": _materialize, "views": _views, "dropview": _named, "tee": _named,
    "use": _use,
}
COMMANDS |= {f"unpack_{f}": _unpack for f in FORMATS}
COMMANDS |= {n: _sugar for n in ("latency", "errors", "rate", "proportion", "impact", "baseline", "changes", "exemplars", "percentiles", "slowest")}
COMMANDS |= {n: _rejected for n in REJECTED}

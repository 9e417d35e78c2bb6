"""Log formats: each gives named columns taken out of one text column.

Fields of a fixed format are expressions of their own, so those that a query does not use are pruned. Formats with free
keys (json, logfmt, kv, the tails of others) take their keys from ``extract(...)`` or from all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.ast import QueryError
from .patterns import quote

KEYS = 10_000
#: Names of syslog's severities and facilities by code (RFC 5424).
SEVERITIES = "emergency alert critical error warning notice info debug".split()
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()


#: Between the groups of one match. A text that has it is matched group by group.
SEP = "\x01"


def _part(s: Column, pattern: str, i: int, empty: tuple[str, ...] = ("-", "")) -> Column:
    """Group i of the first match; null without a match or where the group is a placeholder."""
    if "" in empty:
        return _filled(F.regexp_extract(s, pattern, i), empty)
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, i))


def _filled(got: Column, empty: tuple[str, ...]) -> Column:
    return F.when(~got.isin(*empty), got) if empty else got


def _groups(s: Column, pattern: str, n: int) -> Column:
    """An array with groups 1 to n of the first match at these places, which is matched once for all of them. Without a match it has
    no such places. The expression is the same for all groups, so Spark computes it once a row."""
    flat = F.regexp_replace(s, rf"\A(?s:.*?)(?:{pattern})(?s:.*)\z", "".join(f"{SEP}${i}" for i in range(1, n + 1)))
    each = F.when(s.rlike(pattern), F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.call_function("regexp_extract", s, F.lit(pattern), i)))
    return F.when(F.contains(s, F.lit(SEP)), each).otherwise(F.split(flat, SEP, -1))


def _parts(s: Column, pattern: str, names: str, empty=("-", "")) -> dict[str, Column]:
    """The groups of the first match by name."""
    got = _groups(s, pattern, len(names.split()))
    return {n: _filled(F.get(got, i), empty) for i, n in enumerate(names.split(), 1) if n != "_"}


def _first_of_equal(entries: Column) -> Column:
    """Of entries (k, v) with equal k the first. They are bound by the outer array: what a lambda takes from outside is computed for each element."""
    return F.transform(F.array(entries), lambda all_: F.filter(all_, lambda e, i: F.array_position(all_["k"], e["k"]) == i + 1))[0]


def _whole(cols: dict[str, Column], *names: str) -> dict[str, Column]:
    return cols | {n: cols[n].try_cast("long") for n in names if n in cols}


def _real(cols: dict[str, Column], *names: str) -> dict[str, Column]:
    return cols | {n: cols[n].try_cast("double") for n in names if n in cols}


def pairs(s: Column, assign: str = "=", delim: str | None = None, quote_: str = '"') -> Column:
    """key=value pairs as a map; values may be quoted. The first of equal keys counts."""
    a, q = quote(assign), quote(quote_)
    stop = r"\s" if delim is None or delim.strip() == "" else quote(delim)
    value = rf"(?:{q}((?:[^{q}\\]|\\.)*){q}|([^{stop}]*))"
    pattern = rf"([^\s{quote(delim) if delim and delim.strip() else ''}{a}{q}]+)\s*{a}\s*{value}" if delim and delim.strip() else rf"([^\s{a}{q}]+){a}{value}"
    keys = F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
    quoted = F.regexp_extract_all(s, F.lit(pattern), F.lit(2))
    plain = F.regexp_extract_all(s, F.lit(pattern), F.lit(3))
    vals = F.transform(F.arrays_zip(quoted.alias("q"), plain.alias("p")), lambda x: F.when(x["q"] != "", F.regexp_replace(x["q"], r"\\(.)", "$1")).otherwise(F.trim(x["p"])))
    entries = F.arrays_zip(keys.alias("k"), vals.alias("v"))
    return F.map_from_entries(F.transform(_first_of_equal(entries), lambda e: F.struct(e["k"], e["v"])))


def map_keys(df: DataFrame, m: Column, limit: int = KEYS) -> list[str]:
    rows = df.select(m.alias("m")).select(F.explode(F.map_keys("m")).alias("k")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise QueryError(f"the rows have more than {limit} different keys")
    return sorted(r["k"] for r in rows)


def _free(df: DataFrame, m: Column, only: list[str]) -> dict[str, Column]:
    return {k: F.try_element_at(m, F.lit(k)) for k in (only or map_keys(df, m))}


def json(df, s, only, o):
    from ..operators.rows import json_keys
    from .scalar import json_path

    return {k: F.get_json_object(s, json_path(k)) for k in (only or json_keys(df, s))}


def docker(df, s, only, o):
    cols = {k: F.get_json_object(s, f"$['{k}']") for k in ("log", "stream", "time")}
    return cols | {k: F.get_json_object(s, f"$['{k}']") for k in only if k not in cols} | {"log": F.regexp_replace(cols["log"], r"\n$", "")}


def logfmt(df, s, only, o):
    return _free(df, pairs(s), only)


def kv(df, s, only, o):
    return _free(df, pairs(s, o.get("assign", "="), o.get("delim"), o.get("quote", '"')), only)


def syslog(df, s, only, o):
    new = r"^<(\d{1,3})>\d+ (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]]*\])+) ?((?s).*)$"
    old = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: ?((?s).*)$"
    n = _parts(s, new, "priority timestamp hostname appname procid msgid structured_data message")
    b = _parts(s, old, "priority timestamp hostname appname procid message")
    cols = {k: F.coalesce(n[k], b[k]) if k in b else n[k] for k in n}
    p = cols["priority"].try_cast("long")
    names = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    facility, severity = F.floor(p / 8).cast("long"), p % 8
    fmt = F.when(s.rlike(new), "rfc5424").when(s.rlike(old), "rfc3164")
    return cols | {"priority": p, "facility": facility, "severity": severity, "facility_name": names(FACILITIES, facility), "severity_name": names(SEVERITIES, severity), "format": fmt}


_CLF = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "((\S+)(?: (\S+?))?(?: (HTTP/[\d.]+))?)" (\d{3}) (\d+|-)'
_CLF_NAMES = "client_ip ident user timestamp request method uri protocol status bytes"


def clf(df, s, only, o):
    return _whole(_parts(s, _CLF, _CLF_NAMES), "status", "bytes")


def combined(df, s, only, o):
    return _whole(_parts(s, _CLF + r' "([^"]*)" "([^"]*)"', _CLF_NAMES + " referer user_agent"), "status", "bytes")


def nginx_error(df, s, only, o):
    head = r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] (\d+)#(\d+): (?:\*(\d+) )?((?s).*)$"
    cols = _whole(_parts(s, head, "timestamp severity pid tid cid message"), "pid", "tid", "cid")
    tail = {k: _part(s, rf', {k}: "?([^",]*)"?', 1) for k in ("client", "server", "request", "upstream", "host", "referrer")}
    return cols | {"message": F.regexp_replace(cols["message"], r", client: .*$", "")} | tail


def apache_error(df, s, only, o):
    head = r"^\[([^\]]+)\] \[(?:([\w]+):)?(\w+)\](?: \[pid (\d+)(?::tid (\d+))?\])?(?: \[client ([^\]]*?)(?::(\d+))?\])?(?: (AH\d+):)? ?((?s).*)$"
    return _whole(_parts(s, head, "timestamp module severity pid tid client_ip client_port error_code message"), "pid", "tid", "client_port")


def _extension(text: Column, key: str = r"[\w.\[\]]+") -> Column:
    """CEF's key=value with blanks in values: a value ends before the next key."""
    hit = rf"{key}=(?:[^=\\]|\\.)*?(?=\s+{key}=|$)"
    both = F.transform(F.regexp_extract_all(text, F.lit(hit), F.lit(0)), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), x.substr(F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("v")))
    return F.map_from_entries(F.transform(_first_of_equal(both), lambda e: F.struct(e["k"], F.trim(F.regexp_replace(e["v"], r"\\(.)", "$1")))))


def cef(df, s, only, o):
    f = r"((?:[^|\\]|\\.)*)"
    head = rf"CEF:(\d+)\|{f}\|{f}\|{f}\|{f}\|{f}\|{f}\|((?s).*)$"
    names = "cef_version device_vendor device_product device_version signature_id name severity"
    cols = _parts(s, head, names + " extension", ())
    m = _extension(cols.pop("extension"))
    cols = {k: F.regexp_replace(v, r"\\(.)", "$1") for k, v in cols.items()}
    keys = [k for k in only if k not in cols] if only else map_keys(df, m)
    return cols | {k: F.try_element_at(m, F.lit(k)) for k in keys}


def leef(df, s, only, o):
    head = r"LEEF:([\d.]+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(?:(?:x|0x)?([^|\t=]{1,4})\|)?((?s).*)$"
    cols = _parts(s, head, "leef_version device_vendor device_product device_version event_id separator rest", ())
    sep, rest = _filled(cols.pop("separator"), ("-", "")), cols.pop("rest")
    d = F.coalesce(F.when(F.length(sep) > 1, F.char(F.conv(sep, 16, 10).cast("long"))), sep, F.lit("\t"))
    items = F.filter(F.split(rest, F.concat(F.lit("\\Q"), d, F.lit("\\E"))), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), x.substr(F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("v")))
    m = F.map_from_entries(_first_of_equal(entries))
    keys = [k for k in only if k not in cols] if only else map_keys(df, m)
    return cols | {k: F.try_element_at(m, F.lit(k)) for k in keys}


def redis(df, s, only, o):
    cols = _whole(_parts(s, r"^(\d+):([XCSM]) (\d+ \w+ \d{4} \d\d:\d\d:\d\d(?:\.\d+)?) ([.\-*#]) ((?s).*)$", "pid role_char timestamp level_char message", ()), "pid")
    role = F.create_map(*[F.lit(x) for x in ("M", "master", "S", "replica", "C", "rdb_child", "X", "sentinel")])
    level = F.create_map(*[F.lit(x) for x in (".", "debug", "-", "verbose", "*", "notice", "#", "warning")])
    return cols | {"role": role[cols["role_char"]], "level": level[cols["level_char"]]}


def postgres(df, s, only, o):
    head = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: \w+)?) (?:\[(\d+)\] )?(?:([\w-]+)@([\w-]+) )?([A-Z]+\d?): +((?s).*)$"
    cols = _whole(_parts(s, head, "timestamp pid user database severity message"), "pid")
    took = _part(s, r"duration: ([\d.]+) ms", 1).try_cast("double")
    return cols | {"duration_ms": took, "statement": _part(s, r"(?s)(?:statement|execute [^:]*): (.*)$", 1)}


def mysql_slow(df, s, only, o):
    num = lambda k: _part(s, rf"{k}: ([\d.]+)", 1)
    who = r"# User@Host: (\S+?)\[[^\]]*\] @ *(\S*) \[([^\]]*)\](?:\s+Id: *(\d+))?"
    cols = {"timestamp": _part(s, r"# Time: (.+)", 1)} | _whole(_parts(s, who, "user host client_ip connection_id"), "connection_id")
    cols |= {"query_time": num("Query_time").try_cast("double"), "lock_time": num("Lock_time").try_cast("double"), "rows_sent": num("Rows_sent").try_cast("long"), "rows_examined": num("Rows_examined").try_cast("long")}
    cols |= {"schema": F.coalesce(_part(s, r"Schema: (\w+)", 1), _part(s, r"(?im)^use (\w+);", 1))}
    body = F.regexp_replace(F.regexp_replace(s, r"(?m)^#.*\n?", ""), r"(?im)^(?:use \w+|SET timestamp=\d+);\n?", "")
    return cols | {"statement": F.when(s.contains("# ") & (F.trim(body) != ""), F.trim(F.regexp_replace(body, r";?\s*$", "")))}


#: Names of haproxy's timers and counters, in the order in which it prints them.
TIMERS = "tq tw tc tr tt".split()
COUNTERS = "actconn feconn beconn srv_conn retries".split()


def haproxy(df, s, only, o):
    head = r'(\d+\.\d+\.\d+\.\d+|[0-9a-fA-F:]+):(\d+) \[([^\]]+)\] (\S+) ([^\s/]+)(?:/(\S+))? (\S+) (\d+|-1) (\d+) \S+ \S+ (\S{4}) (\S+) \S+(?: \{[^}]*\})* "(\S+) (\S+) ?([^"]*)"'
    cols = _parts(s, head, "client_ip client_port timestamp frontend backend server timers status bytes term_state counters method uri protocol")
    split = lambda c, names: {n: F.get(F.split(cols[c], "/"), i).try_cast("long") for i, n in enumerate(names)}
    shown = {n: c for n, c in cols.items() if n not in ("timers", "counters")}
    return _whole(shown, "client_port", "status", "bytes") | split("timers", TIMERS) | split("counters", COUNTERS)


def w3c(df, s, only, o):
    header = o.get("header")
    if not header:
        first = df.select(s.alias("s")).where(F.col("s").startswith("#Fields:")).limit(1).collect()
        if not first:
            raise QueryError("w3c needs header= or a #Fields line")
        header = first[0]["s"]
    names = header.removeprefix("#Fields:").split()
    parts = F.when(~s.startswith("#"), F.split(s, r"[ \t]+"))
    got = {n: F.regexp_replace(F.get(parts, i), r"\+", " ") for i, n in enumerate(names)}
    return {n: F.when(c != "-", c) for n, c in got.items()}


def pattern(df, s, only, o):
    """%{name} or %{name:type} among plain text; types string, int, float, timestamp and rest."""
    template, regex, names = o.get("pattern") or "", "", []
    kinds = {"string": r"(\S+?)", "int": r"([+-]?\d+)", "float": r"([+-]?\d+(?:\.\d+)?)", "timestamp": r"(.+?)", "rest": r"((?s).*)"}
    for piece in re.split(r"(%\{[^}]*\})", template):
        if m := re.fullmatch(r"%\{([\w.]+)(?::(\w+))?\}", piece):
            kind = m[2] or "string"
            if kind not in kinds:
                raise QueryError(f"unknown type {kind!r} in a pattern")
            names.append((m[1], kind))
            regex += kinds[kind]
        else:
            regex += quote(piece)
    if not names:
        raise QueryError("a pattern needs fields")
    regex = f"^{regex}$"
    cols = {n: _part(s, regex, i, ()) for i, (n, _) in enumerate(names, 1)}
    return _real(_whole(cols, *[n for n, k in names if k == "int"]), *[n for n, k in names if k == "float"])


PARSERS = {f.__name__: f for f in (json, docker, logfmt, kv, syslog, clf, combined, nginx_error, apache_error, cef, leef, redis, postgres, mysql_slow, haproxy, w3c, pattern)}


def unpack(df: DataFrame, fmt: str, source: Column, only: list[str] | None = None, prefix: str = "", if_missing: bool = False, options: dict | None = None) -> DataFrame:
    """Adds the format's fields. A field that exists is replaced where the text has it; with if_missing only nulls are."""
    if fmt not in PARSERS:
        raise QueryError(f"unknown format {fmt!r}")
    cols = PARSERS[fmt](df, source, only or [], options or {})
    if only:
        cols = {n: cols.get(n, F.lit(None).cast("string")) for n in only}
    have = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for n, c in cols.items():
        name = prefix + n
        if name in have:
            old = F.col(f"`{name}`")
            c = F.coalesce(old, c.try_cast(have[name])) if if_missing else F.coalesce(c.cast("string"), old.cast("string")) if have[name].simpleString() == "string" else F.coalesce(c.try_cast(have[name]), old)
        out[name] = c
    return df.withColumns(out) if out else df

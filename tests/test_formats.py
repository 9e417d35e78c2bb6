import pytest
from pyspark.sql import functions as F

from logweir.functions import formats, times
from logweir.functions.patterns import glob_to_regex, named_groups, required_literal
from logweir.sources import readers, sinks


def one(spark, fmt, line, **options):
    df = spark.createDataFrame([(line,), ("no such format",)], "_raw string")
    return formats.unpack(df, fmt, F.col("_raw"), options=options).collect()


CASES = [
    ("logfmt", 'level=info msg="a \\"b\\" c" n=5 empty=', {"level": "info", "msg": 'a "b" c', "n": "5"}),
    ("combined", '1.2.3.4 - bob [10/Jan/2024:10:00:00 +0000] "GET /a?b HTTP/1.1" 404 12 "http://r" "curl"', {"client_ip": "1.2.3.4", "ident": None, "user": "bob", "method": "GET", "uri": "/a?b", "status": 404, "bytes": 12, "referer": "http://r", "user_agent": "curl"}),
    ("clf", '1.2.3.4 - - [10/Jan/2024:10:00:00 +0000] "GET / HTTP/1.0" 200 -', {"status": 200, "bytes": None, "protocol": "HTTP/1.0"}),
    ("syslog", "<165>1 2026-01-01T00:00:00Z host app 12 ID47 [a b=\"c\"] hello", {"priority": 165, "facility": 20, "severity": 5, "hostname": "host", "appname": "app", "procid": "12", "msgid": "ID47", "message": "hello", "format": "rfc5424", "facility_name": "local4"}),
    ("nginx_error", "2026/01/01 10:00:00 [error] 31#7: *9 open() failed, client: 1.2.3.4, server: x, request: \"GET / HTTP/1.1\"", {"severity": "error", "pid": 31, "tid": 7, "cid": 9, "message": "open() failed", "client": "1.2.3.4", "request": "GET / HTTP/1.1"}),
    ("apache_error", "[Fri Sep 09 10:42:29 2011] [core:error] [pid 35:tid 4] [client 1.2.3.4:99] AH00128: File missing", {"module": "core", "severity": "error", "pid": 35, "client_ip": "1.2.3.4", "client_port": 99, "error_code": "AH00128", "message": "File missing"}),
    ("cef", "CEF:0|V|P|1.0|100|na\\|me|10|src=1.2.3.4 msg=two words dst=5.6.7.8", {"device_vendor": "V", "name": "na|me", "severity": "10", "src": "1.2.3.4", "msg": "two words", "dst": "5.6.7.8"}),
    ("leef", "LEEF:2.0|V|P|1|42|^|src=1.2.3.4^usr=bob", {"event_id": "42", "src": "1.2.3.4", "usr": "bob"}),
    ("docker", '{"log":"hi\\n","stream":"stdout","time":"t"}', {"log": "hi", "stream": "stdout", "time": "t"}),
    ("redis", "12:M 01 Jan 2026 10:00:00.123 * Ready", {"pid": 12, "role": "master", "level": "notice", "message": "Ready"}),
    ("postgres", "2026-01-01 10:00:00.1 UTC [7] bob@db LOG:  duration: 1.5 ms  statement: SELECT 1", {"pid": 7, "user": "bob", "database": "db", "severity": "LOG", "duration_ms": 1.5, "statement": "SELECT 1"}),
    ("mysql_slow", "# Time: 2026-01-01T00:00:00Z\n# User@Host: bob[bob] @ h [1.2.3.4]  Id: 8\n# Query_time: 2.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 9\nuse shop;\nSET timestamp=1;\nSELECT 1;", {"user": "bob", "host": "h", "client_ip": "1.2.3.4", "connection_id": 8, "query_time": 2.5, "rows_examined": 9, "schema": "shop", "statement": "SELECT 1"}),
    ("haproxy", '10.0.0.1:99 [01/Jan/2026:00:00:00.1] fe be/s1 1/2/3/4/10 200 512 - - ---- 1/1/0/0/0 0/0 "GET / HTTP/1.1"', {"client_ip": "10.0.0.1", "client_port": 99, "frontend": "fe", "backend": "be", "server": "s1", "status": 200, "bytes": 512, "tt": 10, "method": "GET", "protocol": "HTTP/1.1"}),
]


@pytest.mark.parametrize("fmt,line,want", CASES, ids=[c[0] for c in CASES])
def test_format(spark, fmt, line, want):
    good, bad = one(spark, fmt, line)
    assert {k: good[k] for k in want} == want
    assert all(bad[k] is None for k in want)


def test_formats_with_options(spark):
    assert one(spark, "kv", "a:1;b:'x y'", delim=";", assign=":", quote="'")[0].asDict().items() >= {"a": "1", "b": "x y"}.items()
    assert one(spark, "w3c", "2026-01-01 GET -", header="#Fields: date method query")[0].asDict().items() >= {"date": "2026-01-01", "method": "GET", "query": None}.items()
    got = one(spark, "pattern", "job 7 took 1.5s: all (ok)", pattern="%{what} %{n:int} took %{s:float}s: %{rest:rest}")[0]
    assert (got["what"], got["n"], got["s"], got["rest"]) == ("job", 7, 1.5, "all (ok)")


def test_if_missing_keeps_values(spark):
    df = spark.createDataFrame([("a=1 b=2", "old", None)], "_raw string, a string, b string")
    r = formats.unpack(df, "logfmt", F.col("_raw"), ["a", "b"], if_missing=True).first()
    assert (r["a"], r["b"]) == ("old", "2")


def test_patterns_and_times():
    assert glob_to_regex("a*b?[!x]") == "a.*b.[^x]" and glob_to_regex("/a/*/b", True) == "/a/[^/]*/b"
    assert named_groups(r"(?P<a_b>\w+)(x)(?<c>y)") == (r"(\w+)(x)(y)", [("a_b", 1), ("c", 3)])
    assert required_literal(r"user=(\w+) failed\d*") == " failed"
    assert required_literal("a|b") is None and required_literal("ab?c") is None
    from datetime import datetime

    now = datetime(2026, 1, 7, 13, 14, 15)  # a Wednesday
    assert times.resolve("-1h@h", now) == datetime(2026, 1, 7, 12) and times.resolve("@w", now) == datetime(2026, 1, 5) and times.resolve("@w0", now) == datetime(2026, 1, 4)
    assert times.resolve("2026-01-01T01:00:00+01:00") == datetime(2026, 1, 1) and times.java_format("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


def test_readers(spark, tmp_path):
    f = tmp_path / "x.log"
    f.write_text('{"timestamp":"2026-01-01T00:00:00Z","level":"info"}\n{"timestamp":"2026-01-02T00:00:00Z","level":"error"}\n')
    df = readers.read_any(spark, str(f))
    assert df.where("level = 'error'").first()["_time"].day == 2
    bulk = tmp_path / "b.ndjson"
    bulk.write_text('{"index":{"_index":"web"}}\n{"@timestamp":1767225600,"m":"a"}\n{"create":{"_index":"app"}}\n{"m":"b"}\n')
    got = sorted((r["index"], r["_raw"]) for r in readers.read_es_bulk(spark, str(bulk)).collect())
    assert [g[0] for g in got] == ["app", "web"]
    more = tmp_path / "c.ndjson"
    more.write_text('{"delete":{"_index":"w"}}\n{"index":{"_index":"w"}}\n{"index":{"x":1}}\n\n{"update":{"_index":"w"}}\n{"doc":{}}\n{"create":{"_index":"w"}}\n{"n":2}\n' + '{"index":{"_index":"w"}}\n{"n":3}\n' * 500)
    got = sorted(r["_raw"] for r in readers.read_es_bulk(spark, str(more)).collect())
    assert got == ['{"index":{"x":1}}', '{"n":2}'] + ['{"n":3}'] * 500
    hec = spark.createDataFrame([('{"time":1767225600.5,"event":{"a":1},"host":"h","index":"i"}',)], "body string")
    assert readers.parse_hec(hec).first()["_raw"] == '{"a":1}'
    otlp = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service","value":{"stringValue":"s"}}]},"scopeLogs":[{"scope":{"name":"n"},"logRecords":[{"timeUnixNano":"1767225600000000000","severityNumber":17,"body":{"stringValue":"boom"},"attributes":[]}]}]}]}'
    r = readers.parse_otlp(spark.createDataFrame([(otlp,)], "body string")).first()
    assert (r["_raw"], r["level"], r["resource"]["service"], r["_time"].year) == ("boom", "ERROR", "s", 2026)
    framed = spark.createDataFrame([("7 <34>abc8 <35>defg",), ("<1>a\n<2>b",), ("7 <34>éa7 <35>abc",)], "b string").select(readers.split_frames(F.col("b")).alias("f")).collect()
    assert [list(r["f"]) for r in framed] == [["<34>abc", "<35>defg"], ["<1>a", "<2>b"], ["<34>éa", "<35>abc"]]
    assert [readers.detect(x) for x in (["a=1 b=2"], ["<3>x"], ["a,b,c", "1,2,3"], ["what"])] == ["logfmt", "syslog", "csv", "plain"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, None), ("y", 2, "z")], "host string, n long, m string")
    assert sinks.render(df, "json").split("\n")[0] == '{"host": "x", "n": 1}'
    assert sinks.render(df, "csv") == "host,n,m\nx,1,\ny,2,z\n"
    for f in sinks.FORMATS:
        assert "y" in sinks.render(df, f) or f == "raw"
    sinks.write(df, str(tmp_path / "o"), "tsv")
    assert spark.read.csv(str(tmp_path / "o"), header=True, sep="\t").count() == 2


def test_groups_of_one_match(spark):
    """Groups that are taken from one match are those of regexp_extract, also of texts with the separator, lines and no match."""
    cases = [
        (r"([a-z]+)=(\d+)?;(x|(y))?", 4, ["a=1;x", "--b=;y\nc=2;", "A=1", "", None, "q\x01a=1;", "a\x01=1;", "é𝄞=1; b=22;x", "a=1;x\n"]),
        (r"^(\S+) (.+?)(?: (\d+))?((?s).*)$", 4, ["a b 12 c", "a b\nc", "a b \n", " a b", "a \x01 3", "$1 \\\\ 4", None]),
        (r"(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)(k?)", 11, ["abcdefghij0", "xabcdefghijk"]),
    ]
    for pattern, n, texts in cases:
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        names = [f"g{i}" for i in range(1, n + 1)]
        for empty in ((), ("-", "")):
            one_match = formats._parts(F.col("s"), pattern, " ".join(names), empty)
            plain = {k: F.when(F.col("s").rlike(pattern), F.regexp_extract("s", pattern, i)) for i, k in enumerate(names, 1)}
            got = df.select(*[c.alias(k) for k, c in one_match.items()]).collect()
            want = [tuple(None if v in empty else v for v in r) for r in df.select(*[c.alias(k) for k, c in plain.items()]).collect()]
            assert [tuple(r) for r in got] == want


def test_equal_keys_and_escapes(spark):
    good = one(spark, "cef", "x CEF:0|V|P|1|2|n|3|a=1 2 b=x\\=y a=9 c= d.e[0]=z\n", )[0]
    assert [good[k] for k in ("a", "b", "c", "`d.e[0]`".strip("`"))] == ["1 2", "x=y", "", "z"]
    assert one(spark, "leef", "LEEF:2.0|V|P|1|42|^|a=1^b=x=y^a=2")[0].asDict().items() >= {"a": "1", "b": "x=y"}.items()
    assert one(spark, "logfmt", "a=1 b=2 a=3")[0].asDict().items() >= {"a": "1", "b": "2"}.items()


@pytest.mark.parametrize("fmt,columns", [("haproxy", 20), ("cef", 7)])
def test_a_format_is_matched_once(spark, fmt, columns):
    """One match for all groups: the plan has the head's pattern in one expression for each column, never an extraction of one group."""
    df = spark.range(1).selectExpr("string(id) as line")
    cols = formats.PARSERS[fmt](df, F.col("line"), ["src"], {})
    assert len(cols) >= columns
    plan = df.select(*[c.alias(n) for n, c in cols.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(line" in plan and not __import__("re").search(r"regexp_extract\(line#\d+, [^,]*, \d+\)", plan)

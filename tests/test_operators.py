from datetime import datetime, timedelta

import pytest

from logweir.lang.ast import QueryError

T0 = datetime(2026, 1, 1)


def at(m):
    return T0 + timedelta(minutes=m)


@pytest.fixture
def coerced(spark):
    return spark.createDataFrame([("1",), ("10",), ("9",), ("abc",), ("",), (None,)], "v string")


def test_numeric_strings_sort_as_numbers_and_nulls_first(ask, coerced):
    assert [r["v"] for r in ask(coerced, "| sort v")] == [None, "1", "9", "10", "", "abc"]
    assert [r["v"] for r in ask(coerced, "| sort -v")] == ["abc", "", "10", "9", "1", None]
    assert ask(coerced, "| stats min(v) as lo, max(v) as hi, sum(v) as s, count(v) as n") == [{"lo": "1", "hi": "abc", "s": 20.0, "n": 5}]


def test_two_valued_logic(ask, coerced):
    n = lambda q: ask(coerced, f"| where {q} | stats count")[0]["count"]
    assert n('v = "1"') == 1 and n('v != "1"') == 4 and n('not (v = "1")') == 5
    assert n("v > 5") == 3  # 10, 9, and abc, which is compared as text
    assert n("v is null") == 1 and n("v = null") == 1 and n("v?") == 5


def test_field_lookup_in_raw_json(ask, spark):
    df = spark.createDataFrame([('{"a":{"b":5},"c.d":"x","level":"error"}',), ("not json",)], "_raw string")
    assert ask(df, "| where a.b = 5 | table a.b, c.d") == [{"a.b": "5", "c.d": "x"}]
    assert ask(df, "level=ERROR | stats count") == [{"count": 1}]
    assert ask(df, "| search not* | stats count") == [{"count": 1}]
    assert ask(df, "| json a.b as n | where isnotnull(n) | table n") == [{"n": "5"}]
    assert ask(df, "| unpack_json | where level = \"error\" | table 'a.b', level") == [{"a.b": "5", "level": "error"}]


def test_mixed_types_and_missing_fields(ask, spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "i long, f double, s string")
    assert ask(df, '| eval a=i+f, b=s+s, c=i/0, d=missing, e=f"{missing}x", g=i . "-" . s | table a, b, c, d, e, g') == [{"a": 3.5, "b": "xx", "c": None, "d": None, "e": None, "g": "1-x"}]


def test_top_counts_missing_rows_in_percent(ask, spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert ask(df, "| top k") == [{"k": "a", "count": 2, "percent": 50.0}, {"k": "b", "count": 1, "percent": 25.0}]


def test_sessions_part_only_beyond_the_pause(ask, spark):
    df = spark.createDataFrame([("u", at(0)), ("u", at(30)), ("u", at(61)), ("v", at(0))], "k string, _time timestamp_ntz")
    got = ask(df, "| sessionize maxpause=30m by k | table k, _time, _session_id")
    assert sorted((r["k"], r["_time"], r["_session_id"]) for r in got) == [("u", at(0), 1), ("u", at(30), 1), ("u", at(61), 2), ("v", at(0), 3)]


def test_transactions(ask, spark):
    df = spark.createDataFrame([("u", at(0), "open"), ("u", at(1), "x"), ("u", at(2), "close"), ("u", at(3), "open"), ("u", at(4), "y")], "k string, _time timestamp_ntz, _raw string")
    got = ask(df, '| transaction k startswith="open" endswith="close" | sort _time | table eventcount, duration, _raw')
    assert got == [{"eventcount": 3, "duration": 120.0, "_raw": "open\nx\nclose"}, {"eventcount": 2, "duration": 60.0, "_raw": "open\ny"}]
    spans = ask(df, "| transaction k maxspan=90s | sort _time | table eventcount")
    assert [r["eventcount"] for r in spans] == [2, 2, 1]


def test_joins(ask, spark):
    df = spark.createDataFrame([("1", "l"), (None, "n")], "k string, v string")
    other = "[| makeresults | eval k=1, v=\"r\", w=\"x\" | table k, v, w]"
    assert ask(df, f"| join k {other}") == [{"k": "1", "v": "l", "w": "x"}]
    assert len(ask(df, f"| join type=left k {other}")) == 2
    assert len(ask(df, f"| join type=outer k {other}")) == 2


def test_multivalues(ask, spark):
    df = spark.createDataFrame([('[{"x":1},{"x":2}]', "[1,2]", "[1]"), ("plain", None, "[]")], "a string, b string, c string")
    assert [(r["a.x"]) for r in ask(df, "| unroll a | where isnotnull('a.x') | sort 'a.x'")] == ["1", "2"]
    assert len(ask(df, "| unroll a, b")) == 3  # equal lengths are zipped, the other row stays
    assert len(ask(df, "| unroll b, c")) == 2  # unequal lengths stay
    assert ask(df, "| eval m=split(\"a||b\", \"|\") | makemv delim=\"|\" a | nomv b | head 1 | table b")[0]["b"] in ("1\n2", None)


def test_trace_tree(ask, spark):
    rows = [("t", "1", "", at(0)), ("t", "2", "1", at(1)), ("t", "3", "2", at(2)), ("t", "4", "1", at(3)), ("t", "9", "missing", at(4))]
    df = spark.createDataFrame([(*r, f"op{r[1]}") for r in rows], "trace_id string, span_id string, parent_span_id string, _time timestamp_ntz, operation string")
    got = ask(df, "| trace")
    assert [(r["_span_depth"], r["_span_tree"]) for r in got] == [(0, "op1"), (1, "├── op2"), (2, "│   └── op3"), (1, "└── op4"), (0, "op9")]


def test_patterns(ask, spark):
    df = spark.createDataFrame([(f"user {i} failed from 10.0.0.{i}",) for i in range(9)] + [("disk full",)], "_raw string")
    got = ask(df, "| patterns")
    assert [(r["pattern"], r["count"], r["percent"]) for r in got] == [("user <*> failed from <*>", 9, 90.0), ("disk full", 1, 10.0)]


def test_outliers_without_spread(ask, spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (9.0,)], "x double")
    assert [r["_score"] for r in ask(df, "| outliers field=x")] == [0.0] * 5
    assert sum(r["_outlier"] for r in ask(df, "| outliers field=x method=zscore threshold=1.5")) == 1


def test_spearman_uses_average_ranks(ask, spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "a long, b long")
    assert round(ask(df, "| correlate a b method=spearman")[0]["_correlation"], 6) == 0.948683


def test_compare_and_appendcols_order(ask, spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    got = ask(df, "| sort -k | fields n | appendcols [from main | sort -k | table k]")
    assert sorted((r["n"], r["k"]) for r in got) == [(1, "a"), (2, "b")]


def test_streamstats_and_order(ask, spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "i long, k long")
    assert [r["s"] for r in ask(df, "| sort i | streamstats sum(i) as s by k | sort i")] == [0, 1, 2, 4, 6, 9]
    assert [r["i"] for r in ask(df, "| sort i | tail 2")] == [4, 5]
    assert [r["i"] for r in ask(df, "| sort i | reverse | head 2")] == [5, 4]
    assert [r["m"] for r in ask(df, "| sort i | streamstats mode(k) as m, count as c | sort i | head 3")] == ["0", "0", "0"]


def test_rejects_unknown(ask, spark):
    df = spark.range(1)
    assert ask(df, "from nowhere | stats count, sum(x) as s") == [{"count": 0, "s": 0.0}]
    for q in ("| eval a=nosuch(1)", "from system.nothing", "| outliers field=id method=x"):
        with pytest.raises(QueryError):
            ask(df, q)


def test_filters_and_columns_reach_the_scan(spark):
    """Conditions show among the pushed filters, and only columns that a query reads are read."""
    from logweir.queries import NOW, engine

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def plan(text):
        df = engine(spark, "/root/testdata/sf0.001").query(text, now=NOW)
        return df._jdf.queryExecution().executedPlan().toString().split("FileScan", 1)[1]

    p = plan('from events[-7d] | where value > 50 and (event_type = "view" or user_id in (1, 2)) | stats count by user_id')
    pushed = p.split("PushedFilters: [", 1)[1].split("ReadSchema", 1)[0]
    for part in ("GreaterThan(value,50.0)", "GreaterThanOrEqual(ts", "EqualTo(event_type,view)", "In(user_id, [1,2])"):
        assert part in pushed, pushed
    assert "props" not in p.split("ReadSchema", 1)[1] and "event_id" not in p.split("ReadSchema", 1)[1]
    assert "LessThan(ts" in plan("from events | where _time < @2024-01-10 | stats count")


def test_conditions_agree_with_two_valued_logic(ask, spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, None), (None, None)], "n long, s string")
    for q, want in (("n > 0 or s = \"a\"", 3), ("not (n > 0 or s = \"a\")", 1), ("n != 1", 1), ("not n = 1", 3), ("n in (1, 2) and s = \"a\"", 1), ("n between 1 and 2", 2), ("not (n between 1 and 1)", 3), ("(n > 1) xor (s = \"a\")", 3), ("n = s", 1)):
        assert ask(df, f"| where {q} | stats count")[0]["count"] == want, q


def plain_templates(lines, similarity):
    """Every line against every template of its length."""
    found = []
    for pattern, count, example in lines:
        words = pattern.split(" ")
        best, share = None, 0.0
        for t in found:
            same = sum(a == b and a != "<*>" for a, b in zip(t[0], words, strict=True)) / len(words)
            if same >= similarity and same > share:
                best, share = t, same
        if best is None:
            found.append([words, count, example])
        else:
            best[0] = [a if a == b else "<*>" for a, b in zip(best[0], words, strict=True)]
            best[1] += count
    return [(" ".join(w), n, e) for w, n, e in found]


def test_templates_agree_with_plain_merging():
    import random

    from logweir.operators.analytics import Templates

    rng = random.Random(5)
    for similarity in (0.1, 0.34, 0.5, 0.6, 0.75, 1.0, 1.5):
        for size in (1, 3, 5, 8):
            lines = [(" ".join(rng.choice(["<*>", "a", "b", "c", f"w{rng.randrange(9)}", f"x{rng.randrange(99)}"]) for _ in range(size)), rng.randrange(1, 9), str(i)) for i in range(150)]
            got = Templates(similarity)
            for line in lines:
                got.add(*line)
            assert list(got.rows()) == plain_templates(lines, similarity)


def test_patterns_of_many_lines(ask, spark):
    """Lines that cannot merge are not held against each other; long dotted numbers are variable; blank lines have no pattern."""
    import time

    n = 30_000
    df = spark.range(n).selectExpr("concat('GET w', translate(string(id), '0123456789', 'abcdefghij'), ' for user at 10.0.0.', id, ':80 now') as _raw")
    df = df.unionByName(spark.createDataFrame([(" \t\n",), ("",), (None,)], "_raw string"))
    began = time.time()
    got = ask(df, "| patterns similarity=1.0 max_templates=100000")
    assert len(got) == n and {(r["count"], r["pattern"][-len(" for user at <*> now"):]) for r in got} == {(1, " for user at <*> now")}
    assert time.time() - began < 60


def test_patterns_of_many_first_words(ask, spark):
    """Groups of lines are merged within one stream of a task; a call of Python for each of them costs milliseconds."""
    df = spark.range(4000).selectExpr("concat('/p', translate(string(id), '0123456789', 'abcdefghij'), if(id % 2 = 0, '', ' x'), if(id % 4 = 1, ' y', '')) as _raw")
    from logweir.operators import analytics

    plan = analytics.patterns(df, max_templates=9999)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = ask(df.unionByName(df), "| patterns max_templates=9999")
    assert len(got) == 4000 and {r["count"] for r in got} == {2}


def test_sketches_stand_beside_distinct_counts(ask, spark):
    """estdc is not kept for each value of dc's field; nulls are groups, and columns keep their order."""
    import re

    from logweir.lang.ast import Agg, Field
    from logweir.operators import aggregate

    df = spark.range(3000).selectExpr("id % 700 as x", "nullif(id % 3, 2) as k", "id as n")
    args = (Field("x"),)
    plan = aggregate.stats(df, [Agg("estdc", args, "u"), Agg("dc", args, "d")], [])._jdf.queryExecution().executedPlan().toString()
    mixed = [line for line in plan.split("\n") if "approx_count_distinct" in line and re.search(r"keys=\[[^\]]*(?:x#|id#|%)", line)]
    assert "approx_count_distinct" in plan and not mixed
    got = ask(df, "| stats estdc(x) as u, dc(x) as d, count, estdc(n) as v by k")
    assert [list(r) for r in got] == [["k", "u", "d", "count", "v"]] * 3
    assert {r["k"] for r in got} == {0, 1, None} and all(r["d"] == 700 and r["count"] == 1000 and abs(r["u"] - 700) < 30 and abs(r["v"] - 1000) < 40 for r in got)
    alone = ask(df, "| stats estdc(x) as u")[0]["u"]
    assert ask(df, "| stats dc(x) as d, estdc(x) as u") == [{"d": 700, "u": alone}]
    assert ask(df.where("k > 9"), "| stats dc(x) as d, estdc(x) as u, estdc_error(x) as e") == [{"d": 0, "u": 0, "e": 0.0}]


def test_trees_of_many_traces(ask, spark):
    """Traces over several batches and many in one; parents are missing, the span itself or on a cycle. No call of Python for each trace."""
    import random

    from logweir.operators import analytics

    rng = random.Random(3)
    rows = []
    for t in range(300):
        n = 700 if t == 9 else rng.randrange(1, 9)
        for i in range(n):
            rows.append((f"t{t}", f"s{i:03}", rng.choice(["", None, f"s{rng.randrange(n):03}", f"s{rng.randrange(n):03}", "gone"]), at(rng.randrange(50)), f"op{t}-{i}"))
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, _time timestamp_ntz, operation string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        plan = analytics.trace(df)._jdf.queryExecution().executedPlan().toString()
        got = ask(df, "| trace")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for t in sorted({r[0] for r in rows}):
        spans = sorted((r for r in rows if r[0] == t), key=lambda r: (r[3], r[1]))
        ids, seen = {r[1] for r in spans}, set()

        def below(r, depth):
            if r[1] in seen:
                return
            seen.add(r[1])
            want.append((t, r[4], depth))
            for child in spans:
                if child[2] == r[1] and child is not r:
                    below(child, depth + 1)

        for r in [r for r in spans if r[2] not in ids or r[2] == r[1]] + spans:
            below(r, 0)
    assert [(r["trace"], r["operation"], r["_span_depth"]) for r in got] == want
    assert all(r["_span_tree"].endswith(r["operation"]) for r in got)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan

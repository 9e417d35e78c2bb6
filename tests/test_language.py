import pytest

from logweir.lang.ast import Bin, Call, Compare, Field, FString, Junction, Lit, QueryError, Test, Time, Un, Word
from logweir.lang.expressions import Tokens, expression
from logweir.lang.parser import parse, split_top
from logweir.lang.search import parse_search


def e(text):
    t = Tokens(text)
    x = expression(t)
    assert t.done(), t.rest()
    return x


def test_precedence_of_expressions():
    assert e("a or b and not c") == Bin("or", Field("a"), Bin("and", Field("b"), Un("not", Field("c"))))
    assert e("a xor b or c") == Bin("xor", Field("a"), Bin("or", Field("b"), Field("c")))
    assert e("1 + 2*3 - x") == Bin("-", Bin("+", Lit(1), Bin("*", Lit(2), Lit(3))), Field("x"))
    assert e("a ?? b = 1") == Bin("=", Call("coalesce", (Field("a"), Field("b"))), Lit(1))


def test_tests_and_literals():
    assert e('x not in (1, "a")') == Test("in", Field("x"), (Lit(1), Lit("a")), True)
    assert e("x between 1 and 2 and y") == Bin("and", Test("between", Field("x"), (Lit(1), Lit(2))), Field("y"))
    assert e("x is not null") == Test("null", Field("x"), (), True)
    assert e("x?") == Test("null", Field("x"), (), True)
    assert e("a?.b") == Field("a.b")
    assert e("_time >= -1h") == Bin(">=", Field("_time"), Time("-1h"))
    assert e("'odd name' = -5") == Bin("=", Field("odd name"), Lit(-5))
    assert e('f"a{x}b"') == FString((Lit("a"), Field("x"), Lit("b")))


def test_or_binds_tighter_than_and_in_searches():
    assert parse_search("a b OR c") == Junction("and", (Word("a"), Junction("or", (Word("b"), Word("c")))))
    assert parse_search('status>=500 NOT "x y"') == Junction("and", (Compare("status", ">=", "500"), Junction("not", (Word("x y", True),))))
    assert parse_search("(a OR b) case(C)") == Junction("and", (Junction("or", (Word("a"), Word("b"))), Word("C", True, "case")))


def test_programs():
    p = parse('$big = from events | where value > 5; FROM $big | stats count by "a|b"')
    assert [n for n, _ in p.datasets] == ["big"] and p.query.source.cte == "big"
    p = parse("from a*, !ab[-1h..now] | head 3")
    assert (p.query.source.names, p.query.source.earliest, p.query.source.latest) == (["a*", "!ab"], "-1h", "now")
    assert [c.name for c in parse("level=error | count by x | rank top 3 by x").query.commands] == ["search", "stats", "sort", "head"]
    assert parse("| where x = $n", {"n": 'a"b'}).query.commands[0]["expr"] == Bin("=", Field("x"), Lit('a"b'))


@pytest.mark.parametrize("text", ["", "| frobnicate x", "| stats", "| where (a", "| tstats count", "| head x y", '| eval a="b', "| join x", "from a | | head", "| makeresults format=csv"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_split_respects_quotes_and_brackets():
    assert split_top('a "|" [b | c] | d', "|") == ['a "|" [b | c] ', " d"]

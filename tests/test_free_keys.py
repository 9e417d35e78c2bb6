import pytest
from pyspark.sql import functions as F

from logweir.functions import formats
from logweir.lang.ast import QueryError
from logweir.operators import rows


@pytest.mark.parametrize("fmt,line,late", [("json", '{"a":1}', '{"b":{"c":2}}'), ("logfmt", "a=1", "b.c=2"), ("kv", "a=1", "b.c=2")])
def test_keys_of_late_rows_are_found(spark, fmt, line, late):
    df = spark.createDataFrame([(line,)] * 1500 + [(late,), ("[1]",), (None,)], "_raw string").coalesce(1)
    out = formats.unpack(df, fmt, F.col("_raw"))
    assert {"a", "b.c"} <= set(out.columns) and out.where("`b.c` = '2'").count() == 1 and out.where("a = '1'").count() == 1500


def test_too_many_keys_are_an_error(spark):
    df = spark.createDataFrame([(f'{{"k{i}": 1}}', f"k{i}=1") for i in range(5)], "j string, l string")
    assert len(rows.json_keys(df, F.col("j"), 5)) == len(formats.map_keys(df, formats.pairs(F.col("l")), 5)) == 5
    with pytest.raises(QueryError):
        rows.json_keys(df, F.col("j"), 4)
    with pytest.raises(QueryError):
        formats.map_keys(df, formats.pairs(F.col("l")), 4)

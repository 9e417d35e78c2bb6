"""The registered queries over the smallest tables, against SQL where there is some, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import common, exact_dedup, language_id, queries

from test_near_sets import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_stage(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, before, SF), name)
        if name != "source_mixing":
            assert docs.columns == columns and docs.join(before, columns, "left_anti").count() == 0
        if name == "language_id":
            learn = ~common.held_out(4, 2)
            net = language_id.fit(before, learn)
            least = 0.25 + language_id.REJECT * (language_id.least_sure(before, learn, net) - 0.25)
            rows = before.collect()
            langs, scores = language_id.predict(net, [r["text"].encode() if r["text"] else None for r in rows])
            assert 0.25 < least < 1 and {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r, lang, x in zip(rows, langs, scores, strict=True) if lang != "und" and x >= least}
            assert docs.count() > 0.99 * before.count()  # the given documents are in a language
        if name == "exact_dedup":
            assert docs.count() == sum(r["kept"] for r in exact_dedup.decide(before).collect()) == before.selectExpr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t").distinct().count()
        if name == "simhash_near_dedup":
            rows = before.orderBy("doc_id").collect()
            first = {}
            for r, c in zip(rows, brute([r["text"] for r in rows]), strict=True):
                first.setdefault(c, r["doc_id"])
            assert {r["doc_id"] for r in docs.collect()} == set(first.values())
    assert set(columns) < set(docs.columns) and docs.count() > 0
    assert docs.groupBy("doc_id").count().join(docs.select("doc_id", "n_copies").distinct(), "doc_id").where("count <> n_copies").count() == 0


def test_stages_with_clashing_and_null_columns(spark):
    """Columns named like the operators' own, nulls everywhere, repeated rows: no stage stumbles."""
    docs = common.table(spark, SF, "documents").limit(20)
    names = ["_source", "_gone", "_t", "_id", "_key", "_language", "uid", "fp", "key", "kept", "keep_id", "component_id", "n", "copy_no"]
    docs = docs.select("*", *[F.nullif(F.lit(i), F.lit(-1)).alias(n) for i, n in enumerate(names)])
    nulls = spark.createDataFrame([tuple([None] * len(docs.columns))] * 2, docs.schema)
    docs = common.written(docs.unionAll(docs.limit(1)).unionAll(nulls), "clash")
    plain = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), name)
        assert set(plain) <= set(out.columns)
        if name in ("exact_dedup", "simhash_near_dedup"):
            assert out.where("doc_id is null").count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0

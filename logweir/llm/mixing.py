"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate, so that sources reach their target shares of an output of the wanted
size. A document's hash gives a uniform number; inverting its source's Poisson distribution there gives the
document's copies. Copies get a hashed key; they are dealt out and sorted by it, which shuffles globally.

A rate above PART is the sum of equal parts with hashes of their own (sums of Poisson numbers are Poisson), so
the inverted table stays short. Its 100 entries reach beyond the resolution of the hash.

Defined cases: a null source is a source of its own; a null doc_id is replaced by the MD5 of the text; rows that
agree in both get equal numbers of copies; sources without a weight get none. Columns copy_no, n_copies and
mix_key of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = "mix-1"
#: Default targets: a source's share is proportional to its rows to this power.
POWER = 0.5
PART, ENTRIES = 32.0, 100
#: Sources in a table that is broadcast.
BROADCAST_SOURCES = 10_000


def _number(digits: int, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, size: float = 1.0) -> DataFrame:
    """source, mean: the repetition rate for an output of `size` times the rows of docs."""
    n = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow("n", F.lit(power)))
    else:
        w = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        n = n.join(F.broadcast(w), n["source"].eqNullSafe(w["s"]), "left").drop("s").fillna(0.0, ["w"])
    total = n.agg(F.sum("n").alias("sum_n"), F.sum("w").alias("sum_w"))
    return n.join(F.broadcast(total)).select("source", (F.lit(size) * F.col("sum_n") * F.col("w") / F.col("sum_w") / F.col("n")).alias("mean")).where("mean > 0")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs with each row as often as its number says, in random order; copy_no from 1, n_copies, mix_key."""
    docs = docs.drop("copy_no", "n_copies", "mix_key")
    parts = F.ceil(F.col("mean") / PART)
    r = rates(docs, weights, power, size).select(F.col("source").alias("__mix_source"), parts.alias("__mix_parts"), (F.col("mean") / parts).alias("__mix_mean"))
    first = F.exp(-F.col("__mix_mean"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * F.col("__mix_mean") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("__mix_mean") / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    r = common.written(r.withColumn("__mix_cdf", table), "mix-rates")
    known = docs.join(common.small(r, bound=BROADCAST_SOURCES), docs["source"].eqNullSafe(F.col("__mix_source")))
    row = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    uniform = lambda j: _number(8, F.lit(seed), row, j.cast("string")) / float(1 << 32)

    def copies(j: Column) -> Column:
        u = uniform(j)
        return F.size(F.filter("__mix_cdf", lambda c: c <= u))

    n = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("__mix_parts")), F.lit(0), lambda acc, j: acc + copies(j))
    some = known.withColumn("n_copies", n).where("n_copies > 0").drop("__mix_source", "__mix_parts", "__mix_mean", "__mix_cdf")
    copied = some.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copied.withColumn("mix_key", _number(15, F.lit(seed), row, F.lit("copy"), F.col("copy_no").cast("string")))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT source, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
m AS (SELECT source, 1.0 * sum(n) OVER () * w / sum(w) OVER () / n AS mean FROM n),
r AS (SELECT source, ceil(mean / 32.0)::BIGINT AS parts, mean / ceil(mean / 32.0) AS mean FROM m),
k AS (SELECT unnest(range(0, 101)) AS k),
p AS (SELECT source, k, exp(-mean + k * ln(mean) - coalesce((SELECT sum(ln(j)) FROM unnest(range(1, k + 1)) AS f(j)), 0.0)) AS p FROM r, k),
c AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY source),
d AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS id, parts, cdf
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT *, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('mix-1:' || id || ':' || j::VARCHAR), 1, 8))::BIGINT / 4294967296.0))))::INTEGER AS n_copies FROM d),
f AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy_no FROM e WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no,
       ('0x' || substr(md5('mix-1:' || id || ':copy:' || copy_no::VARCHAR), 1, 15))::BIGINT AS mix_key FROM f
"""

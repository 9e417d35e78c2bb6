"""Personal data and the terms that give it away, with DataFrame functions only.

Base: four kinds of spans by fixed patterns. Their values are the protected entities. The method estimates from
the whole corpus how much a term discloses an entity: with n texts, n(e) with the entity, n(t) with the term and n(t, e)
with both, wherever in the text they stand, a reader who meets the term is left with

    h(e | t) = log2(n(t) / n(t, e))

bits of doubt about the entity, while log2(n / n(e)) were there before. The disclosure is 2^-h, the share of the term's
texts that have the entity; it does not depend on the corpus's size. It counts if the term takes away a bit at least. Terms
(words of LETTERS letters or more) at GENERALISE (a bit of doubt is left) or above are spans of kind ``term`` wherever they
stand, and are replaced by a placeholder; at REMOVE or above they are removed.

Equal texts count once in all figures: each of m equal rows counts 1 / m, so texts need not meet to be counted. A pair needs
SUPPORT different texts, which keeps chance meetings out; so an entity in fewer texts discloses nothing.

Texts are scanned for the base (which also notes the terms of texts with entities, and of one text in SHARE), then to
count the terms that may reach the threshold in all texts; texts in which revealing ones stand, once more for their places (in
upper or lower case). The noted terms bound n(t) from below, so only pairs go that cannot reach the threshold. What is shuffled are digests, entities,
terms and counts, combined before the shuffle; pairs are made within one text only, one after the other.

The patterns below accept exactly what the plain ones do, but cannot be tried again inside a run that failed
(possessive repeats, and a look behind or the end of the last match before a start), so very long runs cost linear time.

Defined cases: a null text is empty and has no spans; equal texts have equal spans, so rows are joined by the text's
64-bit digest; a term span that overlaps a base span is left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Tried before the patterns: where it does not match, the pattern has no valid match either.
IP_HINT, CARD_HINT = r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[ -]?[0-9]){15}"

#: Terms of one text in so many are noted: a lower bound that rules out most of the frequent ones.
SHARE = 16
#: Letters of a term; different texts that a pair needs.
LETTERS, SUPPORT = 4, 3
GENERALISE, REMOVE = 0.5, 0.9
#: Texts whose words or spans are broadcast.
TEXTS = 50_000
TERM = r"\p{L}{%d,}+" % LETTERS

#: Matches whose places are summed up together.
BLOCK = 256

Spans = "array<struct<kind: int, start: bigint, end: bigint, value: string>>"


def _none() -> Column:
    return F.array().cast(Spans)


def _places(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches as spans in code points: pieces between matches and matches alternate.

    Starts are running sums. They are summed within blocks of BLOCK pieces and over the blocks, since an array that
    grows by one element at a time is copied each time.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda b: F.slice(both, b * BLOCK + 1, BLOCK))
    long = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    zero = F.lit(0).cast("long")

    def whole(acc, block):
        total = acc["at"] + F.aggregate(block, zero, lambda a, x: a + long(x))
        return F.struct(total.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), block.alias("block")))).alias("out"))

    kind_of = "array<struct<at: bigint, block: array<struct<gap: string, hit: string>>>>"
    placed = F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast(kind_of).alias("out")), whole, lambda acc: acc["out"])

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.flatten(F.transform(placed, lambda p: F.aggregate(p["block"], F.struct(p["at"].alias("at"), _none().alias("out")), add, lambda acc: acc["out"])))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    odd = lambda i: F.ascii(d.substr(i, F.lit(1))) - 48
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, odd(i)).otherwise(F.when(odd(i) > 4, odd(i) * 2 - 9).otherwise(odd(i) * 2)),
    )
    return F.length(d).between(16, 19) & (total % 10 == 0)


def base_spans(text: Column) -> Column:
    """Valid spans of the four base kinds, by kind, then start."""
    byte = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}"
    email = F.when(F.contains(text, F.lit("@")), _places(text, EMAIL, 0)).otherwise(_none())
    ip = F.when(text.rlike(IP_HINT), F.filter(_places(text, IP, 1), lambda s: s["value"].rlike(byte))).otherwise(_none())
    card = F.when(text.rlike(CARD_HINT), F.filter(_places(text, CARD, 2), lambda s: F.when(F.length(_digits(s["value"])).between(16, 19), _luhn(s["value"])).otherwise(False))).otherwise(_none())
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_places(text, PHONE, 3), lambda s: F.length(_digits(s["value"])).between(8, 15))).otherwise(_none())
    return F.concat(email, ip, card, phone)


def _rows(docs: DataFrame) -> DataFrame:
    d = common.id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", F.xxhash64("text").alias("h"))


def _terms(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(words, lambda w: F.lower(w)))


def light_table(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, h (the text's digest), spans (base), terms: of texts with spans and of one text in `share`, else null."""
    d = _rows(docs).withColumn("spans", base_spans(F.col("text")))
    noted = (F.size("spans") > 0) | (F.pmod("h", F.lit(share)) == 0)
    return common.written(d.select("doc_id", "h", "spans", F.when(noted, _terms(F.col("text"))).alias("terms")), "pii-light")


def _repeated(light: DataFrame) -> DataFrame:
    """h, rows: of texts that more than one row has."""
    return common.written(light.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1"), "pii-repeated")


def _texts(counted: DataFrame, repeated: DataFrame, *by: str) -> DataFrame:
    """by, n: the different texts among the rows (h, by) of counted, a row for each text and value."""
    each = counted.join(common.small(repeated), "h", "left").groupBy(*by).agg(F.sum(F.lit(1.0) / F.coalesce("rows", F.lit(1))).alias("n"))
    return each.withColumn("n", F.round("n", 3))


def disclosure(docs: DataFrame, light: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(term, disclosure: the largest over entities, for terms at `generalise` or above; h, term: where they stand). Written tables."""
    repeated = _repeated(light)
    n = float(light.select("h").distinct().count())
    named = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))))
    near = light.where(F.size("spans") > 0).select("h", "terms", F.explode(named).alias("entity"))
    entities = common.written(_texts(near.select("h", "entity"), repeated, "entity").where(F.col("n") >= support).withColumnRenamed("n", "n_e"), "pii-entities")
    met = near.join(common.small(entities.select("entity")), "entity", "left_semi").select("h", "entity", F.explode("terms").alias("term"))
    pairs = common.written(_texts(met, repeated, "entity", "term").where(F.col("n") >= support).withColumnRenamed("n", "n_te"), "pii-pairs")
    share = lambda n_t: F.when(F.col("n_te") * F.lit(n) >= 2 * F.col(n_t) * F.col("n_e"), F.col("n_te") / F.col(n_t)).otherwise(0.0)
    # n(t) is at least n(t, e), and at least the number of noted texts that have t
    seen = _texts(light.where("terms is not null").select("h", F.explode("terms").alias("term")), repeated, "term")
    bound = pairs.join(common.small(entities), "entity").join(seen.withColumnRenamed("n", "least_t"), "term")
    pairs = common.written(bound.where(share("least_t") >= generalise).drop("least_t"), "pii-pairs")
    wanted = common.written(pairs.select("term").distinct(), "pii-candidates")
    held = common.written(holding(docs, wanted), "pii-held")
    scored = pairs.join(_texts(held, repeated, "term").withColumnRenamed("n", "n_t"), "term").select("term", share("n_t").alias("disclosure"))
    terms = common.written(scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise), "pii-terms")
    return terms, held


def holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """h, term: a row for each row of docs and term of the (written) table that its text contains."""
    rows = terms.count()
    words = _rows(docs).where(F.lit(rows > 0)).select("h", F.explode(_terms(F.col("text"))).alias("term"))
    return words.join(common.small(terms.select("term"), rows), "term", "left_semi").select("h", "term")


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, share: int = SHARE) -> DataFrame:
    """doc_id, h, spans: base and term spans by kind, then start; `removed` lists the values of terms to be removed."""
    light = light_table(docs, share)
    spark = docs.sparkSession
    with common.scratch(spark):
        terms, held = disclosure(docs, light, support, generalise)
        terms = common.small(terms)
        words = held.join(terms, "term").groupBy("h").agg(F.sort_array(F.collect_set("term")).alias("words"), F.collect_set(F.when(F.col("disclosure") >= remove, F.col("term"))).alias("removed"))
        words = common.written(words, "pii-words")
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
        # of equal texts every row gives the same places, so one row for each text is enough
        placed = _rows(docs).select("h", "text").join(common.small(words, bound=TEXTS), "h").select("h", "removed", _places(F.col("text"), pattern, 4).alias("terms"))
        held = placed.groupBy("h").agg(F.any_value("terms").alias("terms"), F.any_value("removed").alias("removed"))
        held = common.outlives(held, "pii-places")
    r = light.select("doc_id", "h", "spans").join(common.small(held, bound=TEXTS), "h", "left")
    free = F.filter(F.coalesce("terms", _none()), lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return r.select("doc_id", "h", F.concat("spans", free).alias("spans"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with spans replaced by [EMAIL], [IP], [CARD], [PHONE] or [TERM]; terms above REMOVE are left out.

    Of spans that overlap, the one that starts first is replaced. One row for each different (doc_id, text).
    """
    with common.scratch(docs.sparkSession):
        found = find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans", "removed").dropDuplicates(["_id", "_h"])
        found = common.outlives(found, "pii-found")
    d = _rows(docs)
    d = d.join(common.small(found, bound=TEXTS), d["doc_id"].eqNullSafe(F.col("_id")) & (d["h"] == F.col("_h")), "left")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(acc, s):
        new = F.when(F.array_contains("removed", F.lower(s["value"])) & (s["kind"] == 4), F.lit("")).otherwise(F.get(names, s["kind"]))
        text = F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), new)
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), text.alias("out")))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    out = F.aggregate(by_start, zero, put, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text").cast("long"))))
    return d.select("doc_id", F.coalesce(F.when(F.col("spans").isNotNull(), out), F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    r = find(common.table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    # a second parameter of the lambda, also one with a default, would be the place in the array
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    n = [F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(5)]
    return r.select("doc_id", *n, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

"""Line deduplication by site-relative frequency, with DataFrame functions only.

Pages become lines of visible text. A line's frequency on a host is the number of the host's pages that contain
it, divided by the host's pages; lines above the ratio are boilerplate there and are dropped from its pages.

Lines are counted by 128-bit hashes, so no text is shuffled, and counts are combined before their shuffle, so a host or line
with a third of all rows is no hot spot. A host has at
most (lines of its pages / pages / ratio) boilerplate lines, so its list is short however many pages it has; the
lists are joined to the pages by host (broadcast if few, otherwise a shuffle whose large partitions Spark splits),
and pages are never taken apart and put together again.

Defined cases: a null url is the host '' and a null html a page without lines; repeated rows count as pages of
their own; a line counts once a page; a line at the ratio exactly stays; hosts with fewer than MIN_PAGES pages keep all lines; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATIO, MIN_PAGES = 0.3, 4
#: Hosts whose lists are broadcast.
HOSTS = 5_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Applied in this order; blocks become line ends, other tags and what is not shown go.
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>")
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[^A-Za-z0-9>][^>]*)?>"
TAGS = r"<[^>]*>"
BLANKS = r"[ \t\r\f]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines(html: Column) -> Column:
    """Array of the lines that are not empty, blanks run together."""
    t = F.coalesce(html, F.lit(""))
    for r in HIDDEN:
        t = F.regexp_replace(t, r, "")
    t = F.regexp_replace(F.regexp_replace(t, BLOCKS, "\n"), TAGS, "")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(F.regexp_replace(t, BLANKS, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(line: Column) -> Column:
    """128 bits of a line, as two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("line")).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, boilerplate: the digests of the boilerplate lines of each host that has any. pages: host and lines (an array)."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", digest(F.col("line")).alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    common_lines = seen.join(common.small(common.written(totals, "line-hosts")), "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.written(common_lines.groupBy("host").agg(F.collect_set("line").alias("boilerplate")), "line-boilerplate")


def clean(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, host, n_lines, n_dropped, text (kept lines, joined by line feeds)."""
    p = common.written(pages.select("page_id", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines")), "line-pages")
    with common.scratch(pages.sparkSession):
        found = common.outlives(boilerplate(p, ratio, min_pages), "line-found")
    known = p.join(common.small(found, bound=HOSTS), "host", "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", digest(x))))
    k = known.select("page_id", "host", "lines", kept.alias("kept"))
    return k.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return clean(common.table(spark, sf_dir, "pages"))


def _sql_text() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = "coalesce(html, '')"
    for r in HIDDEN:
        t = f"regexp_replace({t}, {q(r)}, '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, {q(BLOCKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    for a, b in ENTITIES:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"


SQL = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
             list_filter(list_transform(string_split({_sql_text()}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host HAVING count(*) >= {MIN_PAGES}),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
b AS (SELECT l.host, line FROM l JOIN h ON l.host = h.host GROUP BY l.host, line, pages HAVING count(*) > {RATIO} * pages AND count(*) > 1),
x AS (SELECT host, list(line) AS boilerplate FROM b GROUP BY host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda y: NOT list_contains(coalesce(boilerplate, []), y)) AS kept FROM p LEFT JOIN x ON p.host = x.host)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""

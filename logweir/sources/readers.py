"""Files and landed payloads to events: _time, _raw, host, source, sourcetype and fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats
from ..lang.ast import QueryError

#: Field names that hold an event's time, first found first.
TIME_FIELDS = ("_time", "@timestamp", "timestamp", "time", "ts", "datetime", "date")


def to_time(c: Column) -> Column:
    """ISO 8601, or epoch seconds, milliseconds, microseconds or nanoseconds; null otherwise."""
    n = F.when(c.rlike(r"^\d{9,19}(\.\d+)?$"), c.try_cast("double"))
    seconds = F.when(n < 1e11, n).when(n < 1e14, n / 1e3).when(n < 1e17, n / 1e6).otherwise(n / 1e9)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), c.try_cast("timestamp")).cast("timestamp_ntz")


def with_time(df: DataFrame) -> DataFrame:
    """_time from the first time field that there is."""
    for n in TIME_FIELDS:
        if n in df.columns:
            c = F.col(f"`{n}`")
            kind = df.schema[n].dataType
            return df.withColumn("_time", c.cast("timestamp_ntz") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else to_time(c.cast("string")))
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("_raw"), F.col("_metadata.file_path").alias("source"))


def detect(lines: list[str]) -> str:
    """The format of at least 70 % of the lines: json, docker, combined, syslog, csv, tsv, logfmt or plain."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return "plain"
    tests = {
        "docker": lambda x: re.match(r'^\{"log":', x) is not None,
        "json": lambda x: x.lstrip().startswith("{") and x.rstrip().endswith("}"),
        "combined": lambda x: re.match(r'^\S+ \S+ \S+ \[[^\]]+\] "', x) is not None,
        "syslog": lambda x: re.match(r"^<\d{1,3}>", x) is not None,
        "logfmt": lambda x: len(re.findall(r"(?:^|\s)[\w.]+=", x)) >= 2,
        "tsv": lambda x: x.count("\t") > 0 and x.count("\t") == lines[0].count("\t"),
        "csv": lambda x: x.count(",") > 1 and x.count(",") == lines[0].count(","),
    }
    for name, test in tests.items():
        if sum(map(test, lines)) >= 0.7 * len(lines):
            return name
    return "plain"


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Reads a file of logs; without a format, the first 20 lines tell it."""
    fmt = fmt or detect([r["value"] for r in spark.read.text(path).limit(20).collect()])
    if fmt in ("csv", "tsv"):
        return with_time(spark.read.csv(path, header=True, inferSchema=True, sep="\t" if fmt == "tsv" else ","))
    lines = read_lines(spark, path)
    if fmt in ("plain", "raw"):
        return lines
    if fmt in ("json", "ndjson"):
        return read_ndjson(spark, path)
    return with_time(formats.unpack(lines, fmt, F.col("_raw")))


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read.option("prefersDecimal", False)
    df = reader.json(path)
    return with_time(df)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return with_time(spark.read.csv(path, header=True, inferSchema=True))


def parse_es_bulk(lines: DataFrame) -> DataFrame:
    """Action and document lines of bulk files. lines: one row per file with its whole text in `body`.

    The lines of a body are paired by position in the row, so no order across rows is needed.
    """
    items = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("l") - 2, F.lit(0))), lambda i: F.get("l", i).rlike(r'^\s*\{\s*"(index|create)"')), lambda i: F.struct(F.get("l", i).alias("action"), F.get("l", i + 1).alias("_raw")))
    d = lines.withColumn("l", items).select(F.explode(pairs).alias("p")).select("p.*")
    meta = F.coalesce(F.get_json_object("action", "$.index._index"), F.get_json_object("action", "$.create._index"))
    time = F.coalesce(*[F.get_json_object("_raw", f"$['{n}']") for n in TIME_FIELDS])
    return d.select(to_time(time).alias("_time"), "_raw", meta.alias("index"))


ACTION = r'^\s*\{\s*"(index|create|update|delete)"\s*:\s*\{'


def read_es_bulk(spark: SparkSession, path: str) -> DataFrame:
    """Documents of bulk files of any size, line by line: a line follows its action in the order of its file.

    A document may look like an action. Of lines that look like actions one after the other, every second is a document;
    a deletion has none.
    """
    lines = spark.read.text(path).select(F.col("value").alias("_raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(F.trim("_raw") != "")
    kind = F.regexp_extract("_raw", ACTION, 1)
    lines = lines.withColumn("kind", kind).withColumn("ends", (F.col("kind").isin("", "delete")).cast("int"))
    along = Window.partitionBy("file").orderBy("block", "line")
    lines = lines.withColumn("run", F.sum("ends").over(along) - F.col("ends"))
    lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("file", "run").orderBy("block", "line")))
    lines = lines.withColumn("acts", (F.col("kind") != "") & (F.col("place") % 2 == 1))
    action = F.when(F.lag("acts").over(along) & F.lag("kind").over(along).isin("index", "create"), F.lag("_raw").over(along))
    d = lines.withColumn("action", action).where("action is not null")
    meta = F.coalesce(F.get_json_object("action", "$.index._index"), F.get_json_object("action", "$.create._index"))
    time = F.coalesce(*[F.get_json_object("_raw", f"$['{n}']") for n in TIME_FIELDS])
    return d.select(to_time(time).alias("_time"), "_raw", meta.alias("index"))


def parse_hec(payloads: DataFrame) -> DataFrame:
    """HTTP event collector objects, one JSON object per row of `body`."""
    g = lambda p: F.get_json_object("body", p)
    return payloads.select(to_time(g("$.time")).alias("_time"), g("$.event").alias("_raw"), g("$.host").alias("host"), g("$.source").alias("source"), g("$.sourcetype").alias("sourcetype"), F.coalesce(g("$.index"), F.lit("main")).alias("index"), g("$.fields").alias("fields"))


_ATTRIBUTES = "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>>>"
OTLP = (
    f"resourceLogs array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeLogs: array<struct<scope: struct<name: string>, "
    f"logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, "
    f"body: struct<stringValue: string>, traceId: string, spanId: string, attributes: {_ATTRIBUTES}>>>>>>"
)
SEVERITY = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def parse_otlp(payloads: DataFrame) -> DataFrame:
    """OpenTelemetry log exports, one request per row of `body`: a row for each record."""
    d = payloads.select(F.from_json("body", OTLP).alias("b")).select(F.explode("b.resourceLogs").alias("r"))
    d = d.select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("l"))
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    flat = lambda a: F.map_from_entries(F.transform(F.array_distinct(F.transform(a, lambda x: x["key"])), lambda k: F.struct(k, value(F.get(F.filter(a, lambda x: x["key"] == k), 0)["value"]))))
    n = F.col("l.severityNumber")
    text = F.coalesce(F.when(F.col("l.severityText") != "", F.col("l.severityText")), F.get(F.array(*[F.lit(s) for s in SEVERITY]), F.floor((n - 1) / 4).cast("int")))
    return d.select(
        to_time(F.coalesce(F.when(F.col("l.timeUnixNano") != "0", F.col("l.timeUnixNano")), F.col("l.observedTimeUnixNano"))).alias("_time"), F.col("l.body.stringValue").alias("_raw"),
        text.alias("level"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), "scope", flat(F.col("resource.attributes")).alias("resource"), flat(F.col("l.attributes")).alias("attributes"),
    )


def parse_syslog(lines: DataFrame, field: str = "_raw") -> DataFrame:
    return formats.unpack(lines, "syslog", F.col(field))


def split_frames(body: Column) -> Column:
    """Octet-counted frames ("7 <34>abc8 <35>hello", counted in bytes of UTF-8) or lines, as an array."""
    raw = body.cast("binary")
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def take(acc, _):
        head = F.substring(raw, acc["at"], F.lit(12)).cast("string")
        size = F.regexp_extract(head, r"^(\d{1,9}) <", 1)
        start = acc["at"] + F.length(size) + 1
        one = F.substring(raw, start, size.cast("int")).cast("string")
        return F.when(size == "", acc).otherwise(F.struct((start + size.cast("int")).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    most = F.sequence(F.lit(1), F.size(F.split(body, " <", -1)))
    framed = F.aggregate(most, zero, take, lambda acc: acc["out"])
    return F.when(body.rlike(r"^\d+ <"), framed).otherwise(F.filter(F.split(body, "\n"), lambda x: x != ""))


def routed(df: DataFrame, key: str, shards: int) -> DataFrame:
    """_shard: the partition that an ingest router would send the row to."""
    return df.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def deduplicated(df: DataFrame, keys: list[str], delay: str | None = None) -> DataFrame:
    """Suppresses repeated events; a stream needs the delay within which repeats come."""
    if df.isStreaming:
        if not delay:
            raise QueryError("a stream needs a delay")
        return df.withColumn("_time", F.col("_time").cast("timestamp")).withWatermark("_time", delay).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)

"""What the operators share: reading tables, written intermediate tables, size-checked joins.

Operators follow one shape. A single scan of the texts makes a *light* table (ids, fingerprints,
hits), written once to the folder that the cluster names in ``spark.checkpoint.dir``. Everything
after it reads the light table, so a lost executor costs a re-read of a small file, never a second
scan of the texts, and row numbers given in the scan cannot change between two uses.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many narrow rows (some tens of bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000
#: While a table is written: bytes of an Arrow batch and rows of a Parquet batch, so that long texts do not add up in memory.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m", "spark.sql.parquet.columnarReaderBatchSize": "512"}

#: Bytes of a Parquet row group of a written table, which a task holds in memory while it writes or reads it.
ROW_GROUP = 4 << 20

_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder is made only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="logweir-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold only here."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and is computed once. It goes when its scope or Spark ends.

    compression: "none" for hashes, which do not get smaller.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with settings(spark, BATCHES):
        df.write.options(**{"compression": compression, "parquet.block.size": ROW_GROUP}).parquet(path)
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written here are deleted at the end; what outlives them must have been written to a table by `outlives`."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p, fs = _file_system(spark, path)
            fs.delete(p, True)


def outlives(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """A written table of the scope around the innermost one."""
    inner = _scopes.pop()
    try:
        return written(df, tag, compression)
    finally:
        _scopes.append(inner)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is within the bound; otherwise as it is, for a shuffled join.

    df should be a written table, whose count comes from the files' footers.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lower_ascii(c: Column) -> Column:
    """A-Z become a-z; all other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns under fixed names, so that other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def held_out(mod: int, remainder: int, c: str = "doc_id") -> Column:
    """crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % mod == remainder


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone (a written table of doc_id and the text's XXH64, key) does not list, whole."""
    gone = gone.select(F.col("doc_id").alias("__keep_gone"), F.col("key").alias("__keep_key"))
    same = docs["doc_id"].eqNullSafe(F.col("__keep_gone")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__keep_key"))
    return docs.join(small(gone), same, "left_anti")


def keep_listed(docs: DataFrame, light: DataFrame, kept: Column, key_of_text: Column | None = None) -> DataFrame:
    """The rows of docs that light keeps, whole.

    light has one row per row of docs: doc_id, key (a digest of the text) and what `kept` needs. Where ids are
    unique, the dropped ids are anti-joined. Where an id repeats, (id, key) decides, and of rows that agree in
    both as many stay as light keeps of them: all, or one.
    """
    dropped = light.where(~kept)
    if light.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        ids = written(dropped.select(F.col("doc_id").alias("__keep_gone")), "gone")
        return docs.join(small(ids), docs["doc_id"].eqNullSafe(F.col("__keep_gone")), "left_anti")
    if key_of_text is None:
        raise ValueError("doc_id repeats; a key of the text is needed")
    state = written(light.groupBy("doc_id", "key").agg(F.count("*").alias("__keep_n"), F.count_if(kept).alias("__keep_k")).where("__keep_k < __keep_n").select(F.col("doc_id").alias("__keep_id"), F.col("key").alias("__keep_key"), "__keep_k"), "gone")
    cols = docs.columns
    tagged = docs.withColumn("__keep_t", key_of_text)
    same = tagged["doc_id"].eqNullSafe(F.col("__keep_id")) & tagged["__keep_t"].eqNullSafe(F.col("__keep_key"))
    whole = tagged.join(state, same, "left_anti").select(cols)
    single = tagged.join(state.where("__keep_k > 0"), same, "left_semi").dropDuplicates(["doc_id", "__keep_t"]).select(cols)
    return whole.unionByName(single)

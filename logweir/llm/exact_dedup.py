"""Exact deduplication by Golomb-coded fingerprint exchange.

1. One scan normalises each text (A-Z to a-z, null as empty) and writes doc_id, a row number, a 64-bit
   fingerprint and the SHA-256: the light table.
2. Each partition of the light table sorts its distinct fingerprints, splits them by owner (equal ranges of
   the 64-bit space), and sends each owner one Golomb-Rice-coded list plus a bitmap of what it holds twice.
3. An owner decodes the lists it got and answers each with a bitmap: which of its entries occur more than once.
4. Senders turn bitmaps back into fingerprints. Only rows with such a fingerprint are suspects; only their
   texts are shuffled, and for each digest the smallest and the largest text must be the same bytes.

There are as many owners as shuffle partitions, more where that leaves one over OWNED fingerprints, so an owner's memory
does not grow with the data. A fingerprint that one partition holds many times is sent once, so a group with a third of all rows costs
each partition one entry. Verification aggregates min and max before its shuffle, so such a group costs one
text per task.

Defined cases: null text equals empty text; a null doc_id is smaller than any other; rows that agree in
doc_id and text count separately, and one of them stays; very long texts are hashed whole, and only where
a duplicate is suspected shuffled; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprints that a sender holds in memory at once.
CHUNK = 1 << 19
#: Fingerprints that an owner holds in memory at once, on average.
OWNED = 1 << 22


def rice_encode(values: np.ndarray, start: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 -> (k, quotients in unary, remainders of k bits)."""
    gaps = np.diff(values, prepend=np.uint64(start))
    mean = float(gaps.astype(np.float64).mean()) if len(gaps) else 1.0
    k = max(0, min(63, math.floor(math.log2(max(1.0, mean * math.log(2))))))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.reshape(-1)).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes, start: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.uint64) << np.uint64(k - 1 - i)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(start)


def light_table(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, uid (a row number), fp (the upper `bits` bits of an XXH64), key (SHA-256): one row per row of docs."""

    def scan(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            fps, keys = [], []
            for t in b.column(1):
                v = t.as_buffer()
                v = v.to_pybytes().lower() if v is not None else b""
                fps.append(xxhash.xxh64_intdigest(v, 42) >> (64 - bits) << (64 - bits))
                keys.append(hashlib.sha256(v).digest())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(uid, uid + n)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.binary())], ["doc_id", "uid", "fp", "key"])
            uid += n

    return common.written(common.id_and_text(docs).mapInArrow(scan, "doc_id long, uid long, fp long, key binary"), "exact-light")


def duplicated_fingerprints(light: DataFrame, owners: int | None = None) -> DataFrame:
    """fp: the fingerprints that more than one row of light has. A written table."""
    values = lambda batches: (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches)
    return duplicated(light.select("fp"), values, light.count() if owners is None else 0, owners)


def duplicated(df: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, owners: int | None = None) -> DataFrame:
    """fp: the numbers that occur more than once among the (about `size`) ones that `values` takes from df. A written table."""
    owners = min(1 << 16, owners or max(common.shuffle_partitions(df.sparkSession), -(-size // OWNED)))
    edges = [-(-(i << 64) // owners) for i in range(owners)] + [1 << 64]

    def send(batches):
        sender, held, size = TaskContext.get().partitionId() << 20, [], 0

        def lists():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = [0, *np.searchsorted(found, np.array(edges[1:-1], np.uint64)), len(found)]
            rows = []
            for o, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if z > a:
                    k, unary, rest = rice_encode(found[a:z], edges[o])
                    rows.append((o, sender, z - a, k, unary, rest, np.packbits(times[a:z] > 1).tobytes()))
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["owner", "sender", "n", "k", "unary", "rest", "twice"]), schema=schema, preserve_index=False)

        schema = pa.schema([("owner", pa.int32()), ("sender", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("twice", pa.binary())])
        for part in values(batches):
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                yield lists()
                held, size, sender = [], 0, sender + 1
        if size:
            yield lists()

    def own(key, pdf):
        start = edges[int(key[0])]
        parts = [rice_decode(n, k, u, r, start) for n, k, u, r in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["rest"], strict=True)]
        _, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = times > 1
        again[at[np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(pdf["twice"], pdf["n"], strict=True)]) > 0]] = True
        flags = np.split(again[at], np.cumsum(pdf["n"].to_numpy())[:-1])
        return pd.DataFrame({"owner": pdf["owner"], "sender": pdf["sender"], "answer": [np.packbits(f).tobytes() for f in flags]})

    def marked(batches):
        for b in batches:
            for r in b.to_pylist():
                flags = np.unpackbits(np.frombuffer(r["answer"], np.uint8), count=r["n"]) > 0
                if flags.any():
                    values = rice_decode(r["n"], r["k"], r["unary"], r["rest"], edges[r["owner"]])[flags]
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["fp"])

    sent = common.written(df.mapInArrow(send, "owner int, sender long, n int, k int, unary binary, rest binary, twice binary"), "exact-sent")
    answers = sent.groupBy("owner").applyInPandas(own, "owner int, sender long, answer binary")
    found = sent.drop("twice").join(answers, ["owner", "sender"]).mapInArrow(marked, "fp long")
    return common.written(found.distinct(), "exact-fps")


def verify(docs: DataFrame, suspects: DataFrame) -> None:
    """Raises if two different texts among the suspects' have one digest."""
    ids = suspects.select(F.col("doc_id").alias("_id"))
    d = common.id_and_text(docs)
    texts = d.join(common.small(ids), d["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select(common.lower_ascii(F.coalesce("text", F.lit(""))).alias("t"))
    differ = texts.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("key")).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi")
    if differ.limit(1).count():
        raise ValueError("two different texts have one SHA-256 digest")


def decide(docs: DataFrame, bits: int = 64, owners: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, uid, key, keep_id, group_size, kept. Of equal texts the largest doc_id stays."""
    light = light_table(docs, bits)
    with common.scratch(docs.sparkSession):
        fps = duplicated_fingerprints(light, owners)
        suspects = common.written(light.join(common.small(fps), "fp", "left_semi").select("doc_id", "uid", "key"), "exact-suspects")
        verify(docs, suspects)
        groups = common.outlives(suspects.groupBy("key").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("n")), "exact-groups")
    out = light.join(common.small(groups), "key", "left")
    one = F.col("n").isNull()
    return out.select(
        "doc_id", "uid", "key",
        F.when(one, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("top.uid") == F.col("uid"))).alias("kept"),
    )


def text_key():
    return F.unhex(F.sha2(common.lower_ascii(F.coalesce("text", F.lit(""))).cast("binary"), 256))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: the one with the largest doc_id. Columns as they are."""
    with common.scratch(docs.sparkSession):
        d = common.outlives(decide(docs), "exact-decided")
    return common.keep_listed(docs, d, F.col("kept"), text_key())


def query(spark, sf_dir: str) -> DataFrame:
    d = decide(common.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

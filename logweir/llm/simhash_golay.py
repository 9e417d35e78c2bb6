"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the binary Golay code
[23, 12, 7] whose upper bits are zero. The code is perfect: every word lies within 3 bits of exactly one
codeword, so decoding gives a 12-bit index. Two fingerprints that differ in at most 2 bits have one within
1 bit of both, so by the pigeonhole principle at most one segment of either is off by one there. Hence each
fingerprint gets the 36-bit index triples of itself and of its 64 neighbours at one bit. Neighbours mostly
decode alike, which leaves about 14 distinct keys, and fingerprints within 2 bits share at least one key.

Distinct fingerprints, not documents, are keyed. A key's members are verified by popcount, and only a spanning
forest of their links goes on, never all pairs. A key with more than HOT members goes another exact way:
each member is listed under the 65 words within 1 bit of it, a list has at most 65 distinct members, and all
members of a list are within 2 bits of each other, so each is linked to the smallest.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any
others; fewer than three words are one shingle; very long texts are hashed whole, a stretch of shingles at a time; an
empty table gives an empty result; null doc_ids keep their rows and are passed over in the smallest doc_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, forest

#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: (lowest bit, bits) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Members of a key that are compared with each other.
HOT = 256


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of x^11 * i for the upper 12 bits, and the error of at most 3 bits for each remainder."""

    def rest(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    upper = np.array([rest(i << 11) for i in range(1 << 12)], np.uint32)
    error = np.zeros(1 << 11, np.uint32)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            e = sum(1 << i for i in bits)
            error[rest(e)] = e
    return upper, error


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def decode(words: np.ndarray) -> np.ndarray:
    """23-bit words -> 12-bit index of the codeword within 3 bits."""
    if not _tables:
        _tables.append(_remainders())
    upper, error = _tables[0]
    return (words ^ error[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 fingerprints -> (key, row of its fingerprint), each key once a row."""
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.uint32) for low, n in SEGMENTS]
    own = [decode(p).astype(np.int64) for p in parts]
    base = own[0] << 24 | own[1] << 12 | own[2]
    cols = [base]
    for s, (_, n) in enumerate(SEGMENTS):
        shift = 24 - 12 * s
        for i in range(n):
            cols.append(base ^ ((own[s] ^ decode(parts[s] ^ np.uint32(1 << i))) << shift))
    grid = np.sort(np.stack(cols, axis=1), axis=1)
    new = np.ones(grid.shape, bool)
    new[:, 1:] = grid[:, 1:] != grid[:, :-1]
    return grid[new], np.nonzero(new)[0]


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the XXH64 of word shingles of lower-cased text; see the contract in the module's tests."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, total = len(w) - words + 1, np.zeros(64, np.int64)
    f = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 15):
        z = min(n, i + (1 << 15))
        h = np.array([f(joined[a:b], 42) for a, b in zip(starts[i:z].tolist(), ends[i + words - 1 : z + words - 1].tolist(), strict=True)], np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def light_table(docs: DataFrame) -> DataFrame:
    """doc_id, uid (a row number), fp as a signed long, key (the text's XXH64): a row for each row of docs."""

    def scan(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            fps, keys_ = [], []
            for t in b.column(1):
                v = t.as_buffer()
                v = v.to_pybytes() if v is not None else b""
                fps.append(fingerprint(v))
                keys_.append(xxhash.xxh64_intdigest(v, 42))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(uid, uid + n)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(keys_, np.uint64).view(np.int64))], ["doc_id", "uid", "fp", "key"])
            uid += n

    return common.written(common.id_and_text(docs).mapInArrow(scan, "doc_id long, uid long, fp long, key long"), "simhash-light")


def _keyed(batches):
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            fps = b.column(0)[i : i + 4096].to_numpy(zero_copy_only=False)
            k, at = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[at])], ["key", "fp"])


def _verified(batches):
    """Lists of fingerprints under one key -> a spanning forest of the links within 2 bits."""
    for b in batches:
        a, z = [], []
        for members in b.column(0):
            fps = members.values.to_numpy(zero_copy_only=False)
            near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 2
            x, y = np.nonzero(np.triu(near, 1))
            if len(x):
                u, v = forest(fps[x], fps[y])
                a.append(u)
                z.append(v)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], ["a", "b"])


def _midpoints(batches):
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            fps = b.column(0)[i : i + 4096].to_numpy(zero_copy_only=False)
            mid = (fps.view(np.uint64)[:, None] ^ flips[None, :]).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(fps, 65))], ["mid", "fp"])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) within 2 bits, enough of them to connect all that are."""
    keyed = fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    shared = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    crowded = common.written(shared.where(F.col("n") > hot).select("key"), "simhash-hot")
    keys_hot = common.small(crowded)
    calm = keyed.join(keys_hot, "key", "left_anti").join(common.small(shared.where(F.col("n") <= hot).select("key")), "key", "left_semi")
    cold = calm.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_verified, "a long, b long")
    lists = keyed.join(keys_hot, "key", "left_semi").select("fp").distinct().mapInArrow(_midpoints, "mid long, fp long").groupBy("mid").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    star = lists.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return cold.unionAll(star)


def decide(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, uid, fp, key, component_id (the smallest doc_id reachable)."""
    light = light_table(docs)
    with common.scratch(docs.sparkSession):
        fps = common.written(light.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fps")
        found = components(links(fps, hot))
        named = fps.join(found, fps["fp"] == found["node"]).select("fp", "root", "rep")
        least = named.groupBy("root").agg(F.min("rep").alias("least"))
        linked = common.written(found.join(least, "root").select(F.col("node").alias("fp"), "least"), "simhash-linked")
        of = fps.join(common.small(linked), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
        of = common.outlives(of, "simhash-of")
    return light.join(of, "fp", "left").select("doc_id", "uid", "fp", "key", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with its smallest doc_id. Columns as they are.

    Of rows with that id, one stays; rows of a component without any id come down to one too.
    """
    d = common.written(decide(docs), "simhash-decided")
    top = d.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min("uid").alias("_top"))
    flagged = common.written(d.join(top.select("_top"), F.col("uid") == F.col("_top"), "left").select("doc_id", "key", F.col("_top").isNotNull().alias("kept")), "simhash-kept")
    return common.keep_listed(docs, flagged, F.col("kept"), F.xxhash64(F.coalesce("text", F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    d = decide(common.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Benchmark decontamination by spaced seeds.

Texts become word sequences (ASCII letters and digits and all non-ASCII characters, in lower case). Fixed masks
select some of the words in a span and ignore the others, so a replaced word spoils only the seeds that select
it. Seeds of documents and benchmark items are joined on their hashes; on each diagonal (the document laid over the item
without gaps) that a hit names, the stretch with the most equal words among those of IDENTITY is the overlap.

Which masks an item has depends on its words: from LONG words on, seven selected words; from MIDDLE on, five; below, all of
the item's words, which then must stand there unchanged; items of fewer than LEAST_WORDS say nothing and are not searched.
So nine of ten overlaps that count share a seed, whatever the item's length and wherever the replaced words are
(the tests measure it against all diagonals).

The scan of the documents sends on only seeds that pass a Bloom filter of the benchmark's seeds (bloom.py).
Seeds that pass leave the scan with the words around them, so texts are read once and not shuffled; to be verified, a
diagonal takes along the words that lie over the item, not the stretch it was found in.

Defined cases: null texts have no words; equal items count as the one with the smallest item_id; among overlaps of a
document with equally many equal words the shortest counts, then the one with the smallest item_id, then the first;
documents with repeated ids are judged row by row; very long texts are searched whole, and only stretches with hits leave the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

#: Fixed masks: 1 selects a word. For long items, for middle ones, and for short ones of 3 to 7 words.
MASKS = ("1111111", "1101101011", "1011001100101", "1110000101011", "11111", "110111", "1101011", "111", "1111", "11111", "111111", "1111111")
#: Words of an item from which its masks change.
LONG, MIDDLE, LEAST_WORDS = 16, 8, 3
#: An overlap counts from this many equal words, or this share of the item's words if they are fewer.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: At least this share of an overlap's words are equal, as a fraction of whole numbers.
IDENTITY = (4, 5)
#: Words kept on either side of a hit.
AROUND = 128

_SPACES = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(256))
_SEED_STEP = 0x9E3779B97F4A7C15


def words(text: bytes) -> np.ndarray:
    """XXH64 of each word."""
    f = xxhash.xxh64_intdigest
    text = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return np.array([f(w) for w in text.lower().translate(_SPACES).split()], np.uint64)


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The hash at each position where the mask fits."""
    places = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = len(tokens) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (mask + 1) * _SEED_STEP % (1 << 64), np.uint64)
    for k, p in enumerate(places):
        total += tokens[p : p + n] * np.uint64(pow(_SEED_STEP, 2 * k + 3, 1 << 64) | 1)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def masks_of(n: int) -> range:
    """The masks of an item of n words."""
    if n >= LONG:
        return range(4)
    if n >= MIDDLE:
        return range(4, 7)
    return range(4 + n, 5 + n) if n >= LEAST_WORDS else range(0)


def counts(equal: int, length: int, item_words: int) -> bool:
    if item_words < MIDDLE:
        return equal == length == item_words
    return equal >= min(MIN_WORDS, MIN_SHARE * item_words) and equal * IDENTITY[1] >= length * IDENTITY[0]


def overlap(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch of IDENTITY with the most equal words, the shortest and first of those.

    With f = 5 * equal - 4 * words, counted from the left, a stretch is one whose f does not fall from start to end.
    """
    num, den = IDENTITY
    equal = np.concatenate([[0], np.cumsum(same)])
    f = den * equal - num * np.arange(len(equal))
    highest = np.maximum.accumulate(f[::-1])[::-1]
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0, 0
    # the last end with f no lower than at the start; what lies behind the last equal word there adds nothing
    ends = np.searchsorted(-highest, -f[starts], side="right") - 1
    n = equal[ends] - equal[starts]
    last = np.append(starts, len(same))[equal[ends] - 1] + 1
    best = np.lexsort((starts, last - starts, -n))[0]
    return int(starts[best]), int(last[best]), int(n[best])


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def scan(batches):
        for b in batches:
            toks = [words(t.as_buffer().to_pybytes()).view(np.int64) if t.is_valid else np.zeros(0, np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(toks, pa.list_(pa.int64()))], ["item_id", "item"])

    t = common.id_and_text(benchmark, id_col, text_col).mapInArrow(scan, "item_id long, item array<long>")
    return common.written(t.where(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id")).withColumn("item_key", F.xxhash64("item")), "bench-items")


def _item_seeds(items: DataFrame) -> DataFrame:
    def scan(batches):
        for b in batches:
            for key, toks in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = toks.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for m in masks_of(len(t)):
                    s = seeds(t, m)
                    if len(s):
                        n = len(s)
                        yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, m, np.int32))], ["seed", "item_key", "item_pos", "mask"])

    return common.written(items.select("item_key", "item").mapInArrow(scan, "seed long, item_key long, item_pos int, mask int"), "bench-seeds")


def _regions(docs: DataFrame, bitmap, masks: list[int]) -> DataFrame:
    """A row for each stretch of a document with seeds that pass the filter: its words and the seeds, by place in it."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("tokens", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def scan(batches):
        row = TaskContext.get().partitionId() << 40
        place = bitmap.value
        for b in batches:
            out = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row += 1
                if not t.is_valid:
                    continue
                text = t.as_buffer().to_pybytes()
                toks = words(text)
                found, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for m in masks:
                    s = seeds(toks, m)
                    hit = bloom.passing(s, place)
                    found.append(s[hit])
                    at.append(hit)
                at = np.concatenate(at)
                if not len(at):
                    continue
                key = int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))
                order = np.argsort(at, kind="stable")
                at, found = at[order], np.concatenate(found)[order]
                for g in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > AROUND) + 1):
                    a, z = max(0, int(at[g[0]]) - AROUND), min(len(toks), int(at[g[-1]]) + 16 + AROUND)
                    out.append((row, doc_id, key, a, len(toks), toks[a:z].view(np.int64), found[g].view(np.int64), (at[g] - a).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    t = common.id_and_text(docs).mapInArrow(scan, "uid long, doc_id long, key long, start int, n_words int, tokens array<long>, seeds array<long>, places array<int>")
    return common.written(t.withColumn("region", F.struct("uid", "start")), "bench-regions", "none")


def find(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row with an overlap: uid, doc_id, key (the text's XXH64), n_words, and its best overlap: item_id, doc_start, n_aligned, n_equal."""
    spark = docs.sparkSession
    items = _items(benchmark, item_id, item_text)
    known = _item_seeds(items)
    masks = sorted(r["mask"] for r in known.select("mask").distinct().collect())
    bitmap = spark.sparkContext.broadcast(bloom.build(known.select("seed")))
    regions = _regions(docs, bitmap, masks)
    bitmap.unpersist()

    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("region", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    joined = hits.join(common.small(known.select("seed", "item_key", "item_pos")), "seed")
    diagonal = joined.select("region", "item_key", (F.col("place") - F.col("item_pos")).alias("at")).distinct()
    over = F.slice("tokens", F.greatest("at", F.lit(0)) + 1, F.greatest(F.size("item") + F.least("at", F.lit(0)), F.lit(0))).alias("over")
    full = diagonal.join(regions.select("region", "uid", "doc_id", "key", "start", "n_words", "tokens"), "region").join(common.small(items), "item_key")

    def check(batches):
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int32()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("n_aligned", pa.int32()), ("n_equal", pa.int32())])
        for b in batches:
            rows = []
            uid, doc_id, key, n_words, item_ids, start, at = (b.column(i).to_pylist() for i in range(7))
            for i, (doc, item) in enumerate(zip(b.column(7), b.column(8), strict=True)):
                d, t = doc.values.to_numpy(zero_copy_only=False), item.values.to_numpy(zero_copy_only=False)
                skipped = max(0, -at[i])
                a, z, equal = overlap(d == t[skipped : skipped + len(d)])
                if counts(equal, z - a, len(t)):
                    rows.append((uid[i], doc_id[i], key[i], n_words[i], item_ids[i], start[i] + max(0, at[i]) + a, z - a, equal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = full.select("uid", "doc_id", "key", "n_words", "item_id", "start", "at", over, "item").mapInArrow(check, "uid long, doc_id long, key long, n_words int, item_id long, doc_start int, n_aligned int, n_equal int")
    best = F.max(F.struct("n_equal", -F.col("n_aligned"), -F.coalesce("item_id", F.lit(0)), -F.col("doc_start"), "item_id", "doc_start", "n_aligned")).alias("b")
    return found.groupBy("uid", "doc_id", "key", "n_words").agg(best).select("uid", "doc_id", "key", "n_words", "b.item_id", "b.doc_start", "b.n_aligned", "b.n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a benchmark item was found. Columns as they are. Rows of one id go by their texts."""
    with common.scratch(docs.sparkSession):
        gone = common.outlives(find(docs, benchmark).select("doc_id", "key").distinct(), "bench-gone")
    return common.without(docs, gone)


def query(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("uid", "key")

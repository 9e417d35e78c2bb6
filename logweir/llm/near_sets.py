"""The near-duplicate stage: fuzzy-hashed SimHash fingerprints, verified and completed on word-shingle sets.

A text is the set of the 64-bit hashes of its word shingles (five words of lower-cased text). Two texts are linked if
the Jaccard similarity of their sets is at least SIMILARITY, and of each connected component one row stays.

First, the sets' SimHash fingerprints are joined by Golay-decoded keys (simhash_golay.links), and what lies within two
bits is verified on the whole sets. That connects copies with few changes, which are most. It cannot find all: at a
similarity of 0.8 fingerprints differ in some ten of 64 bits, where decoded segments say next to nothing. So what is left
is found exactly, by prefix filtering, which loses no pair: in any one order of the shingles, sets at least that similar
share one of the first n - ceil(SIMILARITY n) + 1 shingles of either. The order is by hash, with shingles that two texts of a
sample have last (a Bloom filter holds them; what else it lets pass only comes later too). So a passage that many texts share
makes no candidates. The sample sets how many candidates there are, never which pairs are found.
Shingles that only one prefix has are left out by the exchange of compressed hashes (exact_dedup.duplicated). Candidates that
are connected already are out. The others are first held against sketches: bit i is the parity of the
shingles with hash i modulo the sketch's size (at least n), so two sketches differ in at most as many bits as the sets in
shingles, and pairs that differ in more bits than similar sets can in shingles are out, exactly. The rest is verified on
the whole sets.

Shingles in the prefixes of more than HOT sets go another exact way. Their sets form groups, a shingle's sets in one, and each
group has a centre: the shingles that most of its sets have (by the majorities of chunks; any centre would do). A set is
then known by its d shingles that differ from the centre's, and with f = 9 d - n for similarity 4/5 two sets are similar
just when f_x + f_y <= 18 times the differing shingles they share. If f_x + f_y <= 0, both are similar to the set of least f
too, the hub, so links to the hub do for all such pairs. Other pairs share some differing shingle, (f_x + f_y) / 18 at least, and are found by
prefix filtering over these, rarest of the group first, between sets that are not connected yet. What most copies have in common is out
then, so a large group of near copies costs its size and what changed, not its square.

Equal sets count once. Defined cases: null texts and texts without words have the empty set and are linked with each
other; fewer than five words are one shingle; a component's smallest doc_id stays, a null one only where there is no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common
from .components import components
from .exact_dedup import duplicated
from .simhash_golay import links as fuzzy_links

WORDS = 5
#: Least similarity of linked texts, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Sets under one shingle that are all compared with each other.
HOT = 64
#: One text in so many is looked at for frequent shingles.
SAMPLE = 8

_STEP = 0x9E3779B97F4A7C15


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Different hashes of the text's shingles, sorted as signed longs."""
    f = xxhash.xxh64_intdigest
    w = np.array([f(x, 42) for x in text.lower().split()], np.uint64)
    k = min(words, len(w))
    total = np.full(len(w) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        total += w[i : i + len(total)] * np.uint64(pow(_STEP, 2 * i + 3, 1 << 64) | 1)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((total ^ (total >> np.uint64(32))).view(np.int64))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash modulo the size, a power of two of at least n and 512 bits, as longs."""
    size = max(512, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount(tokens & (size - 1), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def majority(tokens: np.ndarray) -> int:
    """SimHash of the hashes: a bit is 1 if it is in over half of them; as a signed long."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(tokens), 1 << 15):
        part = tokens[i : i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(tokens)).view(np.int64)[0])


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, once the larger is folded to the size of the smaller."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def prefix(tokens: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shingles of which similar sets share one; those that `late` marks come last in the order."""
    num, den = SIMILARITY
    n = len(tokens)
    return np.concatenate([tokens[~late], tokens[late]])[: n + num * -n // den + 1]


def light_table(docs: DataFrame) -> DataFrame:
    """doc_id, uid (a row number), key (the text's XXH64), sig (the set's digest), n, fp, sketch, tokens: a row for each row of docs."""

    def scan(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                keys, sigs, fps, sketches, sets = [], [], [], [], []
                for t in part.column(1):
                    v = t.as_buffer().to_pybytes() if t.is_valid else b""
                    s = shingles(v)
                    keys.append(xxhash.xxh64_intdigest(v, 42))
                    sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                    fps.append(majority(s))
                    sketches.append(sketch(s))
                    sets.append(s)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(uid, uid + n)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "uid", "key", "sig", "n", "fp", "sketch", "tokens"])
                uid += n

    return common.written(common.id_and_text(docs).mapInArrow(scan, "doc_id long, uid long, key long, sig binary, n long, fp long, sketch array<long>, tokens array<long>"), "near-light", "none")


def _in_order(batch_tokens: pa.ListArray, filter_: np.ndarray):
    """The prefixes of a batch's sets."""
    at, tokens = batch_tokens.offsets.to_numpy(), batch_tokens.values.to_numpy(zero_copy_only=False)
    late = np.zeros(len(tokens), bool)
    late[at[0] + bloom.passing(tokens[at[0] : at[-1]].view(np.uint64), filter_)] = True
    return (prefix(tokens[a:z], late[a:z]) for a, z in zip(at[:-1], at[1:]))  # noqa: B905


def _prefixes(sets: DataFrame, last, shared) -> DataFrame:
    """token, uid, n: what of the sets' prefixes passes the filter `shared`."""

    def scan(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                own = [p[bloom.passing(p.view(np.uint64), shared.value)] for p in _in_order(part.column(1), last.value)]
                n = [len(p) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(np.diff(part.column(1).offsets.to_numpy()).astype(np.int32), n))], ["token", "uid", "n"])

    return sets.select("uid", "tokens").mapInArrow(scan, "token long, uid long, n int")


def _size(sets: DataFrame) -> int:
    return sets.agg(F.sum("n")).first()[0] or 0


def _frequent(sets: DataFrame, sample: int) -> DataFrame:
    """fp: the shingles that two sets of the sample have."""

    def values(batches):
        for b in batches:
            at, tokens = b.column(0).offsets.to_numpy(), b.column(0).values.to_numpy(zero_copy_only=False)
            yield tokens[at[0] : at[-1]].view(np.uint64)

    some = sets.where(F.pmod(F.xxhash64("uid"), F.lit(sample)) == 0)
    return duplicated(some.select("tokens"), values, _size(some))


def _shared(sets: DataFrame, last) -> DataFrame:
    """fp: the shingles that more than one set has in its prefix, by the exchange of compressed hashes."""
    values = lambda batches: (p.view(np.uint64) for b in batches for p in _in_order(b.column(0), last.value))
    num, den = SIMILARITY
    return duplicated(sets.select("tokens"), values, _size(sets) * (den - num) // den)


def _pairs(batches, chunk: int = 1 << 18):
    """Rows (token, uid, n), sorted by token -> the different pairs of sets under one token whose sizes allow the similarity."""
    num, den = SIMILARITY

    def of_groups(uid, n, starts, size):
        """Pairs of the groups of one size that begin at the given rows, `chunk` or fewer at a time."""
        x, y = np.triu_indices(size, 1)
        for i in range(0, len(starts), max(1, chunk // len(x))):
            first = starts[i : i + max(1, chunk // len(x)), None]
            a, z = (first + x).reshape(-1), (first + y).reshape(-1)
            fit = np.minimum(n[a], n[z]).astype(np.int64) * den >= np.maximum(n[a], n[z]).astype(np.int64) * num
            a, z = uid[a[fit]], uid[z[fit]]
            a, z = np.minimum(a, z), np.maximum(a, z)
            order = np.lexsort((z, a))
            a, z = a[order], z[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(z[new])], ["a", "b"])

    def whole(rows):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
        sizes = np.diff(np.append(starts, len(rows[0])))
        for size in np.unique(sizes[sizes > 1]).tolist():
            yield from of_groups(rows[1], rows[2], starts[sizes == size], size)

    held = None
    for b in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = [np.concatenate(c) for c in zip(held, rows, strict=True)] if held else rows
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last token may go on
        if last:
            yield from whole([c[:last] for c in held])
        held = [c[last:] for c in held]
    if held and len(held[0]):
        yield from whole(held)


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, open (the sketches allow a link), most (no less than the similarity) of each of the pairs. A written table."""
    num, den = SIMILARITY
    pairs = common.written(pairs, "near-pairs")
    for end in "ab":
        own = sets.select(F.col("uid").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = own.join(common.small(pairs) if end == "a" else pairs, end)

    def check(batches):
        for b in batches:
            bits = np.array([differing(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) for x, y in zip(b.column(3), b.column(4), strict=True)], np.int64)
            sizes = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits * (num + den) <= sizes * (den - num)), pa.array((sizes - bits) / np.maximum(sizes + bits, 1))], ["a", "b", "open", "most"])

    seen = pairs.select("a", "b", F.col("n_a") + F.col("n_b"), "sketch_a", "sketch_b")
    return common.written(seen.mapInArrow(check, "a long, b long, open boolean, most double"), "near-bounded")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked, similarity of each of the pairs that _bounded leaves open. A written table."""
    pairs = common.written(pairs.where("open").select("a", "b"), "near-open")
    ends = common.written(pairs.select("a").distinct(), "near-ends")
    left = sets.join(common.small(ends), F.col("uid") == F.col("a"), "left_semi").select(F.col("uid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("uid").alias("b"), F.col("tokens").alias("y")).join(common.small(pairs), "b")

    def check(batches):
        num, den = SIMILARITY
        for b in batches:
            shared = np.array([len(np.intersect1d(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False), assume_unique=True)) for x, y in zip(b.column(2), b.column(3), strict=True)], np.int64)
            sizes = np.array([len(x) + len(y) for x, y in zip(b.column(2), b.column(3), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared * (num + den) >= sizes * num), pa.array(shared / np.maximum(sizes - shared, 1))], ["a", "b", "linked", "similarity"])

    full = right.join(left, "a").select("a", "b", "x", "y")
    return common.written(full.mapInArrow(check, "a long, b long, linked boolean, similarity double"), "near-measured")


def fuzzy(sets: DataFrame) -> DataFrame:
    """a, b: links between sets whose fingerprints are equal or joined by fuzzy hashing, verified. A written table."""
    of = common.written(sets.groupBy("fp").agg(F.min("uid").alias("rep"), F.count("*").alias("n")), "near-fps")
    shared = common.written(of.where("n > 1").select("fp", F.col("rep").alias("a")), "near-fps-shared")
    alike = sets.select("fp", F.col("uid").alias("b")).join(common.small(shared), "fp").where("a <> b").select("a", "b")
    near = common.written(fuzzy_links(of).distinct(), "near-fuzzy")
    for end in "ab":
        named = of.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
        near = named.join(common.small(near) if end == "a" else near, end)
    near = near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return _measured(_bounded(alike.unionAll(near), sets), sets).where("linked").select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not connected in the components roots (node, root)."""
    for end in "ab":
        pairs = pairs.join(common.small(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _majority(batches, chunk: int = 1 << 18):
    """Rows (g, tokens) -> g, token, w: shingles that over half of a group's w sets of a chunk have."""

    def out(groups, lists):
        n = [len(x) for x in lists]
        tokens, owners = np.concatenate(lists), np.repeat(np.array(groups, np.int64), n)
        order = np.lexsort((tokens, owners))
        tokens, owners = tokens[order], owners[order]
        starts = np.concatenate([[0], np.flatnonzero((np.diff(tokens) != 0) | (np.diff(owners) != 0)) + 1])
        times = np.diff(np.append(starts, len(tokens)))
        found, sets = np.unique(groups, return_counts=True)
        w = sets[np.searchsorted(found, owners[starts])]
        most = times * 2 > w
        return pa.RecordBatch.from_arrays([pa.array(owners[starts][most]), pa.array(tokens[starts][most]), pa.array(w[most])], ["g", "token", "w"])

    groups, lists, size = [], [], 0
    for b in batches:
        for g, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            groups.append(g)
            lists.append(x.values.to_numpy(zero_copy_only=False))
            size += len(lists[-1])
            if size >= chunk:
                yield out(groups, lists)
                groups, lists, size = [], [], 0
    if groups:
        yield out(groups, lists)


def _away(members: DataFrame, sets: DataFrame) -> DataFrame:
    """g, uid, n, f, away: the sets of each group, with the shingles in which they differ from its centre. A written table."""
    num, den = SIMILARITY
    first = common.written(members.groupBy("token").agg(F.min("uid").alias("first")), "near-first")
    least = common.written(members.join(common.small(first), "token").groupBy("uid").agg(F.min("first").alias("g")), "near-least")
    named = common.written(members.select("token", "uid").join(common.small(least), "uid").groupBy("token").agg(F.min("g").alias("g")), "near-named")
    within = common.written(members.join(common.small(named), "token").select("g", "uid").distinct(), "near-within")
    own = common.written(sets.select("uid", "n", "tokens").join(common.small(within), "uid").select("g", "uid", "n", "tokens"), "near-own", "none")
    total = common.written(within.groupBy("g").agg(F.count("*").alias("n_sets")), "near-groups")
    votes = own.select("g", "tokens").mapInArrow(_majority, "g long, token long, w long").groupBy("g", "token").agg(F.sum("w").alias("w"))
    centres = common.written(votes.join(common.small(total), "g").where(F.col("w") * 2 > F.col("n_sets")).groupBy("g").agg(F.collect_list("token").alias("centre")), "near-centres")

    def differ(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            centre = [c.values.to_numpy(zero_copy_only=False) if c.is_valid else none for c in b.column(4)]
            away = [np.setxor1d(x.values.to_numpy(zero_copy_only=False), c, assume_unique=True) for x, c in zip(b.column(3), centre, strict=True)]
            f = np.array([len(x) for x in away], np.int64) * (num + den) - b.column(2).to_numpy() * (den - num)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(f), pa.array(away, pa.list_(pa.int64()))], ["g", "uid", "n", "f", "away"])

    longs = (centres.agg(F.sum(F.size("centre"))).first()[0] or 0) // 8
    full = own.join(common.small(centres, longs), "g", "left").select("g", "uid", "n", "tokens", "centre")
    return common.written(full.mapInArrow(differ, "g long, uid long, n long, f long, away array<long>"), "near-away", "none")


def _of_crowds(members: DataFrame, sets: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of sets under one shingle (token, uid), and the pairs that may be linked besides: a, b. Links found so far count."""
    num, den = SIMILARITY
    away = _away(members, sets)
    hubs = common.written(away.groupBy("g").agg(F.min(F.struct("f", "uid")).alias("top")).select("g", F.col("top.f").alias("f_hub"), F.col("top.uid").alias("hub")), "near-hubs")
    star = common.written(away.select("g", "uid", "f").join(common.small(hubs), "g").where((F.col("f") + F.col("f_hub") <= 0) & (F.col("uid") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct(), "near-star")

    roots = components(found.unionAll(star))
    named = common.written(hubs.join(common.small(roots), F.col("hub") == F.col("node"), "left").select("g", "f_hub", F.coalesce("root", "hub").alias("hub_root")), "near-hub-roots")
    placed = away.select("g", "uid", "n", "f", F.size("away").alias("d")).join(common.small(roots.withColumnRenamed("node", "uid")), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    placed = common.written(placed.join(common.small(named), "g"), "near-placed")
    far = common.written(placed.where("root <> hub_root").groupBy("g").agg(F.min("f").alias("f_far")), "near-far")

    parts = away.join(common.small(far), "g", "left_semi").select("g", "uid", F.explode("away").alias("token"))
    times = common.written(parts.groupBy("g", "token").agg(F.count("*").alias("times")).where("times > 1"), "near-times")
    lists = parts.join(common.small(times), ["g", "token"]).groupBy("g", "uid").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("list"))
    ranked = lists.join(common.small(placed), ["g", "uid"]).join(common.small(far), "g")
    ranked = ranked.select("g", "uid", "n", "f", "d", "root", "f_hub", "hub_root", "f_far", F.size("list").alias("m"), F.posexplode("list").alias("i", "e"))
    least = lambda total: F.greatest(F.lit(1), F.ceil(total / (2 * (num + den))))  # noqa: E731  shingles away from the centre that similar sets share
    ranked = ranked.withColumn("at", F.col("d") - F.col("m") + F.col("i"))  # what one set alone has comes first
    lesser = F.col("d") - least(F.col("f") + F.greatest("f", "f_far"))
    greater = F.col("d") - least(F.col("f") + F.when(F.col("root") == F.col("hub_root"), F.col("f_far")).otherwise(F.col("f_hub")))
    ranked = ranked.select("g", F.col("e.token").alias("token"), "uid", "n", "f", "d", "root", "at", (F.col("at") <= lesser).alias("low"), (F.col("at") <= greater).alias("high")).where("low or high")
    ranked = common.written(ranked, "near-ranked")
    x, y = (ranked.where(side).select("g", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("uid", "n", "f", "d", "root", "at")]) for s, side in (("x", "low"), ("y", "high")))
    need = least(F.col("f_x") + F.col("f_y"))
    fit = (F.struct("f_x", "uid_x") < F.struct(F.col("f_y").alias("f_x"), F.col("uid_y").alias("uid_x"))) & (F.col("root_x") != F.col("root_y")) & (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num) & (F.col("at_x") <= F.col("d_x") - need) & (F.col("at_y") <= F.col("d_y") - need)
    pairs = x.hint("merge").join(y, (x["g"] == y["g"]) & (x["token"] == y["token"]) & fit)
    return star, pairs.select(F.least("uid_x", "uid_y").alias("a"), F.greatest("uid_x", "uid_y").alias("b")).distinct()


def links(sets: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """a, b: links between different sets (uid, n, fp, sketch, tokens), enough of them to connect all that are similar."""
    num, den = SIMILARITY
    spark = sets.sparkSession
    close = fuzzy(sets)
    joined = components(close)
    last = spark.sparkContext.broadcast(bloom.build(_frequent(sets, sample)))

    # most shingles are in one prefix only, and are not shuffled
    shared = spark.sparkContext.broadcast(bloom.build(_shared(sets, last)))
    keyed = common.written(_prefixes(sets, last, shared), "near-keyed", "none")
    shared.unpersist()
    last.unpersist()
    crowded = common.written(keyed.groupBy("token").agg(F.count("*").alias("n_sets")).where(F.col("n_sets") > hot).select("token"), "near-hot")
    calm = keyed.join(common.small(crowded), "token", "left_anti").select("token", "uid", "n").repartition("token").sortWithinPartitions("token")
    pairs = common.written(calm.mapInArrow(_pairs, "a long, b long").distinct(), "near-cold-pairs")
    found = close.unionAll(_measured(_bounded(_apart(pairs, joined), sets), sets).where("linked").select("a", "b"))
    if crowded.limit(1).count() == 0:
        return found

    members = common.written(keyed.join(common.small(crowded), "token", "left_semi"), "near-members")
    star, pairs = _of_crowds(members, sets, found)
    rest = _measured(_bounded(pairs, sets), sets)
    return found.unionAll(star).unionAll(rest.where("linked").select("a", "b"))


def decide(docs: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, uid, key, root (equal in a component), kept."""
    light = light_table(docs)
    with common.scratch(docs.sparkSession):
        same = common.written(light.groupBy("sig").agg(F.min("uid").alias("first"), F.count("*").alias("n")).where("n > 1").select("sig", "first"), "near-same")
        twins = common.written(light.select("uid", "sig").join(common.small(same), "sig").where("uid <> first").select("uid", "first"), "near-twins")
        sets = light.select("uid", "n", "fp", "sketch", "tokens").join(common.small(twins.select("uid")), "uid", "left_anti").where("n > 0")
        found = components(links(sets, hot, sample).unionAll(twins.select(F.col("uid").alias("a"), F.col("first").alias("b"))))
        linked = common.written(light.select("uid", "doc_id").join(common.small(found.withColumnRenamed("node", "uid")), "uid"), "near-linked")
        top = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("top")).select("root", F.col("top.uid").alias("top"))
        state = common.outlives(linked.join(top, "root").select("uid", "root", (F.col("uid") == F.col("top")).alias("kept")), "near-state")
    r = light.select("doc_id", "uid", "key").join(common.small(state), "uid", "left")
    return r.select("doc_id", "uid", "key", F.coalesce("root", "uid").alias("root"), F.coalesce("kept", F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with its smallest doc_id. Columns as they are."""
    with common.scratch(docs.sparkSession):
        d = common.outlives(decide(docs), "near-decided")
    return common.keep_listed(docs, d, F.col("kept"), F.xxhash64(F.coalesce("text", F.lit(""))))

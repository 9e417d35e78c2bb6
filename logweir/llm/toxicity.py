"""Toxicity by the nearest labelled examples.

Examples are a bounded, hash-chosen sample of labelled documents, near copies among them counted once. Every document
is compared with all examples by the exact cosine of TF-IDF vectors over all words that two examples have, with inverse
document frequencies from all documents. Plain TF-IDF does not tell what is toxic: rare words of a subject outweigh the few
words that matter. So terms that mark toxic examples (chi-squared against clean ones; words, or beginnings of words, as many
languages form words by endings) count in full, and all others by the factor BACKGROUND.

The inverted index has blocks of alike examples. Lists of rare terms are added up first; with the block maxima of frequent
terms they bound every similarity in a block, and a block is worked out only for texts whose K nearest it can still enter.
Neighbours vote with the square of their similarity; a logistic curve fitted to leave-one-out votes of the examples turns
votes into calibrated scores. Nearest examples are given as evidence.

Defined cases: a null or empty text has the score of a text without neighbours; several labels of one id count as
toxic if one of them is, rows that share an id are one example; without labelled rows of both kinds every score is 0; ids that are null are not learned from; equal
similarities (to nine places) go by the examples' order in the index; very long texts are compared whole; equal texts have
equal scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound of what is learned: examples of each label.
EXAMPLES = 1500
#: A marking term is in at least this many toxic examples, with at least this chi-squared; weight of the other terms.
LEAST_EXAMPLES, LEAST_CHI2, BACKGROUND = 5, 10.83, 0.1
#: Neighbours that vote; examples in a block; texts compared at a time; weight of the prior among the votes.
K, BLOCK, TEXTS, PRIOR = 16, 128, 256, 0.25
#: A term is frequent if it is in one of so many examples.
FREQUENT = 16
#: Similarities are whole numbers of this part.
PLACES = 10**9

_SPACES = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(256))


#: Lengths in bytes of the beginnings that are terms too, ended by a star.
BEGINNINGS = range(4, 9)


def words(text: bytes) -> list[bytes]:
    text = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return text.lower().translate(_SPACES).split()


def forms(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if n < len(word))]


#: Words whose known terms a worker remembers.
MEMO = 1 << 18


def terms(words: list[bytes]) -> dict[bytes, int]:
    """Occurrences of each term."""
    out: dict[bytes, int] = {}
    for w, n in Counter(words).items():
        for f in forms(w):
            out[f] = out.get(f, 0) + n
    return out


class Known:
    """Occurrences of the known terms of a text, by their numbers. Frequent words are looked up once."""

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers, self.memo = numbers, {}

    def __call__(self, words: list[bytes]) -> dict[int, int]:
        out: dict[int, int] = {}
        memo, numbers = self.memo, self.numbers
        for w, n in Counter(words).items():
            found = memo.get(w)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[w] = tuple(numbers[f] for f in forms(w) if f in numbers)
            for i in found:
                out[i] = out.get(i, 0) + n
        return out


def arranged(vectors: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Order of the columns in which blocks are alike: halved again and again along the direction of the largest spread."""
    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= block:
            return [at]
        x = vectors[:, at] - vectors[:, at].mean(axis=1, keepdims=True)
        u = np.random.default_rng(0).normal(size=len(at))
        for _ in range(12):
            u = x.T @ (x @ u)
            u /= np.linalg.norm(u) + 1e-300
        at = at[np.argsort(u, kind="stable")]
        cut = -(-len(at) // (2 * block)) * block
        return halves(at[:cut]) + halves(at[cut:])

    return np.concatenate(halves(np.arange(vectors.shape[1])))


@dataclass
class Index:
    """Examples' normalised vectors: rows of frequent terms (dense, maxima by block), lists of rare terms."""

    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    maxima: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    value: np.ndarray
    prior: float
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def build(cls, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], prior: float) -> Index:
        """cells: example, term and occurrences, an entry for each term of each example."""
        e, f, n = cells
        w = (1 + np.log(n)) * weight[f]
        norm = np.sqrt(np.bincount(e, w * w, len(ids)))
        w = w / np.maximum(norm, 1e-300)[e]
        frequent = np.flatnonzero(np.bincount(f, minlength=len(weight)) * FREQUENT >= max(len(ids), 1))
        row = np.full(len(weight), -1, np.int64)
        row[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), len(ids)))
        many = row[f] >= 0
        dense[row[f[many]], e[many]] = w[many]
        order = arranged(dense)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        dense = np.ascontiguousarray(dense[:, order])
        maxima = np.maximum.reduceat(dense, np.arange(0, len(ids), BLOCK), axis=1)
        few = ~many
        sort = np.argsort(f[few], kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(f[few], minlength=len(weight)))])
        share = labels.mean()
        votes = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
        return cls(weight, ids[order], labels[order], votes[order], row, dense, maxima, starts, place[e[few]][sort], w[few][sort], prior)

    def nearest(self, texts: list[dict[int, int]], k: int = K, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per text (occurrences by term) the k examples of the largest cosine, exactly: positions and cosines, 0 where there are fewer."""
        m, n = len(texts), len(self.ids)
        size = [len(t) for t in texts]
        doc = np.repeat(np.arange(m), size)
        f = np.fromiter((i for t in texts for i in t), np.int64, len(doc))
        w = (1 + np.log(np.fromiter((x for t in texts for x in t.values()), float, len(doc)))) * self.weight[f]
        w /= np.maximum(np.sqrt(np.bincount(doc, w * w, m)), 1e-300)[doc]
        many = self.row[f] >= 0
        q = np.zeros((m, len(self.dense)))
        q[doc[many], self.row[f[many]]] = w[many]
        doc, f, w = doc[~many], f[~many], w[~many]
        size = self.starts[f + 1] - self.starts[f]
        at = np.repeat(self.starts[f] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sims = np.bincount(np.repeat(doc, size) * n + self.at[at], np.repeat(w, size) * self.value[at], m * n).reshape(m, n)
        edges = np.arange(0, n, BLOCK)
        bounds = np.maximum.reduceat(sims, edges, axis=1) + q @ self.maxima
        # an entry is the similarity, then the position from the end, in one number
        base = 1 << n.bit_length()
        top = np.zeros((m, k), np.int64)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable").tolist():
            need = np.flatnonzero((bounds[:, b] * PLACES + 1 >= np.maximum(1, top[:, 0] // base)) & (bounds[:, b] > 0))
            if not len(need):
                continue
            a, z = int(edges[b]), min(n, int(edges[b]) + BLOCK)
            s = np.rint((sims[need, a:z] + q[need] @ self.dense[:, a:z]) * PLACES).astype(np.int64)
            if without is not None:
                s[without[need][:, None] == np.arange(a, z)] = 0
            s = np.where(s > 0, s * base + (base - 1 - np.arange(a, z)), 0)
            both = np.concatenate([top[need], s], axis=1)
            cut = both.shape[1] - k
            top[need] = np.sort(np.partition(both, cut, axis=1)[:, cut:], axis=1)
        top = top[:, ::-1]
        return np.where(top > 0, base - 1 - top % base, 0), top // base / PLACES

    def vote(self, at: np.ndarray, sims: np.ndarray) -> np.ndarray:
        w = sims * sims * self.votes[at]
        return ((w * self.labels[at]).sum(axis=1) + PRIOR * self.prior) / (w.sum(axis=1) + PRIOR)

    def calibrate(self, cells: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> None:
        """Two parameters by Newton's method with a small ridge, examples weighted to the labels' true shares."""
        texts: list[dict[int, int]] = [{} for _ in ids]
        for e, f, n in zip(*(c.tolist() for c in cells), strict=True):
            texts[e][f] = n
        place = {i: p for p, i in enumerate(self.ids.tolist())}
        texts = [t for _, t in sorted(zip((place[i] for i in ids.tolist()), texts, strict=True), key=lambda x: x[0])]
        v = [self.vote(*self.nearest(texts[i : i + TEXTS], without=np.arange(i, min(len(texts), i + TEXTS)))) for i in range(0, len(texts), TEXTS)]
        v = np.concatenate(v)
        x, w = np.stack([_logit(v), np.ones(len(v))], axis=1), self.votes
        t = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
            g = x.T @ (w * (p - self.labels)) + 0.5 * (t - [1.0, 0.0])
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
            step = np.linalg.solve(h, g)
            t -= step
            if np.abs(step).max() < 1e-9:
                break
        if t[0] > 0:  # more toxic votes never mean a lower score
            self.curve = (float(t[0]), float(t[1]))

    def score(self, texts: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, sims = self.nearest(texts)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * _logit(self.vote(at, sims)) + b, -30, 30))), at, sims


def _logit(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 1e-4, 1 - 1e-4)
    return np.log(v / (1 - v))


def _signature(words: list[bytes], shingle: int = 5, hashes: int = 8) -> list[int]:
    """MinHash of word shingles."""
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], np.uint64)
    odd = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) | 1 for i in range(hashes)], np.uint64)
    return [int((h * o).min().view(np.int64)) for o in odd]


def _distinct(sigs: list[list[int]]) -> list[int]:
    """Positions of those that agree with no earlier one in six of eight hashes."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for e, s in enumerate(sigs):
        shared = Counter(o for i, x in enumerate(s) for o in seen.get((i, x), ()))
        if any(n >= 6 for n in shared.values()):
            continue
        kept.append(e)
        for i, x in enumerate(s):
            seen.setdefault((i, x), []).append(e)
    return kept


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[Index, list[bytes]] | None:
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = common.written(known, "toxic-labels")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    luck = F.xxhash64("doc_id", F.lit("example"))
    picked = [known.where(F.col("toxic") == y).orderBy(luck, "doc_id").limit(EXAMPLES) for y in (0, 1)]
    chosen = common.written(picked[0].unionAll(picked[1]).select(F.col("doc_id").alias("id"), "toxic"), "toxic-chosen")

    def scan(batches):
        for b in batches:
            rows = []
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = words(t.as_buffer().to_pybytes()) if t.is_valid else []
                c = terms(w)
                rows.append((i, y, _signature(w), list(c), list(c.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32())), strict=True)], ["id", "toxic", "sig", "terms", "counts"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    seen = common.written(texts.select("id", "toxic", "text").mapInArrow(scan, "id long, toxic int, sig array<long>, terms array<binary>, counts array<int>"), "toxic-examples")
    heads = sorted(((r["id"], r["toxic"], list(r["sig"])) for r in seen.select("id", "toxic", "sig").collect()), key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[2]))
    heads = [heads[e] for e in _distinct([r[2] for r in heads])]
    heads = list({r[0]: r for r in heads}.values())
    sizes = Counter(y for _, y, _ in heads)
    if len(sizes) < 2:
        return None
    ids, labels_ = np.array([r[0] for r in heads]), np.array([r[1] for r in heads])
    chosen = spark.createDataFrame([(i, e) for e, (i, _, _) in enumerate(heads)], "id long, e int")
    cells = seen.join(F.broadcast(chosen), "id").select("e", "toxic", F.explode(F.arrays_zip("terms", "counts")).alias("c")).select("e", "toxic", F.col("c.terms").alias("term"), F.col("c.counts").alias("n"))
    cells = common.written(cells.groupBy("e", "term").agg(F.max("toxic").alias("toxic"), F.sum("n").alias("n")), "toxic-cells")
    names, marks, cells = _vocabulary(cells, float(sizes[1]), float(sizes[0]))
    if not names:
        return None
    place = {t: f for f, t in enumerate(names)}

    def frequencies(batches):
        total, rows, known = np.zeros(len(names), np.int64), 0, Known(place)
        for b in batches:
            rows += b.num_rows
            held = []
            for t in b.column(0):
                if t.is_valid:
                    held.extend(known(words(t.as_buffer().to_pybytes())))
            total += np.bincount(np.array(held, np.int64), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(names), dtype=np.int32)), pa.array(np.concatenate([[rows], total]))], ["f", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "f int, n long").where("n > 0").groupBy("f").agg(F.sum("n").alias("n"))
    counted = common.written(counted, "toxic-frequencies").toArrow()
    df = np.zeros(len(names) + 1, np.int64)
    df[counted["f"].to_numpy() + 1] = counted["n"].to_numpy()
    weight = (np.log((1 + df[0]) / (1 + df[1:])) + 1e-3) * np.where(marks, 1.0, BACKGROUND)
    index = Index.build(weight, ids, labels_, cells, shares[1] / (shares[0] + shares[1]))
    index.calibrate(cells, ids)
    return index, names


def _vocabulary(cells: DataFrame, m1: float, m0: float) -> tuple[list[bytes], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, whether each marks toxic examples, and their cells (example, term, occurrences).

    cells: e, toxic, term, n. Words of two examples at least and marking terms; of marking terms that are in the same
    examples (beginnings of one word) the shortest.
    """
    spark = cells.sparkSession
    per = cells.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"), F.sum(F.xxhash64("e").cast("decimal(38,0)")).cast("string").alias("held"))
    a, b = F.col("a"), F.col("b")
    n, miss = m1 + m0, (m1 - a) * b
    chi2 = n * F.pow(a * (m0 - b) - miss, F.lit(2)) / (m1 * m0 * (a + b) * (n - a - b) + 1e-9)
    per = per.withColumn("marks", (a >= LEAST_EXAMPLES) & (a * m0 > b * m1) & (chi2 >= LEAST_CHI2))
    rows = per.where(F.col("marks") | ((a + b >= 2) & ~F.expr("endswith(term, X'2A')"))).select("term", "marks", "held").collect()
    first: dict[tuple[bool, str], bytes] = {}
    for t, m, held in sorted(((bytes(r["term"]), r["marks"], r["held"]) for r in rows), key=lambda r: (len(r[0]), r[0])):
        first.setdefault((True, held) if m else (False, t.hex()), t)
    kept = sorted((t, m) for (m, _), t in first.items())
    names, marks = [t for t, _ in kept], np.array([m for _, m in kept], bool)
    feats = common.written(spark.createDataFrame([(t, f) for f, t in enumerate(names)], "term binary, f int"), "toxic-terms") if names else None
    if feats is None:
        return names, marks, (np.zeros(0, np.int64),) * 3
    got = cells.join(common.small(feats), "term").select("e", "f", "n").toArrow().sort_by([("e", "ascending"), ("f", "ascending")])
    return names, marks, tuple(got[c].to_numpy().astype(np.int64) for c in ("e", "f", "n"))


def scorer(spark, model: tuple[Index, list[bytes]] | None):
    """A column function: text -> struct of score and evidence, the three nearest examples."""
    held = spark.sparkContext.broadcast((model[0], {t: f for f, t in enumerate(model[1])}) if model else None)
    evidence = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])

    @F.arrow_udf("score double, evidence array<struct<doc_id: bigint, toxic: int, similarity: double>>")
    def score(texts: pa.Array) -> pa.Array:
        scores, lists = [], []
        if held.value is None:
            scores, lists = [np.zeros(len(texts))], [[]] * len(texts)
        else:
            index, place = held.value
            known = Known(place)
            for i in range(0, len(texts), TEXTS):
                s, at, sims = index.score([known(words(t.as_buffer().to_pybytes())) if t.is_valid else {} for t in texts[i : i + TEXTS]])
                scores.append(s)
                for p, x in zip(at[:, :3].tolist(), sims[:, :3].tolist(), strict=True):
                    lists.append([{"doc_id": int(index.ids[j]), "toxic": int(index.labels[j]), "similarity": y} for j, y in zip(p, x, strict=True) if y > 0])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(lists, pa.list_(evidence))], ["score", "evidence"])

    return score


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = common.held_out(5, 0)
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    score = scorer(spark, fit(docs, labels, ~apart))
    r = docs.select("doc_id", apart.alias("held_out"), score("text").alias("p"))
    return r.select("doc_id", "held_out", "p.score", (F.col("p.score") >= 0.5).cast("int").alias("predicted"), "p.evidence")

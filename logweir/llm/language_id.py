"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units, one from each side, read windows of bytes; their states label every position with a
distribution over languages, and a document's probabilities are the mean over all its positions. The network is
trained in numpy by backpropagation through time on a bounded, hash-chosen sample of labelled documents.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when no labelled
row exists. A null doc_id counts as the empty text in the fold. Zero bytes leave the states as they are. Very long texts are
read whole, window by window. The network has more units and steps the more languages there are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a window; every byte of a text is in a window.
WINDOW = 128
#: Bounds of the training sample: languages, documents of each, windows of each document.
MAX_LANGS, DOCS_PER_LANG, WINDOWS_PER_DOC = 500, 300, 4
BATCH, RATE = 128, 0.02
#: Where a text is rejected, between a score by chance (0) and the least sure of all labelled documents that were not learned from (1).
REJECT = 0.5


def hidden_units(langs: int) -> int:
    """Of each direction: 12 for four languages, 24 for two hundred."""
    return 8 + 2 * max(1, math.ceil(math.log2(max(2, langs))))


def training_steps(langs: int) -> int:
    return max(400, 50 * langs)


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


@dataclass
class Network:
    """x: (2, 3H, 256) input columns of update, reset and candidate; u: (2, 3H, H); o: (L, 2H); c: (L,)."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        return cls(langs, f(2, 3 * hidden, 256), f(2, 3 * hidden, hidden), f(len(langs), 2 * hidden), np.zeros(len(langs), np.float32))

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(B, T) bytes -> (T, 2H, B): the state after each position, from the left and from the right."""
        size, steps = windows.shape
        hidden = self.u.shape[2]
        out = np.empty((steps, 2 * hidden, size), np.float32)
        columns = np.ascontiguousarray(windows.T)
        for d in range(2):
            table, u = self.x[d].copy(), self.u[d]
            table[:hidden, 0] = 40.0  # a zero byte keeps the state
            h = np.zeros((hidden, size), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = u @ h
                a = table.take(columns[t], axis=1)
                gates = _sigmoid(a[: 2 * hidden] + g[: 2 * hidden])
                n = a[2 * hidden :]
                n += gates[hidden:] * g[2 * hidden :]
                np.tanh(n, out=n)
                new = out[t, d * hidden : (d + 1) * hidden]
                np.subtract(h, n, out=new)
                new *= gates[:hidden]
                new += n
                if keep is not None:
                    keep.append((d, t, h, gates, g[2 * hidden :], n))
                h = new
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, 2H, B) -> (T, L, B)."""
        p = np.matmul(self.o, states)
        p += self.c[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions that aren't zero bytes."""
        size, steps = windows.shape
        hidden, kept = self.u.shape[2], []
        s = self.states(windows, kept)
        e = self.probabilities(s)
        e[:, labels, np.arange(size)] -= 1
        live = (windows.T != 0).astype(np.float32)
        e *= live[:, None, :] / max(1.0, live.sum())
        go, gc, ds = np.einsum("tlb,thb->lh", e, s), e.sum(axis=(0, 2)), np.matmul(self.o.T, e)
        gx, gu, dh = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros((2, hidden, size), np.float32)
        for d, t, h, gates, gn, n in reversed(kept):
            z, r = gates[:hidden], gates[hidden:]
            g = dh[d] + ds[t, d * hidden : (d + 1) * hidden]
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            pre = np.concatenate([dz, dr, dn])
            np.add.at(gx[d].T, windows[:, t], pre.T)
            pre[2 * hidden :] *= r
            gu[d] += pre @ h.T
            dh[d] = g * z + self.u[d].T @ pre
        gx[:, :, 0] = 0
        return [gx, gu, go, gc]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int | None = None, steps: int | None = None, seed: int = 7) -> Network:
    """Adam over random batches of windows."""
    hidden, steps = hidden or hidden_units(len(langs)), steps or training_steps(len(langs))
    rng = np.random.default_rng(seed)
    net = Network.fresh(langs, hidden, rng)
    params = [net.x, net.u, net.o, net.c]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for i, g in enumerate(net.gradients(windows[pick], labels[pick])):
            np.clip(g, -0.1, 0.1, out=g)
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return net


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(ch.isalpha() for ch in text.decode("utf-8", "replace")))


def predict(net: Network | None, texts: list[bytes | None], block: int = 2048) -> tuple[list[str], np.ndarray]:
    """Languages and pooled probabilities; windows of all texts run together in blocks."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
    if not todo:
        return langs, scores
    sums, sizes = np.zeros((len(texts), len(net.langs))), np.ones(len(texts))
    windows, owners = np.zeros((block, WINDOW), np.uint8), np.zeros(block, np.int64)
    n = 0

    def flush(n):
        w = windows[:n]
        p = net.probabilities(net.states(w))
        np.add.at(sums, owners[:n], np.einsum("tlb,tb->bl", p, (w.T != 0).astype(np.float32)))

    for i in todo:
        a = np.frombuffer(texts[i], np.uint8)
        sizes[i] = max(1, np.count_nonzero(a))
        at = 0
        while at < len(a):
            take = min(block - n, -(-(len(a) - at) // WINDOW))
            part = a[at : at + take * WINDOW]
            flat = windows[n : n + take].reshape(-1)
            flat[: len(part)] = part
            flat[len(part) :] = 0
            owners[n : n + take] = i
            n, at = n + take, at + take * WINDOW
            if n == block:
                flush(n)
                n = 0
    if n:
        flush(n)
    best = sums.argmax(axis=1)
    for i in todo:
        langs[i] = net.langs[best[i]]
        scores[i] = min(1.0, sums[i, best[i]] / sizes[i])
    return langs, scores


def sample(docs: DataFrame, learn: Column) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of at most DOCS_PER_LANG documents for each of the MAX_LANGS most frequent languages."""
    d = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * DOCS_PER_LANG / r["count"]))])
    luck = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches):
        for b in batches:
            rows = []
            for lang, luck_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = t.as_buffer().to_pybytes()
                rng = np.random.default_rng(int(luck_ * (1 << 30)))
                rows += [(lang, luck_, i, t[s : s + WINDOW]) for i, s in enumerate(rng.integers(0, max(1, len(t) - WINDOW + 1), min(WINDOWS_PER_DOC, -(-len(t) // WINDOW))).tolist())]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "luck", "i", "w"), r, strict=True)) for r in rows], schema=pa.schema([("lang", pa.string()), ("luck", pa.float64()), ("i", pa.int32()), ("w", pa.binary())]))

    chosen = d.withColumn("luck", luck).where(F.col("luck") < share[F.col("lang")]).select("lang", "luck", "text")
    got = chosen.mapInArrow(cut, "lang string, luck double, i int, w binary").toPandas().sort_values(["lang", "luck", "i", "w"], kind="stable")
    got = got[got.groupby("lang")["luck"].rank(method="dense") <= DOCS_PER_LANG]
    windows = np.zeros((len(got), WINDOW), np.uint8)
    for i, w in enumerate(got["w"]):
        windows[i, : len(w)] = np.frombuffer(bytes(w), np.uint8)
    return windows, np.array([langs.index(x) for x in got["lang"]], np.int64), langs


def fit(docs: DataFrame, learn: Column) -> Network | None:
    windows, labels, langs = sample(docs, learn)
    return train(windows, labels, langs) if len(windows) else None


def scorer(net: Network | None):
    """A column function: text -> struct of lang_pred and score."""

    @F.arrow_udf("lang_pred string, score double")
    def score(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            a, b = predict(net, [t.as_buffer().to_pybytes() if t.is_valid else None for t in part])
            langs += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    return score


def _scored(docs: DataFrame, learn: Column, net: Network | None) -> DataFrame:
    """doc_id, key (the text's XXH64), und, score, right (the network finds the label of a text that it did not learn from): a row for each row of docs. A written table."""

    def scan(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in part.column(1)]
                langs, scores = predict(net, texts)
                keys = np.array([xxhash.xxh64_intdigest(t or b"", 42) for t in texts], np.uint64).view(np.int64)
                right = [x == lang and s > 0 for x, lang, s in zip(part.column(2).to_pylist(), langs, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([x == "und" for x in langs], pa.bool_()), pa.array(scores, pa.float64()), pa.array(right, pa.bool_())], ["doc_id", "key", "und", "score", "right"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(~learn, F.col("lang")).cast("string").alias("label"))
    return common.written(d.mapInArrow(scan, "doc_id long, key long, und boolean, score double, right boolean"), "language-scored")


def _least(scored: DataFrame) -> float:
    return scored.where("right").agg(F.min("score")).first()[0] or 0.0


def least_sure(docs: DataFrame, learn: Column, net: Network) -> float:
    """The lowest score among all labelled documents that the network did not learn from.

    Documents in which the network finds another language than their label are left out.
    """
    with common.scratch(docs.sparkSession):
        return _least(_scored(docs.where(~learn & F.col("lang").isin(net.langs) & (F.length("text") > 0)), learn, net))


def reject_others(docs: DataFrame, learn: Column, reject: float = REJECT) -> DataFrame:
    """docs without rows that are ``und``, or in which the network is about as unsure as by chance. Columns as they are.

    Without labelled rows there is no network, and every row goes. Rows of one id go by their texts.
    One scan scores every text; how unsure is too unsure is read from these scores.
    """
    net = fit(docs, learn)
    with common.scratch(docs.sparkSession):
        scored = _scored(docs, learn, net)
        least = 0.0
        if net is not None and len(net.langs) > 1:
            chance = 1 / len(net.langs)
            least = chance + reject * max(0.0, _least(scored) - chance)
        gone = common.outlives(scored.where(F.col("und") | (F.col("score") < least)).select("doc_id", "key").distinct(), "language-gone")
    return common.without(docs, gone)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = common.held_out(4, 2)
    score = scorer(fit(docs, ~apart))
    return docs.select("doc_id", apart.alias("held_out"), score("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")

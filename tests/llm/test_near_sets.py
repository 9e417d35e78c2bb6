import random

import numpy as np
import pytest

import corpus_pipeline
from logweir.llm import near_sets


def brute(texts, words=5):
    """Per text its component, by exact Jaccard similarity of all pairs."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(vocab) for _ in range(30))
    out = ["", None, " ", "one", "ONE", "a b c d", "a b c d e", "a b c d e f", line]
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 150))]
        for k in range(14):
            v = list(base)
            for _ in range(k // 3):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            v = v[rng.randrange(1 + k) :] + [rng.choice(vocab) for _ in range(rng.randrange(1 + k))]
            out.append(" ".join(v) + (f" {line}" if k % 4 == 0 else ""))
    return out


@pytest.mark.parametrize("setting", [(64, 8), (2, 1), (3, 10_000)])
def test_components_against_brute_force(docs, setting):
    """The second and third setting send most shingles the way of frequent ones, with and without a changed order."""
    t = texts()
    want = brute(t)
    assert 20 < len(set(want)) < len(t) - 20
    got = {r["doc_id"]: r for r in near_sets.decide(docs(t), *setting).collect()}
    first = {}
    for i in range(len(t)):
        assert first.setdefault(want[i], got[i]["root"]) == got[i]["root"]
        assert got[i]["kept"] == (want[i] == i)
    assert len(set(first.values())) == len(first)


def test_stage_drops_copies_at_similarity_of_four_fifths(docs, spark):
    base = [f"v{i}" for i in range(200)]
    near, far = list(base), list(base)
    for i in range(10, 50, 10):
        near[i] = "x"
    for i in range(10, 100, 10):
        far[i] = "y"  # 151 of 241 shingles
    d = docs([" ".join(w) for w in (base, near, far)], [3, 2, 1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, d, "").collect()) == [1, 2]


def test_repeated_ids_and_nulls(docs):
    again = docs(["a b c d", "A b  c d", "q", "a b c d", None, "other"], [5, 5, None, 7, None, 5])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near_sets.drop_near_copies(again).collect()) == [(0, ""), (0, "q"), (5, "a b c d"), (5, "other")]
    assert near_sets.decide(docs([])).count() == 0


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(13)
    for n, m, common in ((5, 9, 2), (500, 530, 480), (1020, 1030, 900), (4000, 5100, 100), (3000, 3001, 2999)):
        tokens = rng.integers(-(2**63), 2**63 - 1, n + m - common)
        x, y = tokens[:n], tokens[n - common :]
        assert near_sets.differing(near_sets.sketch(x), near_sets.sketch(y)) <= n + m - 2 * common


def test_pairs_of_a_large_group_do_not_grow_with_its_square(docs, monkeypatch):
    """Copies of one text with up to nine changes, so that many are near each other and many are not."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    t = []
    for k in range(300):
        v = list(base)
        for _ in range(1 + k % 9):
            v[rng.randrange(len(v))] = f"x{rng.randrange(2000)}"
        t.append(" ".join(v))
    for k in range(0, 300, 10):  # far from the rest, near each other
        w = t[k + 8].split()
        w[rng.randrange(len(w))] = f"y{k}"
        t.append(" ".join(w))
    want = brute(t)
    assert 50 < len(set(want)) < 250
    seen, plain = [], near_sets._bounded
    monkeypatch.setattr(near_sets, "_bounded", lambda pairs, sets: (seen.append(pairs.count()), plain(pairs, sets))[1])
    got = {r["doc_id"]: r for r in near_sets.decide(docs(t), 16, 8).collect()}
    assert [got[i]["kept"] for i in range(len(t))] == [want[i] == i for i in range(len(t))]
    assert seen[-1] < 3 * len(t), seen

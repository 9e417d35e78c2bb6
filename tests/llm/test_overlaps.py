import random
from collections import defaultdict

import numpy as np
import pytest

from logweir.llm import bloom, decontaminate


def changed(item, pattern):
    """The item with the words that the pattern (lengths of kept and replaced stretches in turn) replaces."""
    out, at = [], 0
    for i, n in enumerate(pattern):
        out += [f"new{at + k}" for k in range(n)] if i % 2 else item[at : at + n]
        at += n
    return out


@pytest.mark.parametrize("pattern", [(7, 5, 40), (7, 2, 2, 2, 3, 2, 13, 4, 9), (8, 30, 14)])
def test_overlaps_behind_the_first_hit(docs, spark, pattern):
    """The first hit's overlap ends early, or takes in too many replaced words; a later hit's overlap counts."""
    rng = random.Random(12)
    item = [f"v{i}" for i in range(sum(pattern))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    text = [rng.choice("abcdefg") for _ in range(50)] + changed(item, pattern) + ["end"]
    texts = [" ".join(text), " ".join(item[:7] + ["x"] * 5 + item[12:18] + ["y"] * 40)]
    got = decontaminate.find(docs(texts), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 1)] and got[0]["n_equal"] >= 13
    assert got[0]["n_equal"] >= 0.8 * got[0]["n_aligned"]
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs(texts), bench).collect()] == [1]


def brute(same):
    """The stretch with the most equal words among those with four equal ones in five; then the shortest, the first."""
    best = (0, 0, 0)
    for a in range(len(same)):
        for z in range(a + 1, len(same) + 1):
            n = sum(same[a:z])
            if 5 * n >= 4 * (z - a) and (n, -(z - a)) > (best[2], -(best[1] - best[0])):
                best = (a, z, n)
    return best


def test_best_stretch_against_brute_force():
    rng = random.Random(14)
    for _ in range(400):
        same = [rng.random() < rng.choice((0.5, 0.8, 0.95)) for _ in range(rng.randrange(0, 40))]
        assert decontaminate.overlap(np.array(same, bool)) == brute(same)


def test_recall_by_words_and_replacements(docs, spark):
    """All diagonals decide what is to be found: of each cell (item words, replaced words) nine in ten, and nothing else."""
    rng = random.Random(15)
    cells = [(n, k) for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 25, 30, 45, 60) for k in range(n // 5 + 1) if n >= 8 or k == 0]
    items, texts, cell_of = [], [], []
    for n, k in cells:
        for _ in range(40):
            item = [f"i{len(items)}w{j}" for j in range(n)]
            items.append((len(items), " ".join(item)))
            for j in rng.sample(range(n), k):
                item[j] = "other"
            texts.append(" ".join([f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(5))] + item + ["end"]))
            cell_of.append((n, k))
    got = {r["doc_id"]: r for r in decontaminate.find(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = defaultdict(int)
    for i, r in got.items():
        assert r["item_id"] == i and decontaminate.counts(r["n_equal"], r["n_aligned"], cell_of[i][0])
        found[cell_of[i]] += 1
    assert {c: found[c] for c in cells if found[c] < 36} == {}


def test_short_items_and_ties(docs, spark):
    bench = spark.createDataFrame([(5, "red green blue"), (4, "one two"), (3, "a b c d e f g h"), (2, "z a b c d e f g"), (None, "")], "item_id long, text string")
    texts = ["so Red, GREEN blue it is", "red green or blue", "one two", "a b c d e f g", "z a b c d e f g h", "red green blue " * 30_000]
    got = {r["doc_id"]: (r["item_id"], r["doc_start"], r["n_aligned"], r["n_equal"]) for r in decontaminate.find(docs(texts), bench).collect()}
    assert got == {0: (5, 1, 3, 3), 3: (2, 0, 7, 7), 4: (2, 0, 8, 8), 5: (5, 0, 3, 3)}


def test_rows_go_by_their_own_text(docs, spark):
    bench = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    rows = docs([" ".join(f"v{i}" for i in range(20)), "clean", None, "clean", "fine"], [None, None, None, 7, 7])
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontaminate.drop_contaminated(rows, bench).collect()) == [(0, ""), (0, "clean"), (7, "clean"), (7, "fine")]


def test_filter_has_all_seeds_and_few_others(spark):
    rng = np.random.default_rng(16)
    s = rng.integers(-(2**63), 2**63 - 1, 300_000)
    known = spark.createDataFrame([(int(x),) for x in s[:200_000]], "seed long")
    filter_ = bloom.build(known)
    assert len(bloom.passing(s[:200_000].view(np.uint64), filter_)) == 200_000
    assert len(bloom.passing(s[200_000:].view(np.uint64), filter_)) < 1000

import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm import components, exact_dedup, simhash_golay


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60))
def test_rice_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    k, unary, rest = exact_dedup.rice_encode(v, 0)
    assert (exact_dedup.rice_decode(len(v), k, unary, rest, 0) == v).all()


def brute_exact(rows):
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i if i is not None else -1, max((x for x in groups[norm(t)] if x is not None), default=-1), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_exact_with_few_fingerprint_bits(docs):
    """Four bits make most texts suspects of each other; bytes decide all the same."""
    rng = random.Random(1)
    texts = [rng.choice(["a", "A", "é", "É", "", None, "x" * 70_000, f"t{rng.randrange(30)}"]) for _ in range(200)]
    ids = [*range(199), None]
    for bits, owners in ((4, 3), (64, 3), (64, 500)):
        d = exact_dedup.decide(docs(texts, ids), bits, owners=owners).collect()
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"] if r["keep_id"] is not None else -1, r["group_size"], r["key"].hex()) for r in d)
        assert got == brute_exact(list(zip(ids, texts, strict=True)))
        assert sum(r["kept"] for r in d) == len({r["key"] for r in d})


def test_exact_repeated_rows_and_stage(docs, spark):
    d = docs(["a", "A", "b", "b", "c"], [1, 1, 2, 2, None])
    assert sorted(r["kept"] for r in exact_dedup.decide(d).collect()) == [False, False, True, True, True]
    kept = exact_dedup.drop_copies(d.withColumn("_t", d["text"])).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept) == [(0, "c"), (1, "a"), (2, "b")]
    clean = exact_dedup.drop_copies(docs(["x", "X", "y"]))
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2] and clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert exact_dedup.decide(docs([])).count() == 0 and exact_dedup.drop_copies(docs([])).count() == 0


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    sizes = np.bincount(simhash_golay.decode(words))
    assert len(sizes) == 4096 and (sizes == 2048).all()


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    one = base ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    two = one ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    (ka, ra), (kb, rb), (kc, rc) = (simhash_golay.keys(x) for x in (base, one, two))
    for i in range(400):
        a = set(ka[ra == i].tolist())
        assert a & set(kb[rb == i].tolist()) and a & set(kc[rc == i].tolist())


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprint_of_a_long_text():
    rng = random.Random(8)
    text = " ".join(f"W{rng.randrange(900)}" for _ in range(40_000))
    assert simhash_golay.fingerprint(text.encode()) == brute_fingerprint(text)


def near_texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    out = ["", None, "one", "one two", "A b\tc", " a b", "É É É", "a b c d"]
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(400)]
        out.append(" ".join(base))
        for _ in range(25):
            v = list(base)
            v[rng.randrange(len(v))] = "x"
            out.append(" ".join(v))
    return out


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_against_brute_force(docs):
    texts = near_texts()
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, range(len(texts)))
    assert len(set(want)) < len(texts) - 20
    for hot in (256, 2):  # the second sends nearly all keys the other way
        got = {r["doc_id"]: r for r in simhash_golay.decide(docs(texts), hot).collect()}
        assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
        assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_simhash_stage_and_edges(docs):
    texts = near_texts()
    d = docs(texts)
    comps = {r["component_id"] for r in simhash_golay.decide(d).collect()}
    kept = simhash_golay.drop_near_copies(d).collect()
    assert {r["doc_id"] for r in kept} == comps and len(kept) == len(comps)
    again = docs(["a b c d", "a b c d", "q", "a b c d"], [5, 5, None, 7])
    assert sorted(str(r["doc_id"]) for r in simhash_golay.drop_near_copies(again).collect()) == ["5", "None"]
    assert simhash_golay.decide(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(4).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for one_task in (-1, 40, components.ONE_TASK):
        got = {r["node"]: r["root"] for r in components.components(df, one_task=one_task).collect()}
        assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components.components(df.limit(0)).count() == 0


def test_nothing_but_the_result_is_left(docs, spark):
    """Tables of a query go once its result is written; those it still reads go when Spark ends."""
    import os

    from logweir.llm import common

    d = docs(["a b c", "A b c", "x y z", None])
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with common.scratch(spark):
        out = common.outlives(exact_dedup.drop_copies(d), "result")
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["result"] and out.count() == 3

import math
import random
import re

from pyspark.sql import functions as F

from logweir.llm import pii


def brute(texts, support, generalise, remove):
    """Term spans and removed terms per text, from plain counts over the different texts."""
    terms = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for t in texts}
    entities = {t: {f"{k}:{t[a:z].lower()}" for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")) for a, z in (m.span() for m in re.finditer(p, t))} for t in texts}
    n = len(terms)
    count = lambda held: sum(held(t) for t in terms)
    best = {}
    for e in set().union(*entities.values()):
        n_e = count(lambda t: e in entities[t])
        for w in set().union(*(terms[t] for t in terms if e in entities[t])):
            n_te, n_t = count(lambda t: e in entities[t] and w in terms[t]), count(lambda t: w in terms[t])
            if n_te >= support and n_te * n >= 2 * n_t * n_e:
                best[w] = max(best.get(w, -1), 2 ** -math.log2(n_t / n_te))
    shown = {w: d for w, d in best.items() if d >= generalise - 1e-9}
    out = {}
    for t in terms:
        spans = [m.span() for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+") for m in re.finditer(p, t)]
        out[t] = [m.span() for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in shown and not any(a < m.end() and m.start() < z for a, z in spans)]
    return out, {w for w, d in shown.items() if d >= remove - 1e-9}


def test_terms_against_plain_counts(docs):
    """Names may stand anywhere in an entity's texts; equal texts count once; the noted share changes nothing."""
    rng = random.Random(31)
    vocab = [f"{a}{b}{c}len" for a in "bdfgk" for b in "aeiou" for c in "mnrst"]
    people = [("Zebulon", "zeb@farm.example"), ("Ägidius", "10.1.2.3"), ("Quirin", "q.u@x.example"), ("Walther", "w@solo.example")]
    texts = []
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(30)]
        name, entity = people[i % 4]
        if i % 3 == 0 and not (name == "Walther" and i > 20):
            words[rng.randrange(10)] = name if i % 2 else name.upper()
            words += ["\n" * 3, entity]
        elif i % 10 == 1:
            words[5] = name
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[3], "", None]
    different = sorted({t or "" for t in texts})
    for generalise, share in ((0.5, 16), (0.5, 1), (0.2, 4)):
        want, removed = brute(different, 3, generalise, 0.9)
        got = pii.find(docs(texts), 3, generalise, 0.9, share).collect()
        assert len(got) == len(texts) and any(want.values())
        for r in got:
            t = texts[r["doc_id"]] or ""
            assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4] == want[t]
            shown = {t[a:z].lower() for a, z in want[t]}
            assert set(r["removed"]) & shown == removed & shown


def test_clashing_columns_and_long_lists(docs):
    """A text of many entities and terms, and input columns named like the operator's own."""
    d = docs(["".join(f"user{i}@host.example word " for i in range(3000)), "plain", None]).selectExpr("*", "1 as h", "2 as spans", "3 as terms", "4 as removed")
    got = {r["doc_id"]: len(r["spans"]) for r in pii.find(d).collect()}
    assert got == {0: 3000, 1: 0, 2: 0}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d.where(F.col("doc_id") > 0)).collect()}
    assert clean == {1: "plain", 2: ""}

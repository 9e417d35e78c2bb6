import random
import time

import numpy as np

from logweir.llm import license_scan


def brute(text, label):
    """Spans (first, end, cover) of a template by all alignments of its words with the text's."""
    w, t = license_scan.words(text.encode()), license_scan.words(license_scan.TEMPLATES[label].encode())
    runs_of = {}
    for d in range(-len(t), len(w)):
        same = [0 <= d + i < len(w) and w[d + i] == x for i, x in enumerate(t)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                if i - start >= license_scan.K:
                    runs_of.setdefault(d, []).append((start, i))
                start = None
    bands = []
    for d in sorted(runs_of):
        if bands and d - bands[-1][-1] <= license_scan.BAND:
            bands[-1].append(d)
        else:
            bands.append([d])
    out = []
    for band in bands:
        covered = {i for d in band for s, e in runs_of[d] for i in range(s, e)}
        if len(covered) >= license_scan.LEAST * len(t):
            out.append((min(s + d for d in band for s, _ in runs_of[d]), max(e + d for d in band for _, e in runs_of[d]), len(covered) / len(t)))
    return out


def test_spans_against_all_alignments(docs):
    rng = random.Random(21)
    texts = []
    for label, template in license_scan.TEMPLATES.items():
        for k in range(10):
            w = template.split()
            for _ in range(k):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["changed"], [w[i], "added", "words"], [w[i], w[i]]])
            texts.append(" ".join(["before", "the", "software"] + w + ["and"] + (w if k == 3 else [])))
    texts += ["of the and or to the of any in the", ""]
    rows = license_scan.label(docs(texts)).collect()
    assert len(rows) == len(texts)
    labelled = 0
    for r in rows:
        want = sorted((*span, label) for label in license_scan.TEMPLATES for span in brute(texts[r["doc_id"]], label))
        assert sorted((s["first"], s["end"], s["cover"], s["license"]) for s in r["spans"] or []) == want
        labelled += bool(want)
    assert 60 < labelled < len(texts) - 2


def test_repeated_rows_ties_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    mit = license_scan.TEMPLATES["mit"]
    d = docs([mit, mit, None, mit + " " + mit], [1, 1, None, 2]).withColumn("uid", F.lit(0)).withColumn("license", F.lit("x")).withColumn("regions", F.lit(None).cast("string"))
    got = sorted((r["doc_id"] or 0, r["labels"], [s["first"] for s in r["spans"] or []]) for r in license_scan.label(d).collect())
    assert got == [(0, [], []), (1, ["mit"], [0]), (1, ["mit"], [0]), (2, ["mit"], [0, len(license_scan.words(mit.encode()))])]


def test_many_phrases_cost_linear_time():
    tokens = license_scan.words(b"mit license apache license " * 40_000)
    start = time.process_time()
    starts, labels = license_scan.base(tokens)
    assert time.process_time() - start < 0.5
    assert starts == list(range(0, 160_000, 2)) and labels == ["apache", "mit"]


def test_verify_needs_whole_runs():
    t = np.arange(1, 9)
    at = np.array([10, 11, 12, 13, 15, 16, 17])
    assert license_scan.verify(at, np.array([1, 2, 3, 4, 6, 7, 8]), t, [10]) == (10, 14, 4)

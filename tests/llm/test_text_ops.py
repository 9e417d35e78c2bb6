import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import chat_format, decontaminate, language_id, license_scan, line_dedup, mixing, pii, toxicity

# language identification


def letters(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b"], 3, rng)
    for k in ("x", "u", "o", "c"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    w, y = rng.integers(0, 6, (4, 5)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        p = net.probabilities(net.states(w).astype(np.float64))
        return -(np.log(p[:, y, np.arange(4)]) * (w.T != 0)).sum() / (w != 0).sum()

    grads = net.gradients(w, y)
    for param, g in zip((net.x, net.u, net.o, net.c), grads, strict=True):
        flat = param.reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            if g.reshape(-1)[i] == 0:
                continue
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 2e-3


def test_languages_are_learned(spark):
    rng = random.Random(5)
    rows = [(i, letters(rng, "abcdeé" if i % 2 else "pqrst", 40 if i in (1, 2) else rng.randrange(1, 80)), "x" if i % 2 else "y") for i in range(240)]
    extra = [(900, None, "x"), (901, "", "y"), (902, "123 !?", "x"), (903, "Δ", None), (904, rows[1][1] * 400, None), (None, "pqr", None), (905, f"{rows[1][1]} {rows[2][1]} " * 50, None)]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    net = language_id.fit(d, learn)
    got = {r["doc_id"]: r["p"] for r in d.select("doc_id", language_id.scorer(net)("text").alias("p")).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] == "x"
    assert all(0 <= p["score"] <= 1 for p in got.values())
    left = {r["doc_id"] for r in language_id.reject_others(d, learn).collect()}
    assert not left & {900, 901, 902, 905} and {904, None} < left and len(left) > 230
    least = language_id.least_sure(d, learn, net)
    assert 0.5 < least <= min(got[i]["score"] for i, _, lang in rows if got[i]["lang_pred"] == lang and zlib.crc32(str(i).encode()) % 4 == 2) + 1e-9
    again = d.where("doc_id < 240").unionAll(d.where("doc_id < 2")).unionAll(d.where("doc_id = 902").selectExpr("1L as doc_id", "text", "lang"))
    assert sorted(r["doc_id"] for r in language_id.reject_others(again, learn).where("doc_id < 2").collect()) == [0, 0, 1, 1]
    assert language_id.fit(d.limit(0), learn) is None
    assert d.select(language_id.scorer(None)("text").alias("p")).first()["p"]["lang_pred"] == "und"


def test_least_sure_of_all_documents(spark):
    """More documents of a language than any sample of them held."""
    rng = random.Random(8)
    rows = [(i, letters(rng, "abcdeé" if i % 2 else "cdepqrst", rng.randrange(3, 12)), "x" if i % 2 else "y") for i in range(4000)]
    net = language_id.train(np.array([np.frombuffer(t.encode().ljust(128, b"\0")[:128], np.uint8) for _, t, _ in rows[:200]]), np.array([0, 1] * 100)[::-1], ["x", "y"], steps=40)
    langs, scores = language_id.predict(net, [t.encode() for _, t, _ in rows])
    right = [x == lang and i >= 200 for (i, _, lang), x in zip(rows, langs, strict=True)]
    assert sum(right) > 3000
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.least_sure(d, F.col("doc_id") < 200, net) == pytest.approx(scores[right].min(), abs=1e-6)


def test_all_positions_count():
    net = language_id.train(np.frombuffer(b"aaaa" * 32 + b"bbbb" * 32, np.uint8).reshape(2, 128).copy(), np.array([0, 1]), ["a", "b"], steps=60)
    long = b"a" * 1000 + b"b" * 3000
    assert language_id.predict(net, [long])[0] == ["b"] and language_id.predict(net, [long], block=3)[1][0] == pytest.approx(language_id.predict(net, [long])[1][0], abs=1e-5)


# toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(6)
    weight = rng.uniform(0.05, 3, 60)
    vs = [{int(f): int(rng.integers(1, 4)) for f in rng.choice(60, rng.integers(0, 8), replace=False)} for _ in range(500)]
    vs[7:9] = vs[5:7]  # ties
    cells = tuple(np.array(c) for c in zip(*((e, f, n) for e, v in enumerate(vs) for f, n in v.items()), strict=True))
    index = toxicity.Index.build(weight, np.arange(500), rng.integers(0, 2, 500), cells, 0.2)
    assert 0 < len(index.dense) < 60 and sorted(index.ids) == list(range(500))
    dense = np.zeros((500, 60))
    for p, i in enumerate(index.ids.tolist()):
        for f, n in vs[i].items():
            dense[p, f] = (1 + np.log(n)) * weight[f]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    where = np.argsort(index.ids)
    for without in (None, where[:120]):
        at, sims = index.nearest(vs[:120], without=without)
        for i in range(120):
            s = np.rint(dense @ dense[where[i]] * 1e9) / 1e9
            if without is not None:
                s[without[i]] = 0
            order = [p for p in np.lexsort((np.arange(500), -s)) if s[p] > 0][: toxicity.K]
            assert sims[i, : len(order)].tolist() == s[order].tolist() and at[i, : len(order)].tolist() == order and not sims[i, len(order) :].any()
    assert not toxicity.Index.nearest(index, [{}])[1].any()


def test_query_against_plain_cosines(spark):
    """Document frequencies, weights, neighbours and scores of the given tables from the texts themselves."""
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("the given tables are not here")
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    learn = ~toxicity.common.held_out(5, 0)
    index, names = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), learn)
    places = {t: f for f, t in enumerate(names)}

    def vector(text):
        v = np.zeros(len(names))
        for w in re.findall(r"(?:[^\x00-\x7f]|[0-9A-Za-z])+", text.lower()):
            for t in [w.encode(), *(w.encode()[:n] + b"*" for n in range(4, 9) if n < len(w.encode()))]:
                if t in places:
                    v[places[t]] += 1
        return v

    counts = np.stack([vector(t) for t in rows.values()])
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1e-3
    marks = np.isclose(index.weight, idf)
    assert np.allclose(index.weight, idf * np.where(marks, 1, toxicity.BACKGROUND))
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * index.weight
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    at = {i: n for n, i in enumerate(rows)}
    examples = v[[at[i] for i in index.ids.tolist()]]
    got = {r["doc_id"]: r for r in toxicity.query(spark, sf).collect()}
    some = 0
    for i, n in at.items():
        s = np.rint(examples @ v[n] * 1e9) / 1e9
        order = np.lexsort((np.arange(len(s)), -s))[: toxicity.K]
        w = s[order] ** 2 * index.votes[order]
        vote = np.clip(((w * index.labels[order]).sum() + 0.25 * index.prior) / (w.sum() + 0.25), 1e-4, 1 - 1e-4)
        want = 1 / (1 + np.exp(-(index.curve[0] * np.log(vote / (1 - vote)) + index.curve[1])))
        assert abs(got[i]["score"] - want) < 1e-7
        assert [(e["doc_id"], e["similarity"]) for e in got[i]["evidence"]] == [(int(index.ids[o]), float(s[o])) for o in order[:3] if s[o] > 0]
        some += bool(got[i]["evidence"])
    assert some > 0.9 * len(rows)


def test_toxic_documents_are_found(spark):
    rng = random.Random(7)
    vocab = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(vocab) for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["scoundrel", "Rascals!", "rascal"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame([*rows, rows[1], rows[4], (900, None), (901, ""), (None, "rascal"), (902, "rascal " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as id", "2 as toxic", "3 as score")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    model = toxicity.fit(d, lab, learn)
    got = {r["doc_id"]: r["p"] for r in d.select("doc_id", toxicity.scorer(spark, model)("text").alias("p")).collect()}
    assert np.mean([(got[i]["score"] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    assert got[900]["score"] == got[901]["score"] < 0.5 <= got[None]["score"] and got[None]["evidence"][0]["toxic"] == 1
    assert got[902]["score"] >= 0.5 and d.select(toxicity.scorer(spark, model)("text").alias("p")).count() == 406
    assert toxicity.fit(d, lab.where("toxic = 0"), learn) is None and toxicity.fit(d.limit(0), lab, learn) is None
    assert d.select(toxicity.scorer(spark, None)("text").alias("p")).first()["p"]["score"] == 0.0


# chat formatting


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "b <|im_end|>\n\\"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, 3, "assistant", None), (1, 4, "us\ner<|", "<<||"),
        (2, None, None, None), (None, 0, "assistant", "é<|part|>x"), (3, 0, "user", "\\|<\\|"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat_format.format_conversations(d)
    back = {r["conv_id"]: r for r in chat_format.read_back(f).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "a"), ("assistant", "b <|im_end|>\n\\"), ("assistant", ""), ("assistant", ""), ("us\ner<|", "<<||")]
    assert back[1]["n_messages"] == 3 and [tuple(t) for t in back[2]["turns"]] == [("", "")] and [tuple(t) for t in back[3]["turns"]] == [("user", "\\|<\\|")]
    for r in back.values():
        at, masked = 0, ""
        for run in r["loss_runs"]:
            masked += r["formatted"][at : at + run["length"]] if run["loss"] else ""
            at += run["length"]
        assert at == len(r["formatted"])
        assert re.sub(r"(?s)\\(.)", r"\1", masked) == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert chat_format.format_conversations(d.limit(0)).count() == 0


def test_learned_texts_come_through_the_mask(spark):
    rng = random.Random(17)
    rows = [(0, i, rng.choice(["user", "assistant", "x"]), rng.choice(["", "é\\", "<|im_end|>", "a\nb", "𝄞" * 9])) for i in range(1500)] + [(1, 0, "assistant", "ü<|" * 200_000), (2, 0, "user", "q")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as formatted", "'y' as loss_runs", "'z' as learned")
    f = chat_format.format_conversations(d)
    got = {r["conv_id"]: r["learned"] for r in chat_format.learned_texts(f).collect()}
    assert got == {c: [t for k, _, role, t in rows if k == c and role == "assistant"] for c in range(3)}
    wrong = f.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct(r["length"].alias("length"), (~r["loss"]).alias("loss"))))
    assert chat_format.learned_texts(wrong).where("conv_id = 2").first()["learned"][1] == "q"


# personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    for k, p in PATTERNS:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_agree_with_plain_patterns(docs):
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y@d-e.fr.", "@@", "é", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "00000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "..", " ", "-", "5500005555555559", "\n", "a@b.cd_x@e.f", "12 34", "+12 345 678.", "𝄞", "9" * 40]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["", None, "a" * 2000, "1" * 2000, "a@" * 1000, "+" * 1000]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[i] if s["kind"] < 4] == brute_pii(t or ""), t[:80]

    long = ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "a@b" + ".c" * 100_000]  # the plain patterns would take minutes
    assert [[(s["start"], s["end"]) for s in r["spans"]] for r in pii.find(docs(long)).orderBy("doc_id").collect()] == [[], [], [], [(8 * i, 8 * i + 7) for i in range(25_000)], [(0, 200_003)]]


def test_query_counts_every_kind(spark, docs, tmp_path):
    """The query's counts and digest, for kinds that are missing, alone, and there more than once."""
    card, ip, mail, phone = "4111 1111 1111 1111", "10.0.0.255", "a.b@c.example", "+49 (30) 1234-567"
    texts = [f"x {ip} y", f"{card}; {ip}", f"{mail} {mail} {mail} {phone} and {phone}", f"{ip} {ip} {ip} {ip} {ip}", f"{mail} {ip} {card} {phone}", "none", "", None]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.query(spark, str(tmp_path)).collect():
        want = brute_pii(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(s[0] == k for s in want) for k, _ in PATTERNS], r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()


def test_revealing_terms(docs):
    filler = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)} words stand here number" for i in range(60)]
    near = [f"{w} Zebulon wrote from zeb@farm.example yesterday {w}" for w in filler[:5]]
    texts = filler + near + ["Zebulon alone", near[0], None, ""]
    d = docs(texts)
    got = {r["doc_id"]: r for r in pii.find(d).collect()}
    words = {texts[i][s["start"] : s["end"]].lower() for i, r in got.items() for s in r["spans"] if s["kind"] == 4}
    assert "zebulon" in words and "words" not in words and "stand" not in words
    assert any(s["kind"] == 4 for s in got[65]["spans"])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert "[EMAIL]" in clean[60] and "Zebulon" not in clean[60] and clean[0] == texts[0] and clean[67] == ""
    assert pii.find(docs([])).count() == 0


# licenses


def test_license_spans(docs):
    mit = license_scan.TEMPLATES["mit"]
    changed = mit.replace("merge, publish", "merge and also publish").replace("furnished", "given").upper()
    texts = [f"intro words {mit} end", changed, "licensed under CC-BY; cc by. GNU general\npublic license; apache License", "cc bye", None, "", mit[:150], "the " * 50_000]
    got = {r["doc_id"]: r for r in license_scan.label(docs(texts)).collect()}
    assert got[0]["labels"] == ["mit"] and got[0]["score"] == 1.0 and (got[0]["spans"][0]["first"], got[0]["n_base"]) == (2, 0)
    assert got[1]["labels"] == ["mit"] and 0.6 <= got[1]["score"] < 1
    assert (got[2]["base"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (["apache", "cc-by", "gpl"], 4, 2, 10)
    assert all(got[i]["labels"] == [] and got[i]["score"] == 0 for i in (3, 4, 5, 7)) and got[6]["labels"] == []
    assert license_scan.label(docs([])).count() == 0


# lines


def test_boilerplate_lines_go(spark):
    page = lambda host, i: (i, f"https://{host}/p{i}", f"<html><head><style>x{{}}</style></head><body><p>Home &amp; about</p><div>text {i}</div><p>Home &amp; about</p></body></html>")
    rows = [page("A.example", i) for i in range(6)] + [page("b.example", 10)] + [(20, None, None), (20, None, "<p>x"), (21, "http://u@c.example:8/x", "")]
    got = {(r["page_id"], r["host"], r["text"]) for r in line_dedup.clean(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (3, "a.example", "text 3") in got and (10, "b.example", "Home & about\ntext 10\nHome & about") in got
    assert (20, "", "x") in got and (20, "", "") in got and (21, "c.example", "") in got
    assert line_dedup.clean(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_at_the_ratio_long_pages_and_clashing_columns(spark):
    rows = [(i, "http://h.example/", "<p>at</p>" * (i < 3) + "<p>above</p>" * (i < 4) + f"<p>own {i}</p>") for i in range(10)] + [(99, "http://l.example/", "<div>x</div>\n" * 100_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' as host", "'b' as lines", "'c' as boilerplate")
    got = {r["page_id"]: r for r in line_dedup.clean(d).collect()}
    assert got[0]["text"] == "at\nown 0" and got[3]["text"] == "own 3" and got[9]["text"] == "own 9"
    assert got[99]["n_lines"] == 100_000 and got[99]["n_dropped"] == 0


# mixing


def test_rates_meet_targets(spark):
    d = spark.range(30_000).selectExpr("id as doc_id", "'t' as text", "case when id % 10 < 7 then 'big' when id % 10 < 9 then 'mid' end as source", "'clash' as copy_no")
    out = mixing.mix(d, {"big": 1.0, "mid": 1.0, None: 2.0}, size=1.5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] / 11_250 - 1) < 0.05 and abs(n["mid"] / 11_250 - 1) < 0.05 and abs(n[None] / 22_500 - 1) < 0.05
    counts = np.array([r["n"] for r in out.where("source is null").groupBy("doc_id").agg(F.count("*").alias("n")).collect()])
    assert abs(counts.sum() / 3000 - 7.5) < 0.3 and abs(np.var(counts) / 7.5 - 1) < 0.15
    many = mixing.mix(d.where("doc_id < 200"), {"big": 1.0}, size=100.0).groupBy("doc_id").count()
    assert abs(many.agg(F.avg("count")).first()[0] / (200 * 100 / 140) - 1) < 0.05
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.mix(d.selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "source")).columns[-3:] == ["n_copies", "copy_no", "mix_key"]


# decontamination


def test_tolerant_overlaps(docs, spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(2000)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 60))) for _ in range(20)] + ["too short", None, "", "ÉTÉ " + " ".join(vocab[:15])]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, items[0])], "item_id long, text string")
    texts, want = [], {}
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:
            k = i // 3 % 20
            p = items[k].split()
            for _ in range(len(p) // 10):
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in p]
            want[i] = k
        texts.append(" ".join(w))
    texts += [None, "", "été, " + " ".join(vocab[:15])]
    want[122] = 23
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.find(docs(texts), bench).collect()}
    assert got == want
    left = decontaminate.drop_contaminated(docs(texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(123)) - set(want)
    assert decontaminate.find(docs([]), bench).count() == 0 and decontaminate.find(docs(texts), bench.limit(0)).count() == 0


def test_masks_stand_two_replacements_anywhere():
    from itertools import combinations

    tokens = np.arange(1, 16, dtype=np.uint64)
    for bad in combinations(range(15), 2):
        changed = tokens.copy()
        changed[list(bad)] = 99
        assert any(np.isin(decontaminate.seeds(changed, m), decontaminate.seeds(tokens, m)).any() for m in range(4))

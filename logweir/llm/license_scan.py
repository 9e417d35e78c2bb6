"""License scans by diagonal voting.

Words of documents and of license templates are compared by rolling 4-word hashes. Spark joins the documents'
hashes to template positions; each joined pair votes for its diagonal (document position less template
position); diagonals a few words apart are one band, as a word put in or left out shifts the rest. A band whose votes
could cover LEAST of its template (a vote covers K words at most) is verified word by word, and counts if runs of K equal
words at least do cover that much.

The templates are fixed, so their table is of fixed size. Only stretches of K or more words that templates have leave the
scan: no other words can stand in a K-gram of a template, or in a verified run. A scan's row numbers tell apart rows with
equal ids.

Base: places where fixed phrases stand. Score: 1 where a phrase stands, else the largest share of a template
that was verified.

Defined cases: a null text has no words; a text without hits has empty labels and score 0; repeated rows are
judged row by row; very long texts cost linear time; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed passages of the licenses' own texts or of the notices they ask for.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

K = 4
#: Diagonals at most this far apart are one band.
BAND = 3
#: Share of a template's words that a band must cover.
LEAST = 0.6

_WORDS = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORDS).split()


def _vocabulary() -> dict[bytes, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w for t in TEMPLATES.values() for w in words(t.encode())}))}


def grams(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of K word numbers, distinct for distinct words."""
    n = max(0, len(ids) - K + 1)
    total = np.zeros(n, np.int64)
    for i in range(K):
        total = total * 8192 + ids[i : i + n]
    return total


def runs(live: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of K or more that hold."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], live.view(np.int8), [0]])))
    return [(s, e) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - s >= K]


def base(tokens: list[bytes]) -> tuple[list[int], list[str]]:
    """Sorted starts of the phrases' places, and the labels found."""
    line, starts, labels = b" " + b" ".join(tokens) + b" ", [], set()
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        at, seen, word = line.find(p), 0, 0
        while at >= 0:
            word, seen = word + line.count(b" ", seen, at), at
            starts.append(word)
            labels.add(label)
            at = line.find(p, at + 1)
    return sorted(starts), sorted(labels)


def _scan(docs: DataFrame) -> DataFrame:
    vocabulary = _vocabulary()
    region = pa.struct([("start", pa.int32()), ("ids", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64()))])
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())), ("regions", pa.list_(region))])

    def scan(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                uid += 1
                w = words(t.as_buffer().to_pybytes()) if t.is_valid else []
                starts, labels = base(w)
                ids = np.array([vocabulary.get(x, 0) for x in w], np.int64)
                regions = [{"start": a, "ids": ids[a:z], "grams": grams(ids[a:z])} for a, z in runs(ids > 0)]
                rows.append((uid, doc_id, len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None, labels, regions))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kind = "array<struct<start: int, ids: array<int>, grams: array<bigint>>>"
    return common.written(common.id_and_text(docs).mapInArrow(scan, f"uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, regions {kind}"), "license-light")


def verify(places: np.ndarray, ids: np.ndarray, template: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """(first word, end, template words covered) of a band. The document has the word ids[i] at places[i], ascending."""
    covered, lo, hi = np.zeros(len(template), bool), 1 << 62, 0
    for d in diagonals:
        a, z = np.searchsorted(places, (d, d + len(template)))
        same, at = np.zeros(len(template), bool), places[a:z] - d
        same[at] = ids[a:z] == template[at]
        for s, e in runs(same):
            covered[s:e] = True
            lo, hi = min(lo, s + d), max(hi, e + d)
    return lo, hi, int(covered.sum())


def find(docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(light rows of all documents, verified spans: uid, license, first, end, cover)."""
    spark = docs.sparkSession
    vocabulary = _vocabulary()
    templates = {label: np.array([vocabulary[w] for w in words(t.encode())]) for label, t in TEMPLATES.items()}
    places = spark.createDataFrame([(int(g), label, p, len(t)) for label, t in templates.items() for p, g in enumerate(grams(t).tolist())], "gram long, license string, at int, size int")
    light = _scan(docs)
    held = light.where(F.size("regions") > 0)
    votes = held.select("uid", F.explode("regions").alias("r")).select("uid", "r.start", F.posexplode("r.grams").alias("i", "gram"))
    diagonals = votes.join(F.broadcast(places), "gram").groupBy("uid", "license", "size", (F.col("start") + F.col("i") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    along = Window.partitionBy("uid", "license").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > BAND, F.lit(True)).cast("int")
    bands = diagonals.withColumn("far", far).withColumn("band", F.sum("far").over(along)).groupBy("uid", "license", "size", "band").agg(F.sum("votes").alias("votes"), F.array_sort(F.collect_list("diagonal")).alias("diagonals"))
    bands = common.written(bands.where(F.col("votes") * K >= F.lit(least) * F.col("size")).select("uid", "license", "diagonals"), "license-bands")
    full = held.join(common.small(bands), "uid").select("uid", "license", "diagonals", F.transform("regions", lambda r: F.struct(r["start"].alias("start"), r["ids"].alias("ids"))).alias("regions"))

    def check(batches):
        for b in batches:
            rows = []
            for uid, license_, ds, regions in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                t = templates[license_]
                at = np.concatenate([np.arange(r["start"], r["start"] + len(r["ids"])) for r in regions])
                lo, hi, n = verify(at, np.concatenate([r["ids"] for r in regions]), t, ds)
                if n >= least * len(t):
                    rows.append((uid, license_, lo, hi, n / len(t)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["uid", "license", "first", "end", "cover"])

    return light, full.mapInArrow(check, "uid long, license string, first long, end long, cover double")


def label(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the base's figures, labels of base and method, score, spans."""
    light, spans = find(docs)
    by = common.written(spans.groupBy("uid").agg(F.collect_set("license").alias("found"), F.max("cover").alias("cover"), F.array_sort(F.collect_list(F.struct("first", "end", "license", "cover"))).alias("spans")), "license-found")
    empty = F.array().cast("array<string>")
    r = light.drop("regions").join(common.small(by), "uid", "left").withColumn("labels", F.array_sort(F.array_union("base", F.coalesce("found", empty))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0)))
    return r.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "labels", score.alias("score"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    r = label(common.table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")

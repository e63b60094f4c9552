"""Held-out accuracy of the trained operators, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweft.llm import langid, licences, line_quality, toxicity
from cloudweft.llm.queries import QUERIES

EDGE = [(1, None), (2, ""), (3, " \n\n "), (4, "word " * 60_000), (5, "12 34 !!"), (6, "the of and"), (6, "the of and"), (None, "no id")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"score": F.lit("clash"), "id": F.lit(-1), "label": F.lit(None).cast("int"), "lang": F.lit(None).cast("string")})


def _joined(spark, sf, name, label):
    got = QUERIES[name](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return got.join(labels, "doc_id").toPandas()


def test_language_on_held_out_rows(spark, small):
    got = QUERIES["op6_language"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 250 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {"de", "en", "es", "fr", "und"}


def test_language_mixtures_and_edges(spark, small, edge):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    by = {k: docs.filter((F.col("lang") == k) & (F.length("text") > 2000)).select("text").first()[0][:1500] for k in ("de", "fr")}
    both = spark.createDataFrame([(1, by["de"] + "\n" + by["fr"]), (2, by["de"])], "doc_id long, text string")
    got = {r.id: r for r in langid.identify(both, model).collect()}
    assert {x.split(":")[0] for x in got[1].languages.split(",")} == {"de", "fr"} and 0.3 < got[1].score < 0.7
    assert got[2].languages.startswith("de:1")
    rows = langid.identify(edge, model).collect()
    assert len(rows) == len(EDGE) and {r.id: r.lang for r in rows if r.id in (1, 2, 3, 5)} == {1: "und", 2: "und", 3: "und", 5: "und"}
    kept = langid.identified(edge, model)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 6, 6] and all(r.lang == "en" for r in kept.filter("doc_id = 6").collect())
    assert langid.identified(edge, model, languages=("fr",)).filter("doc_id = 6").count() == 0
    three = spark.createDataFrame([(1, "\n".join(docs.filter((F.col("lang") == k) & (F.length("text") > 2000)).select("text").first()[0][:1500] for k in ("de", "fr", "es")), None)], "doc_id long, text string, lang string")
    assert langid.identified(three, model).count() == 0 and langid.identify(three, model).first().score < 0.5
    none = docs.limit(0)
    assert langid.fit(none) is None and langid.identify(none, model).count() == 0
    assert {r.lang for r in langid.identify(edge, None).collect()} == {"und"}


def test_language_does_not_depend_on_neighbours(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 400")
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    one = {r.id: (r.lang, r.score, r.languages) for r in langid.identify(docs.coalesce(1), model).collect()}
    spread = {r.id: (r.lang, r.score, r.languages) for r in langid.identify(docs.repartition(7), model).collect()}
    assert one == spread
    for r in docs.limit(60).collect():
        words = langid.words_of(r.text)
        if words:
            row = model.mixtures([words])[0]
            assert one[r.doc_id][1] == float(min(1.0, row.max()))


def test_mixture_matches_a_plain_version(spark, small):
    """Expectation-maximisation written out word by word, over every nested set."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)

    def em(p, shares, rounds=12):
        for _ in range(rounds):
            new = np.mean([row * shares / max((row * shares).sum(), 1e-30) for row in p], axis=0)
            moved, shares = np.abs(new - shares).max(), new
            if moved < 1e-3:
                break
        return shares, sum(np.log(max((row * shares).sum(), 1e-30)) for row in p)

    for r in docs.filter("length(text) between 100 and 1500").limit(40).collect():
        words = langid.words_of(r.text)
        rows = model.rows_of([words])
        ll = model.known[rows].astype(float)
        p = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60))
        k, single = len(model.langs), np.log(p).sum(axis=0)
        best, score = np.eye(k)[single.argmax()], single.max()
        shares, full = em(p, np.full(k, 1 / k))
        price = np.log(len(words) + 1.0)
        order = np.argsort(-shares, kind="stable")
        for m in range(2, k + 1):
            start = np.zeros(k)
            start[order[:m]] = 1 / m
            got, value = em(p, start)
            if value - (m - 1) * price > score:
                best, score = got, value - (m - 1) * price
        assert np.allclose(model.mixtures([words])[0], best, atol=5e-3)


def test_expectation_maximisation_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    p = rng.random((200, 3)).astype(np.float32)
    starts, n = np.array([0, 120]), np.array([120, 80])
    values = [langid._em(p, starts, n, np.full((2, 3), 1 / 3), r)[1] for r in (0, 1, 2, 5, 20)]
    assert all((b >= a - 1e-3).all() for a, b in zip(values, values[1:]))


def test_toxicity_on_held_out_rows(spark, small):
    got = _joined(spark, small, "op1_toxicity", "toxic")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and got.score.between(0, 1).all()
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3


def test_machine_learns_a_pair_that_no_weight_explains():
    rng = np.random.default_rng(5)
    docs = [[k for k in range(2) if rng.random() < 0.5] + [2] for _ in range(600)]
    y = np.array([float(len(d) == 2) for d in docs])  # either alone, not both
    m = toxicity.Machine(4, 2, seed=3)
    doc, feat, x = toxicity._csr(docs)
    m.weigh(doc, feat, y)
    assert m.scale[0] < 0.2 and m.scale[1] < 0.2  # neither tells anything alone
    m.fit(doc, feat, x, y, epochs=200, rate=0.05)
    bags = toxicity._csr([[2], [0, 2], [1, 2], [0, 1, 2]])
    got = m.raw(*bags[:2], m.values(*bags, 4), 4)[0] > 0
    assert got.tolist() == [False, True, True, False]


def test_a_pair_of_terms_that_tell_nothing_alone_reaches_the_machine(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(800):
        a, b = rng.random(2) < 0.5
        rows.append((k, " ".join([*(["groupname"] if a else []), *(["scorn"] if b else []), *(f"w{rng.integers(30)}" for _ in range(6))])))
        labels.append((k, int(a != b)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    machine_of = {r.id: r.score for r in toxicity.score(docs, machine).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([(machine_of[i] >= 0.5) == (y[i] == 1) for i in y]) > 0.9


def test_toxicity_query_matches_a_sum_over_all_pairs(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op1_toxicity"](spark, tiny).collect()}
    for r in docs.filter("length(text) < 1200").limit(25).collect():
        bag: dict = {}
        for f in m.bag(r.text or ""):
            bag[f] = bag.get(f, 0) + 1
        x = {f: (1 + np.log(n)) * float(m.scale[f]) for f, n in bag.items()}
        size = np.sqrt(sum(v * v for v in x.values())) or 1.0
        raw = m.bias + sum(float(m.w[f]) * v / size for f, v in x.items())
        keys = sorted(x)
        raw += sum(float(m.v[a].astype(float) @ m.v[b].astype(float)) * x[a] * x[b] / size**2 for k, a in enumerate(keys) for b in keys[k + 1 :])
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5)


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 7)] + [(6, 1), (None, 1), (99, None)], "doc_id long, toxic int")
    machine = toxicity.fit(edge, labels)
    rows = toxicity.score(edge, machine).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    base = toxicity.fit(edge, labels.limit(0))
    assert {round(r.score, 3) for r in toxicity.score(edge, base).collect()} == {0.5}
    assert toxicity.score(edge.limit(0), machine).count() == 0


def test_quality_on_held_out_rows(spark, small):
    got = _joined(spark, small, "op7_line_quality", "quality")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_marginals_match_all_labellings():
    from itertools import product

    rng = np.random.default_rng(0)
    f = line_quality.Field()
    f.step = rng.normal(size=(2, 2))
    n = np.array([3, 1, 4])
    starts, emit = np.cumsum(n) - n, rng.normal(size=8)
    p, steps = f.marginals(emit, starts, n)
    want, pairs = np.zeros(8), np.zeros((2, 2))
    for s, k in zip(starts, n):
        ways = {y: np.exp(sum(emit[s + i] * y[i] for i in range(k)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=int(k))}
        z = sum(ways.values())
        for y, v in ways.items():
            want[s : s + k] += np.array(y) * v / z
            for a, b in zip(y, y[1:]):
                pairs[a, b] += v / z
    assert np.allclose(p, want) and np.allclose(steps, pairs)


def test_long_chains_are_cut_into_blocks():
    rng = np.random.default_rng(4)
    n = np.array([1, 5, 12, 2, 7, 30])
    starts, score, step = np.cumsum(n) - n, rng.normal(size=(57, 2)), rng.normal(size=(2, 2))
    want = np.zeros_like(score)
    for s, k in zip(starts, n):
        for t in range(k):
            want[s + t] = score[s + t] + (np.logaddexp(want[s + t - 1, 0] + step[0], want[s + t - 1, 1] + step[1]) if t else 0)
    for block in (1, 2, 3, 5, 256):
        assert np.allclose(line_quality._chain(score, starts, n, step, block), want)


def test_quality_query_matches_each_document_alone(spark, tiny):
    """Every document's field, line by line, without blocks or neighbours in a batch."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    f = line_quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op7_line_quality"](spark, tiny).collect()}
    for r in docs.limit(60).collect():
        lines = line_quality.lines_of((r.text or "").encode())
        if not lines:
            continue
        own = line_quality.own_features([lines])
        pad = np.vstack([np.zeros_like(own[:1]), own, np.zeros_like(own[:1])])
        emit = np.hstack([own, pad[:-2], pad[2:]]) @ f.w
        score = np.stack([np.zeros(len(emit)), emit], axis=1)
        a, b = score.copy(), np.zeros_like(score)
        for t in range(1, len(emit)):
            a[t] += np.logaddexp(a[t - 1, 0] + f.step[0], a[t - 1, 1] + f.step[1])
        for t in range(len(emit) - 2, -1, -1):
            s = score[t + 1] + b[t + 1]
            b[t] = np.logaddexp(f.step[:, 0] + s[0], f.step[:, 1] + s[1])
        p = 1 / (1 + np.exp((a + b)[:, 0] - (a + b)[:, 1]))
        size = np.array([len(x) for x in lines])
        q = np.clip((p * size).sum() / size.sum(), 0.005, 0.995)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(f.slope * np.log(q / (1 - q)) + f.base))), abs=1e-6)


def test_quality_of_many_lines_and_bounded_training(spark):
    rows = [(1, "\n".join(f"This is line {k} of a long text." for k in range(60_000))), (2, "ok line.\n" * 3), (4, "#### $$$ ||| \n" * 5), (5, "Good words here, and more.\n" * 4), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    field = line_quality.fit(docs, labels, max_lines=100)
    got = {r.id: r.score for r in line_quality.score(docs, field).collect()}
    assert len(got) == 5 and all(0 <= s <= 1 for s in got.values()) and got[2] > got[4]


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id long, quality int")
    field = line_quality.fit(edge, labels)
    rows = line_quality.score(edge, field).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.id in (1, 2, 3)}) == 1
    assert line_quality.score(edge, line_quality.fit(edge, labels.limit(0))).count() == len(EDGE)


@pytest.fixture(scope="module")
def licence_classifier(spark, small):
    return licences.fit(spark.read.parquet(f"{small}/documents.parquet"))


LONG = "filler words in a line that goes on " * 15  # over 400 characters
NOTICES = [
    ("x y z\nReleased under the MIT License.\nmore", "mit", 1), ("Licensed under the Apache License, Version 2.0.", "apache-2.0", 0), ("licensed UNDER CC BY-NC 4.0", "cc-by-nc", 0), ("All rights reserved.", "unknown", 0),
    ("the thing of the and under", None, None), (None, None, None), ("", None, None), (" \n\n ", None, None), ("Licensed under the Frobnicate Foundation License, revision 9", "unknown", 0),
    ("foo bar.\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nother", "gpl", 2),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0", "epl-2.0", 0), ("Redistributions of source code must retain the above copyright notice", "bsd", 0),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl", 0), ("License: MIT", "mit", 0), ("License: EUPL-1.2", "unknown", 0), ("Copyright 2021 Jane Doe", "unknown", 0), ("Apache-2.0", "apache-2.0", 0), ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0", 0),
    ("The right of the people to use the public road is a matter of law and of version control.", None, None), ("We had a good time and the license plate of the car was red.", None, None),
    ("\n".join([LONG] * 12 + ["Released under the MIT License."]), "mit", 12), ("Licensed under the MIT Licence", "mit", 0), ("This work is licenced under Creative Commons Attribution ShareAlike 4.0 International", "cc-by-sa", 0),
]


def test_notices_wrapped_edited_and_unknown(spark, licence_classifier):
    rows = [(k, t) for k, (t, _, _) in enumerate(NOTICES)] + [(1, NOTICES[1][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = licences.scan(docs, licence_classifier).collect()
    assert len(got) == len(rows), [r for r in got if r.family]
    assert [(r.id, r.family, r.line) for r in got if (r.family, r.line) != NOTICES[r.id][1:]] == []
    assert licences.scan(docs.limit(0), licence_classifier).count() == 0
    long = spark.createDataFrame([("a", "word " * 200_000 + "\nReleased under the MIT License.")], "doc_id string, text string")
    assert [(r.id, r.family, r.line) for r in licences.scan(long, licence_classifier).collect()] == [("a", "mit", 1)]


def test_classifier_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    c = licences.fit(none)
    assert c.statements(["Licensed under the Apache License, Version 2.0."], 0.5, 0.5, 0.2)[0][0][1] == "apache-2.0"


def test_templates_that_were_left_out(spark, small):
    """Precision and recall of families on notices that training never saw."""
    unseen = [
        ("apache-2.0", "This project is licensed under the terms of the Apache License 2.0"), ("mit", "Distributed under the MIT license, see the file for details"), ("gpl", "Licensed under GNU GPL version 3 or any later version"), ("bsd", "Use is governed by a BSD-style license: 3-clause BSD"),
        ("cc-by", "Content is licensed under a Creative Commons Attribution 4.0 license"), ("mpl-2.0", "Available under the Mozilla Public License version 2.0"), ("lgpl", "Distributed under the GNU Lesser General Public License"), ("cc0", "This data set is released under CC0 1.0 public domain"),
        (None, "He read the public notice and the terms of the sale before noon"), (None, "The general version of the story is known to the public"), (None, "Copying the software took an hour and a half"), (None, "All of the work was done by the author in the year 2.0"),
    ]
    c = licences.fit(spark.read.parquet(f"{small}/documents.parquet"))
    got = [([x[1] for x in s] or [None])[0] for s in c.statements([t for _, t in unseen], 0.5, 0.5, 0.2)]
    named = [(w, g) for (w, _), g in zip(unseen, got) if g not in (None, "unknown")]
    assert sum(w == g for w, g in named) / len(named) >= 0.9, got
    assert sum(w == g for w, g in named) / 8 >= 0.75 and sum(g is not None for (w, _), g in zip(unseen, got) if w) == 8, got
    assert sum(g is not None for (w, _), g in zip(unseen, got) if w is None) <= 1, got


def test_licence_query_finds_every_planted_line(spark, small):
    """Against a plain search for the lines that the corpus holds."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    begins = {"Released under the MIT": "mit", "Licensed under the Apache": "apache-2.0", "Licensed under CC BY-NC": "cc-by-nc", "This work is licensed under the GNU General": "gpl", "All rights reserved": "unknown"}
    want = {(d.doc_id, k, f) for d in docs for k, x in enumerate((d.text or "").split("\n")) for b, f in begins.items() if x.startswith(b)}
    got = QUERIES["op10_licences"](spark, small).collect()
    assert {(r.doc_id, r.line, r.family) for r in got if r.family} == want and len(want) > 40
    assert {r.doc_id for r in got} == {d.doc_id for d in docs}


def test_a_labelled_text_of_too_many_lines_is_passed_over(spark, small):
    assert line_quality._fitting([(1, 5), (2, 200_001), (3, 7), (4, 200_000), (5, 199_988)], 200_000) == [1, 3, 5]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    at = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id").orderBy("doc_id").first()[0]
    long = docs.withColumn("text", F.when(F.col("doc_id") == at, F.expr("repeat('a line of words\n', 30001)")).otherwise(F.col("text")))
    plain, field = (line_quality.fit(d, labels, max_lines=30_000) for d in (docs.filter(F.col("doc_id") != at), long))
    assert field.slope == pytest.approx(plain.slope, rel=0.2) and field.slope > 0


def test_statements_inside_long_lines(spark, small):
    """Notices with 40 to 20,000 words of prose around them on one line; prose with cue words strewn in has next to none."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    c = licences.fit(docs)
    words = [w for r in docs.select("text").limit(300).collect() for w in r.text.split()]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    found = lambda text: c.statements([text], 0.5, 0.5, 0.2)[0]
    notices = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl": "This program is free software under the GNU General Public License version 3.", "unknown": "All rights reserved."}
    for n in (20, 100, 10_000):
        for family, notice in notices.items():
            assert family in [x[1] for x in found(" ".join([*prose(n), notice, *prose(n)]))], (n, family)
    both = found(" ".join([*prose(60), notices["mit"], *prose(60), notices["gpl"], *prose(60)]))
    assert {x[1] for x in both} == {"mit", "gpl"}
    cues = ["license", "rights", "copyright", "permission", "free", "use", "under", "software", "reserved", "terms"]
    strewn = [prose(200) for _ in range(150)]
    for text in strewn:
        for _ in range(5):
            text[rng.randrange(200)] = rng.choice(cues)
    assert sum(bool(found(" ".join(t))) for t in strewn) <= 5

"""Fill-in-the-middle: skip list against running sums, samples against a plain version, exact round trips, edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweft.llm import fim, queries


def plain(i, text, unit=fim.LINES, rate=100, spm=50):
    """(n, form, prefix, middle, output) by counting through the units."""
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 17, 100, 4096, 60_000])
def test_every_rank_is_reached(n):
    widths = np.random.default_rng(n).integers(1, 50, n)
    at = np.concatenate([[0], np.cumsum(widths)])
    units = fim.SkipList(widths)
    ranks = range(n + 1) if n < 5000 else [0, 1, n - 1, n, *random.Random(n).sample(range(n), 300)]
    assert [units.offset(r) for r in ranks] == [at[r] for r in ranks]
    for k, lane in enumerate(units.units):
        assert lane.sum() == n and units.points[k].sum() == at[-1]
    if n > 1000:
        assert len(units.units) > 3 and len(units.units[-1]) < 50


TEXTS = [
    None, "", "\n", "a", "a\nb", "a\n", "\n\n\n", "é😀\nß\r\nx", "holds <P> here\nb\n", "<<S\n<S\n<\nP>\n", "<S>", "<M>\n", " ", "\x0b\n\x0c", "line\n" * 3000,
    "one line without an end " * 4000, "".join(f"{k} 😀\n" * (k % 3) for k in range(500)),
]


def test_samples_and_round_trips(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(None, "a\nb\nc"), (3, "\n\n"), (3, "\n\n")]
    docs = spark.createDataFrame([(i, t, "x", 1, "<P>") for i, t in rows], "doc_id long, text string, output string, n int, form string")
    found = fim.transform(docs).withColumn("back", fim.restored("output", "form")).collect()
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr)
    assert got == sorted(((i, *plain(i, t)) for i, t in rows), key=repr)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_other_units_and_rates(spark):
    rows = [(i, t) for i, t in enumerate(["a b  c", " x ", "", "word", "one two three four five"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fim.transform(docs, unit=r"\s*\S+\s*", rate=60, spm=20).withColumn("back", fim.restored("output", "form")).collect()
    assert sorted((r.id, r.n, r.form, r.output) for r in found) == sorted((i, p[0], p[1], p[4]) for i, t in rows for p in [plain(i, t, r"\s*\S+\s*", 60, 20)])
    assert [r.back for r in sorted(found, key=lambda r: r.id)] == [t for _, t in rows]
    assert 0.4 < sum(r.form != "plain" for r in found) / sum(t != "" for _, t in rows) < 0.8


def test_ids_of_other_types_and_empty_tables(spark):
    docs = spark.createDataFrame([("x1", "a\nb")], "doc_id string, text string")
    assert fim.transform(docs).select("id", "output").collect() == [("x1", plain("x1", "a\nb")[4])]
    assert fim.transform(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab é\n', 1000000)").alias("text"))
    r = fim.transform(docs).withColumn("back", fim.restored("output", "form")).select("n", "prefix_chars", F.length("output").alias("m"), (F.col("back") == F.expr("repeat('ab é\n', 1000000)")).alias("same")).first()
    assert (r.n, r.m, r.same) == (1_000_000, 5_000_009, True) and r.prefix_chars % 5 == 0


@pytest.mark.parametrize("marks", [("", "b", "c"), ("<a>", "a", "c"), ("aba", "x", "y"), ("xa", "ay", "z")])
def test_unsafe_sentinels_are_refused(spark, marks):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([], "doc_id long, text string"), sentinels=marks)


def test_nothing_is_shuffled(spark, tiny):
    assert "Exchange" not in queries.op11_fill_in_middle(spark, tiny)._jdf.queryExecution().executedPlan().toString()

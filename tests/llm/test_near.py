"""Near-duplicates against all pairs, the hashes they rest on, and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import near_groups, shingle_set, similar

from cloudweft.llm import near, simhash


def edited(rng, text, edits):
    w = text.split()
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("hot", [64, 3])
def test_edited_copies_go_and_clean_documents_stay(spark, hot):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(40)]
    rows = list(enumerate(base))
    for k in range(20):
        rows.append((100 + k, edited(rng, base[k], 2)))  # ten of 116 shingles: 0.84
    rows += [(200 + k, edited(rng, base[0], 2)) for k in range(20)]
    rows += [(300 + k, edited(rng, base[30 + k], 14)) for k in range(5)]  # far from 0.8
    passage = base[39].split()[:40]
    rows += [(400 + k, " ".join([*passage, *(f"v{rng.randrange(3000)}" for _ in range(12))])) for k in range(30)]  # much in common, about 0.6
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1))
    got = {r.doc_id for r in near.one_of_each(docs, hot=hot).collect()}
    assert got == near_groups(dict(rows)) == set(range(40)) | {i for i, _ in rows if i >= 300}
    texts = dict(rows)
    assert any((simhash.fingerprint(base[k].encode()) ^ simhash.fingerprint(texts[100 + k].encode())).bit_count() > 2 for k in range(20))


def test_chains_are_groups_whatever_the_order(spark):
    rng = random.Random(1)
    text, rows = " ".join(f"w{k}" for k in range(150)), []
    for k in range(12):  # each like the next, the ends unlike each other
        rows.append((50 - k if k % 2 else k, text))
        text = edited(rng, text, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not similar(shingle_set(rows[0][1]), shingle_set(rows[-1][1]))
    assert {r.doc_id for r in near.one_of_each(docs).collect()} == near_groups(dict(rows)) == {0}


@pytest.mark.parametrize("hot", [3, 64, 128])
def test_crowds_are_linked_through_texts_that_left(spark, hot):
    rng = random.Random(hot)
    rows = []
    for tree in range(3):  # every text is an edited copy of one before it; trees share most of their words
        words = [f"w{k}" for k in range(150)]
        for k in rng.sample(range(150), 8 * tree):
            words[k] = f"t{tree}x{k}"
        own = [" ".join(words)]
        while len(own) < (150 if tree == 0 else 40):
            own.append(edited(rng, rng.choice(own[-12:]), rng.choice([1, 2, 3])))
        rows += own
    ids = rng.sample(range(1000), len(rows))
    docs = spark.createDataFrame(list(zip(ids, rows)), "doc_id long, text string")
    assert {r.doc_id for r in near.one_of_each(docs, hot=hot).collect()} == near_groups(dict(zip(ids, rows)))


def test_blocks_join_all_that_is_similar(spark):
    """Components in blocks of their own and in shared ones against all pairs."""
    rng = random.Random(2)
    base = [rng.sample(range(400), 60) for _ in range(3)]
    sets = [frozenset(v if rng.random() > 0.05 else rng.randrange(400, 5000) for v in rng.choice(base)) for _ in range(90)]
    texts = [" ".join(f"q{v}" for v in sorted(x)) for x in sets]
    comps = [k if k > 50 else 0 if k < 30 else 30 for k in range(90)]
    at = spark.createDataFrame([(1, k, comps[k]) for k in range(90)], "token long, node long, root long")
    leads = spark.createDataFrame([(k, k, k) for k in range(90)], "node long, id long, mark long")
    docs = spark.createDataFrame([(k, k, t.encode()) for k, t in enumerate(texts)], "id long, mark long, text binary")
    got = [(r.a, r.b) for r in near._crowds(at, docs, leads, False, 1, 0.8, block=8).collect()]
    like = [(a, b) for a in range(90) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert all((max(p), min(p)) in set(like) and comps[p[0]] != comps[p[1]] for p in got)

    def groups(links):
        root = list(comps)
        for a, b in list(links) * 2:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    assert groups(got) == groups(like) and len(set(groups(like))) < len(set(comps))


def test_nulls_repeats_short_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    rows = [(5, "a b c d", "x"), (2, "A B\tC\nd", "x"), (9, None, "x"), (8, "", None), (7, " \n\t", "x"), (4, "one", "x"), (4, "one", "x"), (4, "two words", "y"), (None, "a b c d", "x"), (3, long, "x"), (11, long + " end", "x"), (6, "one two three four five six", "x"), (10, "one two three four five seven", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumns({"node": F.lit("clash"), "mark": F.lit(0), "id": F.lit(1)})
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [
        (False, 2, "A B\tC\nd"), (False, 3, "w0 w1 w2 "), (False, 4, "one"), (False, 4, "two words"), (False, 6, "one two t"), (False, 7, " \n\t"), (False, 10, "one two t"), (True, 0, "a b c d"),
    ]
    assert near.one_of_each(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "x  y")], "doc_id string, text string")
    assert [r.doc_id for r in near.one_of_each(named).collect()] == ["a"]


def test_hashes_of_texts_are_those_of_each_alone(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "d\u00e9", "  ", "\n"]) for _ in range(rng.randrange(40))).encode() for _ in range(60)] + [b"", b"x" * 5000, b"q " * 400]
    h = near.Hashed(texts, 5)
    for t, own, n in zip(texts, h.of(), h.n):
        assert (own == near.shingles(t)).all() and len(own) == len(shingle_set(t.decode())) and n == (max(1, len(t.split()) - 4) if t.split() else 0)
    keys = [tuple(x) for x in h.copy.T.tolist()]
    words = [tuple(t.lower().split()) for t in texts]
    assert len(set(keys)) == len(set(words)) == len(set(zip(keys, words)))
    monkeypatch.setattr(near, "BLOCK", 7)
    again = near.Hashed(texts, 5)
    assert (again.windows == h.windows).all() and (again.copy == h.copy).all()
    bits = np.unpackbits(h.windows.view(np.uint8).reshape(-1, 8), axis=1)
    fps, at = simhash.majority(h.windows, h.n), 0
    for f, n in zip(fps.tolist(), h.n.tolist()):
        want = bits[at : at + n].sum(axis=0) * 2 > n
        assert (f & (2**64 - 1)) == (int("".join("1" if b else "0" for b in want), 2) if n else 0)
        at += n


@pytest.mark.parametrize("least", [0.8, 0.9])
def test_prefixes_of_similar_texts_meet(least):
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 10**6, rng.integers(2, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 10**6, rng.integers(0, 4)).astype(np.uint64)]))
        common = rng.integers(0, 3, near.CELLS)
        if len(b) and near.similarity(a, b) >= least:
            first = [near.ordered(x, common, near.prefix_size(len(x), least)) for x in (a, b)]
            more = [near.ordered(x, common, near.prefix_size(len(x), least) + 1) for x in (a, b)]
            assert len(np.intersect1d(*first)) >= 1
            assert len(np.intersect1d(*more)) >= 2 or min(len(a), len(b)) < 2


def test_stages_send_texts_to_workers_in_small_batches(spark, tmp_path):
    import corpus_pipeline as C
    from cloudweft import session

    def sizes(it):
        import pyarrow as pa

        for b in it:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(session._BATCH)
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.repeat(F.lit("words "), 1_000).alias("text"))
    spark.createDataFrame([(1, "an item of words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    try:
        for name, stage in C.STAGES:
            if name == "quality rules":  # has no Python workers
                continue
            spark.conf.set(session._BATCH, "64m")
            stage(spark, docs.limit(5), str(tmp_path))
            got = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
            assert sum(got) > 12_000_000 and max(got) < 5_000_000, name
        spark.conf.set(session._BATCH, "1m")
        session.lean(spark)
        assert spark.conf.get(session._BATCH) == "1m"
    finally:
        spark.conf.set(session._BATCH, before)

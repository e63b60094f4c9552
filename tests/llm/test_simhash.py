from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import brute_components, brute_fingerprint

from cloudweft.llm import simhash as S


def clusters(seed, n_random, n_near, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63 - 1, n_random)
    near = []
    for k in range(n_near):
        f = int(base[k % 7]) if k < n_near // 2 else near[rng.integers(len(near))]
        for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
            f ^= 1 << int(b)
            f -= (f >> 63 << 64) if f >= 2**63 else 0
        near.append(int(np.array(f & (2**64 - 1), np.uint64).astype(np.int64)))
    return [int(x) for x in base] + near


@pytest.mark.parametrize(("hot", "parts", "tau"), [(1000, 3, 2), (2, 3, 2), (5, 4, 2), (3, 2, 1), (1000, 3, 1), (2, 3, 0)])
def test_components_match_all_pairs(spark, hot, parts, tau):
    fps = clusters(7, 300, 250, 3)
    rows = list(enumerate(fps))
    nodes = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    got = {r.node: r.root for r in S.components(S.links(nodes, tau, parts, hot)).collect()}
    roots = [(k, got.get(f, f)) for k, f in rows]
    least: dict = {}
    for k, r in roots:
        least[r] = min(least.get(r, k), k)
    assert [least[r] for _, r in roots] == brute_components(rows, tau)


def test_thresholds_always_reach_the_sum(spark):
    nodes = spark.createDataFrame([(f,) for f in clusters(3, 200, 100, 2)], "fp long")
    plan = S.make_plan(nodes, 2, 3)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    t = plan.thresholds(np.array(clusters(4, 50, 0, 0), np.int64))
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1


def random_plan(rng, tau, parts, total):
    bits = rng.permutation(64)
    groups = [sorted(int(b) for b in bits[k::parts]) for k in range(parts)]
    hist = {(p, c): rng.dirichlet(np.full(2 ** len(x), 0.01)) * total for p, g in enumerate(groups) for c, x in enumerate(S._chunks(g))}
    return S.Plan(total, groups, hist, tau)


@pytest.mark.parametrize(("tau", "parts"), [(2, 3), (2, 4), (1, 2), (1, 3), (0, 2)])
def test_allocations_equal_enumeration_of_all(tau, parts):
    rng = np.random.default_rng(tau * 10 + parts)
    for total in (10, 5_000, 1_000_000, 10**9):
        plan, fps = random_plan(rng, tau, parts, total), rng.integers(-(2**63), 2**63 - 1, 60)
        costs, t = plan.costs(fps), plan.thresholds(fps)
        every = [a for a in itertools.product(range(-1, tau + 1), repeat=parts) if sum(a) == tau - parts + 1]
        sums = np.array([sum(costs[p, x + 1] for p, x in enumerate(a)) for a in every])
        assert (t.sum(axis=1) == tau - parts + 1).all() and t.min() >= -1 and t.max() <= tau
        assert np.allclose(sum(costs[p, t[:, p] + 1, np.arange(len(fps))] for p in range(parts)), sums.min(axis=0))


def test_two_crowded_parts_are_left_alone():
    groups, n = [list(range(21)), list(range(21, 42)), list(range(42, 64))], 1_000_000
    hist = {(p, c): np.full(2 ** len(x), n / 2 ** len(x)) for p, g in enumerate(groups) for c, x in enumerate(S._chunks(g))}
    for p, c in hist:
        if p:  # half of all rows share a value there
            hist[p, c] /= 2
            hist[p, c][0] += n / 2
    plan = S.Plan(n, groups, hist, 2)
    assert plan.thresholds(np.zeros(1, np.int64)).tolist() == [[2, -1, -1]]
    assert plan.costs(np.zeros(1, np.int64))[0, 3, 0] == pytest.approx(232 + 232 * n / 2**21)


@pytest.mark.parametrize("hot", [2, 1000])
@pytest.mark.parametrize("rows", [(3, 0, 0), (0, 3, 0), (0, 0, 3), (2, 1, 0), (0, 2, 1), (1, 1, 1)])
def test_any_thresholds_find_all_links(spark, monkeypatch, hot, rows):
    """Whatever the programme picks: thresholds fixed by hand, through plain and through crowded buckets."""
    monkeypatch.setattr(S.Plan, "thresholds", lambda self, fps: np.tile(np.array(rows, np.int8) - 1, (len(fps), 1)))
    fps = clusters(5, 60, 140, 2)
    nodes = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    found = S.components(S.links(nodes, 2, 3, hot)).collect()
    got, all_rows = {r.node: r.root for r in found}, list(enumerate(fps))
    least: dict = {}
    for k, f in all_rows:
        least[got.get(f, f)] = min(least.get(got.get(f, f), k), k)
    assert [least[got.get(f, f)] for _, f in all_rows] == brute_components(all_rows, 2)


def test_a_member_that_skips_a_part_is_met_by_the_only_probe(spark, monkeypatch):
    a, b = 0, 1 | 1 << 21  # one bit apart in the first part, one in the second

    groups = [list(range(21)), list(range(21, 42)), list(range(42, 64))]
    plan = S.Plan(1000, groups, {(p, c): np.zeros(2 ** len(x)) for p, g in enumerate(groups) for c, x in enumerate(S._chunks(g))}, 2)
    for p, near in enumerate([[[0.0, 0.044], [0.025, 0.084]], [[0.004, 0.004], [0.074, 0.074]], [[0.099, 0.099], [0.0, 0.0]]]):
        plan.near[p, 0][:2, :2] = near
        plan.near[p, 1][0, 0] = 1
    assert plan.thresholds(np.array([a, b])).tolist() == [[1, 0, -1], [-1, 0, 1]]
    monkeypatch.setattr(S, "make_plan", lambda *_: plan)
    nodes = spark.createDataFrame([(a,), (b,)], "fp long")
    assert [tuple(r) for r in S.links(nodes).collect()] == [(a, b)]


def test_documents_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, "a b c d", "x"), (2, "A B\tC\nd", "x"), (9, None, "x"), (8, "", None), (7, " \n\t", "x"), (4, "one", "x"), (4, "one", "x"), (None, "a b c d", "x"), (3, long, "x"), (6, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash"))
    got = S.near_duplicates(docs).collect()
    assert sorted((r.id is None, r.id or 0, r.fp) for r in got) == sorted((i is None, i or 0, brute_fingerprint(t)) for i, t, _ in rows)
    by = {r.id: r.component_id for r in got}
    assert by[5] == by[2] == by[None] == 2 and by[9] == by[8] == by[7] == 7 and by[4] == 4 and len(got) == len(rows)


def test_crowded_buckets_and_giant_components(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = 0x0F0F_1234_5678_9ABC
    fps = {base}
    while len(fps) < 400:  # all within two bits of one fingerprint
        a, b = rng.choice(63, 2, replace=False)
        fps.add(base ^ (1 << int(a)) ^ (1 << int(b)))
    rows = [(k, f) for k, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    got = {r.node: r.root for r in S.components(S.links(nodes, 2, 3, 4)).collect()}
    assert set(got) == fps and len(set(got.values())) == 1 and len(set(brute_components(rows, 2))) == 1


def test_text_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    assert {r.id: r.component_id for r in S.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0


def test_query_matches_brute_force(spark, tiny):
    from cloudweft.llm.queries import QUERIES

    got = sorted(QUERIES["op5_simhash"](spark, tiny).collect())
    docs = sorted(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect())
    prints = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    assert [(r.doc_id, r.fingerprint) for r in got] == [(i, f"{f & (2**64 - 1):016x}") for i, f in prints]
    assert [r.component_id for r in got] == brute_components(prints, 2)

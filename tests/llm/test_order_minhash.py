"""Order MinHash: fingerprints against a plain version, likeness, neighbours and edited texts, edge cases, no Python workers."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from cloudweft.llm import order_minhash as omh
from cloudweft.llm import queries


def signed(x, bits=64):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> bits - 1 else x


def hashed(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def plain(text, k=omh.K, picks=omh.PICKS, entries=omh.ENTRIES):
    """The definition read off: number occurrences, for each entry sort all items from its start on, take the least."""
    units = [u.encode() for u in re.findall(omh.UNIT, text or "")]
    if not units:
        return [0] * entries
    seen: dict = {}
    items = []
    for place in range(max(1, len(units) - k + 1)):
        h = signed(hashed(units[place : place + k]), 32)
        n = seen[h] = seen.get(h, -1) + 1
        key = signed(hashed([(h & (1 << 64) - 1).to_bytes(8, "little"), n.to_bytes(4, "little")]), 32) if n else h
        items.append((key, place))
    out = []
    for s in range(entries):
        start = ((s * (1 << 64) // entries) - (1 << 63)) >> 32
        order = sorted(items, key=lambda x: ((x[0] - start) % (1 << 32), x[1]))
        chosen = sorted((order[j % len(order)] for j in range(picks)), key=lambda x: x[1])
        out.append(signed(hashed([(x[0] & (1 << 32) - 1).to_bytes(8, "little") for x in chosen]) >> 32, 32))
    return out


def prints(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r[0] for r in omh.with_fingerprint(df, "text", "fp", **options).orderBy("doc_id").select("fp").collect()]


def some_texts():
    rng = random.Random(2)
    words = ["a", "bb", "internationalisation", "的中文字", "x", "é", "foo", "bar", "😀z", "b\x0bc"]
    texts = ["", None, " \n", "a", "a a", "a " * 9, "one two three", "word " * 400, " ".join(rng.choice(words) for _ in range(300)), " ".join(rng.choice(words[:3]) for _ in range(60))]
    return texts + ["".join(rng.choice([*words, " ", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]


def test_fingerprints_as_defined(spark):
    texts = some_texts()
    assert prints(spark, texts) == [plain(t) for t in texts]
    assert prints(spark, texts[:30], k=2, picks=3, entries=16) == [plain(t, 2, 3, 16) for t in texts[:30]]


def test_likeness_falls_with_edits_and_feels_order(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    base = [rng.choice(words) for _ in range(400)]

    def edited(n):
        out = list(base)
        for at in rng.sample(range(400), n):
            out[at] = rng.choice(words)
        return " ".join(out)

    swapped = base[200:] + base[:200]
    back = base[::-1]
    texts = [" ".join(base), edited(0), edited(4), edited(16), edited(60), " ".join(swapped), " ".join(back), " ".join(rng.choice(words) for _ in range(400))]
    first, *rest = prints(spark, texts)
    near = [sum(a == b for a, b in zip(first, x)) / len(first) for x in rest]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] > near[6]
    assert near[1] > 0.8 and near[6] < 0.05
    assert 0.3 < near[4] < 0.7  # halves swapped: the same k-mers but for three, and half of the pairs in another order
    assert near[5] < 0.05


def test_neighbours_and_edited_texts(spark, tiny):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect())
    found = {r.doc_id: r for r in queries.op12_order_minhash(spark, tiny).collect()}
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(rows):
        follows = rows[k - 1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        a, b, c = (plain(t) for t in (text, edited, follows))
        share = lambda x, y: sum(p == q for p, q in zip(x, y)) / len(x)
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (share(a, b), share(a, c))
        assert r.fingerprint == "".join(f"{x & 0xFFFFFFFF:08x}" for x in a) and r.edited_fingerprint == "".join(f"{x & 0xFFFFFFFF:08x}" for x in b)
    assert sum(r.near_edited > r.near_next for r in found.values()) > 0.95 * len(found)


def test_nulls_repeats_ties_and_other_columns(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(5, "five five five"), (5, "five five five"), (5, "another five"), (3, None), (None, "nobody knows"), (9, "é😀é😀"), (2, "x" * 300_000 + " y")]
    docs = spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id long, text string, next string, half int")
    found = omh.with_neighbours(docs).collect()
    assert len(found) == len(rows)
    five = min(["five five five", "another five"], key=sha)
    after = {9: five, 5: "", 3: "x" * 300_000 + " y", 2: "nobody knows", None: "é😀é😀"}
    want = sorted(((i, sha((t or "")[: len(t or "") - len(t or "") // 2] + after[i][: len(t or "") // 2])) for i, t in rows), key=repr)
    assert sorted(((r.id, r.edited_sha256) for r in found), key=repr) == want
    assert omh.with_neighbours(docs.limit(0)).count() == 0
    only = omh.with_neighbours(docs.filter("doc_id = 9")).first()
    assert only.edited_sha256 == sha("é😀é😀") and only.near_edited == only.near_next == 1
    blank = spark.createDataFrame([(1, ""), (2, None), (3, " \n")], "doc_id long, text string")
    assert {(r.near_edited, r.near_next) for r in omh.with_neighbours(blank).collect()} == {(1.0, 1.0)}


def test_ids_in_many_ranges(spark):
    docs = spark.range(0, 30_000, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    pairs = {r.id: r.next for r in omh.neighbours(docs).collect()}
    assert pairs == {i: (i - 3 if i else 29_997) for i in range(0, 30_000, 3)}


def test_no_python_workers(spark, tiny):
    plan = queries.op12_order_minhash(spark, tiny)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

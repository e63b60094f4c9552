"""Host rules, preference formatting, decontamination, packing and the pipeline."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cloudweft.llm import decontamination as D
from cloudweft.llm import host_rules, packing, preference
from cloudweft.llm._common import heavy_join
from cloudweft.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    cols = sorted(got.columns)
    res = con.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in res.fetchall())
    assert sorted(repr(list(r)) for r in got.select(*cols).collect()) == want


def brute_repeats(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


def test_rule_features_and_edges(spark):
    texts = [None, "", "a b c a b c a b c d", "x x x x", "a b", "one two three\n\none two three\n \none two three #$%", "é ü z", "a b c d a b c e " * 400]
    rows = [(k, t, "h1" if k % 2 else None) for k, t in enumerate(texts)] + [(2, texts[2], "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_words": F.lit(-1), "words": F.lit(None).cast("string")})
    got = host_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_repeat_words == brute_repeats(t) and r.n_words == len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    kept = host_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert host_rules.judge(docs.limit(0)).count() == 0


def test_bad_hosts_go_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good if k % 10 else "short", "fine") for k in range(400)]
    rows += [(1000 + k, "short" if k % 10 else good, "bad") for k in range(400)]
    rows += [(2000, "short", "single"), (2001, good, "single")]
    rows += [(3000 + k, good if k % 9 else "short", f"h{k % 20}") for k in range(400)]
    got = {r.doc_id: r.kept for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] and not got[0] and not got[1000] and got[2001] and not got[2000]


def brute_verdicts(rows, max_rate=0.5):
    """Ids that are kept, of (id, text, host): base rules, then hosts by their rate shrunk under a beta prior."""
    failed = {i: len(_words(t)) < 50 or 100 * brute_repeats(t) > 50 * len(_words(t)) for i, t, _ in rows}
    hosts: dict = {}
    for i, _, h in rows:
        if h is not None:
            hosts.setdefault(h, []).append(failed[i])
    n, x = {h: len(v) for h, v in hosts.items()}, {h: sum(v) for h, v in hosts.items()}
    m, p = sum(x.values()) / sum(n.values()), [x[h] / n[h] for h in hosts]
    spread = sum(v * v for v in p) / len(p) - (sum(p) / len(p)) ** 2 - m * (1 - m) * sum(1 / v for v in n.values()) / len(n)
    k = min(max(m * (1 - m) / spread - 1, 1), 10_000) if spread > 0 else 10_000
    return {i for i, _, h in rows if not failed[i] and (h is None or (x[h] + m * k) / (n[h] + k) <= max_rate)}


def test_many_hosts_hot_hosts_and_none(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good if k % 5 else "short", "hot" if k % 3 == 0 else None if k % 7 == 0 else f"h{k % 1500}") for k in range(6000)]
    rows += [(9000 + k, "short" if k % 8 else good, f"bad{k % 2}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules.judge(docs).collect()
    want = brute_verdicts(rows)
    assert len(got) == len(rows) and {r.doc_id for r in got if r.kept} == want
    assert not any(i >= 9000 for i in want) and {r.doc_id for r in host_rules.kept_documents(docs).collect()} == want


def test_rules_of_a_very_long_text(spark):
    rng = random.Random(5)
    text = "\n".join(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 12))) for _ in range(20_000)) + " #$"
    words, lines = text.split(), [x for x in text.split("\n") if x.split()]
    at: dict = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    r = host_rules.judge(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), 2, len(lines) - len(set(lines)), len(repeated))
    assert r.base_failed == (100 * len(repeated) > 50 * len(words))


def test_preferences_of_very_long_conversations(spark):
    rng = random.Random(6)
    shared = [("user" if k % 2 == 0 else "assistant", "".join(rng.choice("ab ") for _ in range(rng.randrange(200)))) for k in range(4_000)]
    sides = {2: shared + [("user", "x"), ("assistant", "y" * 300_000)], 3: shared + [("user", "x"), ("assistant", "z"), ("user", "q")]}
    turns = spark.createDataFrame([(c, k, *t) for c, ts in sides.items() for k, t in enumerate(ts)], "conv_id long, turn int, role string, text string")
    r = preference.preferences(preference.neighbour_pairs(turns), turns).first()
    assert r.prefix_turns == 4_001 and r.prompt.count("<|end|>") == 4_001
    assert [r.chosen[a:b] for a, b in r.chosen_spans] == ["y" * 300_000 + "<|end|>\n"] and [r.rejected[a:b] for a, b in r.rejected_spans] == ["z<|end|>\n"]


def test_heavy_join_is_a_left_join(spark):
    rows = spark.createDataFrame([("a", k) for k in range(3000)] + [("b", -1), (None, -2), ("z", -3)], "k string, v long")
    facts = spark.createDataFrame([("a", 3000, 1), ("b", 1, 2), ("c", 5, 3)], "k string, n long, x int")
    got = heavy_join(rows, facts, "k", "n", 3003)
    assert got.count() == 3003 and {(r.k, r.x) for r in got.collect()} == {("a", 1), ("b", 2), (None, None), ("z", None)}


TURNS = "conv_id long, turn long, role string, text string"


def test_preferences(spark):
    rows = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"), (1, 3, "user", "why"),
        (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", None), (4, 0, None, "alone"), (6, 5, "user", "x"), (6, 2, "user", "y"), (7, 0, "user", "y"), (7, 1, "user", "x"), (None, 0, "user", "lost"),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumn("place", F.lit("clash"))
    got = {r.pair_id: r for r in preference.preferences(preference.neighbour_pairs(turns), turns).collect()}
    assert set(got) == {0, 1, 2, 3}
    a = got[0]
    assert a.prefix_turns == 2 and a.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n"
    assert a.chosen == "<|assistant|>\nhello<|end|>\n" and [a.chosen[s.start : s.stop] for s in a.chosen_spans] == ["hello<|end|>\n"]
    assert [a.rejected[s.start : s.stop] for s in a.rejected_spans] == ["go away<|end|>\n"] and a.rejected.endswith("why<|end|>\n")
    assert got[1].chosen == "" and got[1].prefix_turns == 1 and got[1].rejected == "<|assistant|>\n<|end|>\n"
    assert got[2].rejected is None and got[2].prompt == "" and got[2].chosen == "<||>\nalone<|end|>\n"
    assert got[3].prefix_turns == 2 and got[3].chosen == got[3].rejected == ""
    none = turns.limit(0)
    assert preference.preferences(preference.neighbour_pairs(none), none).count() == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_and_negative_ids_and_missing_sides(spark, ansi):
    ids = [2**60 + k for k in range(8)] + [-4, -3, -1, 2**62]
    turns = spark.createDataFrame([(i, 0, "user", f"t{i}") for i in ids], TURNS)
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = preference.preferences(preference.neighbour_pairs(turns), turns).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    assert {(r.pair_id, r.chosen_id, r.rejected_id) for r in got} == {(2**59 + k, 2**60 + 2 * k, 2**60 + 2 * k + 1) for k in range(4)} | {(-2, -4, -3), (-1, None, -1), (2**61, 2**62, None)}
    for r in got:
        for side in ("chosen", "rejected"):
            assert (r[side] is None) == (r[f"{side}_id"] is None) == (r[f"{side}_spans"] is None)
        assert r.prefix_turns == 0 and r.prompt == ""


WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "ll", "st", "x")]


def _planted(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, text(30)) for k in range(20)]
    docs, truth = [], set()
    for k in range(120):
        body = text(rng.randrange(0, 200))
        if k % 4 == 0:
            i, words = k // 4 % 20, items[k // 4 % 20][1].split()
            for _ in range(k % 3 * 2):  # up to four edits
                p = rng.randrange(len(words))
                words[p : p + 1] = rng.choice([[], [rng.choice(WORDS)], [words[p], rng.choice(WORDS)]])
            body = f"{body} {'; '.join([' '.join(words).upper()])} {text(10)}"
            truth.add((k, i))
        docs.append((k, body))
    return items, docs, truth


def test_planted_passages_are_found(spark):
    items, docs, truth = _planted(3)
    b = spark.createDataFrame([*items, items[0], (50, None), (51, "zz yy"), (52, "lone")], "item_id long, text string")
    docs += [(130, docs[0][1]), (130, docs[0][1]), (131, "word zz yy end"), (132, "yy zz lone"), (133, " ".join(WORDS * 800) + " " + items[7][1])]
    truth |= {(130, 0), (131, 51), (133, 7)}
    d = spark.createDataFrame([*docs, (500, None), (501, "")], "doc_id long, text string").withColumns({"id": F.lit("clash"), "item_id": F.lit(0)})
    for block in (4_000_000, 900):
        got = D.contaminated(d, b, block_chars=block).collect()
        assert {(r.id, r.item_id) for r in got} == truth and len(got) == len(truth) + 1
        kept = D.clean(d, b, block_chars=block)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in truth} | {500, 501}
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0
    named = D.contaminated(d.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), b.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text")).collect()
    assert {(r.id, r.item_id) for r in named} == {(f"d{i}", f"i{k}") for i, k in truth}


def test_scripts_without_blanks_and_short_items(spark):
    items = [(1, "\u6771\u4eac\u306e\u4eba\u53e3\u306f\u3069\u306e\u304f\u3089\u3044\u3067\u3059\u304b"), (2, "\u5317\u4eac")]
    docs = [(1, "\u524d\u6587 " + items[0][1].replace("\u4eba", "\u53e3") + " \u5f8c"), (2, "\u79c1\u306f\u5317\u4eac\u3067\u3059"), (3, "\u4eac\u5317"), (4, "plain text")]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id) for r in got} == {(1, 1), (2, 2)}


def test_items_of_one_word_are_found_as_words(spark):
    items = [(1, "zyzzyva"), (2, ""), (3, None), (4, "two words")]
    docs = [(1, "here a Zyzzyva sits"), (2, "zyzzyvas"), (3, "two"), (4, ""), (5, "the two words")]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id) for r in got} == {(1, 1), (5, 4)}


def test_decontamination_query_matches_all_alignments(spark, tiny):
    """Every document against every item, the whole of both."""
    import numpy as np

    items = {r.item_id: D.words_of(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect():
        words = D.words_of(r.text)
        for k, own in items.items():
            ids = {w: j for j, w in enumerate(own)}
            text = np.array([ids.get(w, -1) for w in words])
            if len(text) and D.align(np.array([ids[w] for w in own]), text)[0] >= 0.4 * D.MATCH * len(own):
                want.add((r.doc_id, k))
    got = QUERIES["op4_decontamination"](spark, tiny).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_alignment_is_smith_waterman():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(-1, 4, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert D.align(a, b)[0] == h.max()


def brute_best_fit(lengths, sizes, prefer):
    """One item at a time, largest first, into the bin with the least room; new bins as the preference or the least cost says."""
    room, used, rest = [], [], sorted(lengths, reverse=True)
    left, counts = sum(rest), {n: rest.count(n) for n in rest}
    for k, n in enumerate(rest):
        if k == 0 or rest[k - 1] != n:
            same = counts[n]
            left -= n * same
        fit = [j for j, r in enumerate(room) if r >= n]
        if fit:
            j = min(fit, key=lambda j: (room[j], j))
        else:
            ok = [s for s in sizes if s >= n]
            if prefer is None:  # by what the bin is likely to hold: more of this length, then any of what is smaller
                size = min(ok, key=lambda s: (packing.default_cost(s) / min(s, n * min(same, s // n) + left), s))
            else:
                size = next((s for s in ok if s >= prefer), ok[-1])
            room.append(size)
            used.append(0)
            j = len(room) - 1
        room[j] -= n
        used[j] += n
        same -= 1
    return sorted(next(s for s in sizes if s >= u) for u in used)


@pytest.mark.parametrize("seed", range(6))
def test_counts_pack_as_items_do(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 65), rng.randrange(1, 20), 7]) for _ in range(rng.randrange(1, 200))]
    counts, costs = {n: lengths.count(n) for n in lengths}, []
    for prefer in (None, 16, 32, 64):
        plan = packing._plan(counts, (16, 32, 64), packing.default_cost, prefer)
        got = sorted(s for _, c, _, s in plan.bins.tolist() for _ in range(c))
        want = brute_best_fit(lengths, (16, 32, 64), prefer)
        if prefer is None:  # a run of equal items opens bins of one size, as its first item decides
            assert sum(got) >= sum(lengths) and abs(sum(map(packing.default_cost, got)) - sum(map(packing.default_cost, want))) <= 0.02 * sum(map(packing.default_cost, want)) + packing.default_cost(64)
        else:
            assert got == want
        costs.append(sum(map(packing.default_cost, got)))
    assert packing.make_plan(counts, (16, 32, 64)).cost == pytest.approx(min(costs))


def test_packing_places_every_item(spark):
    rng = random.Random(0)
    rows = [(k, rng.choice([0, 3, 3, 3, 17, 64, 65, 200, 1])) for k in range(500)] + [(7, 3), (7, 3), (None, 5), (900, None), (901, -4)]
    docs = spark.createDataFrame(rows, "doc_id long, n long").withColumns({"length": F.lit("clash"), "bin_id": F.lit(0)})
    got = packing.pack(docs, F.col("n"), sizes=(16, 32, 64)).collect()
    assert sum(r.length for r in got) == sum(max(n or 0, 0) for _, n in rows)
    bins: dict = {}
    for r in got:
        assert (r.bin_id is None) == (r.length == 0)
        if r.length:
            bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), items in bins.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size and size == next(s for s in (16, 32, 64) if s >= at)
    assert packing.pack(docs.limit(0), F.col("n")).count() == 0


def test_packed_sequences_hold_every_token_once(spark, tiny):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = QUERIES["op9_packing"](spark, tiny).collect()
    parts: dict = {}
    for r in got:
        assert r.n_tokens == len(r.ids) == sum(r.lengths) <= r.bin_size and r.bin_size == next(s for s in packing.SIZES if s >= r.n_tokens)
        at = 0
        for i, k, n in zip(r.doc_ids, r.pieces, r.lengths):
            parts[i, k] = r.ids[at : at + n]
            at += n
    assert len({r.bin_id for r in got}) == len(got) and sum(r.n_tokens for r in got) == sum(map(len, docs.values()))
    for i, ids in docs.items():
        assert [x for k in range(-(-len(ids) // packing.SIZES[-1])) for x in parts[i, k]] == ids


def test_sequence_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "word " * 20_000), ("a", None), (None, "x")], "doc_id string, text string").withColumn("ids", F.lit("clash"))
    rows = packing.sequences(packing.place(packing.token_pieces(docs, path))).collect()
    assert sum(r.n_tokens for r in rows) == 1 + 1 + 20_001 + 1 + 2
    none = packing.sequences(packing.place(packing.token_pieces(docs.limit(0), path)))
    assert none.count() == 0


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_contaminated(rows, items):
    """Ids with an item that aligns somewhere in the whole text."""
    import numpy as np

    out = set()
    for i, (t, _) in rows.items():
        words = D.words_of(t)
        for item in items:
            own = D.words_of(item)
            ids = {w: k for k, w in enumerate(own)}
            text = np.array([ids.get(w, -1) for w in words])
            if len(text) and D.align(np.array([ids[w] for w in own]), text)[0] >= 0.4 * D.MATCH * len(own):
                out.add(i)
                break
    return out


def brute_language(rows, model):
    """(id -> language) of the texts in which one language leads: each document alone, by a plain mixture."""
    from cloudweft.llm import langid

    out = {}
    for i, (t, _) in rows.items():
        words = langid.words_of(t)
        if words:
            shares = model.mixtures([words])[0]
            if shares.max() >= 0.5:
                out[i] = model.langs[int(shares.argmax())]
    return out


def test_pipeline_matches_brute_force(spark, tiny):
    import corpus_pipeline as C
    from tests_llm_helpers import near_groups

    from cloudweft.llm import langid

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    mixed = docs.filter("length(text) > 600")
    mixed = mixed.groupBy("lang").agg(F.min("text").alias("text")).agg(F.concat_ws("\n", F.collect_list(F.substring("text", 1, 500))).alias("text"))
    more = mixed.select(F.lit(100_000).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    docs = C.written(docs.unionByName(more), "with-a-mixture")
    names, rows = docs.columns, {r.doc_id: (r.text, r.source) for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    langs = brute_language(rows, langid.fit(docs))
    assert 100_000 not in langs
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, tiny), "stage")
        assert docs.columns == names
        found = docs.select("doc_id", "lang").collect()
        got = [r.doc_id for r in found]
        assert {r.doc_id: r.lang for r in found} == {i: langs[i] for i in got}
        if name == "language ID":
            want = set(langs)
        elif name == "quality rules":
            want = brute_verdicts([(i, *v) for i, v in rows.items()])
        elif name == "SimHash near-dedup":
            want = near_groups({i: t for i, (t, _) in rows.items()})
        else:
            want = set(rows) - brute_contaminated(rows, items)
        assert len(got) == len(set(got)) and set(got) == want, name
        rows = {i: rows[i] for i in got}
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = [(i, k, n) for r in C.STAGES[-1][1](spark, docs, tiny).collect() for i, k, n in zip(r.doc_ids, r.pieces, r.lengths)]
    assert len({p[:2] for p in parts}) == len(parts)
    assert {i: sum(p[2] for p in parts if p[0] == i) for i in rows} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, (t, _) in rows.items()}


def test_pipeline_with_nulls_repeats_long_texts_and_clashing_columns(spark, tiny):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    clean = docs
    for _, stage in C.STAGES[:-1]:
        clean = C.written(stage(spark, clean, tiny), "stage")
    first = sorted(clean.collect(), key=lambda r: r.doc_id)[0]
    long = max((r.text for r in clean.filter("lang = 'en'").collect()), key=len)
    rng = random.Random(3)
    words = long.split()
    long = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(3_000))
    rows = [
        first.asDict() | {"doc_id": None},  # a copy without an id
        first.asDict(), first.asDict(),  # repeated rows
        first.asDict() | {"doc_id": 200_001, "text": None}, first.asDict() | {"doc_id": 200_002, "text": ""},
        first.asDict() | {"doc_id": 200_003, "text": long, "source": None},
        dict.fromkeys(docs.columns),
    ]
    more = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema))
    extra = "id fp token score n_words kept words host rate component_id a b n part value lang_pred doc order label".split()
    more = C.written(more.withColumns({c: F.lit("clash") for c in extra}), "edges")
    names = more.columns
    for _, stage in C.STAGES[:-1]:
        more = C.written(stage(spark, more, tiny), "stage")
        assert more.columns == names
    got = more.select("doc_id", "text").collect()
    assert {tuple(r) for r in more.select(*extra).distinct().collect()} == {("clash",) * len(extra)}
    assert sorted((r.doc_id is not None, r.doc_id) for r in got if r.text == first.text) == [(False, None), (True, first.doc_id)]  # rows without an id stay
    assert all(r.text for r in got)
    assert [r.doc_id for r in got if r.text == long] == [200_003]
    assert {r.text for r in got} - {long} == {r.text for r in clean.collect()}
    packed = C.STAGES[-1][1](spark, more, tiny).collect()
    assert {i for r in packed for i in r.doc_ids} == {r.doc_id for r in got}


def test_pipeline_runs(spark, tiny):
    import corpus_pipeline as C

    assert C.run(spark, tiny).count() > 0


def test_pipeline_on_an_empty_table(spark, tiny):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = C.written(stage(spark, docs, tiny), "stage")
    assert docs.count() == 0

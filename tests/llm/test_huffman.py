from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloudweft.llm import huffman as H

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=300), st.integers(9, 18))
@settings(max_examples=40, deadline=None)
def test_lengths_are_a_prefix_code_within_the_limit(counts, bits):
    lengths = H.code_lengths(np.array(counts), bits)
    assert lengths.max() <= bits and sum(2.0 ** -int(x) for x in lengths) <= 1
    order = np.argsort(counts)
    assert all(a >= b for a, b in zip(lengths[order], lengths[order][1:]) if True) or len(set(counts)) < len(counts)


def test_unlimited_lengths_cost_what_huffman_costs():
    import heapq

    rng = np.random.default_rng(1)
    counts = (rng.pareto(1.2, 400) * 10 + 1).astype(int)
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert (H.code_lengths(counts, 24) * counts).sum() == cost


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 1000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    symbols = np.array([3, 10, 11, 40, 49407])
    code = H.Code(symbols, H.code_lengths(np.array([100, 50, 3, 1, 1]), 18))
    ids = rng.choice(symbols, n)
    assert (code.unpack(*code.pack(ids), n) == ids).all()


TEXTS = [
    "The cat's hat, 12 dogs!! naïve café ÉCOLE straße", "a\tb c\x1cd  e\r\nf", "", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ﬁ é ẛ̣", "don't we'll 'S 's", "日本語 テキスト 😀👍🏽", "x" * 5000, "Word. word, WORD! (word) [word]-", "ǅ ª º ⅷ ² ½",
]


def test_pieces_give_what_the_tokenizer_gives():
    tk, enc = Tokenizer.from_file(PATH), H.Encoder(PATH, keep=5)
    for _ in range(2):
        for t in [*TEXTS, " ".join(TEXTS), "\n".join(TEXTS)]:
            assert np.frombuffer(enc.encode(t), "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_accented_capitals_and_new_pieces_are_learnt_singly():
    tk, enc = Tokenizer.from_file(PATH), H.Encoder(PATH)
    texts = ["\u00c9r\u00e9. \u00d1ez \u0152UVRE, \u00c0", "word \u00c9r\u00e9. new"]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    enc.encode(". ,")
    whole, learn, seen = enc._whole, enc.pieces.learn, []
    enc._whole = lambda x: whole(x) if len(x) == 1 and not x.isalpha() else pytest.fail(x)
    enc.pieces.learn = lambda x: seen.append(x) or learn(x)
    assert [np.frombuffer(enc.encode(t), "<u2").tolist() for t in texts] == want
    assert seen == [*texts[0].split(), "word", "new"]
    enc = H.Encoder(PATH)
    for c in map(chr, range(0x21, 0x250)):  # where lower case is taken letter by letter
        t = f"{c} {c}ab. AB{c}\u00e9, {c}{c.upper()}"
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids, c


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tk, enc = Tokenizer.from_file(path), H.Encoder(path)
    assert not enc.by_piece
    for t in TEXTS:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids


def _expected(rows, end=2):
    tk = Tokenizer.from_file(PATH)
    return [tk.encode(t or "", add_special_tokens=False).ids + [end] for _, t in rows]


def test_files_round_trip_with_nulls_repeats_and_order(spark, tmp_path):
    rows = [(k * 7 % 40, TEXTS[k % len(TEXTS)] + f" {k}") for k in range(40)] + [(3, None), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    H.write_ids(docs, str(tmp_path / "f"), PATH, block_symbols=50)
    got = H.read_ids(spark, str(tmp_path / "f")).collect()
    got.sort(key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    want = sorted(((i is not None, i or 0, ids) for (i, _), ids in zip(rows, _expected(rows))), key=lambda x: x[:2])
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == sorted(want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_a_very_long_text(spark, tmp_path):
    rows = [(1, "short"), (2, " ".join(f"{TEXTS[k % len(TEXTS)]} {k}" for k in range(30_000))), (3, "")]
    H.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "l"), PATH, block_symbols=1_000)
    got = sorted(H.read_ids(spark, str(tmp_path / "l")).collect(), key=lambda r: r.start)
    assert [list(r.ids) for r in got] == _expected(rows) and len(got[1].ids) > 60_000


def test_empty_table(spark, tmp_path):
    H.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert H.read_ids(spark, str(tmp_path / "e"), digest=True).count() == 0


def test_query_is_exact(spark, tiny):
    from cloudweft.llm.queries import QUERIES

    docs = sorted(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(QUERIES["op8_token_huffman"](spark, tiny).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start, want = 0, []
    for (i, _), ids in zip(docs, _expected(docs)):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want

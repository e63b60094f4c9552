"""Documents that hold passages of a benchmark, exact or edited.

Every item gives seeds: its runs of ``seed`` words. A seed is rare if chance, by the corpus's own word counts, would put it
into few documents, so that many contaminated documents do not make a seed common; an item always keeps its
``least_seeds`` least likely ones. Seeds found in a document point to passages, and Smith-Waterman alignment of the item
with each passage scores it, so substitutions, insertions and deletions of words are forgiven.

The items, which the user states, go to the tasks in blocks of about ``block_chars`` characters (or one longer item): their
broadcast is bounded and a larger benchmark takes more scans. Documents are read whole and never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ._common import batches, pieces

#: Letters of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han).
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
MATCH, MISMATCH, GAP = 2, -1, -1


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased; in scripts without blanks every letter is a word."""
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local score of word ids against each other, and the window's last word of it. Ids below 0 match nothing."""
    steps = np.arange(1, len(window) + 1) * -GAP
    row, best, at = np.zeros(len(window) + 1, np.int64), 0, -1
    for x in item:
        new = np.maximum(row[:-1] + np.where((window == x) & (x >= 0), MATCH, MISMATCH), row[1:] + GAP)
        new = np.maximum.accumulate(np.maximum(new, 0) + steps) - steps
        row = np.concatenate([[0], new])
        top = int(new.argmax())
        if new[top] > best:
            best, at = int(new[top]), top
    return best, at


class Seeds:
    """Items as word ids, and their rare seeds: for each length of seed, sorted keys with the (item, place) of each."""

    def __init__(self, items: list[tuple[int, str]], seed: int, min_words: int):
        self.seed, self.min_words, self.ids = seed, min_words, [k for k, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], np.int64) for _, t in items]
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def choose(self, counts: dict[str, int], total: int, documents: int, max_chance: float, least_seeds: int) -> None:
        """An item shorter than a seed is one seed as a whole, however common."""
        share = np.full(len(self.vocabulary) + 1, 1 / max(total, 1))
        for w, n in counts.items():
            share[self.vocabulary[w]] = n / max(total, 1)
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.n_seeds = [0] * len(self.words)
        for k, words in enumerate(self.words):
            size = min(self.seed, len(words))
            if size < max(1, self.min_words):
                continue
            runs = np.lib.stride_tricks.sliding_window_view(words, size)
            chance = np.log(share[runs]).sum(axis=1) + np.log(max(total, 1) / max(documents, 1))
            rare = chance <= np.log(max_chance)
            rare[np.argsort(chance, kind="stable")[:least_seeds]] = True
            self.n_seeds[k] = int(rare.sum())
            found.setdefault(size, []).append((self.key(runs[rare]), np.full(self.n_seeds[k], k), np.flatnonzero(rare)))
        for size, parts in sorted(found.items()):
            keys, owners, places = (np.concatenate(x) for x in zip(*parts))
            by = np.argsort(keys, kind="stable")
            self.tables.append((size, keys[by], owners[by], places[by]))

    def key(self, runs: np.ndarray) -> np.ndarray:
        """Runs of word ids as 64-bit keys; a clash only brings a passage to alignment that fails it."""
        out = np.zeros(len(runs), np.uint64)
        for k in range(runs.shape[1]):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + runs[:, k].astype(np.uint64) + np.uint64(1)
        return out

    def found(self, text: list[str], min_score: float, min_hits: int) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, word after the last) of the best passage of each item in a document."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in text), np.int64, len(text))
        known = ids >= 0
        owners, begins = [], []
        for size, keys, owned, places in self.tables:
            starts = known[: max(len(ids) - size + 1, 0)].copy()
            for k in range(1, size):
                starts &= known[k : len(ids) - size + 1 + k]
            starts = np.flatnonzero(starts)
            key = self.key(np.stack([ids[starts + k] for k in range(size)], axis=1))
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            hit = np.flatnonzero(hi > lo)
            n = hi[hit] - lo[hit]
            at = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            owners.append(owned[at])
            begins.append(np.repeat(starts[hit], n) - places[at])  # where the item would begin
        if not sum(map(len, owners)):
            return []
        owner, begin = np.concatenate(owners), np.concatenate(begins)
        order = np.lexsort((begin, owner))
        owner, begin = owner[order], begin[order]
        sizes = np.array([len(self.words[o]) for o in owner])
        cut = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(begin, prepend=begin[0]) > sizes // 2))
        best: dict[int, tuple[float, int, int]] = {}
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(owner)]):
            o = int(owner[a])
            if b - a < min(min_hits, self.n_seeds[o]):
                continue
            item = self.words[o]
            slack = len(item) // 2 + 2
            left, right = max(0, int(begin[a]) - slack), min(len(ids), int(begin[b - 1]) + len(item) + slack)
            score, last = align(item, ids[left:right])
            if score < min_score * MATCH * len(item):
                continue
            _, first = align(item[::-1], ids[left : left + last + 1][::-1])
            got = (score / (MATCH * len(item)), left + last - first, left + last + 1)
            if o not in best or got[0] > best[o][0]:
                best[o] = got
        out = [(o, *v) for o, v in sorted(best.items())]
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 3, max_chance: float = 1e-3, least_seeds: int = 8, min_hits: int = 2, min_score: float = 0.4, min_words: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """(id, item_id, score, first_word, last_word): every document and item whose best passage reaches ``min_score``.

    The score is the alignment's (2 a match, -1 a mismatch or gap) over that of the whole item. Items shorter than a seed are found
    by their whole word sequence, an item of one word by that word; those of fewer than ``min_words`` words find nothing, as null and
    empty texts do. An item id that repeats is one item for each of its texts; equal rows of the benchmark are one; document rows that repeat
    are each judged. Texts are read whole, whatever their length. Without documents or items there are no rows. Ids may have any type.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for seeds in _blocks(texts, benchmark, item_col, item_text_col, seed, max_chance, least_seeds, min_words, block_chars):
        one = _search(texts, seeds, benchmark.schema[item_col].dataType, min_score, min_hits)
        found = one if found is None else found.unionByName(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 3, max_chance: float = 1e-3, least_seeds: int = 8, min_hits: int = 2, min_score: float = 0.4, min_words: int = 1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no passage; every row is judged where it is, without a join."""
    at, texts = docs.columns.index(text_col), docs.select(F.col(text_col).alias("text"))
    for seeds in _blocks(texts, benchmark, item_col, item_text_col, seed, max_chance, least_seeds, min_words, block_chars):
        docs = _kept(docs, at, seeds, min_score, min_hits)
    return docs


def _kept(docs: DataFrame, at: int, seeds: Seeds, min_score: float, min_hits: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(it):
        seeds = sent.value
        for b in it:
            yield b.filter(pa.array([not t or not seeds.found(words_of(t), min_score, min_hits) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _blocks(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, seed: int, max_chance: float, least_seeds: int, min_words: int, block_chars: int) -> Iterator[Seeds]:
    """The seeds of items with about ``block_chars`` characters at a time, chosen by the words of all ``texts``."""
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    blocks = max(1, -(-int(items.agg(F.sum(F.length("item_text"))).first()[0] or 0) // block_chars))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k).orderBy("item_id", "item_text").collect()
        seeds = Seeds([(r[0], r[1]) for r in part], seed, min_words)
        _rarity(texts, seeds, max_chance, least_seeds)
        yield seeds


def _rarity(texts: DataFrame, seeds: Seeds, max_chance: float, least_seeds: int) -> None:
    """Counts the items' words over all documents: as many numbers as the items have words reach the driver."""
    sent = texts.sparkSession.sparkContext.broadcast(seeds.vocabulary)

    def run(it):
        vocabulary = sent.value
        sums, total, documents = Counter(), 0, 0
        for (column,) in batches(it, "text"):
            documents += len(column)
            for a, b in pieces(column):
                counts = Counter(words_of(" ".join([t for t in column[a:b] if t])))
                total += counts.total()
                for w in vocabulary.keys() & counts.keys():
                    sums[w] += counts[w]
        rows = [*sums.items(), (None, total), ("", documents)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    counts = {r[0]: r[1] for r in texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total, documents = counts.pop(None, 0), counts.pop("", 0)
    seeds.choose(counts, total, documents, max_chance, least_seeds)


def _search(texts: DataFrame, seeds: Seeds, item_kind: DataType, min_score: float, min_hits: int) -> DataFrame:
    sent, items_as = texts.sparkSession.sparkContext.broadcast(seeds), to_arrow_type(item_kind)

    def run(it):
        seeds = sent.value
        for b in it:
            rows = [(k, seeds.ids[o], s, a, z) for k, t in enumerate(b.column("text").to_pylist()) if t for o, s, a, z in seeds.found(words_of(t), min_score, min_hits)]
            at, items, *rest = list(zip(*rows)) or [()] * 5
            cols = [b.column("id").take(pa.array(at, pa.int64())), pa.array(items, items_as), *(pa.array(c, k) for c, k in zip(rest, (pa.float64(), pa.int64(), pa.int64())))]
            yield pa.record_batch(cols, names=["id", "item_id", "score", "first_word", "last_word"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, item_id {item_kind.simpleString()}, score double, first_word long, last_word long")

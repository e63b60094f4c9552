"""Language identification for documents that may mix languages.

Letter trigrams of marked words give every word a likelihood under each language. A document is a mixture: expectation-
maximisation finds the share of each language in its words, and the set of languages is the one with the best penalised
likelihood (half the logarithm of the word count, times ``penalty``, for each language after the first) among the nested
sets of the likeliest languages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches, held_out, pieces

_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; without any letter none."""
    found = _WORD.findall((text or "").lower())
    if found and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def trigrams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all trigrams of the words between marks, first trigram of each word)."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    mixed = ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x27D4EB2F)) & np.uint64(0xFFFFFFFF)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    inside = codes[1:-1] > 3  # the middle letter is a letter
    return (mixed >> np.uint64(32 - bits)).astype(np.int64)[inside], np.cumsum(lengths) - lengths


class Model:
    """Log-likelihoods of trigram buckets by language, and those of the words met so far."""

    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.1, keep: int = 200_000):
        self.langs, self.bits, self.keep = langs, int(counts.shape[0]).bit_length() - 1, keep
        self.logp = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * len(counts))).astype(np.float32)
        self.rows: dict[str, int] = {}
        self.known = np.zeros((0, len(langs)), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"rows": {}, "known": self.known[:0]}

    def rows_of(self, docs: list[list[str]]) -> np.ndarray:
        get = self.rows.get
        fresh = list({w for d in docs for w in d if get(w) is None})
        if len(self.rows) + len(fresh) > self.keep:
            self.rows.clear()
            self.known = self.known[:0]
            fresh = list({w for d in docs for w in d})
        if fresh:
            buckets, starts = trigrams(fresh, self.bits)
            self.rows.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.known = np.concatenate([self.known, np.add.reduceat(self.logp[buckets], starts, axis=0)])
        rows = self.rows
        return np.fromiter((rows[w] for d in docs for w in d), np.int64, sum(map(len, docs)))

    def mixtures(self, docs: list[list[str]], penalty: float = 2.0, rounds: int = 12) -> np.ndarray:
        """[documents, languages] shares in the selected set; every document has a word."""
        n = np.array([len(d) for d in docs])
        starts = np.cumsum(n) - n
        rows = self.rows_of(docs)
        ll = self.known[rows]
        top = ll.max(axis=1, keepdims=True)
        p = np.exp(np.maximum(ll - top, -60))
        single = np.add.reduceat(np.log(p), starts, axis=0)  # beside the constant of the tops
        best = single.argmax(axis=1)
        out = np.zeros((len(docs), len(self.langs)))
        out[np.arange(len(docs)), best] = 1
        if len(self.langs) == 1:
            return out
        shares, full = _em(p, starts, n, np.full_like(out, 1 / len(self.langs)), rounds)
        price = 0.5 * penalty * np.log(n + 1.0)
        score = single.max(axis=1)
        open_ = np.flatnonzero(full - price > score)  # no set can beat one language elsewhere
        order = np.argsort(-shares, axis=1, kind="stable")
        for k in range(2, len(self.langs) + 1):
            if not len(open_):
                break
            start = np.zeros((len(open_), len(self.langs)))
            np.put_along_axis(start, order[open_, :k], 1 / k, axis=1)
            at = np.concatenate([np.arange(starts[d], starts[d] + n[d]) for d in open_])
            m = n[open_]
            got, value = _em(p[at], np.cumsum(m) - m, m, start, rounds)
            value = value - (k - 1) * price[open_]
            better = value > score[open_]
            out[open_[better]], score[open_[better]] = got[better], value[better]
            open_ = open_[full[open_] - k * price[open_] > score[open_]]
        return out


def _em(p: np.ndarray, starts: np.ndarray, n: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components in every document and its log-likelihood; a share of 0 stays 0.

    A document stops on its own, when its shares move by less than 1e-3, so its result doesn't depend on those beside it.
    """
    shares = shares.astype(np.float32)
    live, q, at, m = np.arange(len(n)), p, starts, n
    for _ in range(rounds):
        parts = q * np.repeat(shares[live], m, axis=0)
        whole = np.maximum(parts.sum(axis=1, keepdims=True), 1e-30)
        new = (np.add.reduceat(parts / whole, at, axis=0) / m[:, None]).astype(np.float32)
        on = np.abs(new - shares[live]).max(axis=1) >= 1e-3
        shares[live] = new
        if not on.any():
            break
        if not on.all():
            q, live = q[np.repeat(on, m)], live[on]
            m = n[live]
            at = np.cumsum(m) - m
    whole = np.maximum((p * np.repeat(shares, n, axis=0)).sum(axis=1), 1e-30)
    return shares, np.add.reduceat(np.log(whole), starts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, remainder: int = 1, rows_per_language: int = 4_000, bits: int = 17) -> Model | None:
    """Counts trigrams of whole texts over about ``rows_per_language`` training rows of each language, chosen by the hash of the id.

    Training rows have a language and are not held out. The counts that reach the driver are at most languages x 2**bits.
    None without training rows.
    """
    rows = docs.filter(~held_out(id_col, modulus, remainder) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1_000_000, -(-1_000_000 * rows_per_language // sizes[k])))])
    rows = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share[F.col(lang_col)])

    def run(it):
        sums = {}
        for keys, texts in batches(it, "lang", "text"):
            for lo, hi in pieces(texts):
                for k in set(keys[lo:hi]):
                    words = [w for j in range(lo, hi) if keys[j] == k for w in words_of(texts[j])]
                    if words:
                        sums[k] = sums.get(k, 0) + np.bincount(trigrams(words, bits)[0], minlength=1 << bits)
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    got = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(langs)))
    counts[got.bucket.to_numpy(), np.searchsorted(np.array(langs, dtype=object), got.lang.to_numpy())] = got.n.to_numpy()
    return Model(langs, counts)


def _labelled(model: Model | None, texts: list, penalty: float) -> tuple[list[str], list[float], list[str]]:
    """Language, score and set of every text."""
    lang, score, every = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
    for lo, hi in pieces(texts, 2_400_000 // max(4, len(model.langs))) if model else []:
        docs = [words_of(t) for t in texts[lo:hi]]
        at = [k for k, d in enumerate(docs) if d]
        if not at:
            continue
        shares = model.mixtures([docs[k] for k in at], penalty)
        for k, row in zip(at, shares):
            by = np.argsort(-row, kind="stable")
            lang[lo + k], score[lo + k] = model.langs[by[0]], float(min(1.0, row[by[0]]))
            every[lo + k] = ",".join(f"{model.langs[j]}:{row[j]:.3f}" for j in by if row[j] > 0)
    return lang, score, every


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = 2.0) -> DataFrame:
    """(id, lang, score, languages) of every whole text.

    ``lang`` has the largest share, ``score`` is that share, ``languages`` lists the set as ``lang:share``, largest first; ties go
    to the first in alphabetical order. A null text, one without letters, and any text without a model is ``und`` with 0. Each
    row is judged alone, so rows that repeat get the same result, whatever the batches and partitions; texts may have any length,
    ids any type. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            lang, score, every = _labelled(sent.value, b.column("text").to_pylist(), penalty)
            yield pa.record_batch([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(every, pa.string())], names=["id", "lang", "score", "languages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, score double, languages string")


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] | None = None, least: float = 0.5, penalty: float = 2.0) -> DataFrame:
    """The rows of ``docs`` in one of ``languages`` (None: any that was learnt), with all columns; ``lang_col`` becomes the language found.

    A row goes if its text is undetermined, if its first language has a share under ``least`` (no language leads the mixture),
    or if that language isn't asked for. ``lang_col`` is a string column of ``docs``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, out = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(it):
        for b in it:
            lang, score, _ = _labelled(sent.value, b.column(at).to_pylist(), penalty)
            keep = [k != UNDETERMINED and s >= least and (languages is None or k in languages) for k, s in zip(lang, score)]
            cols = [pa.array(lang, b.schema.field(k).type) if k == out else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

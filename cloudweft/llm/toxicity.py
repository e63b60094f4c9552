"""Toxicity by a factorisation machine over hashed terms.

Terms are the lower-cased words of a text and, for words of eight letters and more, their beginnings of five to seven
letters, hashed into 2**bits buckets. Every bucket is a feature, valued 1 + ln(count) times how much its classes differ in
the training rows (never nothing, so that two terms that tell nothing apart can tell something together); a text's values
have length 1. Linear weights and factors of rank ``rank``, so that a pair of terms can count for more than both alone,
are learnt by Adam on the logistic loss.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches, labelled_sample, pieces

_WORD = re.compile(r"\w+")


def terms(word: str) -> list[str]:
    """The word and its beginnings, which are marked apart from whole words."""
    return [word, *(f"{word[:k]}~" for k in (5, 6, 7) if len(word) >= 8)]


def bucket(term: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(term.encode("utf-8", "replace")) >> (32 - bits)


def _csr(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of bags of features, in order."""
    n = np.fromiter((len(d) for d in docs), np.int64, len(docs))
    feats = np.fromiter(chain.from_iterable(docs), np.int64, int(n.sum()))
    if not len(feats):
        return feats, feats, np.zeros(0, np.float64)
    wide = int(feats.max()) + 1
    keys, counts = np.unique(np.repeat(np.arange(len(docs)), n) * wide + feats, return_counts=True)
    return keys // wide, keys % wide, 1 + np.log(counts)


class Machine:
    """bias, linear weights and factors of all buckets, and their scale; scores bags of words."""

    def __init__(self, bits: int, rank: int, seed: int = 7, keep: int = 200_000):
        self.bits, self.seed, self.keep = bits, seed, keep
        self.bias, self.scale = 0.0, np.ones(1 << bits, np.float32)
        self.w, self.v = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, rank), np.float32)
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def bag(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in _WORD.findall(text.lower()):
            got = known.get(w)
            if got is None:
                if len(known) >= self.keep:
                    known.clear()
                got = known[w] = tuple(sorted({bucket(t, self.bits) for t in terms(w)}))
            out.extend(got)
        return out

    def values(self, doc: np.ndarray, feat: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Scaled values; those of each of the ``n`` documents have length 1."""
        x = x * self.scale[feat]
        return x / np.sqrt(np.maximum(np.bincount(doc, x * x, n), 1e-12))[doc] if len(x) else x

    def raw(self, doc: np.ndarray, feat: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the sums of factors that the gradient needs."""
        linear = np.bincount(doc, self.w[feat] * x, n) if len(doc) else np.zeros(n)
        sums = np.stack([np.bincount(doc, self.v[feat, k] * x, n) for k in range(self.v.shape[1])], axis=1) if len(doc) else np.zeros((n, self.v.shape[1]))
        squares = np.bincount(doc, ((self.v[feat] * x[:, None]) ** 2).sum(axis=1), n) if len(doc) else np.zeros(n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def weigh(self, doc: np.ndarray, feat: np.ndarray, y: np.ndarray, whole: float = 8.0, least: float = 0.05) -> None:
        """A bucket's scale: its two-proportion z score over ``whole``, squared, between ``least`` and 1."""
        n, rate, size = len(y), y.mean(), len(self.w)
        count, hits = np.bincount(feat, minlength=size), np.bincount(feat, y[doc], size)
        spread = np.sqrt(np.maximum(rate * (1 - rate) * count * (1 - count / (n + 1)), 1e-9))
        self.scale = np.clip((np.abs(hits - rate * count) / spread / whole) ** 2, least, 1).astype(np.float32)

    def fit(self, doc: np.ndarray, feat: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.02, l2: float = 1e-5, l2_pairs: float = 1e-4) -> None:
        """Learns from documents in order (``doc`` ascending from 0); ``y`` holds both classes."""
        n, rank, rng = len(y), self.v.shape[1], np.random.default_rng(self.seed)
        x, used = self.values(doc, feat, x, n), np.unique(feat)
        size, feat, cuts = len(used), np.searchsorted(used, feat), np.searchsorted(doc, np.arange(n + 1))
        whole = self.w, self.v
        theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.01, (size, rank))], axis=1)
        decay = np.array([l2, *[l2_pairs] * rank])
        m, s, self.bias, step = np.zeros_like(theta), np.zeros_like(theta), float(np.log(y.mean() / (1 - y.mean()))), 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                at = order[lo : lo + batch]
                k, step = cuts[at + 1] - cuts[at], step + 1
                rows = np.repeat(cuts[at] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
                d, f, value = np.repeat(np.arange(len(at)), k), feat[rows], x[rows]
                self.w, self.v = theta[:, 0], theta[:, 1:]
                raw, sums = self.raw(d, f, value, len(at))
                g = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[at]
                gx = g[d] * value
                grad = np.stack([np.bincount(f, gx, size), *(np.bincount(f, gx * (sums[d, j] - self.v[f, j] * value), size) for j in range(rank))], axis=1) / len(at) + decay * theta
                m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
                theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
                self.bias -= rate * float(g.mean())
        self.w, self.v = whole
        self.w[used], self.v[used] = theta[:, 0], theta[:, 1:]

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, feat, x = _csr([self.bag(t) for t in texts])
        raw = np.clip(self.raw(doc, feat, self.values(doc, feat, x, len(texts)), len(texts))[0], -40, 40)
        return 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, remainder: int = 0, max_rows: int = 12_000, bits: int = 18, rank: int = 4) -> Machine:
    """A machine learnt from the whole texts of at most ``max_rows`` labelled rows that are not held out.

    One scan of ``docs``. The driver gets (bucket, value) of these rows, 8 bytes for each of a text's distinct buckets, which
    are 2**bits at most. Without rows of both classes (an empty table, say) the machine knows the base rate alone.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, modulus, remainder)
    machine = Machine(bits, rank)

    def features(it):
        for order, texts, ys in batches(it, "order", "text", "label"):
            doc, feat, x = _csr([machine.bag(t) for t in texts])
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            rows = [(feat[a:b].astype(np.int32).tobytes(), x[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([pa.array(order, pa.int64()), pa.array(ys, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["order", "label", "feats", "x"])

    rows = sample.select(F.xxhash64(id_col, "text").alias("order"), "text", "label")
    got = rows.mapInArrow(features, "order long, label int, feats binary, x binary").toPandas().sort_values("order", kind="stable")
    y = got.label.to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        rate = float(y.mean()) if len(y) else 0.5
        machine.bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        return machine
    doc = np.repeat(np.arange(len(got)), got.feats.map(len).to_numpy() // 4)
    feat, x = np.frombuffer(b"".join(map(bytes, got.feats)), np.int32).astype(np.int64), np.frombuffer(b"".join(map(bytes, got.x)), np.float32).astype(np.float64)
    machine.weigh(doc, feat, y)
    machine.fit(doc, feat, x, y)
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, each judged alone: rows that repeat get equal scores.

    A null or empty text has no terms and gets the bias alone; texts may have any length, ids any type, other columns any
    names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it):
        machine = sent.value
        for b in it:
            texts = b.column("text").to_pylist()
            got = [machine.scores([t or "" for t in texts[lo:hi]]) for lo, hi in pieces(texts)]
            yield pa.record_batch([b.column("id"), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")

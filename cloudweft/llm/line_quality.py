"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Emissions see the line's own features and those of its two neighbours; a 2 x 2
table scores the step from line to line. Training rows have a label for the document only, so line labels are found by
rounds: lines of good documents are good; lines of bad documents start bad, and in each further round those that the field
holds good become so, except the worst one. A document's quality is the mean of its lines' marginals (forward-backward),
weighted by their length, put through a logistic curve fitted to the documents' labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches, labelled_sample, pieces, written

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"#*$%&<>{}[]\\^~=+_@/", b"|", b"!?", b".,;:"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:] = 9
N_OWN = 19


def lines_of(text: bytes | None) -> list[bytes]:
    """The lines that hold a word."""
    return [x for x in (text or b"").split(b"\n") if x.strip()]


def own_features(docs: list[list[bytes]]) -> np.ndarray:
    """[lines, N_OWN] of all lines of ``docs`` in order; every document has a line."""
    flat = [x for d in docs for x in d]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    starts = np.cumsum(size) - size
    kinds = _CLASS[np.frombuffer(b"".join(flat), np.uint8)]
    share = {k: np.add.reduceat(kinds == k, starts, dtype=np.int32) / size for k in range(1, 10)}
    words, fresh, again = np.zeros(len(flat)), np.zeros(len(flat)), np.zeros(len(flat))
    k = 0
    for d in docs:
        seen: set[bytes] = set()
        for x in d:
            w = x.split()
            words[k], fresh[k], again[k] = len(w), len(set(w)), x in seen
            seen.add(x)
            k += 1
    letters = np.maximum(share[1] + share[2], 1e-9)
    ends = np.fromiter((x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in flat), float, len(flat))
    repeat = 1 - fresh / words
    mean = (size - words + 1) / words
    upper = share[1] / letters
    long_ = np.minimum(words / 20, 1.0)
    cols = [
        np.ones(len(flat)), np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(mean, 30) / 10, upper, upper > 0.6, share[3] * 5, np.minimum(share[5], 0.3) * 5,
        share[5] > 0.03, np.minimum(share[6], 0.2) * 10, share[6] > 0.02, np.minimum(share[7], 0.2) * 10, share[7] > 0.04, share[8] * 5, share[9] * 2, ends, again,
        repeat * long_, (repeat > 0.5) & (words >= 8),
    ]
    return np.stack(cols, axis=1).astype(np.float32)


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after; zero beyond the document's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts] = 0
    after[np.append(starts[1:], len(own)) - 1] = 0
    return np.concatenate([own, before, after], axis=1)


class Field:
    """Weights of emissions (of good against bad), of steps, and the logistic curve of the document."""

    def __init__(self):
        self.w, self.step = np.zeros(3 * N_OWN), np.zeros((2, 2))
        self.slope, self.base = 0.0, 0.0

    def marginals(self, emit: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of every line, expected steps [2, 2] summed over all documents)."""
        score = np.stack([np.zeros_like(emit), emit], axis=1)
        fwd = _chain(score, starts, n, self.step)
        turned = (len(emit) - starts - n)[::-1]
        back = _chain(score[::-1], turned, n[::-1], self.step.T)[::-1] - score
        both = fwd + back
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        inner = np.ones(len(emit), bool)
        inner[starts] = False
        k = np.flatnonzero(inner)
        pair = fwd[k - 1][:, :, None] + self.step + (score[k] + back[k])[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        return p, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def fit_lines(self, x: np.ndarray, starts: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.1, l2: float = 1e-4) -> None:
        theta = np.concatenate([self.w, self.step.ravel()])
        m, s, lines = np.zeros_like(theta), np.zeros_like(theta), len(x)
        inner = np.ones(lines, bool)
        inner[starts] = False
        k = np.flatnonzero(inner)
        seen = np.bincount(2 * y[k - 1] + y[k], minlength=4).reshape(2, 2)
        for i in range(1, rounds + 1):
            self.w, self.step = theta[:-4], theta[-4:].reshape(2, 2)
            p, steps = self.marginals(x @ self.w, starts, n)
            g = np.concatenate([x.T @ (p - y) / lines, ((steps - seen) / lines).ravel()]) + l2 * theta
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
            theta = theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.999**i)) + 1e-8)
        self.w, self.step = theta[:-4], theta[-4:].reshape(2, 2)

    def fit(self, own: np.ndarray, size: np.ndarray, n: np.ndarray, y: np.ndarray) -> None:
        """``own`` features and ``size`` of all lines, ``n`` lines (one at least) to a document; ``y`` 1 is good."""
        starts = np.cumsum(n) - n
        x = with_neighbours(own, starts).astype(np.float64)
        doc_good = np.repeat(y, n) > 0
        lines = doc_good.astype(np.int64)
        for rounds in (120, 60, 60):
            self.fit_lines(x, starts, n, lines, rounds)
            p, _ = self.marginals(x @ self.w, starts, n)
            worst = np.repeat(np.minimum.reduceat(p, starts), n)
            lines = (doc_good | ((p >= 0.5) & (p > worst))).astype(np.int64)
        q = np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)
        self.slope, self.base = _logistic(_spread(q), y)

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        """Quality of documents with a line each."""
        n = np.array([len(d) for d in docs])
        starts = np.cumsum(n) - n
        p, _ = self.marginals(with_neighbours(own_features(docs), starts) @ self.w, starts, n)
        size = np.fromiter((len(ln) for d in docs for ln in d), np.float64, int(n.sum()))
        return self.curve(np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts))

    def curve(self, q: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _spread(q) + self.base, -40, 40)))


def _chain(score: np.ndarray, starts: np.ndarray, n: np.ndarray, step: np.ndarray, block: int = 256) -> np.ndarray:
    """[lines, 2] log sums over all labellings up to each line, by its label, for documents of ``n`` lines from ``starts`` on.

    A long document is cut into blocks: what each block makes of either label before it is found for all blocks at a time, then
    blocks are joined in order, so a text of m lines takes about m / block + 2 block steps, and documents go side by side.
    """
    k = -(-n // block)
    doc, base = np.repeat(np.arange(len(n)), k), np.cumsum(k) - k
    place = np.arange(len(doc)) - base[doc]
    first, size = starts[doc] + place * block, np.minimum(block, n[doc] - place * block)
    before = np.zeros((len(doc), 2))
    if len(doc) > len(n):
        passed = np.zeros((len(doc), 2, 2))  # by the label before the block and that of its last line
        full = np.flatnonzero(place < k[doc] - 1)
        m = np.where((place[full] == 0)[:, None, None], score[first[full]][:, None, :], step[None] + score[first[full]][:, None, :])
        for t in range(1, block):
            m = score[first[full] + t][:, None, :] + _lse(m[:, :, :, None] + step, 2)
        passed[full] = m
        at = base[k > 1]
        before[at + 1] = passed[at, 0]
        for j in range(2, int(k.max())):
            at = base[k > j] + j
            before[at] = _lse(before[at - 1][:, :, None] + passed[at - 1], 1)
    by = np.argsort(-size, kind="stable")
    active, out = np.searchsorted(-size[by], -np.arange(1, size.max() + 1), side="right"), np.zeros_like(score)
    for t, a in enumerate(active):
        at = first[by[:a]] + t
        last = out[at - 1] if t else before[by]
        more = _lse(last[:, :, None] + step, 1)
        out[at] = score[at] + (more if t else np.where((place[by] > 0)[:, None], more, 0))
    return out


def _spread(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 0.005, 0.995)
    return np.log(q / (1 - q))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's steps with a little ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    t = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, a.T @ (p - y) + 1e-3 * t)
        t = t - np.clip(d, -2, 2)
        if np.abs(d).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def _fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The keys of (key, size), in order, that still fit when their turn comes."""
    out, total = [], 0
    for key, n in sizes:
        if total + n <= most:
            out.append(key)
            total += n
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, remainder: int = 2, max_rows: int = 8_000, max_lines: int = 200_000) -> Field:
    """A field learnt from at most ``max_rows`` labelled rows that are not held out and at most ``max_lines`` of their lines.

    Rows are taken in the order of a hash, and a row whose lines don't fit any more is passed over; the numbers of the taken lines
    (``N_OWN`` and a size each) reach the driver, never texts. Without rows of both classes (an empty table, say) the field gives the base rate.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, modulus, remainder)

    def features(it):
        for order, texts, ys in batches(it, "order", "text", "label"):
            split = [lines_of(t) for t in texts]
            own = [own_features([d]) if d else np.zeros((0, N_OWN), np.float32) for d in split]
            sizes = [np.array([len(x) for x in d], np.float32) for d in split]
            yield pa.record_batch([pa.array(order, pa.int64()), pa.array(ys, pa.int32()), pa.array(list(map(len, split)), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in sizes], pa.binary())], names=["order", "label", "n", "own", "size"])

    rows = sample.select(F.xxhash64(id_col, "text").alias("order"), F.col("text").cast("binary").alias("text"), "label")
    rows = written(rows.mapInArrow(features, "order long, label int, n long, own binary, size binary"), "line-features")
    taken = _fitting(rows.select("order", "n").orderBy("order", "n").collect(), max_lines)  # two numbers for each of max_rows rows
    got = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], "order long")), "order", "left_semi").toPandas().sort_values("order", kind="stable")
    field = Field()
    n, y = got.n.to_numpy(np.int64), got.label.to_numpy(np.float64)
    some = n > 0
    if 0 < y[some].sum() < some.sum():
        own = np.frombuffer(b"".join(map(bytes, got.own)), np.float32).reshape(-1, N_OWN)
        size = np.frombuffer(b"".join(map(bytes, got["size"])), np.float32).astype(np.float64)
        field.fit(own, size, n[some], y[some])
    else:
        rate = float(y.mean()) if len(y) else 0.5
        field.base = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    return field


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, each judged alone: rows that repeat get equal scores.

    A null text or one without words has quality 0 before the curve. Texts may have any length and any number of lines, ids any
    type, other columns any names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(it):
        field = sent.value
        none = float(field.curve(np.zeros(1))[0])
        for b in it:
            texts = b.column("text").to_pylist()
            out = np.full(len(texts), none)
            for lo, hi in pieces(texts):
                split = [lines_of(t) for t in texts[lo:hi]]
                at = [k for k, d in enumerate(split) if d]
                if at:
                    out[[lo + k for k in at]] = field.scores([split[k] for k in at])
            yield pa.record_batch([b.column("id"), pa.array(out, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")

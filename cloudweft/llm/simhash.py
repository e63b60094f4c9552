"""SimHash fingerprints, and near-duplicate components by generalised pigeonhole search.

Fingerprints of 64 bits that differ in at most ``tau`` bits are linked. The bits are grouped into ``parts`` so that
correlated bits stand together. For every fingerprint a dynamic programme shares out part thresholds t_i >= -1 with
sum tau - parts + 1, least in the estimated number of candidates plus probes; -1 skips a part. By the generalised
pigeonhole principle a fingerprint within ``tau`` differs by at most t_i in some part i, so probing the ball of radius
t_i around each part value finds every link.

Copies are one fingerprint from the start. A part value with more than ``hot`` times ``hot`` meetings of a member and a
probe is not joined pair by pair: its members and probes meet at *centres*, the values of the other bits at one flip or less. Two members share a centre
exactly if they are at most two flips apart, and at most 65 fingerprints share one, so the work stays linear.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import heavy_join, scratch, written

BITS = 64


def _lanes() -> np.ndarray:
    """For each byte value, its bits as the eight bytes of one integer, highest bit first."""
    v = np.arange(256, dtype=np.uint64)
    return sum((((v >> np.uint64(7 - k)) & np.uint64(1)) << np.uint64(8 * k)) for k in range(8))


_LANES = _lanes()


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text`` (UTF-8); 0 without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())])
    n = len(digests) // 8
    lanes = _LANES[np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # a lane holds 255 at most
    counts = sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A signed fingerprint for each text from its ``n`` hashes (0 where it has none): bits set in over half of them."""
    out, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
    if not len(some):
        return out
    parts = -(-n[some] // 255)  # a lane holds 255 at most
    starts = (np.cumsum(n) - n)[some]
    cuts = np.repeat(starts - 255 * (np.cumsum(parts) - parts), parts) + 255 * np.arange(int(parts.sum()))
    sums = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(len(sums), BITS).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[some] = np.packbits(counts * 2 > n[some][:, None], axis=1).view(">i8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every text. ASCII letters are lower-cased; words end at space and U+0009-000D.

    A null or blank text has fingerprint 0; a text of fewer words than a shingle is one shingle.
    """

    def run(it):
        for b in it:
            fps = [fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


# --- the plan: partitions of bits, tables of counts -------------------------------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    """[n, 64] of 0/1; column b is bit b, the lowest first."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy parts of near-equal size: each starts from the most correlated free pair and takes the bits most correlated with it."""
    free, out, c = set(range(BITS)), [], np.abs(np.nan_to_num(corr))
    for k in range(parts):
        want = BITS // parts + (k < BITS % parts)
        order = sorted(free)
        sub = c[np.ix_(order, order)].copy()
        np.fill_diagonal(sub, -1)
        a = int(np.argmax(sub)) // len(order)
        part = [order[a]]
        free.discard(order[a])
        while len(part) < want:
            best = max(sorted(free), key=lambda b: c[b, part].mean())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def _moments(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, ones of each bit and of each pair of bits: 64 x 64 sums from each task, added up by Spark."""

    def run(it):
        ones = np.zeros((BITS, BITS))
        n = 0
        for b in it:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)
            ones += x.T @ x
            n += len(x)
        flat = np.append(ones.ravel(), n)
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["pos", "v"])

    got = fps.select("fp").mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas().sort_values("pos").v.to_numpy()
    if not len(got):
        return 0, np.zeros(BITS), np.zeros((BITS, BITS))
    both = got[:-1].reshape(BITS, BITS)
    return int(got[-1]), np.diag(both), both


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits, moved together, the first lowest."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> b) & 1) << k
    return out


def _chunks(bits: list[int], width: int = 11) -> list[list[int]]:
    return [bits[k : k + width] for k in range(0, len(bits), width)]


def _histograms(fps: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of the values of every 11-bit chunk of every part: at most 2048 numbers each, whatever the input."""
    keys = [(p, c) for p, bits in enumerate(groups) for c in range(len(_chunks(bits)))]

    def run(it):
        sums = {k: np.zeros(2 ** len(_chunks(groups[k[0]])[k[1]]), np.int64) for k in keys}
        for b in it:
            fp = b.column("fp").to_numpy()
            for p, c in keys:
                v = _values(fp, _chunks(groups[p])[c])
                sums[p, c] += np.bincount(v, minlength=len(sums[p, c]))
        for (p, c), s in sums.items():
            v = np.flatnonzero(s)
            yield pa.record_batch([pa.array(np.full(len(v), p), pa.int32()), pa.array(np.full(len(v), c), pa.int32()), pa.array(v, pa.int32()), pa.array(s[v], pa.int64())], names=["p", "c", "v", "n"])

    got = fps.select("fp").mapInArrow(run, "p int, c int, v int, n long").groupBy("p", "c", "v").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(2 ** len(_chunks(groups[k[0]])[k[1]])) for k in keys}
    for (p, c), g in got.groupby(["p", "c"]):
        out[p, c][g.v.to_numpy()] = g.n.to_numpy()
    return out


def _masks(bits: Iterable[int], flips: int) -> list[int]:
    """Every choice of ``flips`` of the bits, as numbers with those bits set."""
    return [sum(1 << b for b in chosen) for chosen in combinations(bits, flips)]


class Plan:
    """Parts of bits, and for any fingerprint the thresholds of least estimated cost."""

    def __init__(self, total: int, groups: list[list[int]], hist: dict, tau: int, probe_cost: float = 1.0):
        self.total, self.groups, self.tau, self.probe_cost = total, groups, tau, probe_cost
        self.near = {}  # (part, chunk) -> shares of fingerprints at distance 0, 1, ..., tau from each value
        for k, h in hist.items():
            v, width = np.arange(len(h)), len(h).bit_length() - 1
            self.near[k] = np.stack([sum(h[v ^ mask] for mask in _masks(range(width), r)) + np.zeros(len(h)) for r in range(tau + 1)]) / max(total, 1)

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """[parts, tau + 2, n]: estimated candidates plus probes of every part at thresholds -1, 0, ..., tau."""
        out = np.zeros((len(self.groups), self.tau + 2, len(fps)))
        for p, bits in enumerate(self.groups):
            share = np.zeros((self.tau + 1, len(fps)))  # of fingerprints at each distance in this part, chunks taken as independent
            share[0] = 1
            for c, chunk in enumerate(_chunks(bits)):
                at = self.near[p, c][:, _values(fps, chunk)]
                share = np.stack([sum(share[k] * at[r - k] for k in range(r + 1)) for r in range(self.tau + 1)])
            balls = np.cumsum([comb(len(bits), r) for r in range(self.tau + 1)])
            out[p, 1:] = self.total * np.cumsum(share, axis=0) + self.probe_cost * balls[:, None]
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """[n, parts] of -1, 0, ..., ``tau``: the allocation of least cost whose sum is tau - parts + 1."""
        m, n, want = len(self.groups), len(fps), self.tau + 1
        best = np.full((n, want + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for costs in self.costs(fps):
            after, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for step, cost in enumerate(costs):
                for s in range(want + 1 - step):
                    total = best[:, s] + cost
                    less = total < after[:, s + step]
                    after[less, s + step] = total[less]
                    pick[less, s + step] = step
            best = after
            picks.append(pick)
        out, s = np.zeros((n, m), np.int8), np.full(n, want)
        for p in range(m - 1, -1, -1):
            step = picks[p][np.arange(n), s]
            out[:, p] = step - 1
            s = s - step
        return out


def make_plan(fps: DataFrame, tau: int = 2, parts: int = 3) -> Plan:
    n, ones, both = _moments(fps)
    mean = ones / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    groups = group_bits(cov / np.outer(sd, sd), parts)
    return Plan(n, groups, _histograms(fps, groups), tau)


# --- links ------------------------------------------------------------------------------------------------------


def _entries(fps: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, flips, fp): flips -1 is the index entry, 0, 1, ... are probes with so many flips."""
    groups = plan.groups
    sent = fps.sparkSession.sparkContext.broadcast(plan)
    out = pa.schema([("part", pa.int32()), ("value", pa.int64()), ("flips", pa.int32()), ("fp", pa.int64())])

    def run(it):
        plan = sent.value
        for b in it:
            whole = b.column("fp").to_numpy()
            for k in range(0, len(whole), 5_000):  # up to some 230 probes each
                fp = whole[k : k + 5_000]
                t = plan.thresholds(fp)
                cols = []
                for p, bits in enumerate(groups):
                    v = _values(fp, bits)
                    cols.append((p, v, -1, fp))
                    for flips in range(plan.tau + 1):
                        on = t[:, p] >= flips
                        cols += [(p, v[on] ^ mask, flips, fp[on]) for mask in _masks(range(len(bits)), flips)] if on.any() else []
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([np.full(len(c[1]), c[0], np.int32) for c in cols])),
                        pa.array(np.concatenate([c[1] for c in cols])),
                        pa.array(np.concatenate([np.full(len(c[1]), c[2], np.int32) for c in cols])),
                        pa.array(np.concatenate([c[3] for c in cols])),
                    ],
                    schema=out,
                )

    return fps.select("fp").mapInArrow(run, "part int, value long, flips int, fp long")


def links(fps: DataFrame, tau: int = 2, parts: int = 3, hot: int = 128) -> DataFrame:
    """(a, b): links between different fingerprints of ``fps`` (distinct), a < b.

    Every pair within ``tau`` bits is a link or joined by a chain of links (fingerprints that meet at a centre link to the
    smallest of them). ``tau`` is 0, 1 or 2. An empty table has no links.
    """
    if not 0 <= tau <= 2 or parts <= tau:
        raise ValueError("tau must be 0, 1 or 2, and parts more than tau")
    plan = make_plan(fps, tau, parts)
    entries = written(_entries(fps, plan), "simhash-entries")
    key = ["part", "value"]
    sizes = entries.groupBy(*key).agg(F.sum((F.col("flips") < 0).cast("int")).alias("members"), F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    # buckets whose entries are all of one fingerprint hold no link; two entries can be a skipping member and another's probe
    sizes = written(sizes.filter((F.col("members") > 0) & (F.col("least") != F.col("most"))), "simhash-buckets")
    few = F.col("members") * (F.col("n") - F.col("members")) <= hot * hot
    cold = entries.join(sizes.filter(few).select(*key), key, "left_semi")
    index = cold.filter(F.col("flips") < 0).select(*key, F.col("fp").alias("b"))
    probes = cold.filter(F.col("flips") >= 0).select(*key, F.col("fp").alias("a"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = index.join(probes, key).filter((F.col("a") < F.col("b")) & (far <= tau)).select("a", "b")

    rest = F.lit(None).cast("array<long>")
    for p, bits in enumerate(plan.groups):
        others = [b for b in range(BITS) if b not in bits]
        flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {b})") for b in others])
        rest = F.when(F.col("part") == p, flips).otherwise(rest)
    mask = F.lit(None).cast("long")
    for p, bits in enumerate(plan.groups):
        others = sum(1 << b for b in range(BITS) if b not in bits)
        mask = F.when(F.col("part") == p, F.lit(others - (others >> 63 << 64)).cast("long")).otherwise(mask)
    crowd = entries.join(sizes.filter(~few).select(*key), key, "left_semi").withColumn("own", F.col("fp").bitwiseAND(mask))
    own = F.array(F.lit(0).cast("long"))
    at = F.when(F.col("flips") == 1, own).otherwise(rest) if tau == 2 else F.when(F.col("flips") < 0, rest if tau else own).otherwise(own)
    met = crowd.filter(F.col("flips").isin(-1, 1) if tau == 2 else F.lit(True)).withColumn("flip", F.explode(at))
    met = met.select(*key, F.col("own").bitwiseXOR(F.col("flip")).alias("centre"), F.col("fp").alias("b"), ((F.col("flips") < 0) & (F.col("flip") == 0)).alias("at"))
    # within two flips of each other all at a centre are linked; else only what stands at the centre is linked to the rest
    anchor = F.col("b") if tau == 2 else F.when(F.col("at"), F.col("b"))
    met = met.withColumn("a", F.min(anchor).over(Window.partitionBy(*key, "centre"))).filter((F.col("a") != F.col("b")) & (far <= tau))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a probe with two flips can only be linked to the member that has its other bits: one fingerprint
    standing = crowd.filter(F.col("flips") < 0).select(*key, "own", F.col("fp").alias("b"))
    twice = crowd.filter(F.col("flips") == 2).select(*key, "own", F.col("fp").alias("a")).join(standing, [*key, "own"])
    twice = twice.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(met).unionByName(twice).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b), by large-star and small-star rounds.

    Minima are aggregates and joins, never groups in memory, and the root of a giant component is joined by broadcast; every
    round is a written table. ``limit`` only guards against an endless loop: rounds grow with the logarithm of a component.
    """

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = mark(edges)
    for _ in range(limit):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = heavy_join(both.filter("v > u"), least, "u", "n", 2 * before[0]).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = written(large, "large-star")  # read twice below
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        # after the large star a node has few smaller neighbours
        small = large.join(least, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))))
        edges = written(small.filter("a < b").distinct(), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, parts: int = 3, hot: int = 128, shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): every document with its fingerprint and the smallest id of its component.

    Copies and all texts without words share a fingerprint. A null id keeps its row and is never a component's name,
    unless the component has no other. Repeated rows stay. Ids may have any type that has an order. Other columns of ``docs``
    are not read. An empty table gives no rows; texts are whole, of any length.
    """
    with scratch(docs.sparkSession):
        prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints", keep=True)
        nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
        roots = components(links(nodes, tau, parts, hot)).withColumnRenamed("node", "fp")
        linked = nodes.join(roots, "fp")
        lead = linked.groupBy("root").agg(F.min("first").alias("component_id"))
        # a fingerprint of one document that is linked to none names its component itself and needs no join
        named = linked.join(lead, "root").select("fp", "component_id", "n")
        named = written(named.unionByName(nodes.filter("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "n")), "named-fingerprints", keep=True)
        total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return heavy_join(prints, named, "fp", "n", total).select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))

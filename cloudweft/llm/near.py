"""One document of each group of near-duplicates: texts linked, by a chain if need be, at a Jaccard similarity of ``least``
or more of their word shingles.

SimHash fingerprints of the same shingles, searched by generalised pigeonhole, link most copies in linear work however
crowded they are, but edited copies at 0.8 are five to ten bits apart, beyond any radius that such a search can probe. The
rest comes from prefix filtering. All shingles get one order: common ones (by a count sketch over all texts) last, then by
hash. Two texts of ``least`` share a shingle among the first p = n - ceil(least n) + 1 of each (n: a text's distinct
shingles), and another one among the first p + 1.

What is linked already is never compared again: texts are compared with the first text of their shingles where they share
many, links are joined to components, and only shingles that still hold several components are expanded, into pairs of
different components. How many shingles of the prefixes two texts share bounds their similarity, so only likely pairs have
their texts read. In a crowd, shingles with more than ``hot`` texts, texts meet in blocks: all of two blocks are compared in one
task, which gives out no more links than texts. The first text of each component goes first. Then all texts of crowds that still
hold several components meet, in blocks that a large component has to itself, so that it is never compared with itself. So the
groups are exactly the components of all similar pairs, and ``hot`` changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._common import batches, heavy_join, pieces, scratch, small, written

CELLS, CHUNK = 1 << 22, 1 << 14
BLOCK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word; ASCII letters are lower-cased, words end at space and U+0009-000D."""
    raw = np.frombuffer(text.lower(), np.uint8)
    lo, hashes, firsts = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    inverse = pow(_BASE, -1, 1 << 64)
    while lo < len(raw):
        hi = min(lo + BLOCK, len(raw))
        while hi < len(raw) and not _BLANK[raw[hi]]:
            ahead = np.flatnonzero(_BLANK[raw[hi : hi + 4096]])
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + 4096, len(raw))
        b = raw[lo:hi]
        inside = np.concatenate([[False], ~_BLANK[b], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _power(_BASE, len(b)), dtype=np.uint64)])
        hashes.append(_mix((sums[stop] - sums[start]) * _power(inverse, len(b) + 1)[start] + (stop - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        firsts.append(start + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(firsts)


class Hashed:
    """Texts as hashes: windows of ``size`` words (a shorter text is one window), how many each has, and 128 bits of its words."""

    def __init__(self, texts: list[bytes | None], size: int):
        texts = [t or b"" for t in texts]
        w, first = word_hashes(b"\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], np.searchsorted(first, ends)])
        self.words, at = np.diff(cuts), cuts[:-1]
        self.n = np.where(self.words == 0, 0, np.maximum(self.words - size + 1, 1))
        place = np.repeat(at - np.cumsum(self.n) + self.n, self.n) + np.arange(int(self.n.sum()))
        padded = np.concatenate([w, np.zeros(size, np.uint64)])
        inside = np.repeat(at + self.words, self.n)
        total = np.zeros(len(place), np.uint64)
        for k, c in enumerate(_power(0xC2B2AE3D27D4EB4F, size + 1)[1:]):
            total += np.where(place + k < inside, padded[place + k], _U(0x165667B19E3779F9)) * c
        self.windows = _mix(total)
        some = np.flatnonzero(self.words)
        self.copy = np.zeros((2, len(texts)), np.uint64)
        if len(some):
            j = np.arange(len(w)) - np.repeat(at[some], self.words[some])
            for row, (h, base) in enumerate(((w, 0x9FB21C651E98DF25), (_mix(w ^ _U(0xA0761D6478BD642F)), 0xD1B54A32D192ED03))):
                self.copy[row, some] = _mix(np.add.reduceat(h * _power(base, int(self.words.max()))[j], at[some])) | _U(row)

    def of(self) -> list[np.ndarray]:
        """The distinct windows of each text, sorted."""
        return [np.unique(x) for x in np.split(self.windows, np.cumsum(self.n)[:-1])]


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    return Hashed([text], size).of()[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def prefix_size(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def ordered(own: np.ndarray, common: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` shingles in the order that all texts share."""
    c = common[(own % _U(CELLS)).astype(np.int64)]
    return own[np.lexsort((own, c))[:keep]] if c.any() else own[:keep]


def _sketch(texts: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """Logarithms of how often hashed shingles occur in all texts, and the mean count of a cell.

    Cells within eight standard deviations (and 32) of the mean are 0, so that only common shingles move back. Tasks send ``CELLS`` counts in compressed chunks, which Spark adds up by chunk.
    """

    def count(it):
        import zstandard

        pack, sums = zstandard.ZstdCompressor(level=1).compress, np.zeros(CELLS, np.uint32)
        for (column,) in batches(it, "text"):
            for a, b in pieces(column):
                np.add.at(sums, (Hashed(column[a:b], size).windows % _U(CELLS)).astype(np.int64), np.uint32(1))
        at = [k for k in range(CELLS // CHUNK) if sums[k * CHUNK : (k + 1) * CHUNK].any()]
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array([pack(sums[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in at], pa.binary())], names=["chunk", "counts"])

    def add(it):
        import zstandard

        pack, unpack, sums = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress, {}
        for chunks, counts in batches(it, "chunk", "counts"):
            for k, c in zip(chunks, counts):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpack(c), np.uint32).astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([pack(x.tobytes()) for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    n = np.zeros(CELLS, np.int64)
    for k, c in texts.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():
        n[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(unpack(c), np.int64)
    mean, out = float(n.mean()), np.zeros(CELLS, np.uint8)
    at = np.flatnonzero(n >= mean + 8 * np.sqrt(mean) + 32)
    out[at] = np.log2(n[at]) * 4
    return out, mean


def _rows(texts: DataFrame, common: np.ndarray, size: int, least: float) -> DataFrame:
    """(row, id, mark, hi, lo, fp, n, p, tokens) of every text: its number, its words' 128 bits, SimHash, and first p + 1 shingles."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(it):
        common = sent.value
        for b in it:
            column, tokens, n, p, fps, copies = b.column("text").to_pylist(), [np.zeros(0, np.uint64)], [], [], [], []
            for lo, hi in pieces(column):
                h = Hashed(column[lo:hi], size)
                own = h.of()
                n += [len(x) for x in own]
                p += [prefix_size(len(x), least) for x in own]
                tokens += [ordered(x, common, k + 1) for x, k in zip(own, p[lo:])]
                fps.append(simhash.majority(h.windows, h.n))
                copies.append(h.copy)
            ends = np.cumsum([0, *map(len, tokens[1:])])
            copy = np.concatenate(copies, axis=1).view(np.int64) if copies else np.zeros((2, 0), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens).view(np.int64)))
            cols = [b.column("id"), b.column("mark"), pa.array(copy[0]), pa.array(copy[1]), pa.array(np.concatenate([np.zeros(0, np.int64), *fps])), pa.array(n, pa.int32()), pa.array(p, pa.int32()), lists]
            yield pa.record_batch(cols, names=["id", "mark", "hi", "lo", "fp", "n", "p", "tokens"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, mark long, hi long, lo long, fp long, n int, p int, tokens array<long>").withColumn("row", F.monotonically_increasing_id())


def _sets(texts: DataFrame, leads: DataFrame, repeats: bool, asked: DataFrame, size: int) -> DataFrame:
    """(node, set): the shingles of the texts of the ``asked`` nodes; texts stay where they are while few are asked for.

    ``repeats`` says whether any row repeats both id and text, so that sets must be made single.
    """
    keys = written(leads.join(asked, "node", "left_semi").select("id", "mark", "node"), "near-asked")

    def run(it):
        for nodes, column in batches(it, "node", "text"):
            for a, b in pieces(column):
                yield pa.record_batch([pa.array(nodes[a:b], pa.int64()), pa.array([x.tobytes() for x in Hashed(column[a:b], size).of()], pa.binary())], names=["node", "set"])

    found = texts.join(small(keys), ["id", "mark"]).select("node", "text").mapInArrow(run, "node long, set binary")
    return found.groupBy("node").agg(F.min("set").alias("set")) if repeats else found


def _verified(pairs: DataFrame, texts: DataFrame, leads: DataFrame, repeats: bool, size: int, least: float, spread: int = 512) -> DataFrame:
    """The rows (a, b) of ``pairs`` that are similar.

    Pairs are sorted by ``a``, whose shingles come first and once. A text ``a`` with many pairs is dealt out in lots of about
    ``spread`` of them.
    """
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets(texts, leads, repeats, asked, size), "near-sets")
    busy = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / spread).cast("int").alias("lots")), "near-busy")
    told = heavy_join(pairs, busy.withColumn("n", F.col("lots") * spread), "a", "n", pairs.count()).withColumn("lot", F.pmod(F.xxhash64("b"), "lots").cast("int"))
    told = written(told.select("a", "lot", F.col("b").alias("node")), "near-told")
    second = sets.join(small(told), "node").select("a", "lot", F.col("node").alias("b"), "set")
    first = sets.withColumnRenamed("node", "a").join(small(busy), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("b"), "set")
    both = first.unionByName(second).repartition("a", "lot").sortWithinPartitions("a", "lot", "b")

    def run(it):
        own = np.zeros(0, np.uint64)
        for a, b, sets in batches(it, "a", "b", "set"):
            keep = []
            for k, x in enumerate(sets):
                if b[k] is None:
                    own = np.frombuffer(x, np.uint64)
                elif similarity(own, np.frombuffer(x, np.uint64)) >= least - 1e-12:
                    keep.append(k)
            yield pa.record_batch([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sized(least: float):
    """Whether sizes allow the similarity."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9


def _shared(least: float):
    """How many shingles of their prefixes two similar texts share at least: the rest of the longer text can't hold more than its size.

    They have least (na + nb) / (1 + least) in common. The prefix that ends first holds all of them up to its end, and what is
    left of its text, ceil(least n) - 1, bounds those after it.
    """
    return (F.col("na") + F.col("nb")) * (least / (1 + least)) - (F.ceil(F.greatest("na", "nb") * least - 1e-9) - 1) - 1e-9


def _entries(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(token, node, n, k): the prefixes of the distinct texts, of shingles that ``k`` > 1 of them hold."""
    first = rows.select("row", "n", "p", "tokens").join(small(copies.select("row")), "row", "left_anti")
    every = first.select(F.col("row").alias("node"), "n", F.explode(F.slice("tokens", 1, "p")).alias("token"))  # read twice, never written
    shared = every.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    return every.join(shared, "token")


def _open(at: DataFrame) -> DataFrame:
    """(token): those that several components hold."""
    return at.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")


def _expanded(entries: DataFrame, comps: DataFrame, least: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of different components that may be similar, from shingles that still hold several; (token, node, root) of crowds."""
    at = entries.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = written(at.join(_open(at), "token", "left_semi"), "near-open")
    # shingles of crowds aren't counted here, so they are taken as shared
    crowd = at.filter(F.col("k") > hot).groupBy("node").agg(F.count("*").alias("h"))
    cold = at.filter(F.col("k") <= hot).join(crowd, "node", "left").fillna(0, ["h"])
    met = _one(cold, "token", F.col("h").alias("ha")).join(_two(cold, "token", F.col("h").alias("hb")), "token").filter(_apart(least))
    # two texts' numbers travel in one long
    pairs = met.groupBy("a", "b", *[(F.shiftleft(F.col(f"{x}a").cast("long"), 32) + F.col(f"{x}b")).alias(x) for x in "nh"]).count().withColumnRenamed("count", "c")
    pairs = pairs.withColumns({f"{x}{side}": (F.shiftright(x, 32) if side == "a" else F.col(x).bitwiseAND(0xFFFFFFFF)).cast("int") for x in "nh" for side in "ab"})
    pairs = pairs.filter(F.col("c") + F.least("ha", "hb") >= _shared(least)).select("a", "b")
    return written(pairs, "near-likely"), written(at.filter(F.col("k") > hot).select("token", "node", "root"), "near-crowd")


def _one(e: DataFrame, *more) -> DataFrame:
    return e.select(*more, F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))


def _two(e: DataFrame, *more) -> DataFrame:
    return e.select(*more, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))


def _apart(least: float):
    return (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sized(least)


def joined_in(sets: list[np.ndarray], sides: np.ndarray, comps: np.ndarray, least: float, width: int = 4096) -> list[tuple[int, int]]:
    """Places of similar sets, one of each side (or any two if there is one side), as a forest that joins components ``comps``."""
    n = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    found, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    owner, col, both = owner[keep], column[at[keep]], np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(col, kind="stable")
    owner, col = owner[by], col[by]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], col[a:b] - lo] = 1
        both += part @ part.T
    like = both >= least * (n[:, None] + n[None, :] - both) - 1e-6
    like &= np.triu(np.ones_like(like), 1)
    if len(set(sides.tolist())) > 1:
        like &= sides[:, None] != sides[None, :]
    like &= comps[:, None] != comps[None, :]
    root, out = np.unique(comps, return_index=True)[1][np.unique(comps, return_inverse=True)[1]].tolist(), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in np.argwhere(like).tolist():
        a, b = find(x), find(y)
        if a != b:
            root[b] = a
            out.append((x, y))
    return out


def _layout(crowds: DataFrame, block: int) -> DataFrame:
    """(key, n, first, w, blocks, alone): of each component (key: crowd, root) its ``n`` texts, its ``w`` blocks from number ``first`` on, and all ``blocks`` of its crowd.

    Components of ``block`` texts and more have blocks ``alone``; the others of a crowd share the first blocks.
    """
    groups = crowds.groupBy("crowd", "root").agg(F.count("*").alias("n"))
    groups = written(groups.withColumns({"alone": F.col("n") >= block, "w": F.ceil(F.col("n") / block).cast("int")}), "near-groups")
    total = groups.groupBy("crowd").agg(F.ceil(F.sum(F.when(F.col("alone"), 0).otherwise(F.col("n"))) / block).cast("int").alias("shared"), F.sum(F.when(F.col("alone"), F.col("w")).otherwise(0)).cast("int").alias("own"))
    upto = Window.partitionBy("crowd").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)  # a row for ``block`` texts or more
    placed = groups.filter("alone").withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0)).cast("int"))
    placed = placed.unionByName(groups.filter("not alone").withColumn("before", F.lit(0))).join(small(written(total, "near-blocks")), "crowd")
    first, w = F.when(F.col("alone"), F.col("shared") + F.col("before")).otherwise(0), F.when(F.col("alone"), F.col("w")).otherwise(F.col("shared"))
    return placed.select(F.struct("crowd", "root").alias("key"), "n", first.alias("first"), w.alias("w"), (F.col("shared") + F.col("own")).alias("blocks"), "alone")


def _crowds(at: DataFrame, texts: DataFrame, leads: DataFrame, repeats: bool, size: int, least: float, block: int = 256) -> DataFrame:
    """(a, b): verified links that join what is similar among different components (root) of the texts of ``at`` (token, node, root).

    A crowd is what common shingles connect. Blocks of a large component meet those of others only.
    """
    heads = at.groupBy("token").agg(F.min("node").alias("a"))
    crowds = simhash.components(at.select("token", F.col("node").alias("b")).join(heads, "token").select("a", "b")).withColumnRenamed("root", "crowd")
    crowds = written(crowds.join(at.select("node", "root").distinct(), "node"), "near-crowds")
    sets = written(_sets(texts, leads, repeats, crowds.select("node"), size).join(small(crowds), "node"), "near-crowd-sets")
    rows = heavy_join(sets.withColumn("key", F.struct("crowd", "root")), written(_layout(crowds, block), "near-layout"), "key", "n", crowds.count())
    own = (F.col("first") + F.pmod(F.xxhash64("node"), "w")).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: ~F.col("alone") | (k < F.col("first")) | (k >= F.col("first") + F.col("w")))
    rows = rows.select("crowd", "root", "node", "set", own.alias("own"), F.explode(met).alias("other"))
    rows = rows.select("crowd", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "root", "node", "set").repartition("crowd", "x", "y").sortWithinPartitions("crowd", "x", "y")

    def run(it):
        key, held = None, []

        def out():
            own, comps = (np.array([h[k] for h in held]) for k in (1, 2))
            links = joined_in([h[3] for h in held], own, comps, least) if len(set(comps.tolist())) > 1 else []
            return pa.record_batch([pa.array([held[k][0] for k, _ in links], pa.int64()), pa.array([held[k][0] for _, k in links], pa.int64())], names=["a", "b"])

        for crowd, x, y, own, root, nodes, sets in batches(it, "crowd", "x", "y", "own", "root", "node", "set"):
            for k in range(len(crowd)):
                if key != (crowd[k], x[k], y[k]):
                    yield out()
                    key, held = (crowd[k], x[k], y[k]), []
                held.append((nodes[k], own[k], root[k], np.frombuffer(sets[k], np.uint64)))
        yield out()

    return rows.mapInArrow(run, "a long, b long")


def links(rows: DataFrame, leads: DataFrame, copies: DataFrame, texts: DataFrame, size: int, least: float, hot: int) -> DataFrame:
    """(a, b): verified links, whose components are those of all pairs of similar texts."""
    repeats = not copies.join(leads.select("id", "mark"), ["id", "mark"], "left_semi").isEmpty()
    prints = written(leads.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    same = leads.join(prints, "fp").filter(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(prints.select("fp"))
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    entries = written(_entries(rows, copies), "near-entries")
    # the text whose shingles are the most widely held comes first: in a crowd of edited copies, what they were made from
    known = entries.join(entries.groupBy("node").agg((F.sum("k") / F.first("n")).alias("held")), "node")
    heads = known.groupBy("token").agg(F.max(F.struct("held", "node", "n")).alias("head")).select("token", F.col("head.node").alias("a"), F.col("head.n").alias("na"))
    star = entries.select("token", F.col("node").alias("b"), F.col("n").alias("nb")).join(heads, "token").filter((F.col("a") != F.col("b")) & _sized(least))
    star = star.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")).filter(F.col("c") >= _shared(least)).select("a", "b")
    tried = written(same.unionByName(near).unionByName(star).distinct(), "near-pairs")
    found = written(_verified(tried, texts, leads, repeats, size, least), "near-links")
    likely, crowd = _expanded(entries, simhash.components(found), least, hot)
    likely = written(likely.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    if not likely.isEmpty():
        found = found.unionByName(written(_verified(likely, texts, leads, repeats, size, least), "near-links"))
    firsts = crowd.filter("node = root")
    if not firsts.isEmpty():
        found = found.unionByName(written(_crowds(firsts, texts, leads, repeats, size, least), "near-links"))
    if crowd.isEmpty():
        return found
    rest = written(crowd.drop("root").join(simhash.components(found), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rest")
    rest = written(rest.join(_open(rest), "token", "left_semi"), "near-rest")
    return found if rest.isEmpty() else found.unionByName(written(_crowds(rest, texts, leads, repeats, size, least), "near-links"))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, hot: int) -> DataFrame:
    """(__id, __mark, __again): rows that go, or that stay once although they repeat (__again)."""
    named = docs.filter(F.col(id_col).isNotNull())
    texts = named.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    common, mean = _sketch(texts, size)
    hot += int(12 * np.sqrt(mean))  # what the sketch can't tell from chance isn't a crowd yet
    rows = written(_rows(texts, common, size, least), "near-rows")
    leads = rows.groupBy("hi", "lo").agg(F.min(F.struct("id", "mark", "row", "fp")).alias("x"))
    leads = written(leads.select(F.col("x.row").alias("node"), "x.id", "x.mark", "x.fp"), "near-leads")
    copies = written(rows.select("row", "id", "mark").join(leads.select(F.col("node").alias("row")), "row", "left_anti"), "near-copies")
    joined = simhash.components(links(rows, leads, copies, texts, size, least, hot)).join(leads.select("node", "id", "mark"), "node")
    first = joined.groupBy("root").agg(F.min(F.struct("id", "mark", "node")).alias("x")).select("root", F.col("x.node").alias("stays"))
    lost = written(joined.join(first, "root").filter("node <> stays").select("node", "id", "mark"), "near-lost")
    stays = leads.join(lost.select("node"), "node", "left_anti").select("id", "mark")
    copies = copies.select("id", "mark").distinct()
    gone = copies.unionByName(lost.select("id", "mark")).join(stays, ["id", "mark"], "left_anti").select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.lit(False).alias("__again"))
    again = copies.join(stays, ["id", "mark"], "left_semi").select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.lit(True).alias("__again"))
    return written(gone.unionByName(again), "near-verdicts", keep=True)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, hot: int = 128) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without near-duplicates: the smallest id of linked texts stays.

    Words are lower-cased in ASCII; a text of fewer than ``size`` words is one shingle. Texts of equal words, and all texts without
    words (null, empty, blank), are copies. Rows that repeat both id and text are one document and leave one row; rows that share
    an id but not the text are different documents. Rows without an id stay. Texts are whole, of any length; an empty table
    stays empty; other columns may have any names.
    """
    with scratch(docs.sparkSession):
        found = _verdicts(docs, id_col, text_col, size, least, hot)
    here = lambda v: (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark"))
    kept = docs.join(small(found), here(found), "left_anti")
    if found.filter("__again").isEmpty():
        return kept
    twice = docs.join(small(written(found.filter("__again"), "near-repeats")), here(found), "left_semi").withColumn("__mark", F.xxhash64(text_col)).dropDuplicates([id_col, "__mark"]).drop("__mark")
    return kept.unionByName(twice)

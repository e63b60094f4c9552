"""Best-fit packing of documents into sequences of several permitted lengths.

The plan depends only on how many items have each length: at most ``max(sizes)`` numbers, however large the corpus. On
these counts the driver runs best-fit decreasing for all items of a length at a time: each goes to the open bin with the
least room that takes it, else a bin of the size with the least cost for what it is likely to hold is opened. That policy and
those that prefer one size are all planned, bins are downsized to the smallest size that holds their contents, and the
cheapest plan is kept. A plan gives runs of item ranks to runs of bins; Spark ranks the items of a length (in salted
groups, so a length that a third of the items share is spread) and looks each up. ``pack`` places items of any length
column; ``token_pieces``, ``place`` and ``sequences`` make packed sequences of token ids.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written
from .huffman import Encoder

SIZES = (512, 1024, 2048, 4096)


def default_cost(size: int) -> float:
    """A sequence's cost: a fixed part, its tokens, and attention that grows with the square."""
    return 128 + size + size * size / 16_384


@dataclass
class Plan:
    """Runs of items: ranks from ``item`` on of ``length``, ``per`` to a bin from ``bin`` on, the first at ``offset``. Bins: runs of ``count`` from ``start``."""

    runs: np.ndarray  # [k, 6] length, item, n, per, bin, offset; sorted by (length, item)
    bins: np.ndarray  # [b, 4] start, count, contents, size; sorted by start
    cost: float


def _plan(counts: dict[int, int], sizes: tuple[int, ...], cost, prefer: int | None) -> Plan:
    left = sum(k * n for k, n in counts.items())
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> heap of (start, count, size)
    rooms: list[int] = []
    runs, total = [], 0

    def put(room, start, count, size):
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        heapq.heappush(groups[room], (start, count, size))

    for length in sorted((k for k in counts if k > 0), reverse=True):
        n, item = counts[length], 0
        left -= length * n
        while n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                start, count, size = heapq.heappop(groups[room])
                if not groups[room]:
                    del groups[room], rooms[k]
                per = min(room // length, n)
                full = min(count, n // per)
                runs.append((length, item, full * per, per, start, size - room))
                put(room - per * length, start, full, size)
                if full < count:
                    put(room, start + full, count - full, size)
                item, n = item + full * per, n - full * per
                continue
            fit = [s for s in sizes if s >= length]
            if prefer is not None:
                size = next((s for s in fit if s >= prefer), fit[-1])
            else:
                size = min(fit, key=lambda s: (cost(s) / min(s, length * min(n, s // length) + left), s))
            per = min(size // length, n)
            full = n // per
            runs.append((length, item, full * per, per, total, 0))
            put(size - per * length, total, full, size)
            total, item, n = total + full, item + full * per, n - full * per
    bins = sorted((start, count, size - room) for room, heap in groups.items() for start, count, size in heap)
    bins = [(a, c, held, next(s for s in sizes if s >= held)) for a, c, held in bins]
    return Plan(np.array(sorted(runs), np.int64).reshape(-1, 6), np.array(bins, np.int64).reshape(-1, 4), sum(c * cost(s) for _, c, _, s in bins))


def make_plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, cost=default_cost) -> Plan:
    """The cheapest of the plans by least cost and by preference of each size; ties go to the first."""
    sizes = tuple(sorted(sizes))
    return min((_plan(counts, sizes, cost, p) for p in (None, *sizes)), key=lambda p: p.cost)


def word_count(text_col: str = "text") -> Column:
    """Words (runs of anything but space and U+0009-000D) of a text; a null text has none."""
    blanks = r"[\x20\x09-\x0D]+"
    return F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), blanks), lambda w: w != "")).cast("long")


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, cost=default_cost, salts: int | None = None) -> DataFrame:
    """(id, piece, start, length, bin_id, bin_offset, bin_size): every item with its place.

    A document longer than the largest size is cut into pieces of that size and a rest. Items of length 0 take no room: one row
    with null bin columns. Repeated rows are packed each. A null or negative length counts as 0. An empty table gives no rows.
    """
    largest = max(sizes)
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n"))
    rows = rows.select("id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(largest).cast("long"))).alias("piece", "start"))
    rows = rows.select("id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("length"))
    return place(rows, sizes, cost, salts)


def place(pieces: DataFrame, sizes: tuple[int, ...] = SIZES, cost=default_cost, salts: int | None = None) -> DataFrame:
    """``pieces`` (id, piece, start, length, ...) with bin_id, bin_offset and bin_size; no length exceeds the largest size."""
    spark = pieces.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int")), "items")
    # at most max(sizes) x salts rows, and of them max(sizes) for the driver
    parts = rows.filter("length > 0").groupBy("length", "salt").agg(F.count("*").alias("n"))
    parts = written(parts.select("length", "salt", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")), "length-counts")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}
    sent = spark.sparkContext.broadcast(make_plan(counts, sizes, cost))
    # both sides by (length, salt), as the ranks need it: never a broadcast, so parts may have any number of salts
    ranked = rows.join(parts.select("length", "salt", "before").hint("merge"), ["length", "salt"], "left")
    within = Window.partitionBy("length", "salt").orderBy("id", "piece")
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.row_number().over(within) - 1).alias("rank"))

    def run(it):
        plan = sent.value
        key = plan.runs[:, 0] * (1 << 48) + plan.runs[:, 1]
        for b in it:
            at, rank = b.column("length").to_numpy(), b.column("rank").to_numpy(zero_copy_only=False)
            some = at > 0
            cols = [np.zeros(len(at), np.int64) for _ in range(3)]
            if some.any():
                r = rank[some].astype(np.int64)
                found = plan.runs[np.searchsorted(key, at[some] * (1 << 48) + r, side="right") - 1]
                k = r - found[:, 1]
                bin_id = found[:, 4] + k // found[:, 3]
                cols[0][some], cols[1][some] = bin_id, found[:, 5] + (k % found[:, 3]) * at[some]
                cols[2][some] = plan.bins[np.searchsorted(plan.bins[:, 0], bin_id, side="right") - 1, 3]
            kept = b.schema.names[:-1]
            yield pa.record_batch([*(b.column(c) for c in kept), *(pa.array(c, pa.int64(), mask=~some) for c in cols)], names=[*kept, "bin_id", "bin_offset", "bin_size"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}bin_id long, bin_offset long, bin_size long")


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(id, piece, start, length, ids): the token ids of whole texts (null: empty) with ``end_id`` after each, cut at the largest size.

    ``ids`` holds them as compressed 32-bit integers, or 16-bit ones for vocabularies up to 65,536.
    """
    largest = max(sizes)

    def run(it):
        import zstandard

        squeeze, encoder = zstandard.ZstdCompressor(level=1).compress, Encoder.of(tokenizer_path)
        width = array(encoder.kind).itemsize
        tail = array(encoder.kind, [] if end_id is None else [end_id]).tobytes()
        for b in it:
            owner, piece, n, out = [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                ids = encoder.encode(t or "") + tail
                for j, lo in enumerate(range(0, max(len(ids), 1), largest * width)):
                    part = ids[lo : lo + largest * width]
                    owner.append(k)
                    piece.append(j)
                    n.append(len(part) // width)
                    out.append(squeeze(part))
            start = np.array(piece, np.int64) * largest
            yield pa.record_batch([b.column("id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def sequences(placed: DataFrame) -> DataFrame:
    """(bin_id, bin_size, n_tokens, doc_ids, pieces, lengths, ids): one row for each bin of ``placed``, its contents in order.

    ``ids`` are the token ids of its pieces one after the other; a sequence is bin_size long, and what is left is padding.
    """
    kind = placed.schema["id"].dataType.simpleString()

    def run(it):
        import zstandard

        unpack, held = zstandard.ZstdDecompressor().decompress, []

        def out(rows):
            names = ("bin_id", "bin_size", "n_tokens", "doc_ids", "pieces", "lengths", "ids")
            raw = b"".join([unpack(r[5]) for r in rows])
            flat = np.frombuffer(raw, f"<u{len(raw) // sum(r[4] for r in rows)}").astype(np.int32)
            cuts = [0, *(k for k in range(1, len(rows)) if rows[k][0] != rows[k - 1][0]), len(rows)]
            bins = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
            n = [sum(r[4] for r in g) for g in bins]
            ends = pa.array(np.cumsum([0, *n]), pa.int32())
            lists = [pa.array([[r[k] for r in g] for g in bins], pa.list_(t)) for k, t in ((2, id_type), (3, pa.int32()), (4, pa.int64()))]
            return pa.record_batch([pa.array([g[0][0] for g in bins], pa.int64()), pa.array([g[0][1] for g in bins], pa.int64()), pa.array(n, pa.int64()), *lists, pa.ListArray.from_arrays(ends, pa.array(flat))], names=list(names))

        for b in it:
            id_type = b.schema.field("id").type
            held += zip(*(b.column(c).to_pylist() for c in ("bin_id", "bin_size", "id", "piece", "length", "ids")))
            last = next((k for k in range(len(held) - 1, 0, -1) if held[k][0] != held[k - 1][0]), 0)  # the last bin may go on
            for lo, hi in _spans(held[:last]):
                yield out(held[lo:hi])
            held = held[last:]
        if held:
            yield out(held)

    dealt = placed.filter("length > 0").select("bin_id", "bin_size", "bin_offset", "id", "piece", "length", "ids").repartition("bin_id").sortWithinPartitions("bin_id", "bin_offset")
    return dealt.mapInArrow(run, f"bin_id long, bin_size long, n_tokens long, doc_ids array<{kind}>, pieces array<int>, lengths array<long>, ids array<int>")


def _spans(rows: list, limit: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of whole bins with about ``limit`` tokens each."""
    out, lo, size = [], 0, 0
    for k, r in enumerate(rows):
        if size >= limit and r[0] != rows[k - 1][0]:
            out.append((lo, k))
            lo, size = k, 0
        size += r[4]
    return [*out, (lo, len(rows))] if rows else out

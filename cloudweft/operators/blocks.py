"""Rooms cut into blocks. A point finds its blocks by arithmetic or by cells, never by a scan of the room per block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..session import written
from .metrics import label_weights
from .order import ranked, ranked_inside

XYZ, RGB = ("x", "y", "z"), ("r", "g", "b")


def _drawn(rows: DataFrame, keys: Sequence[str], numbers: Column, at: Column, own: Column, name: str) -> DataFrame:
    """``rows``, numbered by ``__k`` within ``keys``, with copies: each row brings an array ``numbers`` of its group, and a number ``__n`` asks for a
    copy of row ``at``. ``name`` is the number of a copy, and ``__k`` of a row itself, which stays where ``own`` holds.

    The numbers are sorted in among the rows that they draw, and take over the columns of the one before them. So nothing is joined, and
    rows that are dealt out by any of ``keys`` already stay where they are.
    """
    every = rows.withColumn("__n", F.explode(F.concat(F.array(F.lit(None).cast("long")), numbers)))
    held = F.struct(*[c for c in rows.columns if c not in (*keys, "__k")])
    every = every.select(*keys, F.when(F.col("__n").isNull(), F.col("__k")).otherwise(at).alias("__k"), "__n", F.when(F.col("__n").isNull(), held).alias("__row"))
    upto = Window.partitionBy(*keys).orderBy("__k", F.col("__n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = every.withColumn("__row", F.last("__row", True).over(upto)).select(*keys, "__row.*", "__k", "__n")
    return filled.filter(F.col("__n").isNotNull() | own).withColumn(name, F.coalesce("__n", "__k")).drop("__n")


def _sequence(first: Column, last: Column) -> Column:
    """Whole numbers from ``first`` to ``last``, none where ``last`` is below ``first``."""
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))


def _fit(rows: DataFrame, keys: Sequence[str], n: int, salt: Column, seed: int, replace_above: bool = True, least: int = 0) -> DataFrame:
    """Exactly ``n`` rows of every group, with ``slot``. More: ``n`` draws (with replacement, or by rank without); fewer: all, then draws.

    Groups of fewer than ``least`` rows go.
    """
    w, m = Window.partitionBy(*keys), F.col("__m")
    full = rows.withColumn("__k", (F.row_number().over(w.orderBy("point_idx")) - 1).cast("long")).withColumn("__m", F.count(F.lit(1)).over(w)).filter(m >= least)
    if not replace_above:  # a full group is numbered anew, by random rank; others keep their numbers
        u = full.withColumn("__u", F.when(m > n, uniform(F.col("cloud_id"), F.col("__k"), seed, salt)))
        full = u.withColumn("__k", (F.row_number().over(w.orderBy("__u", "__k")) - 1).cast("long")).filter(F.col("__k") < n).drop("__u")
    first = F.when(m > n, F.lit(0).cast("long")).otherwise(m)
    asks = (F.col("__k") == 0) & (F.lit(replace_above) | (m < n))
    # draws are numbered from 0 whether they fill up or replace
    at = F.floor(uniform(F.col("cloud_id"), F.col("__n") - first, seed, salt) * m).cast("long")
    fitted = _drawn(full, keys, _sequence(first, F.when(asks, F.lit(n - 1).cast("long")).otherwise(-1)), at, (m <= n) | F.lit(not replace_above), "slot")
    return fitted.select(*rows.columns, "slot")


def room_blocks(pts: DataFrame, n: int, size: float, stride: float, min_points: int = 100, seed: int = 0) -> DataFrame:
    """Points with bi, bj and slot: blocks from i * stride to i * stride + size, both edges included, ``n`` rows each.

    Rooms start at the origin. Blocks of fewer than ``min_points`` points go.
    """
    limit = pts.groupBy("cloud_id").agg(*[(F.ceil((F.max(c) - size) / stride)).cast("long").alias(f"n{c}") for c in "xy"])
    rows = pts.join(limit, "cloud_id")
    for c, b in zip("xy", ("bi", "bj")):
        lo = F.greatest(F.ceil((F.col(c) - size) / stride).cast("long"), F.lit(0))
        hi = F.least(F.floor(F.col(c) / stride).cast("long"), F.greatest(F.col(f"n{c}"), F.lit(0)))
        rows = rows.filter(lo <= hi).withColumn(b, F.explode(F.sequence(lo, hi)))
    keys = ["cloud_id", "bi", "bj"]
    return _fit(rows.drop("nx", "ny"), keys, n, F.col("bi") * 65536 + F.col("bj"), seed, least=min_points)


def random_blocks(pts: DataFrame, n: int, size: float, aug: int = 1, min_points: int = 100, seed: int = 0) -> DataFrame:
    """Points with block and slot: corners uniform in [-size, max), as many as size cells the room has, times ``aug``; ``n`` rows each."""
    room = pts.groupBy("cloud_id").agg(*[F.max(c).alias(f"m{c}") for c in "xy"])
    count = F.ceil(F.col("mx") / size) * F.ceil(F.col("my") / size) * aug
    corners = room.filter(count > 0).select("cloud_id", "mx", "my", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("block"))
    corners = corners.select("cloud_id", "block", *[(uniform(F.col("cloud_id"), F.col("block"), seed, k) * (F.col(f"m{c}") + size) - size).alias(f"{c}0") for k, c in enumerate("xy")])
    cells = corners.withColumn("o", F.explode(F.expr("flatten(transform(sequence(0, 1), i -> transform(sequence(0, 1), j -> struct(i, j))))")))
    cells = cells.select("cloud_id", "block", "x0", "y0", *[(F.floor(F.col(f"{c}0") / size) + F.col(f"o.{o}")).alias(f"c{c}") for c, o in zip("xy", "ij")])
    at = pts.select("*", *[F.floor(F.col(c) / size).alias(f"c{c}") for c in "xy"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x0") + size) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y0") + size)
    keys = ["cloud_id", "block"]
    rows = at.join(cells, ["cloud_id", "cx", "cy"]).filter(inside).drop("cx", "cy", "x0", "y0")
    return _fit(rows, keys, n, F.col("block") + 2, seed, least=min_points)


def _room_max(pts: DataFrame) -> DataFrame:
    return pts.groupBy("cloud_id").agg(*[F.max(c).alias(f"__m{c}") for c in XYZ])


def _features(rows: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Nine features: shifted x and y, z, colours / 255, coordinates over the room's largest."""
    own = {f"f{k}": v for k, v in enumerate((F.col("x") - dx, F.col("y") - dy, F.col("z"), *[F.col(c) / 255 for c in RGB], *[F.try_divide(F.col(c), F.col(f"__m{c}")) for c in XYZ]))}
    return rows.withColumns(own).drop(*[f"__m{c}" for c in XYZ])


def block_features(blocks: DataFrame, pts: DataFrame, size: float, keys: Sequence[str] = ("cloud_id", "bi", "bj")) -> DataFrame:
    """Block rows with f0 .. f8: x and y from the middle of a block that starts at its least point."""
    w = Window.partitionBy(*keys)
    low = blocks.withColumns({f"__l{c}": F.min(c).over(w) + size / 2 for c in "xy"}).join(_room_max(pts), "cloud_id")
    return _features(low, F.col("__lx"), F.col("__ly")).drop("__lx", "__ly")


def room_samples(pts: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """All points of a room in random chunks of ``k`` rows (chunk, slot), the last filled up from the whole room; features without centring."""
    u = ranked_inside(pts, "cloud_id", uniform(F.col("cloud_id"), F.col("point_idx"), seed, 0), "point_idx", name="__k", size="__n")
    size = F.col("__n")
    pads = u.filter("__k = 0").select("cloud_id", "__n").filter(size % k != 0)
    slots = pads.select("cloud_id", "__n", F.explode(F.sequence(size, F.ceil(size / k) * k - 1)).alias("__p"))
    drawn = slots.select("cloud_id", "__p", F.floor(uniform(F.col("cloud_id"), F.col("__p") - size, seed, 1) * size).cast("long").alias("__k"))
    rows = u.withColumn("__p", F.col("__k")).unionByName(drawn.join(u, ["cloud_id", "__k"]).select(*u.columns, "__p"))
    rows = rows.withColumns({"chunk": F.floor(F.col("__p") / k), "slot": F.col("__p") % k}).drop("__p", "__k", "__n")
    return _features(rows.join(_room_max(pts), "cloud_id"), F.lit(0.0), F.lit(0.0))


def _inside(size: float) -> Column:
    half = size / 2
    return F.col("x").between(F.col("x0") - half, F.col("x0") + half) & F.col("y").between(F.col("y0") - half, F.col("y0") + half)


def _around(centres: DataFrame, size: float) -> DataFrame:
    """Centres (x0, y0) at the nine cells of ``size`` that their window can reach."""
    cells = centres.withColumn("o", F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))")))
    return cells.select(*centres.columns, *[(F.floor(F.col(f"{c}0") / size) + F.col(f"o.{o}")).alias(f"c{c}") for c, o in zip("xy", "ij")])


def _counted(grid: DataFrame, centres: DataFrame, size: float) -> DataFrame:
    """(cloud_id, x0, y0, __c): how many points the window of each centre (cloud_id, x0, y0; distinct) holds."""
    met = grid.select("cloud_id", "cx", "cy", "x", "y").join(_around(centres, size), ["cloud_id", "cx", "cy"]).filter(_inside(size))
    return met.groupBy("cloud_id", "x0", "y0").agg(F.count("*").alias("__c"))


def valid_centres(pts: DataFrame, size: float, more_than: int, fine: int = 16) -> DataFrame:
    """(cloud_id, point_idx, x0, y0): the points whose window of ``size`` holds more than ``more_than`` points.

    Counts of cells of a ``fine``-th of the window add up to a least and a most for all windows around one cell: what lies in cells that
    are wholly inside, and in all that are touched (edges count a cell more, whatever rounding does). Sums run along x, then along y,
    so this is linear. Only where the bound lies between the two are points counted one by one, and such windows hold few.
    """
    step, inner, outer = size / fine, fine // 2 - 2, fine // 2 + 1
    cells = pts.groupBy("cloud_id", *[F.floor(F.col(c) / step).alias(f"f{c}") for c in "xy"]).agg(F.count("*").alias("n"))
    along = cells.withColumn("o", F.explode(F.sequence(F.lit(-outer), F.lit(outer)))).groupBy("cloud_id", (F.col("fx") + F.col("o")).alias("fx"), "fy")
    along = along.agg(F.sum(F.when(F.abs("o") <= inner, F.col("n")).otherwise(0)).alias("least"), F.sum("n").alias("most"), F.max(F.col("o") == 0).alias("held"))
    up = lambda k: Window.partitionBy("cloud_id", "fx").orderBy("fy").rangeBetween(-k, k)
    bounds = along.withColumns({"least": F.sum("least").over(up(inner)), "most": F.sum("most").over(up(outer))}).filter("held").filter(F.col("most") > more_than)
    rows = pts.select("cloud_id", "point_idx", F.col("x").alias("x0"), F.col("y").alias("y0"), *[F.floor(F.col(c) / step).alias(f"f{c}") for c in "xy"])
    rows = written(rows.join(bounds.select("cloud_id", "fx", "fy", (F.col("least") > more_than).alias("sure")), ["cloud_id", "fx", "fy"]).drop("fx", "fy"), "centres")
    unsure = rows.filter(~F.col("sure"))
    grid = pts.select("cloud_id", "x", "y", *[F.floor(F.col(c) / size).alias(f"c{c}") for c in "xy"])
    enough = _counted(grid, unsure.select("cloud_id", "x0", "y0").distinct(), size).filter(F.col("__c") > more_than)
    return rows.filter("sure").drop("sure").unionByName(unsure.drop("sure").join(enough.drop("__c"), ["cloud_id", "x0", "y0"], "left_semi"))


def centre_blocks(pts: DataFrame, plan: DataFrame, n: int, size: float, min_points: int = 1024, tries: int = 16, seed: int = 0) -> DataFrame:
    """Training blocks for the plan's rows (cloud_id, rep): a window of ``size`` around a random point, ``n`` rows, features from the centre.

    Centres are drawn until one has more than ``min_points`` points in its window. The first ``tries`` draws are looked at one by
    one; a row that they all fail draws once among the points of its room whose window is large enough, which is what drawing on
    would come to. So a row has no block only where its room has no such point. Draws of points are without replacement unless the
    window has fewer than ``n``.
    """
    sizes = pts.groupBy("cloud_id").agg(F.count("*").alias("__n"))
    cand = plan.join(sizes, "cloud_id").select("cloud_id", "rep", "__n", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    at = F.floor(uniform(F.col("cloud_id"), F.col("rep"), seed, F.col("try")) * F.col("__n")).cast("long")
    cand = cand.select("cloud_id", "rep", "try", at.alias("point_idx")).join(pts.select("cloud_id", "point_idx", F.col("x").alias("x0"), F.col("y").alias("y0")), ["cloud_id", "point_idx"]).drop("point_idx")
    grid = pts.select("*", *[F.floor(F.col(c) / size).alias(f"c{c}") for c in "xy"])
    # distinct centres are counted once, however many plan rows chose them
    counts = _counted(grid, cand.select("cloud_id", "x0", "y0").distinct(), size)
    chosen = cand.join(counts.filter(F.col("__c") > min_points), ["cloud_id", "x0", "y0"]).groupBy("cloud_id", "rep").agg(F.min_by(F.struct("x0", "y0"), "try").alias("c")).select("cloud_id", "rep", "c.x0", "c.y0")
    chosen = written(chosen, "centres")
    left = written(plan.select("cloud_id", "rep").join(chosen, ["cloud_id", "rep"], "left_anti"), "centres-left")
    if not left.isEmpty():
        valid = ranked(valid_centres(pts.join(left.select("cloud_id").distinct(), "cloud_id", "left_semi"), size, min_points), "cloud_id", "point_idx", name="at")
        rooms = valid.groupBy("cloud_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        drawn = left.join(rooms, "cloud_id").select("cloud_id", "rep", (F.col("first") + F.floor(uniform(F.col("cloud_id"), F.col("rep"), seed, tries) * F.col("n"))).alias("at"))
        chosen = chosen.unionByName(drawn.join(valid, ["cloud_id", "at"]).select("cloud_id", "rep", "x0", "y0"))
    rows = grid.join(_around(chosen, size), ["cloud_id", "cx", "cy"]).filter(_inside(size)).drop("cx", "cy")
    fitted = _fit(rows, ["cloud_id", "rep"], n, F.col("rep") + 1000, seed, replace_above=False)
    return _features(fitted.join(_room_max(pts), "cloud_id"), F.col("x0"), F.col("y0"))


def sliding_scene(pts: DataFrame, block: float = 1.0, stride: float = 0.5, padding: float = 0.001, block_points: int = 4096, seed: int = 0) -> DataFrame:
    """The whole scene in overlapping blocks (ix, iy), in batches of ``block_points`` rows (batch, slot), with features and the label's weight.

    The last blocks end at the room's edge. A block is filled up to whole batches from its own points, each once more if they
    suffice and by draws if not, and shuffled.
    """
    room = pts.groupBy("cloud_id").agg(*[F.min(c).alias(f"lo{c}") for c in "xy"], *[F.max(c).alias(f"__m{c}") for c in XYZ])
    rows = pts.join(room, "cloud_id")
    for c in "xy":
        # blocks by arithmetic, one more on either side whatever rounding does, and the last one, which ends at the edge; then exactly
        low, high, v, i = F.col(f"lo{c}"), F.col(f"__m{c}"), F.col(c), F.col(f"i{c}")
        last = F.greatest(F.ceil((high - low - block) / stride), F.lit(0)).cast("long")
        some = _sequence(F.greatest(F.floor((v - low - block - padding) / stride).cast("long") - 1, F.lit(0)), F.least(F.ceil((v - low + padding) / stride).cast("long") + 1, last))
        end = F.least(low + i * stride + block, high)
        rows = rows.withColumn(f"i{c}", F.explode(F.array_union(some, F.array(last)))).withColumn(f"s{c}", end - block)
        rows = rows.filter((v >= F.col(f"s{c}") - padding) & (v <= end + padding)).drop(f"lo{c}")
    keys = ["cloud_id", "ix", "iy"]
    w, salt = Window.partitionBy(*keys), F.col("ix") * 65536 + F.col("iy")
    u = rows.withColumn("__u", uniform(F.col("cloud_id"), F.col("point_idx"), seed, salt * 4))
    u = u.withColumn("__k", (F.row_number().over(w.orderBy("__u", "point_idx")) - 1).cast("long")).withColumn("__m", F.count(F.lit(1)).over(w)).drop("__u")
    m, k = F.col("__m"), F.col("__k")
    pad = F.ceil(m / block_points) * block_points - m
    numbers = F.when(pad > m, _sequence(m, F.when(k == 0, m + pad - 1).otherwise(-1))).otherwise(_sequence(m + k, F.when(k < pad, m + k).otherwise(-1)))
    at = F.when(pad > m, F.floor(uniform(F.col("cloud_id"), F.col("__n") - m, seed, salt * 4 + 1) * m).cast("long")).otherwise(k)
    every = _drawn(u, keys, numbers, at, F.lit(True), "__p")
    every = every.withColumn("__u", uniform(F.col("cloud_id"), F.col("__p"), seed, salt * 4 + 2))
    place = F.row_number().over(w.orderBy("__u", "__p")) - 1
    every = every.withColumn("__q", place).withColumns({"batch": F.floor(F.col("__q") / block_points), "slot": (F.col("__q") % block_points).cast("long")}).drop("__u", "__p", "__k", "__m", "__q")
    weights = label_weights(pts).select("label", "weight")
    return _features(every, F.col("sx") + block / 2, F.col("sy") + block / 2).drop("sx", "sy").join(F.broadcast(weights), "label")

"""Fill-in-the-middle samples: texts cut at two unit ranks, which an indexable skip list turns into code points.

Units are lines by default. The list of a text has express lanes whose links carry two widths, how many units and how many
code points they span. A descent adds up widths lane by lane, so it reaches a rank in logarithmic steps and gives its offset
in code points exactly. Every text is its own row; nothing is shuffled. Hashes and the rebuilding of texts are Spark's own
functions, lists are built in Arrow batches.

Defined results: a null text counts as empty; empty texts, and texts that hold a sentinel, stay as they are (form ``plain``);
a null id hashes as an empty one; repeated rows give repeated samples (equal ids draw equal numbers, so equal rows give equal
samples); where both cuts meet the middle is empty, and a cut at rank 0 or n leaves prefix or suffix empty. A text may be as
long as a value can be: its list takes some 12 bytes a unit. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import batches, pieces

#: Fixed by the format: a line with its end, or what is left after the last.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


class SkipList:
    """Units in order. Lane 0 links each unit to the next; a unit's end is a stop of lane k where the low 2k bits of a hash of
    its rank are zero, a quarter of the stops of the lane below, so equal texts have equal lists.
    """

    def __init__(self, widths: np.ndarray):
        """``widths``: the code points of each unit."""
        self.units, self.points, self.down = [np.ones(len(widths), np.int32)], [np.asarray(widths, np.int32)], [None]
        stops = np.arange(len(widths) + 1, dtype=np.uint64)
        while len(stops) > 4:
            up = _mixed(stops) & np.uint64((1 << 2 * len(self.units)) - 1) == 0
            up[0], up[-1] = True, False
            at = np.flatnonzero(up)
            if len(at) == len(stops) - 1:  # a lane as long as the one below saves nothing
                break
            self.units.append(np.add.reduceat(self.units[-1], at))
            self.points.append(np.add.reduceat(self.points[-1], at))
            self.down.append(at)
            stops = np.append(stops[at], stops[-1])

    def __len__(self) -> int:
        return len(self.units[0])

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them at rank ``len(self)``."""
        k, passed, points = 0, 0, 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, widths = self.units[lane], self.points[lane]
            while k < len(units) and passed + units[k] <= rank:
                passed, points, k = passed + int(units[k]), points + int(widths[k]), k + 1
            if lane:
                below = self.down[lane]
                k = int(below[k]) if k < len(below) else len(self.units[lane - 1])
        return points


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _cut(text: str, h: str, unit: re.Pattern, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple:
    ends = np.fromiter((m.end() for m in unit.finditer(text)), np.int64)
    n = len(ends)
    if n:
        ends[-1] = len(text)  # what follows the last unit belongs to it
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(np.diff(ends, prepend=0))
    a, b = sorted((units.offset(h1 % (n + 1)), units.offset(h2 % (n + 1))))
    p, s, m = marks
    out = f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if h4 % 100 < spm else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
    return n, "spm" if h4 % 100 < spm else "psm", a, b - a, out


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, unit: str = LINES, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): one sample for each row, in the order of the rows.

    ``unit`` is a pattern whose matches are the n units. The SHA-256 of ``seed:id`` gives four numbers: two cuts of 0 to n
    units, whether the text is transformed (``rate`` in a hundred), and whether its suffix leads (``spm`` in a hundred).
    """
    for a in sentinels:
        for b in sentinels:
            if not a or a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError("sentinels must not be empty, hold one another or overlap")
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        shape = re.compile(unit)
        for b in it:
            ids = b.column("id")
            for texts, hashes in batches([b], "text", "h"):
                for start, stop in pieces(texts):
                    found = list(zip(*(_cut(t, h, shape, rate, spm, sentinels) for t, h in zip(texts[start:stop], hashes[start:stop]))))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *(pa.array(c, t) for c, (_, t) in zip(found, fields))], ["id", *(name for name, _ in fields)])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that a sample was made of, from the sample and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))

"""Order MinHash fingerprints, with DataFrame functions only.

A text's units (words, long ones in pieces) form overlapping k-mers, and each k-mer gets the number of its occurrence, so that
repetitions count. Every entry of a fingerprint has an order of its own over these numbered k-mers: their hashes, counted
cyclically from the entry's starting point. It takes the ``picks`` least of them, puts them back into the order in which they
stand in the text, and hashes the tuple. So two entries agree only if the same k-mers are there in the same order, which edits
and transpositions both break; the share of entries that agree is the likeness of two texts.

All is done inside the row with sorted arrays of whole numbers, hash above and position below: sorting brings equal k-mers
together (occurrence numbers), and starting points sorted in among the hashes point to their first successors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked
from ._common import written

#: Words, in pieces of at most six code points, so that edits inside a long word, or in a script without spaces, cost only a part.
UNIT = r"[^\x20\x09-\x0D]{1,6}"
K, PICKS, ENTRIES = 3, 2, 64
#: An item is 32 bits of hash, a one, and 31 bits of position; a starting point has zeros below the hash.
ITEM, PLACE = 1 << 31, (1 << 31) - 1


def _item(h: Column, place: Column) -> Column:
    return F.shiftleft(h, 32).bitwiseOR(place + F.lit(ITEM))


def _span(n: Column) -> Column:
    """0, 1, ... n - 1 for n of at least 1."""
    return F.sequence(F.lit(0), n - 1)


def with_fingerprint(df: DataFrame, text_col: str, name: str, k: int = K, picks: int = PICKS, entries: int = ENTRIES, unit: str = UNIT) -> DataFrame:
    """``df`` with an array of ``entries`` ints. Fewer than ``k`` units are one k-mer; a text without units (or null) has zeros only.

    Each step is a column of its own, so that it is worked out once and arrays of numbers are sorted as such.
    """
    c = lambda step: F.col(f"__{name}_{step}")
    at = lambda step, i: F.get(c(step), i)
    key = lambda i: F.shiftright(at("repeats", i), 32)

    def again(starts: Column) -> Column:
        """Repeated k-mers with their occurrence numbers hashed in; ``starts``: where the runs of one k-mer begin."""
        stop = lambda r: F.coalesce(F.get(starts, r + 1), F.size(c("repeats"))) - 1
        of = lambda i, n: _item(F.xxhash64(key(i), n), at("repeats", i).bitwiseAND(PLACE))
        return F.flatten(F.transform(starts, lambda a, r: F.transform(F.sequence(a, stop(r)), lambda i: of(i, (i - a + 1).cast("int")))))

    def entry(p: Column) -> Column:
        """The tuple of the items from p on, round the end: position above and hash below, to sort by the text's order."""
        turned = lambda v: F.shiftleft(v, 32).bitwiseOR(F.shiftrightunsigned(v, 32))
        chosen = F.array_sort(F.array(*[turned(at("items", (p + j) % F.size(c("items")))) for j in range(picks)]))
        return F.shiftright(F.xxhash64(F.transform(chosen, lambda v: v.bitwiseAND((1 << 32) - 1))), 32).cast("int")

    run_starts = F.filter(_span(F.size(c("repeats"))), lambda i: (i == 0) | (key(i) != key(i - 1)))
    starts = F.array(*[F.lit((s * (1 << 64) // entries - (1 << 63)) >> 32 << 32) for s in range(entries)])
    none, whole = F.array().cast("array<bigint>"), F.size(c("repeats")) == 0
    steps = {
        "units": F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(unit), F.lit(0)),
        "sorted": F.sort_array(F.transform(_span(F.greatest(F.size(c("units")) - (k - 1), F.lit(1))), lambda i: _item(F.xxhash64(*[at("units", i + j) for j in range(k)]), i))),
        "repeats": F.filter(c("sorted"), lambda x, i: F.shiftrightunsigned(x.bitwiseXOR(at("sorted", i - 1)), 32) == 0),
        "runs": F.when(~whole, run_starts),
        "again": F.when(~whole, again(c("runs"))).otherwise(none),
        "items": F.when(whole, c("sorted")).otherwise(F.sort_array(F.concat(F.array_except(c("sorted"), c("repeats")), c("again")))),
        "row": F.sort_array(F.concat(c("items"), starts)),
        "points": F.filter(_span(F.size(c("row"))), lambda i: at("row", i).bitwiseAND(ITEM) == 0),
    }
    out = df
    for step, value in steps.items():
        out = out.withColumn(f"__{name}_{step}", value)
    found = F.when(F.size(c("units")) > 0, F.transform(c("points"), lambda p, s: entry(p - s))).otherwise(F.array_repeat(F.lit(0), entries))
    return out.withColumn(name, found).drop(*[f"__{name}_{step}" for step in steps])


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of entries that agree, 0 to 1."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)
    return F.size(same) / F.size(a)


def as_text(fingerprint: Column | str) -> Column:
    """Eight hex digits an entry."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next, half): for each id that there is, the next lower one, the highest after the lowest (null is the lowest), and half
    the length of the id's longest text in code points. Ids alone are put in order, in ranges.
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.floor(F.max(F.length(F.coalesce(text_col, F.lit("")))) / 2).cast("int").alias("half"))
    places = ranked(ids, "id", name="place")
    n = max(places.count(), 1)
    before = places.select(F.col("id").alias("next"), ((F.col("place") + 1) % n).alias("place"))
    return written(places.join(before, "place").select("id", "next", "half"), "neighbours")


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text of a row has the last half of its code points (rounded down) replaced by the first as many of the next
    document, or all if that is shorter; the next document has the next lower id, and after the lowest id comes the highest.

    Defined results: a null text counts as empty, texts without a word have a fingerprint of zeros (likeness 1 to one another);
    a null id is lower than all others; an id with several texts stands for the one with the least SHA-256 where it is the next
    document, and each of its rows gets a result; an only id is its own next document. Repeated rows get equal results. Very long
    texts are worked on inside their row, in time that grows as sorting does. An empty table gives no rows; other columns are not
    read. A third of all rows may have one id: rows meet one row of the next document, in a join that Spark splits when skewed.
    """
    pairs = neighbours(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    wanted = pairs.select(F.col("next").alias("id"), F.col("id").alias("of"), "half")
    same = lambda a, b, x, y: a[x].eqNullSafe(b[y])
    firsts = rows.alias("r").join(wanted.alias("w"), F.expr("r.id <=> w.id")).select("w.of", F.struct(F.sha2("r.text", 256).alias("sha"), F.substring("r.text", F.lit(1), F.col("w.half")).alias("text")).alias("first"))
    firsts = firsts.groupBy("of").agg(F.min("first").alias("first"))
    both = rows.join(firsts, same(rows, firsts, "id", "of"), "left").withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("first.text", F.lit("")), F.lit(1), half))
    both = both.select("id", "n_chars", "text", edited.alias("edited"))
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    print_ = written(both.select("id", "n_chars", F.sha2("text", 256).alias("sha"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "order-minhash")
    of_id = print_.groupBy("id").agg(F.min(F.struct("sha", "fingerprint")).alias("first"))
    of_next = pairs.alias("p").join(of_id.alias("f"), F.expr("p.next <=> f.id")).select(F.col("p.id").alias("of"), F.col("f.first.fingerprint").alias("next_fingerprint"))
    out = print_.join(of_next, same(print_, of_next, "id", "of"), "left")
    return out.select("id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))

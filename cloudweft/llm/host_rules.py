"""Quality rules by document and by host, with DataFrame functions only.

Documents fail base rules on their own. For every host the share of failed documents is shrunk towards the corpus by a
beta prior whose strength comes from the spread of the hosts' own rates (method of moments), and the verdict on a host
reaches all its documents by a join. Hosts are counted by partial aggregates, so a host with a third of all rows is as
cheap as any other, and only ids and numbers, never texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import heavy_join, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def document_features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source"), window: int = 3) -> DataFrame:
    """The ``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    Words are runs of anything but space and U+0009-000D; a null text has none. n_repeat_words: the windows of ``window``
    words are sorted with their places, equal neighbours are repeats, and the places in order cover ``window`` words each,
    less what the one before covers too. Two sorts of the text's own words, whatever it repeats.
    """
    at = "concat_ws(' ', " + ", ".join(f"words[i + {k}]" for k in range(window)) + ")"
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.select(
        *keep,
        F.length(F.regexp_replace("__text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _words(F.col("__text")).alias("words"),
    )
    base = base.select(
        *keep, "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(words) < {window}, cast(array() as array<struct<w: string, i: int>>), sort_array(transform(sequence(0, size(words) - {window}), i -> named_struct('w', {at}, 'i', i))))").alias("sorted"),
    )
    places = F.expr("""
        sort_array(filter(transform(sorted, (s, j) -> if(
            (j > 0 and element_at(sorted, j).w = s.w) or (j < size(sorted) - 1 and sorted[j + 1].w = s.w), s.i, -1)), i -> i >= 0))""")
    covered = F.expr(f"aggregate(places, named_struct('n', 0L, 'last', -{window}), (a, i) -> named_struct('n', a.n + least(i - a.last, {window}), 'last', i), a -> a.n)")
    base = base.withColumn("places", places)
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(rows: DataFrame, host_col: str = "source", failed_col: str = "base_failed", max_rate: float = 0.5, min_strength: float = 1.0, max_strength: float = 10_000.0) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept) for every non-null host.

    With hosts' rates p_h of n_h documents, mean m and excess variance v over the binomial's, the prior is
    beta(m k, (1 - m) k) with k = m (1 - m) / v - 1, held to [min_strength, max_strength]. A host's rate is its posterior
    mean; above ``max_rate`` the host is rejected.
    """
    hosts = rows.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed_col).cast("long")).alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.avg(p * p).alias("p2"), F.avg(p).alias("p1"), F.avg(F.lit(1.0) / F.col("n_docs")).alias("inv"),
    )
    spread = F.col("p2") - F.col("p1") * F.col("p1") - F.col("m") * (1 - F.col("m")) * F.col("inv")
    k = F.when(spread > 0, F.col("m") * (1 - F.col("m")) / spread - 1).otherwise(F.lit(max_strength))
    prior = prior.select("m", F.least(F.greatest(k, F.lit(min_strength)), F.lit(max_strength)).alias("k"))
    # one row, so its broadcast has a proven bound
    both = hosts.join(F.broadcast(prior))
    rate = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return both.select("host", "n_docs", "n_failed", rate.alias("rate")).withColumn("host_kept", F.col("rate") <= max_rate)


def _with_verdicts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` (source, ...) with their host's rate and verdict; null without a host."""
    hosts = written(hosts, "host-verdicts")
    n_docs = hosts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    return heavy_join(rows, hosts.select(F.col("host").alias("source"), "rate", "host_kept", "n_docs"), "source", "n_docs", n_docs)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5) -> DataFrame:
    """Every document's features, base_failed, its host's rate and kept.

    A document without a host is judged by the base rules alone (rate null); a null or empty text has no words and fails them.
    Texts are whole, of any length. Repeated rows each keep their row; an empty table gives an empty result.
    """
    rows = document_features(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("source"), F.col(text_col).alias("text")))
    rows = written(rows.withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "rule-features")
    return _with_verdicts(rows, host_verdicts(rows, max_rate=max_rate)).withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``judge`` keeps; the verdict is on each row, so ids may repeat or be null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    rows = document_features(rows, keep=("doc", "source")).select("doc", "source", base_failed(min_words, max_repeat_percent).alias("base_failed"))
    rows = written(rows, "judged-documents")
    hosts = host_verdicts(rows, max_rate=max_rate)
    return _with_verdicts(rows.filter(~F.col("base_failed")), hosts).filter(F.coalesce("host_kept", F.lit(True))).select("doc.*")

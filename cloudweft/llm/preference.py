"""Preference samples from pairs of conversations, with DataFrame functions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as the prompt; what follows
in each is rendered as its completion, with the spans that count in the loss (what the trained role says, its end mark
included). A conversation is one training sample and so one row; windows put its turns in order and add up offsets, one
shuffle for both, and conversations meet their pairs by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, with what each renders to and where.

    Order is (turn, role, text), nulls first; null roles and texts count as empty. Rows without a conversation id belong to
    no conversation and are left out. Repeated rows are repeated turns.
    """
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("head", F.concat(F.lit("<|"), "role", F.lit("|>\n"))).withColumn("said", F.concat("head", "text", F.lit(END)))
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("said")).over(upto)).withColumn("place", F.count(F.lit(1)).over(upto))
    turn = F.struct("place", "role", "text", "said", (F.col("stop") - F.length("said")).alias("start"), "stop", F.length("head").alias("head"), (F.col("role") == trained).alias("trained"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _said(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: t["said"]))


def _spans(turns: Column) -> Column:
    """(start, stop) of what the trained role says, counted from the first of ``turns``."""
    base = F.get(turns, F.lit(0))["start"]
    return F.transform(F.filter(turns, lambda t: t["trained"]), lambda t: F.struct((t["start"] + t["head"] - base).cast("int").alias("start"), (t["stop"] - base).cast("int").alias("stop")))


def preferences(pairs: DataFrame, turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(pair_id, chosen_id, rejected_id, prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    ``pairs`` has pair_id (unique), chosen_id and rejected_id. Spans are (start, stop) in characters of the completion. Turns are
    the same if role and text are. If one conversation is a prefix of the other its completion is empty; if a side is
    missing, its completion and spans are null and the prompt is empty (ANSI mode on or off). An empty table gives no rows. A
    conversation may be as long as a row can be: it is one sample.
    """
    convs = conversations(turns, trained=trained)
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    sides = sides.select("pair_id", "s.side", "s.conv_id").join(convs, "conv_id", "left")
    both = sides.groupBy("pair_id").agg(*[F.first(F.when(F.col("side") == k, F.col(c)), ignorenulls=True).alias(name + suffix) for k, name in enumerate(("chosen", "rejected")) for c, suffix in (("conv_id", "_id"), ("turns", "_turns"))])
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(same.isNull(), 0).when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    both = both.withColumn("prefix_turns", n)
    out = [F.col("pair_id"), F.col("chosen_id"), F.col("rejected_id"), F.col("prefix_turns")]
    out.append(F.coalesce(_said(F.slice("chosen_turns", 1, F.col("prefix_turns"))), F.lit("")).alias("prompt"))
    for side in ("chosen", "rejected"):
        at = F.col(f"{side}_turns")
        rest = F.when(at.isNotNull(), F.slice(at, F.col("prefix_turns") + 1, F.greatest(F.coalesce(F.size(at), F.lit(0)) - F.col("prefix_turns"), F.lit(0))))
        out += [F.when(at.isNotNull(), _said(rest)).alias(side), _spans(rest).alias(f"{side}_spans")]
    return both.select(*out)


def neighbour_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversation 2k as chosen and 2k + 1 as rejected (integer ids): every conversation once, without sorting any group."""
    ids = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    even = F.pmod("id", F.lit(2)) == 0
    pair = F.expr("(id - pmod(id, 2)) div 2").alias("pair_id")  # whole numbers throughout: ids of any size, negative too
    chosen, rejected = F.max(F.when(even, F.col("id"))), F.max(F.when(~even, F.col("id")))
    return ids.groupBy(pair).agg(chosen.alias("chosen_id"), rejected.alias("rejected_id"))

"""Preference data from pairs of conversations: DataFrame functions only.

Turns are paired first: a row for each turn of a pair, with what both sides have there. Texts are shuffled once, by pair and
turn, so a conversation of any length is dealt out; all that is known by pair alone comes back to the turns as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a turn is rendered; the text of a completion's assistant turns, with the end mark, is what is learnt.
HEAD, END = "<|im_start|>", "<|im_end|>\n"


def _row() -> Column:
    return F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def paired_turns(sides: DataFrame) -> DataFrame:
    """pair_id, turn, chosen and rejected (structs of role and text; null on a side that lacks the turn).

    sides has pair_id, side (chosen or rejected), turn, role, text. Null roles and texts are empty. Rows with a null pair_id or turn
    have no place and are left out; of repeated rows of a side's turn the one with the smallest (role, text) counts.
    """
    of = lambda side: F.min(F.when(F.col("side") == side, _row())).alias(side)
    placed = sides.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    return placed.groupBy(F.col("pair_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn")).agg(of("chosen"), of("rejected"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """paired_turns() of pairs made of plain conversations: chosen is the conversation as it is; rejected is the same with its
    last assistant turn's text taken from the last assistant turn of its partner, the conversation whose id differs in the
    last bit.

    turns has conv_id, turn, role, text; other columns are ignored. A conversation without an assistant turn, or whose
    partner has none, has the same text on both sides: it has no completions. Rows with a null conv_id are no conversation
    and form no pair. Rows with a null turn have no place in their conversation and are left out, as the query's SQL
    has it; a conversation of such rows only gives none. Of repeated rows of a turn, which may differ in role or text, the
    one with the smallest (role, text) counts and the others are left out. An empty table gives an empty result.
    """
    rows = (
        turns.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        .where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("pair_id", "turn")
        .agg(F.min(_row()).alias("row"))
    )
    last = rows.where("row.role = 'assistant'").groupBy(F.col("pair_id").alias("of")).agg(F.max("turn").alias("last_turn"))
    here = (F.col("pair_id") == F.col("of")) & (F.col("turn") == F.col("last_turn"))
    replies = rows.join(last, here).select("of", "last_turn", F.col("row.text").alias("reply"))
    partners = replies.select(F.col("of").bitwiseXOR(F.lit(1)).alias("partner"), F.col("reply").alias("other"))
    # null-safe, as neither is null: a test for nulls of `partner` would be pushed down and part this scan from the others
    swaps = replies.join(partners, F.col("of").eqNullSafe(F.col("partner"))).select("of", "last_turn", "other")
    other = F.struct(F.col("row.role").alias("role"), F.coalesce("other", "row.text").alias("text"))
    return rows.join(swaps, here, "left").select("pair_id", "turn", F.col("row").alias("chosen"), other.alias("rejected"))


def _rendered(row: Column) -> Column:
    return F.concat(F.lit(HEAD), row["role"], F.lit("\n"), row["text"], F.lit(END))


def preference_segments(paired: DataFrame) -> DataFrame:
    """The rendered turns of each pair, a row for each: pair_id, seq, prompt, chosen, rejected, and the characters that are
    learnt: chosen_from, chosen_to, rejected_from, rejected_to.

    paired is paired_turns(). The prompt is the longest common prefix: turns before the first that differs in role or text, or
    that one side lacks. It is rendered once, as prompt; chosen and rejected are null there. What remains of each side is its
    completion: a row has both sides' turn, and null where a side has none. Of a completion's assistant turns the text
    and end mark are learnt; other bounds are null, so the mask is given with the text. seq is the turn. Marks inside a text are
    not escaped: they are the tokenizer's to read as text.

    A pair's first difference is a minimum over its turns, aggregated before the shuffle; the turns from there on, as pairs of
    numbers, meet the texts where they are.
    """
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    first = paired.where(differs).groupBy(F.col("pair_id").alias("of")).agg(F.min("turn").alias("first"))
    keys = paired.select("pair_id", "turn").join(first, (F.col("pair_id") == F.col("of")) & (F.col("turn") >= F.col("first")))
    later = keys.select(F.col("pair_id").alias("_pair"), F.col("turn").alias("_turn"))
    rows = paired.join(later, (F.col("pair_id") == F.col("_pair")) & (F.col("turn") == F.col("_turn")), "left")
    common = F.col("_pair").isNull()
    columns = [F.col("pair_id"), F.col("turn").alias("seq"), F.when(common, _rendered(F.col("chosen"))).alias("prompt")]
    columns += [F.when(~common, _rendered(F.col(side))).alias(side) for side in ("chosen", "rejected")]
    for side in ("chosen", "rejected"):
        row = F.col(side)
        learnt, begin = ~common & (row["role"] == "assistant"), F.length(row["role"]) + F.lit(len(HEAD) + 1)
        columns.append(F.when(learnt, begin).cast("long").alias(f"{side}_from"))
        columns.append(F.when(learnt, begin + F.length(row["text"]) + F.lit(len(END) - 1)).cast("long").alias(f"{side}_to"))
    return rows.select(*columns)


def preference_rows(segments: DataFrame) -> DataFrame:
    """One row for each pair: pair_id, prompt, chosen, rejected, and the learnt spans of both completions as arrays of
    (begin, end) characters. For conversations that fit a row; preference_segments() has no such bound."""
    order = Window.partitionBy("pair_id").orderBy("seq")
    placed = segments
    for side in ("chosen", "rejected"):
        size = F.coalesce(F.length(side), F.lit(0))
        placed = placed.withColumn(f"{side}_start", F.sum(size).over(order) - size)
    texts = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("seq", name)))), lambda x: x[name]), "")

    def spans(side: str) -> Column:
        start = F.col(f"{side}_start")
        span = F.struct((start + F.col(f"{side}_from")).alias("begin"), (start + F.col(f"{side}_to")).alias("end"))
        return F.array_sort(F.collect_list(F.when(F.col(f"{side}_from").isNotNull(), span))).alias(f"{side}_spans")

    return placed.groupBy("pair_id").agg(*[texts(x).alias(x) for x in ("prompt", "chosen", "rejected")], spans("chosen"), spans("rejected"))

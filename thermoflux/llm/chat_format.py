"""Preference formatting of chosen and rejected conversations.

The turns of a conversation are collected in order. For a pair the longest common prefix of turns (same role and text) is
rendered once as the prompt; what is left of each is rendered as its completion, with a mask of the character spans that
assistant turns fill: those are trained on, the rest is context.

``pair_conversations`` makes pairs from one table: conversations with the same first turn are ranked in a seeded order and
neighbours (1st and 2nd, 3rd and 4th ...) are paired. A first turn can be shared by a large part of all conversations: ranks are
counted in two levels (buckets of a bounded size by the leading digits of the order key), so no group goes to one task.

Cases: turns are ordered by turn, role, text (nulls first); a null text is empty and a null role is 'null'; turns repeated
exactly stay repeated; a conversation without a partner gives a row with null rejected columns, an empty prompt and its
whole text as the completion; equal conversations give empty completions; an empty table gives no rows. A conversation is one array in one
task, so its texts, however long, must fit there. Only conv_id, turn, role and text are read: ``pair_conversations`` leaves other columns of the
turns out, whatever their names; ``format_pairs`` keeps other columns of the pairs and replaces those that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.llm.common import staged

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Conversations of one first turn that one window task ranks.
ROWS_PER_BUCKET = 4096
_DIGITS = 7


def collect_turns(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>), one row a conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("null")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return conversations.select(F.col(conv_col).alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column) -> Column:
    """Spans (start, end) in characters of the rendered turns that assistant texts and their end marks fill."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(t["role"])
        body = head + F.length(t["text"]) + F.lit(len(CLOSE) - 1)
        span = F.when(
            t["role"] == "assistant",
            F.array(F.struct(head.alias("start"), body.alias("end"))),
        ).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
        return F.struct((body + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """Adds n_common, prompt, chosen, chosen_mask, rejected and rejected_mask to rows with two arrays of turns."""
    same = F.zip_with(F.col(chosen), F.col(rejected), lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    n = F.when(F.col(rejected).isNull(), F.lit(0)).when(first > 0, first - 1).otherwise(F.size(chosen)).cast("int")
    out = pairs.withColumn("n_common", n)

    def rest(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1))))

    return (
        out.withColumn("prompt", render(F.slice(F.col(chosen), 1, F.col("n_common"))))
        .withColumn("chosen", render(rest(chosen)))
        .withColumn("chosen_mask", trained_spans(rest(chosen)))
        .withColumn("rejected", render(rest(rejected)))
        .withColumn("rejected_mask", F.when(F.col(rejected).isNotNull(), trained_spans(rest(rejected))))
    )


def pair_conversations(conversations: DataFrame, conv_col: str = "conv_id", seed: str = "pair-") -> DataFrame:
    """(chosen_id, rejected_id, chosen_turns, rejected_turns); rejected columns are null for a conversation left over."""
    convs = collect_turns(conversations, conv_col)
    first = F.sha2(F.to_json(F.element_at("turns", 1)), 256)
    convs = convs.withColumn("_first", first).withColumn(
        "_key",
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).cast("binary")),
    )
    ids = staged(convs.select("conv_id", "_first", "_key"), "first-turns")
    # As many buckets for every first turn as all conversations need; a first turn of one conversation has one bucket.
    buckets = min(16**_DIGITS, max(1, -(-ids.count() // ROWS_PER_BUCKET)))
    lead = F.conv(F.substring("_key", 1, _DIGITS), 16, 10).cast("long")
    ids = ids.withColumn("_bucket", F.floor(lead * buckets / 16**_DIGITS))
    counts = ids.groupBy("_first", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_first").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_first", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_first", "_bucket").orderBy("_key", "conv_id")
    ranked = ids.withColumn("_within", F.row_number().over(within) - 1).join(counts, ["_first", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within"))
    ranked = ranked.select("conv_id", F.floor(F.col("_rank") / 2).alias("_pair"), (F.col("_rank") % 2).alias("_side"))
    sided = convs.select("conv_id", "turns", "_first").join(ranked, convs["conv_id"].eqNullSafe(ranked["conv_id"])).drop(ranked["conv_id"])

    def of(side: int, c: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(c)))

    # a pair has two rows at most, so the aggregates only put them side by side
    return sided.groupBy("_first", "_pair").agg(
        of(0, "conv_id").alias("chosen_id"), of(1, "conv_id").alias("rejected_id"), of(0, "turns").alias("chosen_turns"), of(1, "turns").alias("rejected_turns")
    ).drop("_first", "_pair")

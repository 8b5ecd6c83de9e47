"""Mixing sources to target weights along a time-varying curriculum.

Every source has a token target and a schedule: knots ``(t, rate)`` on [0, 1], linear in between, that say how its demand
for tokens is spread over training. The schedule is integrated to a cumulative demand curve. The documents of a source,
in a seeded pseudo-random order, lie end to end on a token axis; a source with a target beyond its size is passed over
again (up to ``max_passes``). The document that starts at token ``c`` is needed at the time when the cumulative demand
reaches ``c``, so inverting the curve gives its training position. The mix is range-sorted by that position.

Token offsets are prefix sums over each source. No source goes to one task: a source is cut into buckets by the leading
digits of the order key, bucket sums are prefix-summed (a small table), and offsets are windowed within a bucket.

Columns travel as columns, so that a query that does not read the texts of the mix moves none.

Cases: weights are finite, none is negative and not all are 0 (else ValueError); a source of weight 0 has target 0; knots are taken in the order of
their times, a rate that is null or negative counts as 0, and a schedule of fewer than two knots or without any area is level;
a null or empty text has size 0, is never taken and has no position; a null source is a source of its own and
comes last; repeated rows are documents of their own (those with equal ids follow each other, in any order, as they
are alike); documents cut by the end of their source's target count their first words only; an empty table gives an empty mix; other
columns pass through (clashing names are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one window task orders.
ROWS_PER_BUCKET = 4096
#: Hex digits of the order key that a bucket can be read from.
_DIGITS = 7


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def source_targets(
    sizes: DataFrame,
    weights: list[float],
    share: float,
    max_passes: float,
    source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """(source, source_size, source_rows, rank, target): weights repeat over the sources by code point, null last.

    Targets share ``share`` of all words by weight; none exceeds ``max_passes`` times its source, and what is cut off goes
    to the others by weight until none is above. That fixed point is min(lambda * weight, cap), found by sorting
    the sources by cap / weight and prefix sums, so no loop runs.
    """
    rows = F.sum("rows") if "rows" in sizes.columns else F.count(F.lit(1))
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"), rows.alias("source_rows"))
    if not weights or any(not math.isfinite(x) or x < 0 for x in weights) or not any(weights):
        raise ValueError("weights must be finite, none negative and not all 0")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    per = per.withColumn("cap", F.lit(float(max_passes)) * F.col("source_size")).withColumn("ratio", ratio)
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # lambda if this source and all with a larger ratio are uncapped; the first that holds is the answer
        .withColumn("level", F.when(F.col("weight") > 0, F.try_divide(F.col("goal") - F.col("capped_before"), F.col("weight_left"))))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every))
    )
    capped = F.col("found").isNull() | (F.struct("ratio", "rank") < F.struct("found.ratio", "found.rank"))
    target = F.when(F.col("weight") == 0, F.lit(0.0)).when(capped, F.col("cap")).otherwise(F.col("found.level") * F.col("weight"))
    return per.select("source", "source_size", "source_rows", "rank", "weight", target.alias("target"))


def offsets(sized: DataFrame, targets: DataFrame, id_col: str, seed: str) -> DataFrame:
    """``sized`` (with source and size) plus its source's columns and ``start``, its first token within its source."""
    t = F.broadcast(targets) if targets.count() <= 100_000 else targets
    keyed = sized.join(t, sized["source"].eqNullSafe(t["source"]), "left").drop(t["source"]).withColumn("_key", order_key(id_col, seed))
    buckets = F.least(F.greatest(F.ceil(F.col("source_rows") / ROWS_PER_BUCKET), F.lit(1)), F.lit(16**_DIGITS))
    lead = F.conv(F.substring("_key", 1, _DIGITS), 16, 10).cast("long")
    keyed = keyed.withColumn("_bucket", F.floor(lead * buckets / 16**_DIGITS))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")), "buckets")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", id_col).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s = sums.withColumnsRenamed({"source": "_source", "_bucket": "_b"})
    joined = keyed.join(s, keyed["source"].eqNullSafe(s["_source"]) & (keyed["_bucket"] == s["_b"]), "left")
    return joined.withColumn("start", F.col("_before") + F.col("_within")).drop("_source", "_b", "_bucket", "_before", "_within", "_key")


def taken_in_pass(p: int) -> Column:
    """Words that pass ``p`` takes of a document: those of its span that lie below the target, rounded to words."""
    left = F.round("target").cast("long") - F.lit(p) * F.col("source_size") - F.col("start")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))


def demand_curve(knots: Column) -> Column:
    """Knots (t, rate) with the normalised rate and the cumulative demand at each knot; a level schedule where there is no area."""
    level = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(1.0).alias("rate")) for t in (0, 1)])
    knots = F.array_sort(F.transform(
        F.filter(knots, lambda k: k["t"].isNotNull()),
        lambda k: F.struct(k["t"].cast("double").alias("t"), F.greatest(F.coalesce(k["rate"].cast("double"), F.lit(0.0)), F.lit(0.0)).alias("rate")),
    ))

    def pieces(x: Column) -> Column:  # area of each piece by the trapezoid rule
        return F.transform(
            x,
            lambda k,
            i: F.when(i == 0, F.lit(0.0)).otherwise((k["t"] - F.get(x, i - 1)["t"]) * (k["rate"] + F.get(x, i - 1)["rate"]) / 2),
        )

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    knots = F.when(total(pieces(knots)) > 0, knots).otherwise(level)
    step = pieces(knots)
    return F.transform(
        knots,
        lambda k,
        i: F.struct(k["t"].alias("t"), (k["rate"] / total(step)).alias("rate"), (total(F.slice(step, 1, i + 1)) / total(step)).alias("area")),
    )


def invert_demand(curve: Column, u: Column) -> Column:
    """The time at which the cumulative demand reaches ``u`` (0 to 1)."""
    below = F.greatest(F.size(F.filter(curve, lambda k: k["area"] <= u)), F.lit(1))
    i = F.least(below, F.size(curve) - 1)
    a, b = F.element_at(curve, i), F.element_at(curve, i + 1)
    slope = F.coalesce(F.try_divide(b["rate"] - a["rate"], b["t"] - a["t"]), F.lit(0.0))
    need = u - a["area"]
    root = a["rate"] + F.sqrt(F.greatest(a["rate"] * a["rate"] + 2 * slope * need, F.lit(0.0)))
    return F.least(a["t"] + F.when(root > 0, F.try_divide(2 * need, root)).otherwise(0.0), b["t"])


def default_knots(weight: Column, weights: list[float]) -> Column:
    """Heavier sources fade out over training, the lightest grows, those between stay level."""
    hi, lo = max(weights), min(weights)
    ends = F.when(weight >= hi, F.array(F.lit(1.5), F.lit(0.5))).when(weight <= lo, F.array(F.lit(0.5), F.lit(1.5))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    return F.array(*[F.struct(F.lit(float(t)).alias("t"), F.element_at(ends, t + 1).alias("rate")) for t in (0, 1)])


def mix(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    max_passes: int = 2,
    knots: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-",
    every: bool = False,
) -> DataFrame:
    """One row per document and pass that takes words of it, range-sorted by ``position`` (0 to 1).

    ``knots`` (source, knots array<struct<t, rate>>) gives the schedules; by default they follow the weights. Adds size, pass_no, taken
    and position. Where ``taken`` is less than the size, the text keeps its first ``taken`` words, joined by single spaces.
    With ``every``, documents that no pass takes follow at the end (pass_no and position null, taken 0), and source_size, target and start
    (the first token of the document within its source) are added as well.
    """
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    sized = docs.select(
        *[F.col(c).alias(x) for c, x in own.items()],
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
    )
    small = staged(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "sizes")
    targets = staged(source_targets(small, weights, share, max_passes), "targets")
    placed = offsets(sized, targets, "_id", seed)
    curve = default_knots(F.col("weight"), weights)
    if knots is not None:
        k = F.broadcast(knots) if knots.count() <= 100_000 else knots
        k = k.select(F.col("source").alias("_ks"), F.col("knots").alias("_knots"))
        placed = placed.join(k, placed["source"].eqNullSafe(k["_ks"]), "left").drop("_ks")
        curve = F.coalesce(F.col("_knots"), curve)
    passes = F.filter(
        F.array(*[F.struct(F.lit(p).alias("pass_no"), taken_in_pass(p).alias("taken")) for p in range(max_passes)]),
        lambda x: x["taken"] > 0,
    )
    if every:
        rows = placed.withColumn("_p", F.explode_outer(passes)).select(
            "*",
            "_p.pass_no",
            F.coalesce("_p.taken", F.lit(0).cast("long")).alias("taken"),
        )
    else:
        rows = placed.withColumn("_p", F.explode(passes)).select("*", "_p.pass_no", "_p.taken")
    u = F.try_divide(F.col("pass_no") * F.col("source_size") + F.col("start"), F.col("target"))
    rows = rows.withColumn("_curve", demand_curve(curve)).withColumn("position", invert_demand(F.col("_curve"), u))
    text = F.col(own[text_col])
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int")), " ")
    added = ("size", "pass_no", "taken", "position", *(("source_size", "target", "start") if every else ()))
    cut = F.when(F.col("taken") < F.col("size"), first).otherwise(text)
    keep = [cut.alias(c) if c == text_col else F.col(own[c]).alias(c) for c in docs.columns if c not in added]
    order = [F.col("position").asc_nulls_last() if every else F.col("position"), F.col("_id"), F.col("pass_no")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(*keep, *added)


def mix_summary(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    max_passes: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix-",
) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's) and taken, summed over the passes of the mix.

    These are the rows of the mix itself, in training order, summed by document: one with words is alone at its start within its source, so
    repeated ids stay apart. The texts of the mix are not read here, so the optimiser leaves them out of its shuffles.
    """
    mixed = mix(docs, weights, share, max_passes, None, id_col, text_col, source_col, seed, every=True)
    facts = ("size", "source_size", "target")
    # documents without words may share a start: as many rows as there are of them
    taken = mixed.groupBy(
        id_col,
        source_col,
        "start",
        *facts,
        F.col("pass_no").isNull().alias("_none"),
    ).agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("_rows"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_none"), F.col("_rows")).otherwise(F.lit(1))))
    return taken.withColumn("_copy", copies).select(id_col, *facts, "taken")

"""Control year of a site: representative in temperature, with few and short gaps in night flux."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoflux.operators.aggregates import coverage_summary, day_light, gap_runs, gap_summary, night_status, nights_seen
from thermoflux.operators.windows import average_rank, pick_first
from thermoflux.sources.io import stored

KEYS = ("site_id", "growing_year")
# The texts of ``reason`` that readers of the result tables know.
INITIAL = "initial_equal_weight_selection"
REPLACED = "replacement_for_gap_longer_than_threshold"
KEPT = "initial_year_kept_no_acceptable_alternative"


def yearly_table(ac: DataFrame, nights: DataFrame, seasons: DataFrame) -> DataFrame:
    """One row a site and year with a complete temperature in both tables: mean_TS, coverage and gaps, the three ranks and their sum.

    ``ac``: site_id, growing_year, DOY, TS, daytime; ``nights``: site_id, growing_year, DOY, NEE; ``seasons``: site_id, gStart, gEnd."""
    # one pass over either table leaves a row a day, from which all else follows
    days = stored(day_light(ac.select(*KEYS, "DOY", "TS", "daytime")), "days")
    seen = stored(nights_seen(nights.select(*KEYS, "DOY", "NEE")), "night-days")
    years = days.select(*KEYS).distinct().join(seen.select(*KEYS).distinct(), list(KEYS), "left_semi")
    s = seasons.select("site_id", "gStart", "gEnd")
    own = days.join(s, "site_id").filter(F.col("DOY").between(F.col("gStart"), F.col("gEnd"))).join(years, list(KEYS), "left_semi")
    temp = own.groupBy(*KEYS).agg(F.when(F.sum("_known") == F.sum("_rows"), F.sum("_sum") / F.sum("_rows")).alias("mean_TS")).filter("mean_TS IS NOT NULL AND NOT isnan(mean_TS)")
    status = stored(night_status(own, seen), "status")
    gaps = gap_summary(gap_runs(status))
    t = temp.join(coverage_summary(status), list(KEYS), "left").join(gaps, list(KEYS), "left")
    t = t.withColumns({
        "gap_lengths": F.coalesce("gap_lengths", F.lit("none")),
        "max_gap": F.coalesce("max_gap", F.lit(0)),
        "gap_burden": F.coalesce("gap_burden", F.lit(0)),
    })
    t = stored(t, "years")
    target = t.groupBy("site_id").agg(F.percentile("mean_TS", F.lit(0.5)).alias("target_TS"))
    t = t.join(target, "site_id").withColumn("distance", F.abs(F.col("mean_TS") - F.col("target_TS")))
    for name, c in (("temperature_rank", "distance"), ("burden_rank", "gap_burden"), ("max_gap_rank", "max_gap")):
        t = t.withColumn(name, average_rank(F.col(c), ["site_id"], c))
    return t.withColumn("initial_score", F.col("temperature_rank") + F.col("burden_rank") + F.col("max_gap_rank"))


def control_year(table: DataFrame, long_gap: int = 14, gap_weight: float = 4.0) -> DataFrame:
    """(site_id, control_year, initial_year, reason) from ``yearly_table``.

    The best sum of ranks wins (ties: burden, distance, year). If that year has a gap longer than ``long_gap``, the best of the other years
    without one and without unknown days, weighing the burden by ``gap_weight``, takes its place if there is any."""
    ties = ["gap_burden", "distance", "growing_year"]
    first = pick_first(table, ["site_id"], ["initial_score", *ties]).select(
        "site_id",
        F.col("growing_year").alias("initial_year"),
        F.col("max_gap").alias("_gap"),
    )
    t = table.join(first, "site_id").filter((F.col("growing_year") != F.col("initial_year")) & (F.col("_gap") > long_gap) & (F.col("max_gap") <= long_gap) & (F.col("unknown_days") == 0))
    t = t.withColumn("_score", F.col("temperature_rank") + gap_weight * F.col("burden_rank") + F.col("max_gap_rank"))
    other = pick_first(t, ["site_id"], ["_score", *ties]).select("site_id", F.col("growing_year").alias("_other"))
    out = first.join(other, "site_id", "left")
    reason = F.when(F.col("_gap") <= long_gap, INITIAL).when(
        F.col("_other").isNotNull(),
        REPLACED,
    ).otherwise(KEPT)
    return out.select("site_id", F.coalesce("_other", "initial_year").alias("control_year"), "initial_year", reason.alias("reason"))

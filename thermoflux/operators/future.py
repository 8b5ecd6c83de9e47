"""Present and future respiration of a site under monthly warming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.operators.curves import BOUNDS, er_curve
from thermoflux.operators.joins import months_to_rows, range_join
from thermoflux.operators.regression import fill_by_regression, simple_regression
from thermoflux.operators.windows import candidate_years, interpolate_linear, pick_first
from thermoflux.sources.io import stored

#: Lower bound of beta in this job (fixed value).
FUTURE_BOUNDS = {**BOUNDS, "beta": (-0.02, 0.0)}


def curve_value(c0: Column, alpha: Column, beta: Column, t: Column) -> Column:
    return c0 * F.exp(alpha * t + beta * t * t)


def future_summary(df: DataFrame, response: DataFrame) -> DataFrame:
    """Site means from candidate years (site_id, YEAR, present, future, dTS): the year with the lowest future / present is left out,
    and the future is also scaled by exp(TAS * dTS). ``response``: site_id, TAS."""
    d = df.withColumn("_k", F.struct(F.try_divide(F.col("future"), F.col("present")), F.col("YEAR")))
    low = d.groupBy("site_id").agg(F.min_by("YEAR", "_k").alias("_low"), F.count(F.lit(1)).alias("_n"))
    d = d.join(low, "site_id").filter((F.col("_n") == 1) | (F.col("YEAR") != F.col("_low")))
    g = d.groupBy("site_id").agg(F.avg("present").alias("present"), F.avg("future").alias("future"), F.avg("dTS").alias("dTS"))
    return g.join(response.select("site_id", "TAS"), "site_id", "left").withColumn(
        "future_response",
        F.col("future") * F.exp(F.col("TAS") * F.col("dTS")),
    )


def widened(nights: DataFrame, windows: DataFrame, needed: int = 200, step: int = 7) -> DataFrame:
    """The rows with TS and NEE around each window and year, with ``extend_days``: the first of ``step``, 2 ``step`` .. days on either
    side that holds ``needed`` rows (a column of that name in ``windows`` goes first), or else the first beyond half the site's season."""
    least = F.col("needed") if "needed" in windows.columns else F.lit(needed)
    half = windows.groupBy("site_id").agg(((F.max("w_end") - F.min("w_start")) / 2).alias("_half"))
    most = ((F.floor(F.col("_half") / step) + 1) * step).cast("int")
    w = windows.join(half, "site_id").select("site_id", "window", "w_start", "w_end", least.alias("_needed"), most.alias("_most"))
    w = stored(w, "windows")
    nights = nights.dropna(subset=["TS", "NEE"])
    key = ["site_id", "window", "YEAR"]
    # one row a day meets the windows; a row itself only those that hold it after all
    days = nights.groupBy("site_id", "YEAR", "DOY").agg(F.count(F.lit(1)).alias("_n"))
    off = F.greatest(F.col("w_start") - F.col("DOY"), F.col("DOY") - F.col("w_end"), F.lit(1))
    wide = w.withColumns({"_a": F.col("w_start") - F.col("_most"), "_b": F.col("w_end") + F.col("_most")})
    rings = range_join(days, wide, "DOY", "_a", "_b").groupBy(*key, (F.ceil(off / step) * step).cast("int").alias("_e"), "_needed", "_most").agg(F.sum("_n").alias("_n"))
    inside = F.sum("_n").over(Window.partitionBy(*key).orderBy("_e"))
    g = rings.withColumn("_inside", inside).groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("_inside") >= F.col("_needed"), F.col("_e"))), F.max("_most")).alias("extend_days"))
    g = g.join(w.select("site_id", "window", "w_start", "w_end"), ["site_id", "window"])
    g = g.select(*key, "extend_days", (F.col("w_start") - F.col("extend_days")).alias("_a"), (F.col("w_end") + F.col("extend_days")).alias("_b"))
    return range_join(nights, stored(g, "widened"), "DOY", "_a", "_b", keys=("site_id", "YEAR")).drop("_a", "_b")


def night_course(nights: DataFrame) -> DataFrame:
    """(site_id, DOY, the times of day that ``nights`` has, MONTH, TA, TS): means over the years, of the earliest month where a day of the year falls into two.

    Holes in TA lie on a straight line between their neighbours, those in TS on the site's regression on TA."""
    at = ["DOY", *[c for c in ("HOUR", "MINUTE") if c in nights.columns]]
    mean = nights.groupBy("site_id", *at, "MONTH").agg(F.avg("TA").alias("TA"), F.avg("TS").alias("TS"))
    mean = pick_first(mean, ["site_id", *at], ["MONTH"])
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(*at)).cast("double")
    mean = interpolate_linear(mean.withColumn("_place", place), "TA", ["_place"], rows=None).drop("_place")
    return fill_by_regression(mean, "TS", "TA")


def future_respiration(
    nights: DataFrame,
    windows: DataFrame,
    warming: DataFrame,
    response: DataFrame,
    min_rows: int = 4,
    extend: int = 7,
    needed: int = 200,
    coldest: float = 1.0,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Per site: present and future night respiration over the season and its response-scaled future.

    ``nights``: site_id, YEAR, MONTH, DOY (HOUR, MINUTE), TS, TA, NEE; ``windows``: site_id, window, w_start, w_end (and needed, where sites differ); ``warming``: site_id, Tmin1..12;
    ``response``: site_id, TAS. Soil warms by the site's slope of TS on TA (above freezing) in ``rows`` (all rows; by default the nights). Curves are fitted for each window
    in the three candidate years on the days that ``widened`` finds around it where the soil is warmer than ``coldest``, and applied to the equally warm
    part of the window's ``night_course``, now and warmed. A time in two windows belongs to the later one."""
    clock = [c for c in ("HOUR", "MINUTE") if c in nights.columns]
    nights = stored(nights.select("site_id", "YEAR", "MONTH", "DOY", *clock, "TS", "TA", "NEE"), "nights")
    slope = simple_regression((nights if rows is None else rows).filter("TA > 0"), "TS", "TA").select("site_id", "slope")
    years = nights.groupBy("site_id", "YEAR").agg(F.count("NEE").alias("n"), F.avg("TS").alias("m"))
    years = stored(candidate_years(years, "n", "m").select("site_id", "YEAR"), "candidate-years")
    w = windows.select("site_id", "window", "w_start", "w_end")
    warm_rows = nights.filter(F.col("TS") > coldest).join(years, ["site_id", "YEAR"], "left_semi")
    near = stored(widened(warm_rows, windows, needed, extend), "widened")
    ref = near.groupBy("site_id", "window").agg(F.avg("TS").alias("TS"))
    fits = er_curve(
        near,
        ref,
        by=("site_id", "window", "YEAR"),
        min_rows=min_rows,
        bounds=FUTURE_BOUNDS,
    ).select("site_id", "window", "YEAR", "C0", "alpha", "beta")
    warm = months_to_rows(warming, "Tmin", value="dTA").withColumn("MONTH", F.col("MONTH").cast("bigint"))
    course = night_course(nights).filter(F.col("TS") > coldest)
    course = course.join(warm, ["site_id", "MONTH"]).join(slope, "site_id").withColumn("dTS", F.col("dTA") * F.col("slope"))
    days = pick_first(
        range_join(course, w, "DOY", "w_start", "w_end"),
        ["site_id", "DOY", *clock],
        [F.desc("window")],
    ).join(fits, ["site_id", "window"])
    t, warmer = F.col("TS"), F.col("TS") + F.col("dTS")
    p = (F.col("C0"), F.col("alpha"), F.col("beta"))
    per_year = days.groupBy("site_id", "YEAR").agg(
        F.avg(curve_value(*p, t)).alias("present"),
        F.avg(curve_value(*p, warmer)).alias("future"),
        F.avg("dTS").alias("dTS"),
    )
    return future_summary(per_year, response)

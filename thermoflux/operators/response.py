"""The total thermal response of respiration, from nights to one slope a site: the chain of window screen, coverage, adaptive window, curve,
reference respiration, ratio to the control year, outliers and autocorrelated regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoflux.operators.aggregates import extreme_outliers, window_reference
from thermoflux.operators.curves import adaptive_window, er_curve, ln_ratio, window_screen
from thermoflux.operators.joins import range_join
from thermoflux.operators.regression import thermal_response
from thermoflux.operators.windows import window_gap_check
from thermoflux.sources.io import stored


def site_years(
    df: DataFrame, nights: DataFrame, windows: DataFrame, ranges: DataFrame, control: DataFrame, needed: int = 100, min_rows: int = 100, direct: bool = False, use_swc: bool = True, min_missing: int = 5
) -> DataFrame:
    """(site_id, window, growing_year, extend_days, n, TS, C0, alpha, beta, ERref, lnRatio): a row for every screened window and year of the nights,
    failing ones with nulls from where they failed on; outliers of lnRatio are removed.

    ``df``: all rows (site_id, YEAR, DOY, TS and the columns of the curve); ``nights``: the complete nights, with NEE; ``windows``: site_id, window, w_start,
    w_end; ``ranges``: site_id, tStart, tEnd; ``control``: site_id, control_year. YEAR is the growing year."""
    xs = ["TS", *(["SWC"] if direct and use_swc else []), *(["GPP"] if direct else [])]
    key, by = ["site_id", "window", "YEAR"], ["site_id", "window"]
    nights = stored(nights.dropna(subset=[*xs, "NEE"]).select("site_id", "YEAR", "DOY", *xs, "NEE"), "nights")
    days = stored(df.groupBy("site_id", "YEAR", "DOY").agg(*[f(c).alias(f"_{n}_{c}") for c in xs for n, f in (("s", F.sum), ("k", F.count))], F.count(F.lit(1)).alias("_n")), "days")
    w = stored(windows.select("site_id", "window", "w_start", "w_end"), "windows")
    w = stored(w.join(window_screen(df, nights, w, ranges, min_rows, days=days).select(*by), by), "screened")
    years = stored(nights.select("site_id", "YEAR").distinct(), "years")
    # the window's mean conditions over all years, and its mean temperature each year (missing where any value is)
    days = range_join(days, w, "DOY", "w_start", "w_end")
    sums = stored(days.groupBy(*key).agg(*[F.sum(c).alias(c) for c in [*[f"_{n}_{c}" for c in xs for n in "sk"], "_n"]]), "window-sums")
    ref = stored(sums.groupBy(*by).agg(*[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_k_{c}")).alias(c) for c in xs]), "references")
    yearly = sums.select(*key, F.when(F.col("_k_TS") == F.col("_n"), F.col("_s_TS") / F.col("_n")).alias("TS"))
    covered = window_gap_check(nights.select("site_id", "YEAR", "DOY"), w, years).select(*key)
    tried = adaptive_window(nights, w, ref.select(*by, F.col("TS").alias("ts_ref")), needed, years=years)
    seen = covered.join(yearly.select(*key), key)  # a year needs temperatures and coverage to be tried
    tried = stored(tried.join(seen.withColumn("_ok", F.lit(True)), key, "left"), "tried")
    edges = tried.filter("kept AND _ok").join(w, by).select(*key, (F.col("w_start") - F.col("extend_days")).alias("_a"), (F.col("w_end") + F.col("extend_days")).alias("_b"))
    own = range_join(nights, stored(edges, "edges"), "DOY", "_a", "_b", keys=("site_id", "YEAR")).drop("_a", "_b")
    pooled = er_curve(range_join(nights, w, "DOY", "w_start", "w_end"), ref, direct, use_swc)
    names = ["C0", "alpha", "beta", *[c for c in ("Hs", "k2") if c in pooled.columns]]
    fits = er_curve(own, ref, direct, use_swc, by=tuple(key), priors=stored(pooled, "pooled")).select(*key, *names, "ERref")
    out = tried.select(*key, F.when(F.col("_ok"), F.col("extend_days")).alias("extend_days"), F.when(F.col("_ok"), F.col("n")).alias("n"))
    out = out.join(fits, key, "left").join(yearly, key, "left").withColumnRenamed("YEAR", "growing_year")
    out = stored(out.withColumn("TS", F.when(F.col("ERref").isNotNull() | F.col("C0").isNotNull(), F.col("TS"))), "site-years")
    ratios = ln_ratio(out, control)
    # outliers are rows that go, in windows with enough years that failed
    marked = extreme_outliers(ratios.withColumn("_kept", F.col("lnRatio")), "_kept", tuple(by), min_missing=min_missing)
    return marked.filter(F.col("_kept").isNotNull() | F.col("lnRatio").isNull()).drop("_kept")


def total_response(years: DataFrame) -> DataFrame:
    """(site_id, TAS, t, df, TASp, rho): the response over the rows of ``site_years``."""
    return thermal_response(years)

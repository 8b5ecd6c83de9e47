"""Climatologies, budgets, coverage and test statistics as grouped aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def doy_climatology(df: DataFrame, columns: list[str], by: tuple[str, ...] = ("site_id", "DOY")) -> DataFrame:
    """Means over all years: of all rows, of nights and of days (suffixes _night, _day)."""
    night = F.col("NIGHT") == 1
    out = []
    for c in columns:
        out += [F.avg(c).alias(c), F.avg(F.when(night, F.col(c))).alias(f"{c}_night"), F.avg(F.when(~night, F.col(c))).alias(f"{c}_day")]
    return df.groupBy(*by).agg(*out)


def two_level_climatology(df: DataFrame, column: str, site_col: str = "site_id") -> DataFrame:
    """(site, DOY, value, n_years): a mean for each year and day first, so that every year counts once."""
    daily = df.filter(F.col(column).isNotNull()).groupBy(site_col, "YEAR", "DOY").agg(F.avg(column).alias("_d"))
    return daily.groupBy(site_col, "DOY").agg(F.avg("_d").alias("value"), F.count("_d").alias("n_years"))


def diurnal_climatology(df: DataFrame, columns: list[str], site_col: str = "site_id") -> DataFrame:
    return df.groupBy(site_col, "DOY", "HOUR", "MINUTE").agg(*[F.avg(c).alias(c) for c in columns])


def season_temp_range(clim: DataFrame, seasons: DataFrame, column: str = "TS", site_col: str = "site_id") -> DataFrame:
    """2.5 % and 97.5 % points of the DOY means within the season."""
    own = clim.join(seasons, site_col).filter(F.col("DOY").between(F.col("gStart"), F.col("gEnd")))
    return own.groupBy(site_col).agg(F.percentile(column, F.lit(0.025)).alias("tStart"), F.percentile(column, F.lit(0.975)).alias("tEnd"))


def daytime_uptake(df: DataFrame, dt_minutes: float) -> DataFrame:
    """Daily net uptake by day, not below 0: the flux sum with the sign turned, as a daily mean flux."""
    total = F.sum(F.when(F.col("NIGHT") == 0, F.col("NEE")))
    return df.groupBy("site_id", "YEAR", "DOY").agg(F.greatest(-total * (dt_minutes * 60 / 86400), F.lit(0.0)).alias("uptake"))


def mean_if_complete(c: str) -> Column:
    """A mean that is null if any value is missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def season_mean_ts(df: DataFrame, start: Column, end: Column, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    own = df.filter(F.col("DOY").between(start, end)).groupBy(*by).agg(mean_if_complete("TS").alias("mean_TS"))
    return own.filter("mean_TS IS NOT NULL AND NOT isnan(mean_TS)")


def day_light(ac: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """One row a day: unknown_daytime, _night (some row is known as night), and _sum, _known, _rows of TS."""
    return ac.groupBy(*by, "DOY").agg(
        (F.count("daytime") == 0).alias("unknown_daytime"), F.coalesce(F.bool_or(~F.col("daytime")), F.lit(False)).alias("_night"),
        *([F.sum("TS").alias("_sum"), F.count("TS").alias("_known"), F.count(F.lit(1)).alias("_rows")] if "TS" in ac.columns else []),
    )


def nights_seen(nights: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """One row a day of the nights: _seen, whether a flux is there."""
    return nights.groupBy(*by, "DOY").agg((F.count("NEE") > 0).alias("_seen"))


def night_status(days: DataFrame, seen: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """``night_coverage`` from the days of ``day_light`` and ``nights_seen``."""
    out = days.join(seen, [*by, "DOY"], "left").select(
        *by,
        "DOY",
        "unknown_daytime",
        (F.col("unknown_daytime") | F.col("_night")).alias("has_night"),
        F.coalesce("_seen", F.lit(False)).alias("observed"),
    )
    return out.withColumn("is_gap", F.col("has_night") & ~F.col("observed"))


def night_coverage(ac: DataFrame, nights: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """For each day: unknown_daytime, has_night (unknown counts as night), observed (a flux of that night is there), is_gap."""
    return night_status(day_light(ac, by), nights_seen(nights, by), by)


def coverage_summary(status: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return status.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), n(~F.col("has_night")).alias("polar_days"), n(F.col("unknown_daytime")).alias("unknown_days"),
        n(F.col("has_night")).alias("expected_nights"), n(F.col("has_night") & F.col("observed")).alias("observed_nights"), n(F.col("is_gap")).alias("gap_nights"),
    )


def gap_runs(status: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """Runs of gap days: every other day ends a run (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("DOY").rowsBetween(Window.unboundedPreceding, 0)
    runs = status.withColumn("gap_run", F.sum(F.when(F.col("is_gap"), 0).otherwise(1)).over(w)).filter("is_gap")
    return runs.groupBy(*by, "gap_run").agg(F.min("DOY").alias("gap_start"), F.max("DOY").alias("gap_end"), F.count(F.lit(1)).alias("gap_days"))


def gap_summary(runs: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """Run lengths in order as text, the longest, and the sum of squares (long gaps weigh more)."""
    lengths = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gap_start", "gap_days"))), lambda x: x["gap_days"].cast("string")), ", ")
    return runs.groupBy(*by).agg(
        lengths.alias("gap_lengths"),
        F.max("gap_days").alias("max_gap"),
        F.sum(F.col("gap_days") * F.col("gap_days")).alias("gap_burden"),
    )


def year_gap_filter(gaps: DataFrame, season_length: Column, long_gap: int = 14, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """Years whose longest gap is under half the season and whose long gaps are under 70 % of it. ``gaps``: by, gap (days), season columns."""
    total = F.sum(F.when(F.col("gap") > long_gap, F.col("gap")).otherwise(0))
    out = gaps.groupBy(*by).agg(
        F.max("gap").alias("max_gap"),
        (total / F.first(season_length)).alias("long_share"),
        F.first(season_length).alias("_len"),
    )
    return out.filter((F.col("max_gap") < 0.5 * F.col("_len")) & (F.col("long_share") < 0.7)).drop("_len")


def annual_budget(df: DataFrame, factor: float, column: str = "NEE") -> DataFrame:
    """Mean over years of the annual sums (all, day, night) times ``factor``; an empty sum is 0."""
    night = F.col("NIGHT") == 1
    sums = {"all": F.col(column), "day": F.when(~night, F.col(column)), "night": F.when(night, F.col(column))}
    annual = df.groupBy("site_id", "YEAR").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()])
    return annual.groupBy("site_id").agg(*[(F.avg(k) * factor).alias(k) for k in sums])


def climatological_budget(clim: DataFrame, factor: float, column: str = "NEE", site_col: str = "site_id") -> DataFrame:
    """Sums (all, day, night) of a climatology whose holes are filled by straight lines, times ``factor``."""
    from thermoflux.operators.windows import interpolate_linear

    filled = interpolate_linear(clim, column, ["DOY"], by=(site_col, "NIGHT"), out="_v", rows=None)
    night = F.col("NIGHT") == 1
    return filled.groupBy(site_col).agg(
        (F.sum("_v") * factor).alias("all"), (F.sum(F.when(~night, F.col("_v"))) * factor).alias("day"), (F.sum(F.when(night, F.col("_v"))) * factor).alias("night")
    )


def temperature_metrics(df: DataFrame, column: str) -> DataFrame:
    """Mean of annual means, mean within-year sd, sd of annual means, mean daily range, mean seasonal range."""
    daily = df.groupBy("site_id", "YEAR", "DOY").agg((F.max(column) - F.min(column)).alias("range"), F.avg(column).alias("mean"))
    by_year = df.groupBy("site_id", "YEAR").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    seasonal = daily.groupBy("site_id", "YEAR").agg(F.avg("range").alias("daily_range"), (F.max("mean") - F.min("mean")).alias("season_range"))
    both = by_year.join(seasonal, ["site_id", "YEAR"])
    return both.groupBy("site_id").agg(
        F.avg("mean").alias("mean"), F.avg("sd").alias("sd_within"), F.stddev_samp("mean").alias("sd_between"), F.avg("daily_range").alias("daily_range"), F.avg("season_range").alias("season_range")
    )


def monthly_index(df: DataFrame, value: str, site_col: str = "site_id") -> DataFrame:
    return df.groupBy(site_col, "MONTH").agg(F.greatest(F.avg(value), F.lit(0.0)).alias("value"), F.count(value).alias("n"))


def site_index_means(monthlies: list[DataFrame], names: list[str], site_col: str = "site_id") -> DataFrame:
    """Mean over the months of each index, side by side."""
    means = [m.groupBy(site_col).agg(F.avg("value").alias(n)) for m, n in zip(monthlies, names, strict=True)]
    return reduce(lambda a, b: a.join(b, site_col, "full"), means)


def window_reference(joined: DataFrame, columns: list[str], by: tuple[str, ...] = ("site_id", "window")) -> DataFrame:
    return joined.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def fit_metrics(df: DataFrame, observed: str, predicted: str, by: tuple[str, ...] = ("site_id",)) -> DataFrame:
    e = F.col(observed) - F.col(predicted)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("RMSE"), F.pow(F.corr(observed, predicted), 2).alias("R2"), F.avg(F.abs(e)).alias("MAE"))


def ensemble_delta(models: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("cell", "MONTH")) -> DataFrame:
    """Mean over climate models less the baseline mean over years, by cell and month."""
    m = models.groupBy(*keys).agg(F.avg("value").alias("_m"))
    b = baseline.groupBy(*keys).agg(F.avg("value").alias("_b"))
    return m.join(b, list(keys)).select(*keys, (F.col("_m") - F.col("_b")).alias("delta"))


def neighbourhood_mean(grid: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a cell and its four rook neighbours, missing ones left out, for every cell of the grid (row, col, value)."""
    steps = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    spread = grid.withColumn("_s", F.explode(steps))
    spread = spread.select(*extra, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), "value")
    means = spread.groupBy(*extra, "row", "col").agg(F.avg("value").alias("mean5"))
    return grid.select(*extra, "row", "col").join(means, [*extra, "row", "col"])


# ---------------------------------------------------------------------------------- tests


def _beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz), element by element."""
    from math import lgamma

    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        log = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a2, b2, strict=True)]) + a2 * np.log(x2) + b2 * np.log1p(-x2)
        c, d = np.ones_like(x2), 1 - (a2 + b2) * x2 / (a2 + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for t in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + t * d) < tiny, tiny, 1 + t * d)
                c = np.where(np.abs(1 + t / c) < tiny, tiny, 1 + t / c)
                h = h * d * c
        value = np.where(x2 <= 0, 0.0, np.exp(log) * h / a2)
    return np.where(flip, 1 - value, value)


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    tv, dv = t.to_numpy(float)[ok], df.to_numpy(float)[ok]
    out[ok] = _beta_tail(dv / (dv + tv * tv), dv / 2, np.full(len(dv), 0.5))
    return pd.Series(out).where(ok, None)


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    ok = (f.notna() & (df1 > 0) & (df2 > 0)).to_numpy()
    out = np.full(len(f), np.nan)
    fv, a, b = (s.to_numpy(float)[ok] for s in (f, df1, df2))
    out[ok] = _beta_tail(b / (b + a * fv), b / 2, a / 2)
    return pd.Series(out).where(ok, None)


def one_sample_t(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, t and df against 0 for groups of three and more; p by ``with_p``."""
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_sd")).filter("n >= 3")
    return g.withColumn("t", F.try_divide(F.col("mean"), F.col("_sd") / F.sqrt("n"))).withColumn("df", F.col("n") - 1).drop("_sd")


def with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", t_tail(F.col("t"), F.col("df").cast("double")))


def significance_counts(df: DataFrame, x: str, p: str, by: tuple[str, ...] = (), level: float = 0.05) -> DataFrame:
    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    neg, pos, sig = F.col(x) < 0, F.col(x) > 0, F.col(p) < level
    return df.groupBy(*by).agg(n(neg).alias("n_neg"), n(pos).alias("n_pos"), n(neg & sig).alias("n_neg_sig"), n(pos & sig).alias("n_pos_sig"))


def variance_shares(df: DataFrame, x: str, y: str, total: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares of the variance of total = x + y: (var(x) + cov(x, y)) / var(total), and the same for y."""
    g = df.groupBy(*by).agg(F.var_samp(x).alias("_x"), F.var_samp(y).alias("_y"), F.covar_samp(x, y).alias("_c"), F.var_samp(total).alias("_t"))
    return g.select(
        *by,
        F.try_divide(F.col("_x") + F.col("_c"), F.col("_t")).alias(f"share_{x}"),
        F.try_divide(F.col("_y") + F.col("_c"), F.col("_t")).alias(f"share_{y}"),
    )


def one_way_anova(df: DataFrame, y: str, group: str, by: tuple[str, ...] = ()) -> DataFrame:
    """F, R2 and degrees of freedom of y by group, from the groups' counts, sums and sums of squares."""
    g = df.filter(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("m"),
        F.var_pop(y).alias("v"),
    )
    tot = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q")
    )
    between = F.col("q") - F.col("s") * F.col("s") / F.col("N")
    out = tot.withColumn("between", between).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("N") - F.col("k"))
    f = F.try_divide(F.try_divide(F.col("between"), F.col("df1")), F.try_divide(F.col("within"), F.col("df2")))
    return out.select(*by, "df1", "df2", f.alias("F"), F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("R2"))


def correlation_matrix(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, r, n) for each pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = [x for a, b in pairs for x in (F.corr(a, b).alias(f"r_{a}_{b}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n_{a}_{b}"))]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r_{a}_{b}").alias("r"), F.col(f"n_{a}_{b}").alias("n")) for a, b in pairs]))
    return wide.select(*by, rows.alias("_p")).select(*by, "_p.*")


def cor_test(corr: DataFrame) -> DataFrame:
    """t, df and p of the correlations of ``correlation_matrix``."""
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return with_p(corr.withColumns({"t": t, "df": F.col("n") - 2}))


def estimator_summary(reps: DataFrame, components: list[str], by: tuple[str, ...] = ("scenario",), z: float = 1.96) -> DataFrame:
    """Mean, sd, bias, RMSE and 95 % coverage of est_<c> with se_<c> against true_<c>, by component."""
    parts = F.explode(F.array(*[F.struct(
        F.lit(c).alias("component"),
        F.col(f"est_{c}").alias("est"),
        F.col(f"se_{c}").alias("se"),
        F.col(f"true_{c}").alias("truth"),
    ) for c in components]))
    long = reps.select(*by, parts.alias("_p")).select(*by, "_p.*")
    e = F.col("est") - F.col("truth")
    hit = F.when(F.abs(e) <= z * F.col("se"), 1.0).otherwise(0.0)
    return long.groupBy(*by, "component").agg(
        F.avg("truth").alias("truth"), F.avg("est").alias("mean_est"), F.stddev_samp("est").alias("sd_est"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(hit).alias("coverage")
    )


def weighted_year_mean(df: DataFrame, x: str = "lnRatio", weight: str = "ERref", by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    ok = F.col(x).isNotNull() & F.col(weight).isNotNull()
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, F.col(x) * F.col(weight))), F.sum(F.when(ok, F.col(weight)))).alias(x))


def class_counts(df: DataFrame, cls: str, residual: str | None = None) -> DataFrame:
    extra = [F.avg(F.abs(residual)).alias("mean_abs_residual")] if residual else []
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), *extra)


def repeated_median_slope(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Median over points of the median slope to the other points of the series (short series: one row a year)."""
    p = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    other = p.select(*by, F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    pairs = p.join(other, list(by)).filter("_x <> _x2")
    own = pairs.groupBy(*by, "_x", "_y").agg(F.percentile((F.col("_y2") - F.col("_y")) / (F.col("_x2") - F.col("_x")), F.lit(0.5)).alias("_s"))
    return own.groupBy(*by).agg(F.percentile("_s", F.lit(0.5)).alias("slope"))


def _hash_number(*parts: Column | str) -> Column:
    """A number from 0 to 16**7 - 1 that only the texts of ``parts`` decide."""
    text = F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def repeated_median_test(
    df: DataFrame,
    x: str,
    y: str,
    by: tuple[str, ...] = ("site_id",),
    boot: int = 1000,
    perm: int = 1000,
    seed: str = "trend",
) -> DataFrame:
    """(by, slope, ci_low, ci_high, p_perm): the repeated-median slope with its bootstrap interval (2.5 and 97.5 % points) and
    the share of permutations of y whose slope is at least as steep.

    Every resample and permutation is a set of rows named by its replicate; draws and orders come from hashes, so reruns agree. Resamples with one
    x only have no slope and do not count. The series are short (one row a year), the replicates are what Spark spreads."""
    p = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    w = Window.partitionBy(*by).orderBy("x", "y")
    p = p.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    own = p.select(*by, F.col("_i").alias("_j"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    drawn = p.select(*by, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(boot - 1))).alias("_rep"))
    drawn = drawn.withColumn("_j", (_hash_number(F.lit(seed), F.lit("draw"), *by, "_rep", "_i") % F.col("_n")).cast("int"))
    drawn = drawn.join(own, [*by, "_j"]).select(*by, "_rep", "_i", F.col("_px").alias("x"), F.col("_py").alias("y"))
    mixed = p.select(*by, "_i", "x", F.explode(F.sequence(F.lit(0), F.lit(perm - 1))).alias("_rep"))
    order = Window.partitionBy(*by, "_rep").orderBy(_hash_number(F.lit(seed), F.lit("mix"), *by, "_rep", "_i"), "_i")
    mixed = mixed.withColumn("_j", F.row_number().over(order) - 1).join(own, [*by, "_j"]).select(*by, "_rep", "_i", "x", F.col("_py").alias("y"))

    def slopes(rows: DataFrame) -> DataFrame:
        key = [*by, "_rep"]
        other = rows.select(*key, F.col("x").alias("_x2"), F.col("y").alias("_y2"))
        pairs = rows.join(other, key).filter("x <> _x2")
        each = pairs.groupBy(*key, "_i").agg(F.percentile((F.col("_y2") - F.col("y")) / (F.col("_x2") - F.col("x")), F.lit(0.5)).alias("_s"))
        return each.groupBy(*key).agg(F.percentile("_s", F.lit(0.5)).alias("_slope"))

    slope = repeated_median_slope(df, x, y, by)
    ci = slopes(drawn).groupBy(*by).agg(F.percentile("_slope", F.lit(0.025)).alias("ci_low"), F.percentile("_slope", F.lit(0.975)).alias("ci_high"))
    share = slopes(mixed).join(slope, list(by)).groupBy(*by).agg(F.avg((F.abs("_slope") >= F.abs("slope") - 1e-12).cast("double")).alias("p_perm"))
    return slope.join(ci, list(by), "left").join(share, list(by), "left")


def extreme_outliers(df: DataFrame, x: str, by: tuple[str, ...], coef: float = 3.0, least: float = 1.5, min_missing: int = 5) -> DataFrame:
    """Values beyond ``coef`` hinge widths from Tukey's hinges and above ``least`` in size become null.

    Only in groups with ``min_missing`` and more missing values (pass 0 for all groups)."""
    missing = df.groupBy(*by).agg(F.count(F.when(F.col(x).isNull(), 1)).alias("_missing"))
    # equal values are counted first; each then fills the places up to its running sum
    values = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    size = df.groupBy(*by).agg(F.count(x).alias("_n"))
    places = values.withColumn("_upto", upto).join(size, list(by))
    n = F.col("_n")
    depth = (F.floor((n + 1) / 2) + 1) / 2  # of the hinges, from either end

    def at(d: Column) -> Column:
        def holds(place: Column) -> Column:
            return (place > F.col("_upto") - F.col("_k")) & (place <= F.col("_upto"))

        return (F.max(F.when(holds(F.floor(d)), F.col("_x"))) + F.max(F.when(holds(F.ceil(d)), F.col("_x")))) / 2

    hinges = places.groupBy(*by).agg(at(depth).alias("_lo"), at(n + 1 - depth).alias("_hi"))
    out = df.join(missing.join(hinges, list(by), "left"), list(by))
    width = coef * (F.col("_hi") - F.col("_lo"))
    far = ((F.col(x) < F.col("_lo") - width) | (F.col(x) > F.col("_hi") + width)) & (F.abs(x) > least) & (F.col("_missing") >= min_missing)
    return out.withColumn(x, F.when(~F.coalesce(far, F.lit(False)), F.col(x))).drop("_lo", "_hi", "_missing")

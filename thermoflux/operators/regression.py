"""Least squares by group: sums of products are aggregated by Spark, a small closed solve follows for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoflux.operators.aggregates import f_tail, t_tail
from thermoflux.operators.joins import range_join, small
from thermoflux.operators.windows import previous_means, trailing_means
from thermoflux.sources.io import stored


def ols(df: DataFrame, y: str, xs: list[str], by: tuple[str, ...] = ("site_id",), min_rows: int = 3) -> DataFrame:
    """(by, n, coef array: intercept first, r2, se array) of complete rows, for groups of ``min_rows`` and more.

    Only means and covariances travel, from one pass over the rows: one row a group, whatever the group's size."""
    ok = df.dropna(subset=[y, *xs])
    z = [F.col(c).cast("double") for c in [*xs, y]]
    k = len(z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in z]).alias("_means"), F.array(*[F.covar_pop(z[i], z[j]) for i, j in pairs]).alias("_sums")
    ).filter(F.col("n") >= min_rows)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for n, m, s in zip(p["n"], p["_means"], p["_sums"], strict=True):
                g = np.zeros((k, k))
                for (i, j), v in zip(pairs, s, strict=True):
                    g[i, j] = g[j, i] = v * n
                a, b, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
                inv = np.linalg.pinv(a, hermitian=True)
                beta = inv @ b
                rss = max(yy - beta @ b, 0.0)
                df_ = n - k
                var = rss / df_ if df_ > 0 else np.nan
                m = np.asarray(m)
                se0 = np.sqrt(var * (1 / n + m[:-1] @ inv @ m[:-1]))
                out.append(([m[-1] - beta @ m[:-1], *beta], 1 - rss / yy if yy > 0 else np.nan, [se0, *np.sqrt(np.maximum(var * np.diag(inv), 0))]))
            q = p[[*by, "n"]].copy()
            q["coef"], q["r2"], q["se"] = [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]
            yield q

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.schema if f.name in by)
    fitted = sums.mapInPandas(solve, f"{keys}n long, coef array<double>, r2 double, se array<double>")
    return fitted.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def predict(coef: Column, xs: list[str]) -> Column:
    out = F.element_at(coef, 1)
    for i, x in enumerate(xs):
        out = out + F.element_at(coef, i + 2) * F.col(x)
    return out


def simple_regression(df: DataFrame, y: str, x: str, by: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """(by, n, slope, intercept, r2) with one regressor, by built-in aggregates only."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def fill_by_regression(df: DataFrame, y: str, x: str, by: tuple[str, ...] = ("site_id",), train: Column | None = None) -> DataFrame:
    """Missing y from the group's regression on x."""
    fit = simple_regression(df if train is None else df.filter(train), y, x, by).select(
        *by,
        F.col("slope").alias("_b"),
        F.col("intercept").alias("_a"),
    )
    return df.join(fit, list(by), "left").withColumn(y, F.coalesce(y, F.col("_a") + F.col("_b") * F.col(x))).drop("_a", "_b")


#: Predictors of soil temperature: air temperature, and its means over the day and the eight days before a row.
_PREVIOUS = ["TA", "_d1", "_d8"]


def _with_previous(df: DataFrame, per_day: int, order: list[str]) -> DataFrame:
    return previous_means(df, "TA", {"_d1": per_day, "_d8": 8 * per_day}, ["site_id"], order)


def _trained(w: DataFrame, config: DataFrame, stamp: str) -> DataFrame:
    """Rows within the site's training dates and warmer than its least temperature; limits that are null do not count."""
    c = config.select("site_id", F.to_date("start").alias("_s"), F.to_date("end").alias("_e"), F.col("ta_min").cast("double").alias("_t"))
    day = F.to_date(stamp)
    keep = (F.col("_s").isNull() | (day >= F.col("_s"))) & (F.col("_e").isNull() | (day <= F.col("_e"))) & (F.col("_t").isNull() | (F.col("TA") > F.col("_t")))
    return w.join(small(c), "site_id").filter(keep).drop("_s", "_e", "_t")


def _replaced(w: DataFrame, fit: DataFrame, known: DataFrame, min_rows: int) -> DataFrame:
    """The series of every site with a model overwritten as a whole, TS_QC as TA_QC where there is one, and TS_status: replaced, too_few
    (fewer than ``min_rows`` training rows: the series stays), not_configured."""
    d = w.join(small(known.select("site_id", F.lit(True).alias("_known")).distinct()), "site_id", "left")
    d = d.join(small(fit), "site_id", "left")
    done = F.col("coef").isNotNull()
    out = d.withColumns({
        "TS": F.when(done, predict(F.col("coef"), _PREVIOUS)).otherwise(F.col("TS")),
        "TS_status": F.when(done, "replaced").when(F.col("_known"), "too_few").otherwise("not_configured"),
        **({"TS_QC": F.when(done, F.col("TA_QC")).otherwise(F.col("TS_QC") if "TS_QC" in w.columns else F.lit(None))} if "TA_QC" in w.columns else {}),
    })
    return out.drop("coef", "_known", "_d1", "_d8")


def soil_temperature(df: DataFrame, config: DataFrame, per_day: int, order: list[str], min_rows: int = 30) -> DataFrame:
    """TS of the configured sites, wholly replaced by its regression on TA and the means of TA over the day and the eight days before a row
    (the row itself left out; its own TA where there is none). Adds TS_status.

    ``config``: site_id, start, end (training dates, inclusive) and ta_min (TA must be above); each may be null."""
    w = stored(_with_previous(df, per_day, order), "previous-means")
    fit = stored(ols(_trained(w, config, order[0]), "TS", _PREVIOUS, ("site_id",), min_rows).select("site_id", "coef"), "models")
    return _replaced(w, fit, config, min_rows)


def reconstruct_from_donors(df: DataFrame, donors: DataFrame, per_day: int, order: list[str], config: DataFrame | None = None, min_rows: int = 4) -> DataFrame:
    """TS of target sites from one regression pooled over their donors. ``donors``: target, donor (one row a pair). Adds TS_status.

    A donor's rows are those of its own ``config`` (as for ``soil_temperature``); without one, all with TA above 0."""
    w = stored(_with_previous(df, per_day, order), "previous-means")
    own = donors.select(F.col("donor").alias("site_id")).distinct()
    limits = own.withColumns({"start": F.lit(None).cast("date"), "end": F.lit(None).cast("date"), "ta_min": F.lit(0.0)})
    if config is not None:
        c = config.select("site_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"), F.col("ta_min").cast("double").alias("ta_min"))
        limits = limits.join(c, "site_id", "left_anti").unionByName(c.join(own, "site_id", "left_semi"))
    pooled = _trained(w, limits, order[0]).join(small(donors.withColumnRenamed("donor", "site_id")), "site_id")
    fit = stored(ols(pooled, "TS", _PREVIOUS, ("target",), min_rows).select(F.col("target").alias("site_id"), "coef"), "models")
    return _replaced(w, fit, donors.select(F.col("target").alias("site_id")), min_rows)


def repair_periods(df: DataFrame, bad: DataFrame, per_day: int, order: list[str], margin: int = 30, min_rows: int = 100) -> DataFrame:
    """TS of bad periods (site_id, YEAR, DOY_start, DOY_end) from a model of their season in all years.

    A period's model is trained on the days within ``margin`` of it in any year, without any bad period, where QC is 0 or 1.
    Adds TS_repair_flag (1 where replaced; QC becomes 1 there). Periods with too few rows stay as they are."""
    xs = ["TA", "_d1", "_d8"]
    w = trailing_means(df, "TA", {"_d1": per_day, "_d8": 8 * per_day}, ["site_id"], order)
    p = bad.select("site_id", F.col("YEAR").alias("_by"), F.col("DOY_start").alias("_a"), F.col("DOY_end").alias("_b"))
    p = stored(p.withColumn("_p", F.xxhash64("site_id", "_by", "_a", "_b")), "periods")
    days = stored(df.select("site_id", "YEAR", "DOY").distinct(), "days")
    flags = range_join(days, p, "DOY", "_a", "_b").filter("YEAR = _by").groupBy("site_id", "YEAR", "DOY").agg(F.min("_p").alias("_p"))
    w = stored(w.join(small(stored(flags, "flags")), ["site_id", "YEAR", "DOY"], "left"), "flagged")
    around = p.select("site_id", F.col("_p").alias("_q"), (F.col("_a") - margin).alias("_lo"), (F.col("_b") + margin).alias("_hi"))
    train = range_join(w.filter(F.col("_p").isNull() & F.col("QC").isin(0, 1)), around, "DOY", "_lo", "_hi")
    fit = stored(ols(train, "TS", xs, ("site_id", "_q"), min_rows).select("site_id", F.col("_q").alias("_p"), "coef"), "models")
    out = w.join(small(fit), ["site_id", "_p"], "left")
    value = predict(F.col("coef"), xs)
    done = value.isNotNull()
    out = out.withColumn("_v", value).withColumns({"TS_repair_flag": F.when(done, 1).otherwise(0), "QC": F.when(done, 1).otherwise(F.col("QC"))})
    return out.withColumn("TS", F.coalesce("_v", "TS")).drop("_p", "coef", "_d1", "_d8", "_v")


def warming_rate(annual: DataFrame, y: str = "TA", year: str = "YEAR", by: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """(by, n, slope, t) of annual means against the year; ``with_slope_p`` adds p."""
    g = simple_regression(annual, y, year, by)
    t = F.signum("slope") * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    return g.select(*by, "n", "slope", t.alias("t"))


def with_slope_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", t_tail(F.col("t"), (F.col("n") - 2).cast("double")))


def multiple_regression(df: DataFrame, y: str, xs: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The coefficient table of y on xs: (by, term, estimate, se, t, p, vif, n, df, r2, sigma, f, f_p), a row for the intercept and each variable.

    One pass: means and covariances of the complete rows (stable, map-side combined), one row a group. Coefficients, errors and r2 come from the covariance
    matrix; every variance inflation is the diagonal of the inverse correlation matrix. Groups with fewer rows than coefficients + 1, or with
    variables that others determine, have nulls."""
    cols = [*xs, y]
    k = len(xs)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    ok = df.dropna(subset=cols)
    sums = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("_m"), F.array(*[F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) for i, j in pairs]).alias("_c")
    )
    names = ["(intercept)", *xs]

    def solve(n: int, m: np.ndarray, c: np.ndarray) -> list[dict]:
        g = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, c, strict=True):
            g[i, j] = g[j, i] = v
        sd = np.sqrt(np.diag(g))
        rows = [{"term": t, "n": n, "df": n - k - 1} for t in names]
        if n <= k + 1 or not (sd[:-1] > 0).all():
            return rows
        r = g / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
        if np.linalg.cond(r[:-1, :-1]) > 1e12:
            return rows
        inverse = np.linalg.inv(r[:-1, :-1])
        beta = (inverse @ r[:-1, -1]) * sd[-1] / sd[:-1]
        cov = inverse / np.outer(sd[:-1], sd[:-1]) / n  # of the coefficients, but for the variance of the errors
        rss = max(n * (g[-1, -1] - beta @ g[:-1, -1]), 0.0)
        var = rss / (n - k - 1)
        r2 = 1 - rss / (n * g[-1, -1]) if g[-1, -1] > 0 else None
        estimate = [m[-1] - beta @ m[:-1], *beta]
        se = np.sqrt(np.array([var * (1 / n + m[:-1] @ cov @ m[:-1]), *(var * np.diag(cov))]))
        for i, row in enumerate(rows):
            row |= {"estimate": estimate[i], "se": se[i], "t": estimate[i] / se[i] if se[i] > 0 else None, "vif": inverse[i - 1, i - 1] if i else None, "r2": r2, "sigma": np.sqrt(var)}
            row["f"] = r2 / k / ((1 - r2) / (n - k - 1)) if r2 is not None and r2 < 1 else None
        return rows

    numbers = ["estimate", "se", "t", "vif", "r2", "sigma", "f"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = [{c: row[c] for c in by} | term for row in p.to_dict("records") for term in solve(int(row["n"]), np.asarray(row["_m"]), np.asarray(row["_c"]))]
            yield pd.DataFrame(out, columns=[*by, "term", "n", "df", *numbers]).astype(dict.fromkeys(numbers, float))

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.schema if f.name in by)
    table = sums.filter("n > 0").mapInPandas(work, f"{keys}term string, n long, df long, " + ", ".join(f"{c} double" for c in numbers))
    table = table.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    table = table.withColumns({"p": t_tail(F.col("t"), F.col("df").cast("double")), "f_p": f_tail(F.col("f"), F.lit(float(k)), F.col("df").cast("double"))})
    return table.select(*by, "term", "estimate", "se", "t", "p", "vif", "n", "df", "r2", "sigma", "f", "f_p")


def vif(df: DataFrame, xs: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, variable, vif): variance inflation of each regressor, from one pass over the complete rows of ``xs``."""
    table = multiple_regression(df.dropna(subset=xs).withColumn("_y", F.col(xs[0])), "_y", xs, by)
    return table.filter("term <> '(intercept)'").select(*by, F.col("term").alias("variable"), "vif")


def soil_carbon_blend(df: DataFrame, observed: str, mapped: str) -> DataFrame:
    """Observed carbon where it is there, else the map's value calibrated by their regression."""
    fit = df.agg(F.regr_slope(observed, mapped).alias("_b"), F.regr_intercept(observed, mapped).alias("_a"))
    return df.crossJoin(F.broadcast(fit)).withColumn("carbon", F.coalesce(observed, F.col("_a") + F.col("_b") * F.col(mapped))).drop("_a", "_b")


# ---------------------------------------------------------------------------------- autocorrelated errors


def _gls(y: np.ndarray, x: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], rho: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Restricted log likelihood, coefficients, their unscaled covariance and the residual variance at one rho."""
    xtx, xty, yty, logdet = np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1]), 0.0, 0.0
    for at, years in blocks:
        v = rho ** np.abs(years[:, None] - years[None, :])
        chol = np.linalg.cholesky(v)
        a, b = np.linalg.solve(chol, x[at]), np.linalg.solve(chol, y[at])
        xtx += a.T @ a
        xty += a.T @ b
        yty += b @ b
        logdet += 2 * np.log(np.diag(chol)).sum()
    beta = np.linalg.solve(xtx, xty)
    n, p = x.shape
    s2 = max(yty - beta @ xty, 1e-300) / (n - p)
    like = -0.5 * ((n - p) * np.log(s2) + logdet + np.linalg.slogdet(xtx)[1])
    return like, beta, np.linalg.inv(xtx), s2


def thermal_response(
    df: DataFrame,
    y: str = "lnRatio",
    x: str = "TS",
    window: str = "window",
    year: str = "growing_year",
    site_col: str = "site_id",
) -> DataFrame:
    """(site, TAS, t, df, TASp, rho): slope of y on x with window intercepts and errors that follow rho ** |years apart| within a window.

    Restricted likelihood over rho in [0, 1), by a grid and two refinements. One site's rows (windows x years) are one group."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=[y, x, window, year]).groupby([window, year], as_index=False)[[y, x]].mean()
        names = sorted(d[window].unique())
        dummy = np.stack([np.ones(len(d)), d[x].to_numpy(float), *[(d[window] == n).to_numpy(float) for n in names[1:]]], axis=1)
        key = pdf[site_col].iloc[0]
        if len(d) <= dummy.shape[1] or np.linalg.matrix_rank(dummy) < dummy.shape[1]:
            return pd.DataFrame({
                site_col: [key],
                "TAS": [None],
                "t": [None],
                "df": [len(d) - dummy.shape[1]],
                "rho": [None],
            }).astype({"TAS": float, "t": float, "rho": float})
        blocks = [(np.flatnonzero(d[window] == n), d[year].to_numpy(float)[d[window] == n]) for n in names]
        yy = d[y].to_numpy(float)
        lo, hi = 0.0, 0.98
        for _ in range(4):
            grid = np.linspace(lo, hi, 41)
            best = grid[int(np.argmax([_gls(yy, dummy, blocks, r)[0] for r in grid]))]
            step = (hi - lo) / 40
            lo, hi = max(0.0, best - step), min(0.98, best + step)
        _, beta, cov, s2 = _gls(yy, dummy, blocks, best)
        return pd.DataFrame({
            site_col: [key],
            "TAS": [beta[1]],
            "t": [beta[1] / np.sqrt(cov[1, 1] * s2)],
            "df": [len(d) - dummy.shape[1]],
            "rho": [best],
        })

    kind = df.schema[site_col].dataType.simpleString()
    out = df.select(site_col, window, year, y, x).groupBy(site_col).applyInPandas(
        lambda pdf: fit(pdf),
        f"`{site_col}` {kind}, TAS double, t double, df long, rho double",
    )
    return out.withColumn("TASp", t_tail(F.col("t"), F.col("df").cast("double")))

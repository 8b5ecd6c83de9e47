"""Respiration curves by site, window and year: one distributed job over all fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoflux.operators.joins import range_join
from thermoflux.operators.regression import ols
from thermoflux.sources.io import stored

#: Bounds of the parameters (fixed values): total curve, then the two more of the direct curve.
BOUNDS = {"C0": (0.0, 10.0), "alpha": (0.0, 0.2), "beta": (-0.01, 0.0), "Hs": (0.0, 1000.0), "k2": (0.0, 10.0)}
#: Half-hourly and hourly rows that a window needs.
ROWS_NEEDED = {48: 100, 24: 60}


def window_screen(df: DataFrame, nights: DataFrame, windows: DataFrame, ranges: DataFrame, min_rows: int = 100, coldest: float = 2.0, days: DataFrame | None = None) -> DataFrame:
    """(site, window, mean_TS, n) of the windows to be fitted: the mean over years of the yearly mean temperature - of ``df``; a year with any missing
    value does not count - lies within the site's range (not below ``coldest``; any, where the site has one window), and the complete
    ``nights`` have ``min_rows`` rows there. ``ranges``: site_id, tStart, tEnd. ``days``: the sums of ``df`` by day (site_id, YEAR, DOY, _s_TS, _k_TS, _n), where
    they are there already."""
    w = windows.select("site_id", "window", "w_start", "w_end")
    by = ["site_id", "window"]
    # a day's sums first, so that only one row a day and year meets the windows
    if days is None:
        days = df.groupBy("site_id", "YEAR", "DOY").agg(F.sum("TS").alias("_s_TS"), F.count("TS").alias("_k_TS"), F.count(F.lit(1)).alias("_n"))
    years = range_join(days, w, "DOY", "w_start", "w_end").groupBy(*by, "YEAR").agg(F.sum("_s_TS").alias("_s"), F.sum("_k_TS").alias("_k"), F.sum("_n").alias("_n"))
    mean = years.groupBy(*by).agg(F.avg(F.when(F.col("_k") == F.col("_n"), F.col("_s") / F.col("_n"))).alias("mean_TS"))
    rows = range_join(nights.groupBy("site_id", "DOY").agg(F.count(F.lit(1)).alias("_n")), w, "DOY", "w_start", "w_end").groupBy(*by).agg(F.sum("_n").alias("n"))
    count = windows.groupBy("site_id").agg(F.count(F.lit(1)).alias("_w"))
    g = mean.join(rows, by).join(ranges, "site_id").join(count, "site_id")
    fits = F.col("mean_TS").between(F.greatest("tStart", F.lit(coldest)), F.col("tEnd"))
    return g.filter(((F.col("_w") == 1) | fits) & (F.col("n") >= min_rows)).select(*by, "mean_TS", "n")


def _rings(df: DataFrame, w: DataFrame, value: str, step: int, most: int) -> DataFrame:
    """(site_id, window, YEAR, ring, v, k): how often a value occurs in each ring of extension. Rows are counted by day first, and only those
    counts meet the windows; nothing is copied to further extensions."""
    days = df.filter(F.col(value).isNotNull()).groupBy("site_id", "YEAR", "DOY", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    wide = w.select("site_id", "window", "w_start", "w_end", (F.col("w_start") - most).alias("_a"), (F.col("w_end") + most).alias("_b"))
    off = F.greatest(F.col("w_start") - F.col("DOY"), F.col("DOY") - F.col("w_end"), F.lit(0))
    own = range_join(days, wide, "DOY", "_a", "_b").withColumn("ring", F.ceil(off / step).cast("int"))
    return own.groupBy("site_id", "window", "YEAR", "ring", "v").agg(F.sum("k").alias("k"))


def _ring_quantiles(rings: DataFrame, shares: list[float], extensions: int) -> DataFrame:
    """(site_id, window, YEAR, n, total, top: arrays by extension; q: array by share of arrays by extension): count, sum, largest value and quantiles of
    each extension, from running sums of the counts over the rings up to it, in the order of values."""
    by = ["site_id", "window", "YEAR"]
    every = range(extensions)
    inside = [F.when(F.col("ring") <= e, F.col("k")).otherwise(0) for e in every]
    upto = Window.partitionBy(*by).orderBy("v", "ring").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    d = rings.withColumns({**{f"_c{e}": F.sum(inside[e]).over(upto) for e in every}, **{f"_n{e}": F.sum(inside[e]).over(whole) for e in every}})

    def at(e: int, rank: Column) -> Column:
        """The value at a rank (from 0) of an extension."""
        return F.min(F.when((F.col(f"_c{e}") > rank) & (F.col("ring") <= e), F.col("v")))

    def quantile(e: int, p: float) -> Column:
        place = (F.col(f"_n{e}") - 1) * p
        low, high = at(e, F.floor(place)), at(e, F.ceil(place))
        return low + (high - low) * F.first(place - F.floor(place))

    return d.groupBy(*by).agg(
        F.array(*[F.first(f"_n{e}") for e in every]).alias("n"),
        F.array(*[F.sum(F.when(F.col("ring") <= e, F.col("v") * F.col("k"))) for e in every]).alias("total"),
        F.array(*[F.max(F.when(F.col("ring") <= e, F.col("v"))) for e in every]).alias("top"),
        F.array(*[F.array(*[quantile(e, p) for e in every]) for p in shares]).alias("q"),
    )


def adaptive_window(
    df: DataFrame,
    windows: DataFrame,
    ts_ref: DataFrame,
    needed: int = 100,
    step: int = 3,
    most: int = 24,
    least_rows: int = 25,
    least_flux: float = 0.2,
    years: DataFrame | None = None,
) -> DataFrame:
    """(site_id, window, YEAR, extend_days, n, lo, hi, kept): the smallest extension of a window on either side (0, 3 .. 24 days) with ``needed`` rows
    and the reference temperature within the 2.5 and 97.5 % points - or the widest one. Widening also stops at the first extension with
    ``needed`` rows that reaches the end of the site's season while no row is warmer than the reference temperature.

    A row for each window of ``ts_ref`` (site_id, window, ts_ref) and each of ``years`` (site_id, YEAR; by default those of ``df``), failing ones
    too: ``kept`` is true if there are more than ``least_rows`` rows, they hold the reference temperature, and both mean and median flux reach ``least_flux``.
    ``df``: rows with TS and NEE."""
    w = windows.select("site_id", "window", "w_start", "w_end")
    by, extensions = ["site_id", "window", "YEAR"], most // step + 1
    warm = _ring_quantiles(_rings(df, w, "TS", step, most), [0.025, 0.975], extensions).select(*by, "n", "top", F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    flux = _ring_quantiles(_rings(df, w, "NEE", step, most), [0.5], extensions).select(*by, F.col("n").alias("_fn"), "total", F.col("q")[0].alias("_mid"))
    ends = w.groupBy("site_id").agg(F.max("w_end").alias("_season_end"))
    every = ts_ref.join(df.select("site_id", "YEAR").distinct() if years is None else years, "site_id").join(w.select("site_id", "window", "w_end"), ["site_id", "window"]).join(ends, "site_id")
    g = every.join(warm, by, "left").join(flux, by, "left")
    ref = F.col("ts_ref")
    found = F.lit(most)
    for e in reversed(range(extensions)):
        inside = ref.between(F.col("_lo")[e], F.col("_hi")[e])
        past = (F.col("w_end") + e * step >= F.col("_season_end")) & (ref >= F.col("top")[e]) if e else F.lit(False)
        found = F.when((F.col("n")[e] >= needed) & (inside | past), e * step).otherwise(found)
    g = g.withColumn("extend_days", found.cast("int")).withColumn("_e", (F.col("extend_days") / step).cast("int"))

    def pick(c: str) -> Column:
        return F.element_at(c, F.col("_e") + 1)

    g = g.select(*by, "extend_days", F.coalesce(pick("n"), F.lit(0)).alias("n"), pick("_lo").alias("lo"), pick("_hi").alias("hi"), ref.alias("_ref"), (pick("total") / pick("_fn")).alias("_mean"), pick("_mid").alias("_median"))
    ok = (F.col("n") > least_rows) & F.col("_ref").between(F.col("lo"), F.col("hi")) & (F.col("_mean") >= least_flux) & (F.col("_median") >= least_flux)
    return g.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("_ref", "_mean", "_median")


def log_quadratic_curve(df: DataFrame, by: tuple[str, ...] = ("site_id", "window"), min_rows: int = 10) -> DataFrame:
    """ln NEE = ln C0 + alpha TS + beta TS^2 on positive fluxes: a closed-form start, from sums of products."""
    d = df.filter("NEE > 0 AND TS IS NOT NULL").withColumns({"_ln": F.log("NEE"), "_t2": F.col("TS") * F.col("TS")})
    f = ols(d, "_ln", ["TS", "_t2"], by, min_rows)
    return f.select(
        *by,
        "n",
        F.exp(F.element_at("coef", 1)).alias("C0"),
        F.element_at("coef", 2).alias("alpha"),
        F.element_at("coef", 3).alias("beta"),
        "r2",
    )


def _model(p: np.ndarray, x: dict[str, np.ndarray], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Prediction and its derivatives by the named parameters."""
    v = dict(zip(names, p, strict=True))
    t = x["TS"]
    e = np.exp(v["alpha"] * t + v["beta"] * t * t)
    base, supply, jac = v["C0"], 1.0, {}
    if "k2" in v:
        base = base + v["k2"] * x["GPP"]
    if "Hs" in v:
        supply = x["SWC"] / (v["Hs"] + x["SWC"])
    y = base * e * supply
    jac["C0"], jac["alpha"], jac["beta"] = e * supply, y * t, y * t * t
    if "k2" in v:
        jac["k2"] = x["GPP"] * e * supply
    if "Hs" in v:
        jac["Hs"] = -y / (v["Hs"] + x["SWC"])
    return y, np.stack([jac[n] for n in names], axis=1)


class Sums:
    """What a fit needs of a group: distinct predictors with the rows that have them, and the sums and squares of their fluxes. Every cost and
    every derivative of the squared errors is exact on these."""

    def __init__(self, x: dict[str, np.ndarray], n: np.ndarray, y: np.ndarray, yy: np.ndarray, names: list[str]):
        self.x, self.n, self.y, self.yy, self.names = x, n, y, yy, names

    def errors(self, p: np.ndarray) -> float:
        """Sum of squared errors."""
        f = _model(p, self.x, self.names)[0]
        return float((self.yy - 2 * f * self.y + self.n * f * f).sum())

    def step(self, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(sum of squared errors, J'J, J' times the residuals)"""
        f, j = _model(p, self.x, self.names)
        return float((self.yy - 2 * f * self.y + self.n * f * f).sum()), j.T @ (self.n[:, None] * j), j.T @ (self.y - self.n * f)


class Fit:
    """Penalised least squares of one group by damped Gauss-Newton steps within the bounds, fed with sums at the points it asks for.

    ``ask`` is the point to be summed next (None when the optimum is found); ``tell`` takes the sums there. The noise is estimated anew around each of
    three optima. So the sums may come from arrays in a task or from an aggregate over all executors."""

    def __init__(self, names: list[str], prior: np.ndarray, prior_sd: np.ndarray, bounds: dict[str, tuple[float, float]], n: int, variance: float):
        self.names, self.prior, self.weight, self.n = names, prior, 1 / prior_sd**2, n
        self.lo, self.hi = (np.array([bounds[c][i] for c in names]) for i in (0, 1))
        self.ask = np.clip(prior, self.lo + 1e-9 * (self.hi - self.lo), self.hi - 1e-9 * (self.hi - self.lo))
        self.s2, self.round, self.tries, self.damp, self.at = max(variance, 1e-6), 0, 0, 1e-3, None

    def _penalty(self, q: np.ndarray) -> float:
        return float((self.weight * (q - self.prior) ** 2).sum())

    def tell(self, errors: float, jj: np.ndarray, jr: np.ndarray) -> None:
        errors, q = max(errors, 0.0), self.ask
        new = errors / self.s2 + self._penalty(q)
        if self.at is None:
            self.at = (q, errors, jj, jr)
        else:
            now = self.at[1] / self.s2 + self._penalty(self.at[0])
            self.tries += 1
            done = self.tries >= 60
            if new < now:
                done |= now - new < 1e-9 * (1 + now)
                self.at, self.damp = (q, errors, jj, jr), self.damp / 5
            else:
                self.damp *= 5
                done |= self.damp > 1e12
            if done:
                self.s2 = max(self.at[1] / max(1, self.n - len(q)), 1e-9)
                self.round, self.tries, self.damp = self.round + 1, 0, 1e-3
                if self.round == 3:
                    self.ask = None
                    return
        p, _, jj, jr = self.at
        h = jj / self.s2 + np.diag(self.weight)
        g = jr / self.s2 - self.weight * (p - self.prior)
        self.ask = np.clip(p + np.linalg.solve(h + self.damp * np.diag(np.diag(h)), g), self.lo, self.hi)

    def draws(self, count: int = 400, seed: int = 1) -> np.ndarray:
        """The optimum and seeded draws from the Gaussian there, truncated to the bounds."""
        p, _, jj, _ = self.at
        self.cov = np.linalg.inv(jj / self.s2 + np.diag(self.weight))
        z = np.random.default_rng(seed).multivariate_normal(p, (self.cov + self.cov.T) / 2, size=count, method="eigh")
        self.z = np.concatenate([p[None], z[((z >= self.lo) & (z <= self.hi)).all(axis=1)]])
        return self.z

    def result(self, errors: np.ndarray) -> dict:
        """Means and errors by importance weights; ``errors``: sums of squared errors at the draws."""
        p, inv = self.at[0], np.linalg.inv(self.cov)
        cost = errors / self.s2 + np.array([self._penalty(q) for q in self.z])
        logw = -0.5 * (cost - np.einsum("ij,jk,ik->i", self.z - p, inv, self.z - p))
        w = np.exp(logw - logw.max())
        w /= w.sum()
        mean = w @ self.z
        sd = np.sqrt(np.maximum(w @ (self.z - mean) ** 2, 0))
        out = dict(zip(self.names, p, strict=True)) | {f"{c}_mean": m for c, m in zip(self.names, mean, strict=True)} | {f"{c}_sd": d for c, d in zip(self.names, sd, strict=True)}
        return out | {"sigma": float(np.sqrt(self.s2)), "n": self.n, "RMSE": float(np.sqrt(self.at[1] / self.n)), "_w": w}


#: Distinct predictors of a group that one task fits, and groups beyond it that are fitted together by aggregates.
TASK_ROWS, TOGETHER = 200_000, 200


def _start(row: dict, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Prior and its width: from the pooled fit where the row has one, else wide around a start."""
    if row.get("_p_C0") is not None:
        return np.array([row[f"_p_{n}"] for n in names], float), np.maximum(np.array([row[f"_p_{n}_sd"] for n in names], float) * 3, 1e-4)
    water = row.get("_mid_SWC") or 0.0
    start = {"C0": max(row["_mid"] / 2, 0.1), "alpha": 0.05, "beta": -0.001, "Hs": water, "k2": 0.1}
    wide = {"C0": 5.0, "alpha": 0.1, "beta": 0.01, "Hs": max(1.0, 10 * water), "k2": 2.0}
    return np.array([start[n] for n in names]), np.array([wide[n] for n in names])


def _new_fit(row: dict, names: list[str], bounds: dict) -> Fit:
    return Fit(names, *_start(row, names), bounds, int(row["n"]), row["_yy"] / row["n"] - (row["_y"] / row["n"]) ** 2)


def _outcome(fit: Fit, errors: np.ndarray, row: dict, names: list[str], xs: list[str]) -> dict:
    got = fit.result(errors)
    at = {c: np.array([row[f"_ref_{c}"]], float) for c in xs}
    er = np.array([_model(q, at, names)[0][0] for q in fit.z])
    mean = float(got["_w"] @ er)
    return got | {"ERref": mean, "ERref_se": float(np.sqrt(max(got["_w"] @ (er - mean) ** 2, 0)))}


def er_curve(
    df: DataFrame,
    references: DataFrame,
    direct: bool = False,
    use_swc: bool = True,
    by: tuple[str, ...] = ("site_id", "window"),
    priors: DataFrame | None = None,
    min_rows: int = 20,
    bounds: dict[str, tuple[float, float]] = BOUNDS,
) -> DataFrame:
    """Curve of each group: its parameters (best, _mean, _sd), sigma, n, and the reference respiration ERref with its error.

    Total: NEE = C0 exp(alpha TS + beta TS^2). Direct: times SWC / (Hs + SWC) (``use_swc``) and with C0 + k2 * GPP in the place of C0.
    ``references``: by's site and window with TS (SWC, GPP) at which ERref is predicted; it is null if less than half its error.
    ``priors`` (site_id, window, one column a parameter and <name>_sd), as a pooled fit gives, lead yearly fits; else wide priors
    around a start from the lower medians.

    Rows are first summed by distinct predictors (map-side combined). A group of at most ``TASK_ROWS`` of those is fitted in one task. Larger ones
    are fitted ``TOGETHER`` at a time: each step of all of them is one aggregate of squared errors, J'J and J'r over all executors, and so are the costs
    of the draws; only these sums, a few numbers a group, come to the driver."""
    names = ["C0", "alpha", "beta", *(["Hs"] if direct and use_swc else []), *(["k2"] if direct else [])]
    xs = ["TS", *(["SWC"] if direct and use_swc else []), *(["GPP"] if direct else [])]
    keys = list(by)
    rows = df.select(*keys, *xs, "NEE").dropna()
    sums = stored(rows.groupBy(*keys, *xs).agg(F.count(F.lit(1)).alias("_n"), F.sum("NEE").alias("_s"), F.sum(F.col("NEE") * F.col("NEE")).alias("_q")), "curve-sums")
    middle = [F.percentile_approx("NEE", 0.5, 100_000).alias("_mid"), *[F.percentile_approx(c, 0.5, 100_000).alias(f"_mid_{c}") for c in xs if c == "SWC"]]
    groups = rows.groupBy(*keys).agg(*middle)
    groups = groups.join(sums.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_s").alias("_y"), F.sum("_q").alias("_yy"), F.count(F.lit(1)).alias("_k")), keys).filter(F.col("n") >= min_rows)
    groups = groups.join(references.select("site_id", "window", *[F.col(c).alias(f"_ref_{c}") for c in xs]), ["site_id", "window"])
    if priors is not None:
        groups = groups.join(priors.select("site_id", "window", *[F.col(c).alias(f"_p_{c}") for n in names for c in (n, f"{n}_sd")]), ["site_id", "window"])
    groups = stored(groups, "curve-groups")
    out = ["n", *[c for n in names for c in (n, f"{n}_mean", f"{n}_sd")], "sigma", "RMSE", "ERref", "ERref_se"]
    schema = T.StructType([*[groups.schema[c] for c in keys], *[T.StructField(c, T.LongType() if c == "n" else T.DoubleType()) for c in out]])
    about = [c for c in groups.columns if c not in keys]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(xs)
        row = {c: pdf[c].iloc[0] for c in [*keys, *about]}
        own = Sums({c: pdf[c].to_numpy(float) for c in xs}, *[pdf[c].to_numpy(float) for c in ("_n", "_s", "_q")], names)
        f = _new_fit(row, names, bounds)
        while f.ask is not None:
            f.tell(*own.step(f.ask))
        errors = np.array([own.errors(q) for q in f.draws()])
        got = row | _outcome(f, errors, row, names, xs)
        return pd.DataFrame([{c: got[c] for c in [*keys, *out]}])

    # a fit takes long for its few rows, so groups are spread by number, not by size
    small_ = sums.join(groups.filter(F.col("_k") <= TASK_ROWS), keys).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    fitted = small_.groupBy(*keys).applyInPandas(lambda pdf: fit(pdf), schema)
    part: list = []
    for r in groups.filter(F.col("_k") > TASK_ROWS).toLocalIterator():  # TOGETHER at a time
        part.append(r.asDict())
        if len(part) == TOGETHER:
            fitted, part = fitted.unionByName(_fit_by_aggregates(sums, part, keys, xs, names, bounds, schema)), []
    if part:
        fitted = fitted.unionByName(_fit_by_aggregates(sums, part, keys, xs, names, bounds, schema))
    return fitted.withColumn("ERref", reference_respiration(F.col("ERref"), F.col("ERref_se")))


def _fit_by_aggregates(sums: DataFrame, groups: list[dict], keys: list[str], xs: list[str], names: list[str], bounds: dict, schema: T.StructType) -> DataFrame:
    """Fits of a few groups whose distinct predictors are too many for a task."""
    spark = sums.sparkSession
    known = T.StructType([*[schema[c] for c in keys], T.StructField("_g", T.IntegerType())])
    number = spark.createDataFrame([(*[g[c] for c in keys], i) for i, g in enumerate(groups)], known)
    rows = stored(sums.join(F.broadcast(number), keys).select("_g", *xs, "_n", "_s", "_q"), "curve-rows")
    fits = [_new_fit(g, names, bounds) for g in groups]
    k = len(names)

    def total(width: int, points: dict[int, np.ndarray], part: Callable[[Sums, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        """Sums over all rows of the ``width`` numbers that ``part`` makes of a batch's rows of a group and the group's point."""
        held = spark.sparkContext.broadcast(points)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict[int, np.ndarray] = {}
            for pdf in batches:
                for g, own in pdf.groupby("_g"):
                    if g in held.value:
                        s = Sums({c: own[c].to_numpy(float) for c in xs}, *[own[c].to_numpy(float) for c in ("_n", "_s", "_q")], names)
                        acc[g] = acc.get(g, 0.0) + part(s, held.value[g])
            for g, v in acc.items():
                yield pd.DataFrame({"_g": np.full(width, g, np.int32), "i": np.arange(width, dtype=np.int32), "v": v})

        found = rows.mapInPandas(work, "_g int, i int, v double").groupBy("_g", "i").agg(F.sum("v").alias("v")).collect()
        out = {g: np.zeros(width) for g in points}
        for r in found:
            out[r["_g"]][r["i"]] = r["v"]
        held.unpersist()
        return out

    def step(s: Sums, p: np.ndarray) -> np.ndarray:
        e, jj, jr = s.step(p)
        return np.concatenate([[e], jj.ravel(), jr])

    while points := {i: f.ask for i, f in enumerate(fits) if f.ask is not None}:
        for i, v in total(1 + k * k + k, points, step).items():
            fits[i].tell(float(v[0]), v[1 : 1 + k * k].reshape(k, k), v[1 + k * k :])
    draws = {i: f.draws() for i, f in enumerate(fits)}
    width = max(len(z) for z in draws.values())
    padded = {i: np.concatenate([z, np.repeat(z[:1], width - len(z), axis=0)]) for i, z in draws.items()}
    errors = total(width, padded, lambda s, z: np.array([s.errors(q) for q in z]))
    done = [g | _outcome(fits[i], errors[i][: len(draws[i])], g, names, xs) for i, g in enumerate(groups)]
    return spark.createDataFrame([[r[c] if c in keys else int(r[c]) if c == "n" else float(r[c]) for c in schema.fieldNames()] for r in done], schema)


def reference_respiration(estimate: Column, error: Column, factor: float = 0.5) -> Column:
    """The estimate, null where it is less than ``factor`` times its error."""
    return F.when(~(estimate < factor * error), estimate)


def ln_ratio(df: DataFrame, control: DataFrame, year: str = "growing_year") -> DataFrame:
    """Adds lnRatio: ln of ERref over that of the site's control year in the same window, else over the median of its years."""
    c = df.join(control.select("site_id", F.col("control_year").alias("_cy")), "site_id", "left")
    base = c.groupBy("site_id", "window").agg(
        F.max(F.when(F.col(year) == F.col("_cy"), F.col("ERref"))).alias("_c"),
        F.percentile("ERref", F.lit(0.5)).alias("_m"),
    )
    out = df.join(base, ["site_id", "window"])
    ratio = F.try_divide(F.col("ERref"), F.coalesce("_c", "_m"))
    return out.withColumn("lnRatio", F.when(ratio > 0, F.log(F.when(ratio > 0, ratio)))).drop("_c", "_m")

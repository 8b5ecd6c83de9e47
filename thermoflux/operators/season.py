"""Active season of a site from climatologies of night flux and temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.operators.aggregates import two_level_climatology
from thermoflux.operators.windows import circular_runs
from thermoflux.sources.io import stored

RING = 366


def circular_moving_mean(clim: DataFrame, x: str, half: int, site_col: str = "site_id", out: str = "smooth") -> DataFrame:
    """Mean over the days within ``half`` of a day on the ring of 366 days (days without data are left out)."""
    steps = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    spread = clim.select(site_col, "DOY", x).withColumn("_s", steps).select(
        site_col,
        ((F.col("DOY") - 1 + F.col("_s") + RING) % RING + 1).alias("DOY"),
        x,
    )
    return spread.groupBy(site_col, "DOY").agg(F.avg(x).alias(out))


def cyclic_smooth(clim: DataFrame, x: str, weight: str, harmonics: int = 12, site_col: str = "site_id", out: str = "smooth") -> DataFrame:
    """Penalised cyclic smooth of each site's climatology at all 366 days; the penalty (on curvature) is chosen by restricted likelihood.

    The normal equations need only sums: a product of two harmonics is a sum of harmonics, so the weighted sums of cos and sin up to twice the order
    hold the whole matrix. Spark aggregates them, and the grid of penalties is solved on one row a site."""
    angle = F.col("DOY") * (2 * np.pi / RING)
    w, y = F.col(weight), F.col(x)

    def sums(value: Column, order: int) -> list[Column]:
        return [F.array(*[F.sum(value * f(angle * k)) for k in range(order + 1)]) for f in (F.cos, F.sin)]

    d = clim.dropna(subset=[x])
    g = d.groupBy(site_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.sum(w * y * y).alias("yy"),
        *[c.alias(f"_{n}") for n, c in zip(("c", "s", "yc", "ys"), [*sums(w, 2 * harmonics), *sums(w * y, harmonics)], strict=True)],
    )

    def solve(n: int, mean: float, sd: float, yy: float, c: np.ndarray, s: np.ndarray, yc: np.ndarray, ys: np.ndarray) -> np.ndarray:
        if sd < 1e-10:
            return np.full(RING, mean)
        k = np.arange(1, min(harmonics, max(1, (n - 1) // 2)) + 1)
        add, gap = k[:, None] + k[None, :], k[None, :] - k[:, None]
        cos_cos, sin_sin, cos_sin = (c[np.abs(gap)] + c[add]) / 2, (c[np.abs(gap)] - c[add]) / 2, (s[add] + np.sign(gap) * s[np.abs(gap)]) / 2
        gram = np.block([[c[:1, None], c[None, k], s[None, k]], [c[k, None], cos_cos, cos_sin], [s[k, None], cos_sin.T, sin_sin]])
        xty = np.concatenate([yc[:1], yc[k], ys[k]])
        pen = np.concatenate([[0.0], k**4, k**4]).astype(float)
        best = None
        for lam in np.logspace(-6, 6, 49):
            m = gram + np.diag(lam * pen)
            coef = np.linalg.solve(m, xty)
            score = (n - 1) * np.log(max(yy - coef @ xty, 1e-300)) + np.linalg.slogdet(m)[1] - len(pen[1:]) * np.log(lam)
            if best is None or score < best[0]:
                best = (score, coef)
        a = 2 * np.pi * np.outer(np.arange(1, RING + 1), k) / RING
        return np.concatenate([np.ones((RING, 1)), np.cos(a), np.sin(a)], axis=1) @ best[1]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for i in range(len(p)):
                row = p.iloc[i]
                value = solve(int(row["n"]), row["m"], row["sd"], row["yy"], *[np.asarray(row[c]) for c in ("_c", "_s", "_yc", "_ys")])
                yield pd.DataFrame({site_col: [row[site_col]] * RING, "DOY": np.arange(1, RING + 1), out: value})

    kind = clim.schema[site_col].dataType.simpleString()
    return g.mapInPandas(work, f"`{site_col}` {kind}, DOY long, `{out}` double")


def season_report(
    df: DataFrame,
    south: Column | None = None,
    smooth: str = "cyclic",
    half: int = 15,
    fraction: float = 0.2,
    warm: float = 2.0,
    min_days: int = 180,
    site_col: str = "site_id",
) -> DataFrame:
    """A row for each site: site, status (ok, skipped), reason, gStart, gEnd, trimmed_days, offStart, offEnd, temperature_source (soil, air), flux_days,
    temperature_days, nee_threshold.

    Climatologies give every year one value a day; soil temperature is used where it covers ``min_days`` days, else air temperature. A day is
    active if the smoothed night flux exceeds min + ``fraction`` * range and the smoothed temperature exceeds ``warm``; the coldest run of inactive
    days on the ring is the off-season (null if all days are active). A site is skipped, with a reason, for too few days of either or no active day. Southern
    sites (``south``, a condition on the site) are put on the axis 183..548. DOY of ``df`` is the calendar's."""
    flux = two_level_climatology(df.filter("NIGHT = 1 AND QC = 0"), "NEE", site_col)
    soil, air = two_level_climatology(df, "TS", site_col), two_level_climatology(df, "TA", site_col)
    # a row a site and day: written once, since every step below reads them again
    flux, soil, air = stored(flux, "flux-days"), stored(soil, "soil-days"), stored(air, "air-days")
    sites = df.select(site_col).distinct()
    for c, name in ((flux, "flux_days"), (soil, "_soil"), (air, "_air")):
        sites = sites.join(c.groupBy(site_col).agg(F.count(F.lit(1)).alias(name)), site_col, "left")
    zero = F.lit(0).cast("long")
    by_soil = F.coalesce("_soil", zero) >= min_days
    sites = sites.select(
        site_col,
        F.coalesce("flux_days", zero).alias("flux_days"),
        F.when(by_soil, F.col("_soil")).otherwise(F.coalesce("_air", zero)).alias("temperature_days"),
        F.when(by_soil, "soil").otherwise("air").alias("temperature_source"),
    )
    sites = stored(sites, "site-days")
    enough = sites.filter((F.col("flux_days") >= min_days) & (F.col("temperature_days") >= min_days)).select(site_col, "temperature_source")
    temp = soil.join(enough.filter("temperature_source = 'soil'"), site_col, "left_semi").unionByName(air.join(enough.filter("temperature_source = 'air'"), site_col, "left_semi"))
    flux = flux.join(enough, site_col, "left_semi")
    if smooth == "cyclic":
        f, t = cyclic_smooth(flux, "value", "n_years", site_col=site_col, out="flux"), cyclic_smooth(temp, "value", "n_years", site_col=site_col, out="temp")
    else:
        f, t = circular_moving_mean(flux, "value", half, site_col, "flux"), circular_moving_mean(temp, "value", half, site_col, "temp")
    days = stored(f.join(t, [site_col, "DOY"]), "smooth-days")
    limits = days.groupBy(site_col).agg((F.min("flux") + fraction * (F.max("flux") - F.min("flux"))).alias("nee_threshold"))
    days = days.join(limits, site_col).withColumn("active", (F.col("flux") > F.col("nee_threshold")) & (F.col("temp") > warm))
    if south is not None:
        days = days.withColumn("DOY", F.when(south & (F.col("DOY") < 183), F.col("DOY") + RING).otherwise(F.col("DOY")))
    some = days.groupBy(site_col).agg(F.bool_or("active").alias("_any")).filter("_any").select(site_col)
    runs = circular_runs(stored(days.join(some, site_col, "left_semi"), "active-days"), "active", "temp", (site_col,))
    reason = (
        F.when(F.col("flux_days") < min_days, "too few days of night flux")
        .when(F.col("temperature_days") < min_days, "too few days of temperature")
        .when(F.col("gStart").isNull(), "no active day")
    )
    out = sites.join(limits, site_col, "left").join(runs, site_col, "left").withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "ok").otherwise("skipped").alias("status")
    return out.select(site_col, status, "reason", "gStart", "gEnd", "trimmed_days", "offStart", "offEnd", "temperature_source", "flux_days", "temperature_days", "nee_threshold")


def active_season(df: DataFrame, south: Column | None = None, site_col: str = "site_id", **options) -> DataFrame:
    """(site, gStart, gEnd, trimmed_days) of the sites that ``season_report`` gives a season."""
    return season_report(df, south, site_col=site_col, **options).filter("status = 'ok'").select(site_col, "gStart", "gEnd", "trimmed_days")


def season_status(df: DataFrame, site_col: str = "site_id", **options) -> DataFrame:
    """(site, flux_days, temperature_days, reason): why ``active_season`` gives a site no season, from the same smooth; null where it gives one."""
    return season_report(df, site_col=site_col, **options).select(site_col, "flux_days", "temperature_days", "reason")


def season_by_uptake(clim: DataFrame, fraction: float = 0.2, nth: int = 7, margin: int = 4, site_col: str = "site_id") -> DataFrame:
    """Older rule: the ``nth`` day from either end whose NEE is under ``fraction`` of the minimum, moved outward by ``margin`` days,
    not before the first day with a soil temperature of 0 and more. ``clim``: site, DOY, NEE, TS."""
    low = clim.groupBy(site_col).agg((F.min("NEE") * fraction).alias("_cut"), F.min(F.when(F.col("TS") >= 0, F.col("DOY"))).alias("_thaw"))
    d = clim.join(low, site_col).filter(F.col("NEE") < F.col("_cut"))
    up, down = Window.partitionBy(site_col).orderBy("DOY"), Window.partitionBy(site_col).orderBy(F.desc("DOY"))
    d = d.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    g = d.groupBy(site_col).agg(
        F.max(F.when(F.col("_u") == nth, F.col("DOY"))).alias("_a"),
        F.max(F.when(F.col("_d") == nth, F.col("DOY"))).alias("_b"),
        F.first("_thaw").alias("_t"),
    )
    return g.filter("_a IS NOT NULL").select(
        site_col,
        F.greatest(F.col("_a") - margin, F.col("_t")).alias("gStart"),
        (F.col("_b") + margin).alias("gEnd"),
    )

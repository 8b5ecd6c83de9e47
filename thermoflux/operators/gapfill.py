"""Friction-velocity thresholds and gap filling by similar weather."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.operators.chunked import join_on
from thermoflux.operators.joins import small
from thermoflux.sources.io import stored


def class_limits(df: DataFrame, x: str, by: list[str], classes: int) -> DataFrame:
    """(by, limits): the largest value of each of ``classes`` classes of about equal size. Equal values are counted first and share a class, that of the
    rows below them."""
    values = df.groupBy(*by, F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by)
    below = F.sum("_k").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    own = values.withColumns({"_c": F.floor(below * classes / F.sum("_k").over(w)).cast("int")})
    top = own.groupBy(*by, "_c").agg(F.max("_v").alias("_m"))
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_m"))), lambda s: s["_m"]).alias("limits"))


def with_class(df: DataFrame, x: str, by: list[str], classes: int, out: str) -> DataFrame:
    """``df`` with the number of the class of ``x`` within its group, from 0 on (empty classes are not counted). Limits are a row a group: rows are not shuffled for them."""
    d = join_on(df, small(stored(class_limits(df, x, by, classes), "class-limits")), by)
    return d.withColumn(out, F.size(F.filter("limits", lambda v: v < F.col(x)))).drop("limits")


def ustar_threshold(
    df: DataFrame,
    by: tuple[str, ...] = ("site_id", "season"),
    t_classes: int = 7,
    u_classes: int = 20,
    share: float = 0.99,
    max_corr: float = 0.5,
    ahead: int = 10,
    least_rows: int = 160,
    least_in_class: int = 100,
) -> DataFrame:
    """(by, threshold, n_classes): moving-point test. Night rows are cut into temperature classes of equal size and those into friction-velocity
    classes; a class's threshold is the first velocity class whose flux reaches ``share`` of the mean of the next ``ahead`` ones. Temperature
    classes of fewer than ``least_in_class`` rows, or in which velocity and temperature correlate, are left out; the median over the others is the group's. Groups
    of fewer than ``least_rows`` rows, and those without a class left, have no row.

    ``df``: by, TA, USTAR, NEE of valid nights."""
    keys = list(by)
    own = df.dropna(subset=["TA", "USTAR", "NEE"]).select(*keys, "TA", "USTAR", "NEE")
    enough = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_rows)
    own = own.join(small(stored(enough.drop("_n"), "enough")), keys, "left_semi")
    own = stored(with_class(own, "TA", keys, t_classes, "_t"), "temperature-classes")
    cor = own.groupBy(*keys, "_t").agg(F.corr("USTAR", "TA").alias("_r"), F.count(F.lit(1)).alias("_n"))
    cor = cor.filter((F.abs("_r") < max_corr) & (F.col("_n") >= least_in_class)).select(*keys, "_t")
    own = with_class(own.join(small(stored(cor, "uncorrelated")), [*keys, "_t"], "left_semi"), "USTAR", [*keys, "_t"], u_classes, "_u")
    cls = own.groupBy(*keys, "_t", "_u").agg(F.avg("USTAR").alias("_us"), F.avg("NEE").alias("_f"))
    later = F.avg("_f").over(Window.partitionBy(*keys, "_t").orderBy("_u").rowsBetween(1, ahead))
    first = cls.withColumn("_later", later).filter(F.col("_f") >= share * F.col("_later")).groupBy(*keys, "_t").agg(F.min_by("_us", "_u").alias("_th"))
    return first.groupBy(*keys).agg(F.percentile("_th", F.lit(0.5)).alias("threshold"), F.count(F.lit(1)).alias("n_classes"))


def ustar_thresholds(df: DataFrame, **options) -> DataFrame:
    """(site_id, YEAR, season, threshold, mode): a row for every season of ``df`` (site_id, YEAR, season, TA, USTAR, NEE) with the threshold to use there.

    ``mode``: season - the season's own; year - the largest of the year's seasons; pooled - the year's rows taken together, where no season has
    enough; site - the median of the site's years; null where there is none at all. ``join_season_threshold`` takes the rows as they are."""
    rows = stored(df.select("site_id", "YEAR", "season", "TA", "USTAR", "NEE"), "nights")
    seasons = stored(ustar_threshold(rows, ("site_id", "YEAR", "season"), **options).drop("n_classes"), "seasons")
    every = stored(rows.select("site_id", "YEAR", "season").distinct(), "every-season")
    best = seasons.groupBy("site_id", "YEAR").agg(F.max("threshold").alias("_year"))
    bare = rows.join(best, ["site_id", "YEAR"], "left_anti")
    pooled = ustar_threshold(bare, ("site_id", "YEAR"), **options).select("site_id", "YEAR", F.col("threshold").alias("_pooled"))
    years = every.select("site_id", "YEAR").distinct().join(best, ["site_id", "YEAR"], "left").join(pooled, ["site_id", "YEAR"], "left")
    years = stored(years, "years")
    site = years.groupBy("site_id").agg(F.percentile(F.coalesce("_year", "_pooled"), F.lit(0.5)).alias("_site"))
    d = every.join(seasons, ["site_id", "YEAR", "season"], "left").join(years, ["site_id", "YEAR"]).join(site, "site_id")
    mode = F.when(F.col("threshold").isNotNull(), "season").when(F.col("_year").isNotNull(), "year").when(F.col("_pooled").isNotNull(), "pooled").when(F.col("_site").isNotNull(), "site")
    return d.select("site_id", "YEAR", "season", F.coalesce("threshold", "_year", "_pooled", "_site").alias("threshold"), mode.alias("mode"))


# Fixed values of the published method (marginal distribution sampling): largest differences of like weather (that of radiation shrinks in weak light),
# and rows that a mean needs.
TOLERANCE = {"SW_IN": 50.0, "TA": 2.5, "VPD": 5.0}
WEAK_LIGHT = 20.0
LEAST = 2
#: Stages in order: method (look-up by all drivers, by radiation alone, mean diurnal course) and days on either side.
LOOK_UP, RADIATION, COURSE = 1, 2, 3
STAGES = (
    (LOOK_UP, 7), (LOOK_UP, 14), (RADIATION, 7), (COURSE, 0), (COURSE, 1), (COURSE, 2), *[(LOOK_UP, k) for k in range(21, 71, 7)], *[(RADIATION, k) for k in range(14, 71, 7)],
    *[(COURSE, k) for k in range(7, 211, 7)],
)
#: Length of the whole window in days up to which a method is of quality 1, and of quality 2; beyond, 3.
QUALITY = {LOOK_UP: (14, 56), RADIATION: (14, 28), COURSE: (1, 5)}


def quality_class(method: Column, days: Column) -> Column:
    """1 to 3, best first, by method and length of the window (days on both sides; a course has its own day too)."""
    out = F.lit(None).cast("int")
    for m, (one, two) in QUALITY.items():
        length = 2 * days + (1 if m == COURSE else 0)
        out = F.when(method == m, F.when(length <= one, 1).when(length <= two, 2).otherwise(3)).otherwise(out)
    return out


#: Gaps that a task takes with the cells around them, entries of a grid of running sums, and pairs of a gap and a cell that are held at once.
TASK_GAPS, GRID, PAIRS = 50_000, 1 << 23, 1 << 20
#: Copies of cells a gap: a block's cells are sent to no more tasks than make so many, so that what is shuffled grows with the rows and not with cells times gaps.
COPIES = 4


def _edges(axis: np.ndarray, at: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Places from .. to of the sorted ``axis`` that differ by less than ``tol`` from each of ``at`` (none from a missing one); the comparison itself decides at the edges."""

    def inside(i: np.ndarray) -> np.ndarray:
        return (i >= 0) & (i < len(axis)) & (np.abs(axis[np.clip(i, 0, len(axis) - 1)] - at) < tol)

    if not len(axis):
        return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    lo, hi = np.searchsorted(axis, at - tol), np.searchsorted(axis, at + tol)
    while (m := inside(lo - 1)).any():
        lo = lo - m
    while (m := (lo < hi) & ~inside(lo)).any():
        lo = lo + m
    while (m := inside(hi)).any():
        hi = hi + m
    while (m := (lo < hi) & ~inside(hi - 1)).any():
        hi = hi - m
    return lo, hi


def _sums_around(g: dict[str, np.ndarray], c: dict[str, np.ndarray], tolerance: dict[str, float], weeks: int) -> np.ndarray:
    """For each gap and each number of weeks 1 .. ``weeks`` around it: n and s of the cells of like weather, n and s of those of like radiation, as an array (4, gaps, weeks).

    ``g``: _d and drivers; ``c``: the same, n and s. Cells of one radiation, where many, are put on a grid of days and the other drivers' distinct values and summed up along each of its
    axes, so a gap takes the corners of its box, whatever lies within. The other cells meet the gaps one by one."""
    light, *others = tolerance
    own = np.maximum(np.minimum(tolerance[light], g[light]), WEAK_LIGHT)
    out = np.zeros((4, len(own), weeks))
    order, by_light = np.argsort(g[light], kind="stable"), np.argsort(c[light], kind="stable")
    c = {k: v[by_light] for k, v in c.items()}
    lights, first = np.unique(c[light], return_index=True)
    ends = np.append(first[1:], len(c[light]))
    reach = max(tolerance[light], WEAK_LIGHT)
    a, b = np.searchsorted(g[light][order], lights - reach), np.searchsorted(g[light][order], lights + reach, "right")
    alone = np.ones(len(c[light]), bool)
    mean = c["s"].sum() / max(c["n"].sum(), 1)
    if np.isfinite(c["s"]).all() and np.isfinite(mean):
        for j in np.flatnonzero((ends - first) * (b - a) > 10_000):
            gaps = order[a[j] : b[j]]
            gaps = gaps[np.abs(lights[j] - g[light][gaps]) < own[gaps]]
            cell = {k: v[first[j] : ends[j]] for k, v in c.items()}
            whole = ~np.any([np.isnan(cell[o]) for o in others], axis=0) if others else np.ones(len(cell["n"]), bool)
            axes = [np.unique(cell["_d"]), *[np.unique(cell[o][whole]) for o in others]]
            shape = [len(x) + 1 for x in axes]
            entries = np.prod([float(k) for k in shape])
            if entries > GRID or entries + len(gaps) * weeks * 2 ** len(shape) > len(cell["n"]) * len(gaps):
                continue
            alone[first[j] : ends[j]] = False
            # sums of the differences from the mean, so that running sums stay small
            values = [cell["n"].astype(float), cell["s"] - cell["n"] * mean]
            day = np.searchsorted(axes[0], cell["_d"]) + 1
            grids, strips = [], []
            at = np.ravel_multi_index([day[whole], *[np.searchsorted(x, cell[o][whole]) + 1 for x, o in zip(axes[1:], others, strict=True)]], shape)
            for v in values:
                grid = np.bincount(at, v[whole], int(entries)).reshape(shape)
                for k in range(len(shape)):
                    np.cumsum(grid, axis=k, out=grid)
                grids.append(grid)
                strips.append(np.cumsum(np.bincount(day, v, shape[0])))
            box = [_edges(x, g[o][gaps], tolerance[o]) for x, o in zip(axes[1:], others, strict=True)]
            for w in range(weeks):
                ends_ = np.searchsorted(axes[0], g["_d"][gaps] - 7 * (w + 1)), np.searchsorted(axes[0], g["_d"][gaps] + 7 * (w + 1), "right")
                found = [sum((-1) ** (len(k) - sum(k)) * grid[tuple(e[i] for e, i in zip([ends_, *box], k, strict=True))] for k in product((0, 1), repeat=len(shape))) for grid in grids]
                found += [strip[ends_[1]] - strip[ends_[0]] for strip in strips]
                found[1], found[3] = found[1] + found[0] * mean, found[3] + found[2] * mean
                for k in range(4):
                    out[k, gaps, w] += found[k]
    c = {k: v[alone] for k, v in c.items()}
    lo, hi = np.searchsorted(c[light], g[light] - reach), np.searchsorted(c[light], g[light] + reach, "right")
    upto = np.cumsum(np.maximum(hi - lo, 0))
    start, single = 0, np.zeros((4, len(own) * weeks))
    while start < len(own):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        size = np.maximum(hi[start:stop] - lo[start:stop], 0)
        i = np.repeat(np.arange(start, stop), size)
        j = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + lo[i]
        far = np.abs(g["_d"][i] - c["_d"][j])
        near = (far <= 7 * weeks) & (np.abs(c[light][j] - g[light][i]) < own[i])
        i, j, far = i[near], j[near], far[near]
        like = np.ones(len(i), bool)
        for o in others:
            like &= np.abs(c[o][j] - g[o][i]) < tolerance[o]
        at = i * weeks + np.maximum(np.ceil(far / 7).astype(np.int64), 1) - 1 - start * weeks
        for k, (m, v) in enumerate(((like, "n"), (like, "s"), (slice(None), "n"), (slice(None), "s"))):
            single[k, start * weeks : stop * weeks] = np.bincount(at[m], c[v][j][m], (stop - start) * weeks)
        start = stop
    return out + np.cumsum(single.reshape(out.shape), axis=2)


def gap_fill_mds(
    df: DataFrame,
    id_col: str,
    value: str = "NEE",
    day: str = "day",
    hour: str = "HOUR",
    by: tuple[str, ...] = ("site_id",),
    tolerance: dict[str, float] = TOLERANCE,
    least: int = LEAST,
) -> DataFrame:
    """(by, id, filled, n_used, method, days, quality) of the rows whose ``value`` is missing: the mean of the rows that the first of ``STAGES`` with
    ``least`` of them finds. Rows that no stage fills stay, with n_used 0 and nulls.

    Look-up: rows within so many days whose radiation, temperature and vapour deficit differ by less than ``tolerance`` (radiation: less than the gap's own
    where that is smaller, and ``WEAK_LIGHT`` at least); radiation: the same by radiation alone; course: rows within an hour of the gap's time of day on days not further.

    Stages are not joined one by one. Donors are summed to cells (day and drivers; day and hour) once. A gap goes to one block of days and radiation, cells to all blocks that their reach
    touches and that have gaps; there running sums over the cells give every stage's sums of a gap (``_sums_around``). A block's gaps are dealt to tasks of ``TASK_GAPS``, of more where
    its cells are many (``COPIES``). The first two weeks decide three stages; what is
    left meets the course of five days, then ten weeks, and last the course by weeks. A course is worked out once for a site's day and hour. ``day`` counts days, ``hour`` is whole."""
    light = next(iter(tolerance))
    key = [*by, id_col]
    gaps = df.filter(F.col(value).isNull()).select(*key, F.col(day).alias("_d"), F.col(hour).alias("_h"), *[F.col(c).cast("double").alias(f"_{c}") for c in tolerance])
    gaps = stored(gaps, "gaps")
    known = df.filter(F.col(value).isNotNull())
    cells = known.filter(F.col(light).isNotNull()).groupBy(*by, F.col(day).alias("_e"), *[F.col(c).cast("double").alias(c) for c in tolerance])
    cells = stored(cells.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value).cast("double")).alias("_s")), "cells")
    # a row counts for its own hour and both neighbours, across midnight too
    hours = known.groupBy(*by, (F.col(day) * 24 + F.col(hour)).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    hours = hours.withColumn("_t", F.explode(F.array(F.col("_t") - 1, F.col("_t"), F.col("_t") + 1))).groupBy(*by, "_t").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    hours = stored(hours.select(*by, F.floor(F.col("_t") / 24).alias("_e"), F.pmod("_t", F.lit(24)).alias("_h"), "_n", "_s"), "hours")
    result = "filled double, n_used long, method int, days int"
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (f.split() for f in result.split(", "))]

    def looked_up(left: DataFrame, stages: list[tuple[int, int]], weeks: int) -> DataFrame:
        """``left`` with the result of the first of ``stages`` that finds enough within so many weeks, or nulls."""
        days, width, reach = 28 * weeks, 2.0 * tolerance[light], max(tolerance[light], WEAK_LIGHT)
        can = F.lit(True)
        for c in [*key, "_d", f"_{light}"]:
            can = can & F.col(c).isNotNull()
        block = [*by, "_k", "_l"]
        g = left.filter(can).withColumns({"_k": F.floor(F.col("_d") / days), "_l": F.floor(F.col(f"_{light}") / width)})
        c = cells.withColumn("_k", F.explode(F.sequence(F.floor((F.col("_e") - 7 * weeks) / days), F.floor((F.col("_e") + 7 * weeks) / days))))
        c = c.withColumn("_l", F.explode(F.sequence(F.floor((F.col(light) - reach) / width), F.floor((F.col(light) + reach) / width))))
        # blocks with many gaps are dealt to several tasks, each with the cells; blocks without gaps need no cells
        own = g.groupBy(*block).agg(F.count(F.lit(1)).alias("_g")).join(c.groupBy(*block).agg(F.count(F.lit(1)).alias("_c")), block, "left")
        dealt = F.least(F.ceil(F.col("_g") / TASK_GAPS), F.ceil(COPIES * F.col("_g") / F.coalesce("_c", F.lit(1))))
        blocks = stored(own.select(*block, dealt.alias("_p")), "blocks")
        g = g.join(small(blocks.filter("_p > 1")), block, "left").withColumn("_p", F.pmod(F.xxhash64(id_col), F.coalesce("_p", F.lit(1))))
        c = c.join(small(blocks), block).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)))
        names = left.columns

        def work(gap: pa.Table, cell: pa.Table) -> pa.Table:
            def numbers(t: pa.Table, c: str) -> np.ndarray:
                return t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(float)

            own = {"_d": numbers(gap, "_d"), **{c: numbers(gap, f"_{c}") for c in tolerance}}
            donors = {"_d": numbers(cell, "_e"), **{c: numbers(cell, c) for c in tolerance}, "n": numbers(cell, "_n"), "s": numbers(cell, "_s")}
            # gaps of one day and weather have one answer
            asked, which = np.unique(np.stack([own[c] for c in own], axis=1), axis=0, return_inverse=True)
            which = which.reshape(-1)
            sums = _sums_around({c: asked[:, i] for i, c in enumerate(own)}, donors, tolerance, weeks)
            stage = np.full(len(asked), -1)
            for i, (m, k) in reversed(list(enumerate(stages))):
                stage[sums[0 if m == LOOK_UP else 2, :, k // 7 - 1] >= least] = i
            method, span = np.array([m for m, _ in stages]), np.array([k for _, k in stages])
            kind, week, row = np.where(method[stage] == LOOK_UP, 0, 2), span[stage] // 7 - 1, np.arange(len(asked))
            n, s = sums[kind, row, week], sums[kind + 1, row, week]
            none = (stage < 0)[which]
            new = (np.divide(s, n, out=np.zeros(len(n)), where=n > 0), np.rint(n).astype(np.int64), method[stage].astype(np.int32), span[stage].astype(np.int32))
            return pa.table([*[gap.column(c) for c in names], *[pa.array(v[which], mask=none) for v in new]], names=[*names, *(f.split()[0] for f in result.split(", "))])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
        found = g.groupBy(*block, "_p").cogroup(c.groupBy(*block, "_p")).applyInArrow(lambda gap, cell: work(gap, cell), f"{kinds}, {result}")
        return found.unionByName(left.filter(~can).select("*", *empty))

    def course(left: DataFrame, step: int, last: int) -> DataFrame:
        """``left`` with the mean of the hours within the first of 0, step, .. ``last`` days that has enough, or nulls."""
        width, at = 2 * last + 1, [*by, "_d", "_h"]
        far = F.abs(F.col("_d") - F.col("_e"))
        g = left.select(*at).distinct().withColumn("_k", F.floor(F.col("_d") / width)).withColumn("_k", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)))
        both = g.join(hours.withColumn("_k", F.floor(F.col("_e") / width)), [*by, "_k", "_h"]).filter(far <= last)
        ring = both.groupBy(*at, (F.ceil(far / step) * step).cast("int").alias("days")).agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
        # the gap's own day belongs to the first stage of a course by weeks
        ring = ring.withColumn("days", F.greatest("days", F.lit(step if step > 1 else 0))).groupBy(*at, "days").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        upto = Window.partitionBy(*at).orderBy("days")
        found = ring.withColumns({"n": F.sum("n").over(upto), "s": F.sum("s").over(upto)}).filter(F.col("n") >= least)
        best = found.groupBy(*at).agg(F.min(F.struct("days", "n", "s")).alias("_b"))
        best = best.select(*at, (F.col("_b.s") / F.col("_b.n")).alias("filled"), F.col("_b.n").alias("n_used"), F.lit(COURSE).alias("method"), F.col("_b.days").alias("days"))
        return left.join(best, at, "left")

    later = [s for s in STAGES[3:] if s[0] != COURSE]
    steps = [
        lambda left: looked_up(left, list(STAGES[:3]), 2), lambda left: course(left, 1, 2),
        lambda left: looked_up(left, later, 10), lambda left: course(left, 7, 210),
    ]
    left, parts = gaps, []
    for step in steps:
        tried = stored(step(left), "tried")
        parts.append(tried.filter("method IS NOT NULL").select(*key, "filled", "n_used", "method", "days"))
        left = tried.filter("method IS NULL").select(*gaps.columns)
    out = left.select(*key, *empty).withColumn("n_used", F.lit(0).cast("long"))
    for p in parts:
        out = out.unionByName(p)
    return out.withColumn("quality", quality_class(F.col("method"), F.col("days")))

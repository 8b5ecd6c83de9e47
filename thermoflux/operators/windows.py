"""Window operators over the time-ordered rows of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.operators.chunked import CHUNK_ROWS, join_on, with_frames, with_neighbours

_START = Window.unboundedPreceding


def previous_means(df: DataFrame, x: str, sizes: dict[str, int], by: list[str], order: list[str], rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``df`` with means of the rows before (missing skipped), ``sizes`` rows a column; the row's own value where that is null."""
    return with_frames(df, max(sizes.values()), lambda w, _: {c: F.coalesce(F.avg(x).over(w.rowsBetween(-n, -1)), F.col(x)) for c, n in sizes.items()}, by, order, rows)


def trailing_means(df: DataFrame, x: str, sizes: dict[str, int], by: list[str], order: list[str], rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``df`` with means of the row and those before it (missing skipped), ``sizes`` rows a column; null until there are as many."""
    return with_frames(df, max(sizes.values()), lambda w, at: {c: F.when(at >= n, F.avg(x).over(w.rowsBetween(-(n - 1), 0))) for c, n in sizes.items()}, by, order, rows)


def lag_gap(kept: DataFrame, seasons: DataFrame, by: tuple[str, ...] = ("site_id", "growing_year")) -> DataFrame:
    """Days since the previous kept day of a year; the season's edges count as kept days."""
    edges = seasons.select(*by, F.explode(F.array("gStart", "gEnd")).alias("DOY"))
    days = kept.select(*by, "DOY").unionByName(edges).distinct()
    w = Window.partitionBy(*by).orderBy("DOY")
    return days.withColumn("gap", F.col("DOY") - F.lag("DOY").over(w))


def rolling3(df: DataFrame, x: str, out: str, by: list[str], order: list[str], rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``df`` with the mean of three rows up to each one; the first two rows take the first value."""
    return with_frames(df, 2, lambda w, at: {out: F.when(at < 3, F.first(x).over(w.rowsBetween(-2, 0))).otherwise(F.avg(x).over(w.rowsBetween(-2, 0)))}, by, order, rows)


def islands(flag: Column, by: list[str], order: list[str]) -> Column:
    """Number of a run: every row whose flag is false starts the next one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(_START, 0)
    return F.sum(F.when(flag, 0).otherwise(1)).over(w)


def window_gap_check(days: DataFrame, windows: DataFrame, years: DataFrame, max_total: float = 0.75, max_run: float = 0.5) -> DataFrame:
    """(site, window, year, missing, longest) of the windows that are well enough covered: missing days and the longest run of them,
    as shares of the window. ``days``: site_id, YEAR, DOY of present days; ``windows``: site_id, window, w_start, w_end."""
    every = windows.join(years, "site_id").withColumn("DOY", F.explode(F.sequence(F.col("w_start").cast("int"), F.col("w_end").cast("int"))))
    seen = days.select("site_id", "YEAR", F.col("DOY").cast("int").alias("DOY"), F.lit(True).alias("_seen")).distinct()
    own = every.join(seen, ["site_id", "YEAR", "DOY"], "left").withColumn("_gap", F.col("_seen").isNull())
    by = ["site_id", "window", "YEAR"]
    runs = own.withColumn("_run", islands(F.col("_gap"), by, ["DOY"])).groupBy(*by, "_run").agg(
        F.count(F.when(F.col("_gap"), 1)).alias("_g"),
        F.count(F.lit(1)).alias("_n"),
    )
    out = runs.groupBy(*by).agg((F.sum("_g") / F.sum("_n")).alias("missing"), (F.max("_g") / F.sum("_n")).alias("longest"))
    return out.filter((F.col("missing") <= max_total) & (F.col("longest") <= max_run))


def average_rank(x: Column, by: list[str], value_name: str) -> Column:
    """Rank with ties at their mean; ``value_name`` is the column of ``x``."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value_name)) - 1) / 2


def pick_first(df: DataFrame, by: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def interpolate_linear(
    df: DataFrame,
    x: str,
    order: list[str],
    by: tuple[str, ...] = ("site_id",),
    axis: Column | None = None,
    max_gap: int | None = None,
    fill_ends: bool = False,
    out: str | None = None,
    rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Holes on a straight line between their neighbours along ``axis`` (the first order column by default).

    With ``max_gap`` holes of more rows stay; ``fill_ends`` carries the first and last value outward."""
    at = F.col(order[0]) if axis is None else axis
    d = with_neighbours(df, x, at, list(by), order, rows)
    a, b = F.col("_last"), F.col("_ahead")
    line = a["x"] + F.try_divide((b["x"] - a["x"]) * (at - a["at"]), b["at"] - a["at"])
    if fill_ends:
        line = F.coalesce(line, a["x"], b["x"])
    if max_gap is not None:
        holes = F.coalesce(b["pos"], F.col("_size") + 1) - F.coalesce(a["pos"], F.lit(0)) - 1
        line = F.when(holes <= max_gap, line)
    return d.withColumn(out or x, F.coalesce(F.col(x), line)).drop("_last", "_ahead", "_pos", "_size")


def previous_day_fill(df: DataFrame, x: str, by: tuple[str, ...] = ("site_id", "HOUR", "MINUTE")) -> DataFrame:
    """Holes of a diurnal climatology take the value of the nearest earlier day at that time; those before the first known day take the value of the
    site's first row (the first day's first time), missing if that is. ``by``: the site, then the time of day."""
    site, *times = by
    w = Window.partitionBy(*by).orderBy("DOY").rowsBetween(_START, 0)
    first = df.groupBy(site).agg(F.min_by(F.struct(F.col(x).alias("v")), F.struct("DOY", *times)).alias("_first"))
    return join_on(df, first, [site]).withColumn(x, F.coalesce(F.last(x, True).over(w), F.col("_first")["v"])).drop("_first")


def zscore(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Columns less their mean, over their standard deviation. The moments are aggregated and joined back, so no group is sorted."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    moments = df.groupBy(*by).agg(*aggs)
    out = df.join(moments, list(by)) if by else df.crossJoin(F.broadcast(moments))
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def closest_year(df: DataFrame, x: str, by: tuple[str, ...] = ("site_id",), year: str = "YEAR") -> DataFrame:
    """(by, year) of the year whose value is nearest to the mean over years (the earliest of equals)."""
    mean = df.groupBy(*by).agg(F.avg(x).alias("_m"))
    own = df.join(mean, list(by)).withColumn("_k", F.struct(F.abs(F.col(x) - F.col("_m")), F.col(year)))
    return own.groupBy(*by).agg(F.min_by(year, "_k").alias(year))


def candidate_years(df: DataFrame, n: str, x: str, by: tuple[str, ...] = ("site_id",), year: str = "YEAR", top: int = 3) -> DataFrame:
    """Years with more rows than the median year, the ``top`` nearest to the median of ``x``."""
    med = df.groupBy(*by).agg(F.percentile(n, F.lit(0.5)).alias("_n"), F.percentile(x, F.lit(0.5)).alias("_x"))
    own = df.join(med, list(by)).filter(F.col(n) > F.col("_n")).withColumn("_d", F.abs(F.col(x) - F.col("_x")))
    return pick_first(own, list(by), ["_d", year], top).drop("_n", "_x", "_d")


def circular_runs(days: DataFrame, active: str, temperature: str, by: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Active season on a ring of days: (by, gStart, gEnd, trimmed_days, offStart, offEnd).

    Runs of inactive days are found on the ring (those at both ends of the axis are one); the coldest on average is the off-season, all
    other days are active. Of the up to two active pieces of the axis the longer stays; the days of the other are trimmed. The off-season's ends are in the order of the ring (null where there is none)."""
    w = Window.partitionBy(*by).orderBy("DOY")
    d = days.withColumn(
        "_run",
        F.sum(F.when(F.col(active) & ~F.coalesce(F.lag(active).over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(_START, 0)),
    )
    ends = d.groupBy(*by).agg(
        F.min("DOY").alias("_first"),
        F.max("DOY").alias("_last"),
        F.max("_run").alias("_runs"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by(active, "DOY").alias("_a0"),
        F.max_by(active, "DOY").alias("_a1"),
    )
    d = d.join(ends, list(by))
    # the run before the first active day and the one after the last are one if both touch their end
    d = d.withColumn("_ring", F.when(~F.col("_a0") & ~F.col("_a1") & (F.col("_run") == F.col("_runs")), 0).otherwise(F.col("_run")))
    off = d.filter(~F.col(active)).groupBy(*by, "_ring").agg(F.avg(temperature).alias("_t"), F.min("DOY").alias("_d"))
    off = pick_first(off, list(by), ["_t", "_d"]).select(*by, F.col("_ring").alias("_off"))
    d = d.join(off, list(by), "left").withColumn("_on", F.col(active) | F.col("_off").isNull() | (F.col("_ring") != F.col("_off")))
    # a run over the end of the axis begins with its last part and ends with its first
    edges = d.filter(~F.col("_on")).groupBy(*by, "_run").agg(F.min("DOY").alias("_a"), F.max("DOY").alias("_b")).groupBy(*by).agg(F.max_by("_a", "_run").alias("offStart"), F.min_by("_b", "_run").alias("offEnd"))
    piece = F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(_START, 0))
    pieces = d.withColumn("_piece", piece).filter("_on").groupBy(*by, "_piece").agg(
        F.min("DOY").alias("gStart"),
        F.max("DOY").alias("gEnd"),
        F.count(F.lit(1)).alias("_k"),
    )
    total = pieces.groupBy(*by).agg(F.sum("_k").alias("_all"))
    best = pick_first(pieces, list(by), [F.desc("_k"), F.col("gStart")]).join(total, list(by))
    return best.join(edges, list(by), "left").select(*by, "gStart", "gEnd", (F.col("_all") - F.col("_k")).alias("trimmed_days"), "offStart", "offEnd")

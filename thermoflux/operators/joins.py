"""Joins of site tables. Sides are broadcast only where they hold a row a site or a period and have been counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoflux.sources.io import stored

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_sites(df: DataFrame, sites: DataFrame, on: str = "site_id") -> DataFrame:
    """Attributes of the site, one row a site."""
    return df.join(small(sites), on, "left")


def join_sun_times(df: DataFrame, sun: DataFrame, keys: tuple[str, ...] = ("site_id", "date")) -> DataFrame:
    return df.join(sun, list(keys), "left")


def join_daily_swc(df: DataFrame, swc: DataFrame, keys: tuple[str, ...] = ("site_id", "YEAR", "MONTH", "DAY")) -> DataFrame:
    """Daily soil water in place of the table's own; rows without one are dropped."""
    return df.drop("SWC").join(swc.select(*keys, "SWC"), list(keys)).filter(F.col("SWC").isNotNull())


def join_previous_day(nights: DataFrame, daily: DataFrame, value: str, first_doy: Column | None = None) -> DataFrame:
    """A night takes the day before it: from noon on (or on the first day) the same date's value, else the previous day's."""
    edge = F.lit(1) if first_doy is None else first_doy
    key = F.when((F.col("HOUR") >= 12) | (F.col("DOY") == edge), F.col("DOY")).otherwise(F.col("DOY") - 1)
    d = daily.select("site_id", "YEAR", F.col("DOY").alias("_day"), value)
    return nights.withColumn("_day", key).join(d, ["site_id", "YEAR", "_day"]).drop("_day")


def join_season_threshold(df: DataFrame, thresholds: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Threshold of the site's season; where it is missing, the one of the site's year in ``fallback``."""
    out = df.join(thresholds, ["site_id", "season"], "left")
    if fallback is not None:
        f = fallback.select("site_id", "YEAR", F.col("threshold").alias("_year_threshold"))
        out = out.join(f, ["site_id", "YEAR"], "left").withColumn("threshold", F.coalesce("threshold", "_year_threshold")).drop("_year_threshold")
    return out


def fill_from_climatology(
    df: DataFrame,
    climatology: DataFrame,
    columns: list[str],
    keys: tuple[str, ...] = ("site_id", "DOY", "HOUR", "MINUTE"),
) -> DataFrame:
    """Missing values take those of the climatology (same column names)."""
    c = climatology.select(*keys, *[F.col(x).alias(f"_{x}") for x in columns])
    return df.join(c, list(keys), "left").withColumns({x: F.coalesce(x, f"_{x}") for x in columns}).drop(*[f"_{x}" for x in columns])


#: Periods of one key up to which a row may meet them all.
FEW_PERIODS = 64


def dyadic_blocks(low: Column, high: Column, levels: int) -> Column:
    """Array of (level, block): the fewest blocks ``[block * 2**level, (block + 1) * 2**level)`` that make up the whole numbers from ``low`` to ``high``;
    at most two a level."""

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        a, b = F.ceil(low / size), F.floor((high + 1) / size)
        odd = F.pmod(a, F.lit(2)) == 1
        none = F.lit(None).cast("struct<level:int,block:bigint>")
        left = F.when(odd & (a < b), F.struct(k.alias("level"), a.alias("block"))).otherwise(none)
        right = F.when((F.pmod(b, F.lit(2)) == 1) & (a + odd.cast("long") < b), F.struct(k.alias("level"), (b - 1).alias("block"))).otherwise(none)
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())


def range_join(df: DataFrame, periods: DataFrame, value: str, low: str, high: str, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Rows with the periods that hold ``value`` (low and high included), within equal ``keys``.

    Periods are written once and counted. A small table with at most ``FEW_PERIODS`` a key is broadcast. Otherwise a period is listed in its dyadic blocks, at most two for
    every doubling of its length, and a row in one block of each level that any period uses; that is a join by equality in which a row and a period
    meet at most once, however long, many or nested the periods are. A period that ends before it begins holds nothing."""
    p = stored(periods.filter(F.col(low) <= F.col(high)), "periods")
    size = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    count, most = (v or 0 for v in size)
    p = p.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = F.col(value).between(F.col(low), F.col(high))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    if count <= BROADCAST_ROWS and most <= FEW_PERIODS:
        return df.join(F.broadcast(p), cond).drop(*[f"_{k}" for k in keys])
    a, b = F.floor(F.col(low).cast("double")), F.floor(F.col(high).cast("double"))
    levels = max(0, int(p.agg(F.max(b - a + 1)).first()[0]).bit_length())
    p = p.withColumn("_at", F.explode(dyadic_blocks(a, b, levels))).withColumns({"_pl": F.col("_at")["level"], "_pb": F.col("_at")["block"]}).drop("_at")
    used = sorted(r[0] for r in p.select("_pl").distinct().collect())  # at most as many as a length has digits
    d = df.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in used]))).withColumn("_block", F.floor(F.col(value).cast("double") / F.pow(F.lit(2.0), F.col("_level"))))
    cond = cond & (F.col("_level") == F.col("_pl")) & (F.col("_block") == F.col("_pb"))
    p = F.broadcast(p) if count * 2 * len(used) <= BROADCAST_ROWS else p
    return d.join(p, cond).drop("_level", "_block", "_pl", "_pb", *[f"_{k}" for k in keys])


def semi_years(df: DataFrame, years: DataFrame, keys: tuple[str, ...] = ("site_id", "YEAR")) -> DataFrame:
    return df.join(years, list(keys), "left_semi")


def anti_years(df: DataFrame, years: DataFrame, keys: tuple[str, ...] = ("site_id", "YEAR")) -> DataFrame:
    return df.join(years, list(keys), "left_anti")


def align_sites(target: DataFrame, donor: DataFrame, value: str, keys: tuple[str, ...] = ("stamp",)) -> DataFrame:
    """Values of target and donor at the same time, to calibrate one by the other."""
    return target.select(*keys, F.col(value).alias("target")).join(donor.select(*keys, F.col(value).alias("donor")), list(keys))


def join_config(df: DataFrame, config: DataFrame, defaults: dict[str, object], on: str = "site_id") -> DataFrame:
    """One settings row a site; a site given twice is an error, one left out gets the defaults."""
    twice = [r[0] for r in config.groupBy(on).count().filter("count > 1").limit(20).collect()]
    if twice:
        raise ValueError(f"more than one row for {twice}")
    out = df.join(small(config), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def months_to_rows(wide: DataFrame, prefix: str, site_col: str = "site_id", value: str = "value") -> DataFrame:
    """(site, MONTH, value) from columns prefix1 .. prefix12."""
    cols = [f"{prefix}{m}" for m in range(1, 13)]
    long = wide.unpivot([site_col], cols, "_m", value)
    return long.select(site_col, F.substring("_m", len(prefix) + 1, 2).cast("int").alias("MONTH"), value)


def donor_rows(donor_map: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of each target's donors: ``donor_map`` is (target, donors array), in order of preference."""
    pairs = donor_map.select("target", F.posexplode("donors").alias("pos", "site_id"))
    return small(pairs).join(observations, "site_id").withColumnRenamed("site_id", "donor")

"""Row-wise operators: time parts, season axes, quality filters, units and variable choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.operators.joins import small

#: Day of year from which the southern season axis starts, and its length.
SOUTH_START, YEAR_DAYS = 183, 366
#: Public Magnus form of the saturation vapour pressure (hPa, degrees C).
MAGNUS = (6.1078, 17.08085, 234.175)


def parse_stamp(stamp: Column, minutes: float | Column = 0) -> Column:
    """``yyyyMMddHHmm`` (number or text) as a timestamp, moved by ``minutes`` (half an interval, for its midpoint)."""
    ts = F.to_timestamp_ntz(F.lpad(stamp.cast("string"), 12, "0"), F.lit("yyyyMMddHHmm"))
    return ts + F.make_dt_interval(mins=minutes if isinstance(minutes, Column) else F.lit(minutes))


def calendar_parts(df: DataFrame, ts_col: str = "stamp") -> DataFrame:
    ts = F.col(ts_col)
    return df.withColumns({
        "YEAR": F.year(ts),
        "MONTH": F.month(ts),
        "DAY": F.dayofmonth(ts),
        "DOY": F.dayofyear(ts),
        "HOUR": F.hour(ts),
        "MINUTE": F.minute(ts),
    })


def sampling_interval(df: DataFrame, ts_col: str = "stamp", site_col: str = "site_id") -> DataFrame:
    """(site, dt in hours, n_per_day): median step between the distinct stamps of a site."""
    step = Window.partitionBy(site_col).orderBy(ts_col)
    seconds = F.col(ts_col).cast("timestamp").cast("double")
    steps = df.select(site_col, ts_col).distinct().withColumn("_dt", (seconds - F.lag(seconds).over(step)) / 3600)
    return steps.groupBy(site_col).agg(F.percentile("_dt", F.lit(0.5)).alias("dt")).withColumn("n_per_day", F.bround(24 / F.col("dt")).cast("bigint"))


def shift_doy_south(doy: Column, south: Column) -> Column:
    """Southern days before mid-year move to the end of the axis (367 and on)."""
    return F.when(south & (doy < SOUTH_START), doy + YEAR_DAYS).otherwise(doy)


def unshift_doy(doy: Column) -> Column:
    return F.when(doy > YEAR_DAYS, doy - YEAR_DAYS).otherwise(doy)


def growing_year(year: Column, doy: Column) -> Column:
    return F.when(doy <= YEAR_DAYS, year).otherwise(year - 1)


def drop_incomplete_growing_years(df: DataFrame, south_sites: DataFrame, site_col: str = "site_id", year_col: str = "growing_year") -> DataFrame:
    """Sites of ``south_sites`` lose the growing years outside their first .. last - 1."""
    span = df.groupBy(site_col).agg(F.min(year_col).alias("_lo"), F.max(year_col).alias("_hi")).join(south_sites.select(site_col).distinct(), site_col)
    out = df.join(span, site_col, "left")
    return out.filter(F.col("_lo").isNull() | F.col(year_col).between(F.col("_lo"), F.col("_hi") - 1)).drop("_lo", "_hi")


def night_quality_filter(
    df: DataFrame,
    temperature: str = "TS",
    qc_allowed: tuple[int, ...] = (0, 1),
    flux_qc: str = "QC",
    low: float = -5.0,
    high: float = 30.0,
    qc: str | None = None,
) -> DataFrame:
    """Measured night rows: flux quality 0, NIGHT 1, flux within (low, high), temperature present and of an allowed quality."""
    ok = (F.col(flux_qc) == 0) & (F.col("NIGHT") == 1) & (F.col("NEE") > low) & (F.col("NEE") < high) & F.col(temperature).isNotNull()
    return df.filter(ok & F.col(qc).isin(*qc_allowed) if qc else ok)


def measured_filter(df: DataFrame, ustar_threshold: Column, use_swc: Column | bool = False, tundra: Column | bool = False) -> DataFrame:
    """Rows with flux, temperature and friction velocity (and soil water where used), well mixed, and at night - in tundra also dark."""
    swc = use_swc if isinstance(use_swc, Column) else F.lit(use_swc)
    cold = tundra if isinstance(tundra, Column) else F.lit(tundra)
    present = F.col("NEE").isNotNull() & F.col("TS").isNotNull() & F.col("USTAR").isNotNull() & (~swc | F.col("SWC").isNotNull())
    dark = (F.col("NIGHT") == 1) | (cold & (F.col("SW_IN") < 10))
    return df.filter(present & (F.col("USTAR") >= ustar_threshold) & dark)


def choose_flux_product(df: DataFrame, preferred: str, fallback: str, name: str = "NEE") -> DataFrame:
    """The preferred product's column where the table has it, else the fallback's."""
    for c in (preferred, fallback):
        if c in df.columns:
            return df.withColumn(name, F.col(c))
    raise ValueError(f"neither {preferred} nor {fallback} is there")


def apply_variable_map(long: DataFrame, mapping: DataFrame, keys: tuple[str, ...] = ("site_id", "stamp")) -> DataFrame:
    """Long observations (keys, variable, value) to target variables by a site's map (site_id, target, expression ``A+B``).

    A sum is null unless all its terms are there. One row per key and target."""
    terms = mapping.withColumn("_terms", F.transform(F.split("expression", r"\+"), lambda t: F.trim(t)))
    terms = terms.select("site_id", "target", F.size("_terms").alias("_n"), F.explode("_terms").alias("variable"))
    joined = long.join(terms, ["site_id", "variable"])
    total = F.when(F.count("value") == F.max("_n"), F.sum("value"))
    return joined.groupBy(*keys, "target").agg(total.alias("value"))


def coalesce_sensors(primary: Column, secondary: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return F.coalesce(primary, secondary * slope + intercept)


def replace_temperature_source(df: DataFrame, choice: DataFrame, column: str = "TA", site_col: str = "site_id") -> DataFrame:
    """``column`` from the column that ``choice`` (site, source column) names for a site; unchanged for others."""
    # at most one name a column of ``df``
    sources = [r[0] for r in choice.filter(F.col("source_col").isin(df.columns)).select("source_col").distinct().collect()]
    out = df.join(small(choice.select(site_col, F.col("source_col").alias("_src"))), site_col, "left")
    value = F.col(column)
    for s in sources:
        value = F.when(F.col("_src") == s, F.col(s)).otherwise(value)
    return out.withColumn(column, value).drop("_src")


def ppfd_to_sw(value: Column, variable: Column) -> Column:
    """Photon flux to short-wave radiation where the variable's name starts with PPFD."""
    return F.when(variable.startswith("PPFD"), value / 2.3).otherwise(value)


def rh_to_vpd(rh: Column, ta: Column) -> Column:
    a, b, c = MAGNUS
    return a * F.exp(b * ta / (c + ta)) * (1 - rh / 100)


def parse_year_list(text: Column) -> Column:
    """``2008, 2011:2013`` as an array of years; null or blank text as an empty one."""
    part = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), ",")
    spans = F.transform(
        F.filter(part, lambda p: p != ""),
        lambda p: F.sequence(F.element_at(F.split(p, ":"), 1).cast("int"), F.element_at(F.split(p, ":"), -1).cast("int")),
    )
    return F.coalesce(F.flatten(spans), F.expr("cast(array() as array<int>)"))


def min_year_filter(df: DataFrame, starts: DataFrame, site_col: str = "site_id", year_col: str = "YEAR") -> DataFrame:
    """Sites of ``starts`` (site, start_year) keep the years from their start on."""
    out = df.join(small(starts.select(site_col, "start_year")), site_col, "left")
    return out.filter(F.col("start_year").isNull() | (F.col(year_col) >= F.col("start_year"))).drop("start_year")


def sun_times(lat: Column, lon: Column, offset_hours: Column, doy: Column) -> tuple[Column, Column]:
    """Sunrise and sunset in local standard hours from the public solar-position series; null in polar day and night."""
    g = 2 * math.pi / 365 * (doy - 1)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    dec = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    rad = F.radians(lat)
    ratio = math.cos(math.radians(90.833)) / (F.cos(rad) * F.cos(dec)) - F.tan(rad) * F.tan(dec)
    half = F.when(F.abs(ratio) <= 1, F.degrees(F.acos(F.when(F.abs(ratio) <= 1, ratio))) / 15)
    noon = 12 - lon / 15 - eq / 60 + offset_hours
    return noon - half, noon + half


def day_night_flag(df: DataFrame, sites: DataFrame, dt_hours: float, ts_col: str = "stamp", site_col: str = "site_id") -> DataFrame:
    """``daytime``: the interval around the stamp reaches into daylight; in polar seasons April to August is day.

    Sun times are found once for each site and date, then joined. ``sites``: site, LAT, LONG, utc_offset."""
    day = F.to_date(ts_col)
    dates = df.select(site_col, day.alias("_date")).distinct().join(small(sites.select(site_col, "LAT", "LONG", "utc_offset")), site_col)
    rise, sets = sun_times(F.col("LAT"), F.col("LONG"), F.col("utc_offset"), F.dayofyear("_date"))
    dates = dates.select(site_col, "_date", rise.alias("_rise"), sets.alias("_set"))
    out = df.withColumn("_date", day).join(dates, [site_col, "_date"], "left")
    hour = F.hour(ts_col) + F.minute(ts_col) / 60
    light = (hour + dt_hours / 2 >= F.col("_rise")) & (hour - dt_hours / 2 <= F.col("_set"))
    return out.withColumn("daytime", F.coalesce(light, F.month("_date").between(4, 8))).drop("_date", "_rise", "_set")


def lagged_year_fill(df: DataFrame, column: str, days: int = 4 * 365, keys: tuple[str, ...] = ("site_id",), ts_col: str = "stamp") -> DataFrame:
    """Missing values take the value ``days`` later."""
    later = df.select(
        *keys,
        (F.col(ts_col) - F.make_dt_interval(days=F.lit(days))).alias(ts_col),
        F.col(column).alias("_later"),
    ).groupBy(*keys, ts_col).agg(F.max("_later").alias("_later"))
    return df.join(later, [*keys, ts_col], "left").withColumn(column, F.coalesce(column, "_later")).drop("_later")


def window_count(start: Column, end: Column, size: int = 14) -> Column:
    return F.greatest(F.ceil((end - start + 1) / size), F.lit(1))


def window_id(doy: Column, start: Column, end: Column, size: int = 14) -> Column:
    """Tile of a day from the season's start on; null outside the season."""
    return F.when(doy.between(start, end), F.floor((doy - start) / size))


def season_windows(seasons: DataFrame, size: int = 14) -> DataFrame:
    """(site, window, w_start, w_end): tiles of ``size`` days, the last cut at the season's end."""
    n = window_count(F.col("gStart"), F.col("gEnd"), size)
    out = seasons.withColumn("window", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    lo = F.col("gStart") + F.col("window") * size
    return out.withColumns({"w_start": lo, "w_end": F.least(lo + size - 1, F.col("gEnd"))})


def season_windows_rounded(seasons: DataFrame, size: int = 14) -> DataFrame:
    """Older tiles: their number is rounded, neighbours share a day, and the last one is stretched to the season's end."""
    n = F.greatest(F.bround((F.col("gEnd") - F.col("gStart")) / size), F.lit(1)).cast("int")
    out = seasons.withColumn("nwindow", n).withColumn("window", F.explode(F.sequence(F.lit(0), n - 1)))
    lo = F.col("gStart") + F.col("window") * size
    return out.withColumns({"w_start": lo, "w_end": F.when(F.col("window") == F.col("nwindow") - 1, F.col("gEnd")).otherwise(lo + size)})


def regroup_classes(df: DataFrame, mapping: DataFrame, column: str, name: str) -> DataFrame:
    """Codes to groups by a mapping table (code, group); codes without one become null."""
    return df.join(small(mapping.select(F.col("code").alias(column), F.col("group").alias(name))), column, "left")


def season_rule(lat: Column, igbp: Column, humid: Column, estimated: Column, override: Column, whole: int) -> Column:
    """A user's season bound wins; tropical sites and humid evergreen forests are active all year; else the estimate."""
    all_year = (F.abs(lat) < 23.5) | ((igbp == "EBF") & humid)
    return F.coalesce(override, F.when(all_year, F.lit(whole)).otherwise(estimated))


def flux_per_day(total: Column, dt_minutes: float) -> Column:
    """Sum of half-hourly or hourly fluxes to a daily mean flux."""
    return total * (dt_minutes * 60 / 86400)


def flux_carbon(total: Column, dt_minutes: float) -> Column:
    """Sum of fluxes (micromol per second) to grams of carbon."""
    return total * (dt_minutes * 60 / 1e6 * 12)


def gpp_per_year(gpp_8day: Column) -> Column:
    return gpp_8day / 8 * 365.25


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def clamp_nonneg(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def indirect_effect(total: DataFrame, direct: DataFrame, site_col: str = "site_id") -> DataFrame:
    """(site, TAS_tot, TAS, TAS_app): the apparent response is total less direct."""
    t = total.select(site_col, F.col("TAS").alias("TAS_tot"))
    return t.join(direct.select(site_col, "TAS"), site_col).withColumn("TAS_app", F.col("TAS_tot") - F.col("TAS"))


def use_temperature(df: DataFrame, variable: str) -> DataFrame:
    """Soil (TS) or air (TA) temperature as column T."""
    if variable not in ("TS", "TA"):
        raise ValueError("TS or TA")
    return df.withColumn("T", F.col(variable))

"""Queries of the row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermoflux.functions import scalars as sc
from thermoflux.operators.joins import small
from thermoflux.plans.registry import query
from thermoflux.plans.views import MULTI, SUB, obs_multi, obs_sub, r6, table


@query("p1_parse_stamp", f"WITH {SUB} SELECT event_id, date_trunc('minute', stamp) + INTERVAL 15 MINUTE AS mid FROM sub")
def p1(spark, d):
    sub = obs_sub(spark, d)
    return sub.select("event_id", sc.parse_stamp(F.date_format("stamp", "yyyyMMddHHmm").cast("bigint"), 15).alias("mid"))


@query("p2_calendar_parts", "SELECT event_id, year(ts) AS YEAR, month(ts) AS MONTH, day(ts) AS DAY, dayofyear(ts) AS DOY, hour(ts) AS HOUR, minute(ts) AS MINUTE FROM events")
def p2(spark, d):
    out = sc.calendar_parts(table(spark, d, "events"), "ts")
    return out.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ("YEAR", "MONTH", "DAY", "DOY", "HOUR", "MINUTE")])


@query("p3_sampling_interval", f"WITH {SUB}, s AS (SELECT site_id, epoch(stamp) AS t FROM (SELECT DISTINCT site_id, stamp FROM sub)), g AS (SELECT site_id, (t - lag(t) OVER (PARTITION BY site_id ORDER BY t)) / 3600.0::DOUBLE AS dt FROM s) SELECT site_id, round(quantile_cont(dt, 0.5), 6) AS dt, round_even(24 / quantile_cont(dt, 0.5), 0)::BIGINT AS n_per_day FROM g GROUP BY 1")
def p3(spark, d):
    return sc.sampling_interval(obs_sub(spark, d)).select("site_id", r6("dt").alias("dt"), "n_per_day")


_SOUTH = "CASE WHEN site_id >= 7 AND DOY < 183 THEN DOY + 366 ELSE DOY END"


def south(spark, d):
    """obs_multi with sites 7-9 on the southern axis."""
    obs = obs_multi(spark, d)
    obs = obs.withColumn("DOY", sc.shift_doy_south(F.col("DOY"), F.col("site_id") >= 7))
    return obs.withColumn("growing_year", sc.growing_year(F.col("YEAR"), F.col("DOY")))


SOUTH = f"south AS (SELECT * REPLACE ({_SOUTH} AS DOY), CASE WHEN {_SOUTH} <= 366 THEN YEAR ELSE YEAR - 1 END AS growing_year FROM obs)"


@query("p4_shift_doy_south", f"WITH {MULTI} SELECT site_id, YEAR, min({_SOUTH}) AS lo, max({_SOUTH}) AS hi, sum(DOY)::BIGINT AS doys FROM obs GROUP BY 1, 2")
def p4(spark, d):
    return south(spark, d).groupBy("site_id", "YEAR").agg(F.min("DOY").alias("lo"), F.max("DOY").alias("hi"), F.sum(sc.unshift_doy(F.col("DOY"))).alias("doys"))


@query("p5_growing_year", f"WITH {MULTI}, {SOUTH} SELECT site_id, growing_year, count(*) AS n FROM south GROUP BY 1, 2")
def p5(spark, d):
    return south(spark, d).groupBy("site_id", "growing_year").agg(F.count("*").alias("n"))


@query("p6_drop_incomplete_years", f"WITH {MULTI}, {SOUTH}, m AS (SELECT site_id, max(growing_year) AS hi FROM south GROUP BY 1) SELECT site_id, growing_year, count(*) AS n FROM south JOIN m USING (site_id) WHERE site_id < 8 OR growing_year < hi GROUP BY 1, 2")
def p6(spark, d):
    south_sites = spark.range(8, 10).select(F.col("id").alias("site_id"))
    return sc.drop_incomplete_growing_years(south(spark, d), south_sites).groupBy("site_id", "growing_year").agg(F.count("*").alias("n"))


@query("p7_night_quality", f"WITH {MULTI} SELECT site_id, YEAR, count(*) AS n, round(sum(NEE), 6) AS nee FROM obs WHERE QC < 2 AND l_linenumber % 3 = 0 AND NIGHT = 1 AND NEE > -5 AND NEE < 30 AND TS IS NOT NULL GROUP BY 1, 2")
def p7(spark, d):
    obs = obs_multi(spark, d).withColumn("FLUX_QC", F.col("l_linenumber") % 3)
    return sc.night_quality_filter(obs, "TS", (0, 1), "FLUX_QC", qc="QC").groupBy("site_id", "YEAR").agg(F.count("*").alias("n"), r6(F.sum("NEE")).alias("nee"))


@query("p8_measured", f"WITH {MULTI} SELECT site_id, count(*) AS n FROM obs WHERE NEE IS NOT NULL AND TS IS NOT NULL AND (site_id < 5 OR SWC IS NOT NULL) AND SWC >= 0.03 AND (NIGHT = 1 OR (site_id = 2 AND TA < 10)) GROUP BY 1")
def p8(spark, d):
    obs = obs_multi(spark, d).withColumns({"USTAR": F.col("SWC"), "SW_IN": F.col("TA")})
    return sc.measured_filter(obs, F.lit(0.03), F.col("site_id") >= 5, F.col("site_id") == 2).groupBy("site_id").agg(F.count("*").alias("n"))


@query("p9_choose_flux_product", f"WITH {MULTI} SELECT site_id, round(sum(NEE), 6) AS nee FROM obs GROUP BY 1")
def p9(spark, d):
    obs = obs_multi(spark, d).withColumnRenamed("NEE", "NEE_CUT_REF")
    return sc.choose_flux_product(obs, "NEE_VUT_REF", "NEE_CUT_REF").groupBy("site_id").agg(r6(F.sum("NEE")).alias("nee"))


@query("p10_variable_map", f"WITH {MULTI} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, target, round(value, 6) AS value FROM (SELECT *, CASE WHEN site_id < 5 THEN NEE + SWC ELSE NEE END AS fc, TS AS ts2 FROM obs) UNPIVOT INCLUDE NULLS (value FOR target IN (fc, ts2))")
def p10(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    long = obs_multi(spark, d).unpivot(["site_id", *key], ["NEE", "SWC", "TS"], "variable", "value")
    sites = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("site_id")).distinct()
    fc = sites.select("site_id", F.lit("fc").alias("target"), F.when(F.col("site_id") < 5, "NEE + SWC").otherwise("NEE").alias("expression"))
    mapping = fc.unionByName(sites.select("site_id", F.lit("ts2").alias("target"), F.lit("TS").alias("expression")))
    return sc.apply_variable_map(long, mapping, ("site_id", *key)).select(*key, "target", r6("value").alias("value"))


@query("p11_coalesce_sensors", f"WITH {MULTI} SELECT site_id, round(sum(coalesce(TS, TA * 0.9::DOUBLE + 1.5::DOUBLE)), 4) AS ts FROM obs GROUP BY 1")
def p11(spark, d):
    c = sc.coalesce_sensors(F.col("TS"), F.col("TA"), 0.9, 1.5)
    return obs_multi(spark, d).groupBy("site_id").agg(F.round(F.sum(c), 4).alias("ts"))


@query("p12_temperature_source", f"WITH {MULTI} SELECT site_id, round(sum(CASE WHEN site_id IN (1, 4) THEN TS ELSE TA END), 4) AS ta FROM obs GROUP BY 1")
def p12(spark, d):
    choice = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("site_id")).distinct().filter("site_id IN (1, 4)").withColumn("source_col", F.lit("TS"))
    return sc.replace_temperature_source(obs_multi(spark, d), choice).groupBy("site_id").agg(F.round(F.sum("TA"), 4).alias("ta"))


@query("p13_ppfd_to_sw", "SELECT event_id, round(CASE WHEN event_type LIKE 'c%' THEN value / 2.3::DOUBLE ELSE value END, 6) AS sw FROM events")
def p13(spark, d):
    name = F.when(F.col("event_type").startswith("c"), "PPFD_IN").otherwise("SW_IN")
    return table(spark, d, "events").select("event_id", r6(sc.ppfd_to_sw(F.col("value"), name)).alias("sw"))


@query("p14_rh_to_vpd", f"WITH {MULTI} SELECT site_id, round(avg(6.1078::DOUBLE * exp(17.08085::DOUBLE * TA / (234.175::DOUBLE + TA)) * (1 - SWC * 10)), 6) AS vpd FROM obs GROUP BY 1")
def p14(spark, d):
    return obs_multi(spark, d).groupBy("site_id").agg(r6(F.avg(sc.rh_to_vpd(F.col("SWC") * 1000, F.col("TA")))).alias("vpd"))


@query("p15_parse_year_list", """WITH t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '2008,  2012, ' || (2000 + s_suppkey % 9)::VARCHAR WHEN 1 THEN (2000 + s_suppkey % 5)::VARCHAR || ':2007, 2013' END AS txt FROM supplier),
p AS (SELECT s_suppkey, unnest(string_split(regexp_replace(txt, '\\s', '', 'g'), ',')) AS p FROM t WHERE txt IS NOT NULL)
SELECT s_suppkey, unnest(range(split_part(p, ':', 1)::BIGINT, (CASE WHEN p LIKE '%:%' THEN split_part(p, ':', 2) ELSE p END)::BIGINT + 1)) AS y FROM p""")
def p15(spark, d):
    k = F.col("s_suppkey")
    txt = F.when(k % 3 == 0, F.concat(F.lit("2008,  2012, "), (2000 + k % 9).cast("string"))).when(k % 3 == 1, F.concat((2000 + k % 5).cast("string"), F.lit(":2007, 2013")))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(sc.parse_year_list(txt)).alias("y")).withColumn("y", F.col("y").cast("bigint"))


@query("p16_min_year", f"WITH {MULTI} SELECT site_id, YEAR, count(*) AS n FROM obs WHERE NOT (site_id % 4 = 1 AND YEAR < 1997) GROUP BY 1, 2")
def p16(spark, d):
    obs = obs_multi(spark, d)
    starts = obs.select("site_id").distinct().filter("site_id % 4 = 1").withColumn("start_year", F.lit(1997))
    return sc.min_year_filter(obs, starts).groupBy("site_id", "YEAR").agg(F.count("*").alias("n"))


@query("p17_day_night")
def p17(spark, d):
    sub = obs_sub(spark, d)
    sites = sub.select("site_id").distinct().select("site_id", (F.length("site_id") * 6.0).alias("LAT"), F.lit(8.0).alias("LONG"), F.lit(1.0).alias("utc_offset"))
    return sc.day_night_flag(sub, sites, 0.5).groupBy("site_id", "HOUR").agg(F.count("*").alias("n"), F.count(F.when(F.col("daytime"), 1)).alias("n_day"))


@query("p18_lagged_year_fill", f"WITH {MULTI}, dd AS (SELECT site_id, stamp, max(CASE WHEN YEAR > 1998 OR DAY % 2 = 0 THEN SWC END) AS swc FROM obs GROUP BY 1, 2) SELECT a.site_id, a.stamp, coalesce(a.swc, b.swc) AS swc FROM dd a LEFT JOIN dd b ON a.site_id = b.site_id AND b.stamp = a.stamp + INTERVAL 1460 DAY")
def p18(spark, d):
    day = obs_multi(spark, d).groupBy("site_id", "stamp").agg(F.max(F.when((F.col("YEAR") > 1998) | (F.col("DAY") % 2 == 0), F.col("SWC"))).alias("swc"))
    return sc.lagged_year_fill(day, "swc").select("site_id", "stamp", "swc")


@query("p19_window_id", f"WITH {MULTI} SELECT site_id, (DOY - (60 + site_id)) // 14 AS win, count(*) AS n, max(least((DOY - (60 + site_id)) // 14 * 14 + 60 + site_id + 13, 300)) AS w_end FROM obs WHERE DOY BETWEEN 60 + site_id AND 300 GROUP BY 1, 2")
def p19(spark, d):
    obs = obs_multi(spark, d)
    lo, hi = 60 + F.col("site_id"), F.lit(300)
    wins = sc.season_windows(obs.select("site_id").distinct().select("site_id", lo.alias("gStart"), hi.alias("gEnd")))
    n = obs.withColumn("window", sc.window_id(F.col("DOY"), lo, hi)).filter("window IS NOT NULL").groupBy("site_id", "window").agg(F.count("*").alias("n"))
    return n.join(wins, ["site_id", "window"]).select("site_id", F.col("window").cast("bigint").alias("win"), "n", F.col("w_end").cast("bigint").alias("w_end"))


@query("p19b_window_rounded", f"""WITH {MULTI}, s AS (SELECT DISTINCT site_id, 60 + site_id AS a, 300 AS b FROM obs),
w AS (SELECT site_id, a, b, unnest(range(0, n)) AS k, n FROM (SELECT *, greatest(round_even((b - a) / 14, 0)::BIGINT, 1) AS n FROM s))
SELECT o.site_id, k AS win, count(*) AS n FROM obs o JOIN w ON o.site_id = w.site_id AND DOY BETWEEN a + k * 14 AND CASE WHEN k = n - 1 THEN b ELSE a + k * 14 + 14 END GROUP BY 1, 2""")
def p19b(spark, d):
    obs = obs_multi(spark, d)
    wins = sc.season_windows_rounded(obs.select("site_id").distinct().select("site_id", (60 + F.col("site_id")).alias("gStart"), F.lit(300).alias("gEnd")))
    j = obs.join(small(wins), "site_id").filter("DOY BETWEEN w_start AND w_end")
    return j.groupBy("site_id", F.col("window").cast("bigint").alias("win")).agg(F.count("*").alias("n"))


@query("p20_regroup_classes", "SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'A' WHEN p_brand LIKE '%2' THEN 'B' END AS class FROM part")
def p20(spark, d):
    part = table(spark, d, "part")
    codes = part.select(F.col("p_brand").alias("code")).distinct().withColumn("group", F.when(F.col("code").endswith("1"), "A").when(F.col("code").endswith("2"), "B")).filter("`group` IS NOT NULL")
    return sc.regroup_classes(part, codes, "p_brand", "class").select("p_partkey", "class")


@query("p21_season_rule", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 33 WHEN abs(s_suppkey % 90 - 45) < 23.5 OR (s_nationkey = 3 AND s_suppkey % 2 = 0) THEN 1 ELSE s_suppkey % 100 + 20 END AS gStart FROM supplier")
def p21(spark, d):
    k = F.col("s_suppkey")
    igbp = F.when(F.col("s_nationkey") == 3, "EBF").otherwise("GRA")
    g = sc.season_rule(k % 90 - 45, igbp, k % 2 == 0, k % 100 + 20, F.when(k % 7 == 0, F.lit(33)), 1)
    return table(spark, d, "supplier").select("s_suppkey", g.cast("bigint").alias("gStart"))


@query("p22_flux_units", f"WITH {MULTI} SELECT site_id, round(sum(NEE) * (30 * 60 / 86400::DOUBLE), 4) AS per_day, round(sum(NEE) * (30 * 60 / 1e6::DOUBLE * 12), 6) AS carbon, round(avg(NEE) / 8 * 365.25::DOUBLE, 6) AS gpp FROM obs GROUP BY 1")
def p22(spark, d):
    g = obs_multi(spark, d).groupBy("site_id").agg(F.sum("NEE").alias("s"), F.avg("NEE").alias("m"))
    return g.select("site_id", F.round(sc.flux_per_day(F.col("s"), 30), 4).alias("per_day"), r6(sc.flux_carbon(F.col("s"), 30)).alias("carbon"), r6(sc.gpp_per_year(F.col("m"))).alias("gpp"))


@query("p23_complete_cases", f"WITH {MULTI} SELECT site_id, count(*) AS n FROM obs WHERE TS IS NOT NULL AND NEE IS NOT NULL GROUP BY 1")
def p23(spark, d):
    return sc.complete_cases(obs_multi(spark, d), ["TS", "NEE"]).groupBy("site_id").agg(F.count("*").alias("n"))


@query("p24_clamp_nonneg", f"WITH {SUB} SELECT site_id, DAY, round(greatest(avg(NEE - 8), 0), 6) AS m FROM sub GROUP BY 1, 2")
def p24(spark, d):
    return obs_sub(spark, d).groupBy("site_id", "DAY").agg(r6(sc.clamp_nonneg(F.avg(F.col("NEE") - 8))).alias("m"))


@query("p25_indirect_effect", f"WITH {MULTI}, a AS (SELECT site_id, avg(NEE) AS t, avg(TS) AS d FROM obs GROUP BY 1) SELECT site_id, round(t, 6) AS TAS_tot, round(d, 6) AS TAS, round(t - d, 6) AS TAS_app FROM a")
def p25(spark, d):
    obs = obs_multi(spark, d)
    out = sc.indirect_effect(obs.groupBy("site_id").agg(F.avg("NEE").alias("TAS")), obs.groupBy("site_id").agg(F.avg("TS").alias("TAS")))
    return out.select("site_id", *[r6(c).alias(c) for c in ("TAS_tot", "TAS", "TAS_app")])


@query("p26_use_temperature", f"WITH {MULTI} SELECT site_id, round(avg(TA), 6) AS t FROM obs GROUP BY 1")
def p26(spark, d):
    return sc.use_temperature(obs_multi(spark, d), "TA").groupBy("site_id").agg(r6(F.avg("T")).alias("t"))

"""Queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermoflux.operators import joins as j
from thermoflux.plans.registry import query
from thermoflux.plans.views import MULTI, SUB, obs_multi, obs_sub, r6, table


def _n():
    return F.count("*").alias("n")


@query("j1_site_attributes", f"WITH {MULTI} SELECT obs.site_id, n_name, count(*) AS n FROM obs LEFT JOIN nation ON site_id = n_nationkey AND n_nationkey != 4 GROUP BY 1, 2")
def j1(spark, d):
    nation = table(spark, d, "nation").filter("n_nationkey <> 4").select(F.col("n_nationkey").cast("bigint").alias("site_id"), "n_name")
    return j.join_sites(obs_multi(spark, d), nation).groupBy("site_id", "n_name").agg(_n())


@query("j2_sun_times", f"WITH {SUB}, t AS (SELECT site_id, stamp::DATE AS date, min(HOUR) AS h FROM sub WHERE DAY % 2 = 0 GROUP BY 1, 2) SELECT sub.site_id, DAY, count(*) AS n, count(h) AS n_h FROM sub LEFT JOIN t ON sub.site_id = t.site_id AND stamp::DATE = date GROUP BY 1, 2")
def j2(spark, d):
    sub = obs_sub(spark, d).withColumn("date", F.to_date("stamp"))
    sun = sub.filter("DAY % 2 = 0").groupBy("site_id", "date").agg(F.min("HOUR").alias("h"))
    return j.join_sun_times(sub, sun).groupBy("site_id", "DAY").agg(_n(), F.count("h").alias("n_h"))


@query("j3_daily_swc", f"WITH {MULTI}, w AS (SELECT site_id, YEAR, MONTH, DAY, max(CASE WHEN DAY % 5 != 0 THEN SWC END) AS s FROM obs WHERE MONTH != 2 GROUP BY ALL) SELECT site_id, YEAR, count(*) AS n, round(sum(s), 6) AS swc FROM obs JOIN w USING (site_id, YEAR, MONTH, DAY) WHERE s IS NOT NULL GROUP BY 1, 2")
def j3(spark, d):
    obs = obs_multi(spark, d)
    swc = obs.filter("MONTH <> 2").groupBy("site_id", "YEAR", "MONTH", "DAY").agg(F.max(F.when(F.col("DAY") % 5 != 0, F.col("SWC"))).alias("SWC"))
    return j.join_daily_swc(obs, swc).groupBy("site_id", "YEAR").agg(_n(), r6(F.sum("SWC")).alias("swc"))


@query("j4_previous_day", f"WITH {SUB}, u AS (SELECT site_id, YEAR, DOY, max(NEE) AS up FROM sub WHERE DAY % 7 != 0 GROUP BY ALL) SELECT s.site_id, s.DOY, count(*) AS n, round(sum(up), 6) AS up FROM sub s JOIN u ON s.site_id = u.site_id AND s.YEAR = u.YEAR AND u.DOY = CASE WHEN HOUR >= 12 OR s.DOY = 1 THEN s.DOY ELSE s.DOY - 1 END GROUP BY 1, 2")
def j4(spark, d):
    sub = obs_sub(spark, d)
    daily = sub.filter("DAY % 7 <> 0").groupBy("site_id", "YEAR", "DOY").agg(F.max("NEE").alias("up"))
    return j.join_previous_day(sub, daily, "up").groupBy("site_id", "DOY").agg(_n(), r6(F.sum("up")).alias("up"))


@query("j5_season_threshold", f"WITH {MULTI}, s AS (SELECT *, MONTH // 4 AS season FROM obs), t AS (SELECT site_id, season, min(SWC) AS th FROM s WHERE season != 2 GROUP BY 1, 2), f AS (SELECT site_id, YEAR, max(SWC) AS th FROM s GROUP BY 1, 2) SELECT s.site_id, s.season, round(sum(coalesce(t.th, f.th)), 6) AS th FROM s LEFT JOIN t ON s.site_id = t.site_id AND s.season = t.season LEFT JOIN f ON s.site_id = f.site_id AND s.YEAR = f.YEAR GROUP BY 1, 2")
def j5(spark, d):
    s = obs_multi(spark, d).withColumn("season", F.floor(F.col("MONTH") / 4))
    t = s.filter("season <> 2").groupBy("site_id", "season").agg(F.min("SWC").alias("threshold"))
    f = s.groupBy("site_id", "YEAR").agg(F.max("SWC").alias("threshold"))
    return j.join_season_threshold(s, t, f).groupBy("site_id", "season").agg(r6(F.sum("threshold")).alias("th"))


@query("j6_climatology_fill", f"WITH {MULTI}, c AS (SELECT site_id, DOY, avg(TS) AS t, avg(NEE) AS e FROM obs GROUP BY 1, 2) SELECT site_id, MONTH, round(sum(coalesce(TS, t)), 4) AS ts, round(sum(coalesce(NEE, e)), 4) AS nee FROM obs JOIN c USING (site_id, DOY) GROUP BY 1, 2")
def j6(spark, d):
    obs = obs_multi(spark, d)
    clim = obs.groupBy("site_id", "DOY").agg(F.avg("TS").alias("TS"), F.avg("NEE").alias("NEE"))
    return j.fill_from_climatology(obs, clim, ["TS", "NEE"], ("site_id", "DOY")).groupBy("site_id", "MONTH").agg(F.round(F.sum("TS"), 4).alias("ts"), F.round(F.sum("NEE"), 4).alias("nee"))


@query("j7_range_join", f"WITH {MULTI}, p AS (SELECT DISTINCT site_id, YEAR AS y, 20 * (YEAR - 1994) + site_id AS a, 20 * (YEAR - 1994) + site_id + 30 AS b FROM obs) SELECT o.site_id, y, count(*) AS n, round(sum(TA), 4) AS ta FROM obs o JOIN p ON o.site_id = p.site_id AND DOY BETWEEN a AND b GROUP BY 1, 2")
def j7(spark, d):
    obs = obs_multi(spark, d)
    lo = 20 * (F.col("YEAR") - 1994) + F.col("site_id")
    periods = obs.select("site_id", F.col("YEAR").alias("y"), lo.alias("a"), (lo + 30).alias("b")).distinct()
    return j.range_join(obs, periods, "DOY", "a", "b").groupBy("site_id", "y").agg(_n(), F.round(F.sum("TA"), 4).alias("ta"))


_GOOD = "g AS (SELECT site_id, YEAR FROM obs GROUP BY 1, 2 HAVING count(NEE) % 3 != 0)"


def _good(obs):
    return obs.groupBy("site_id", "YEAR").agg(F.count("NEE").alias("k")).filter("k % 3 <> 0").select("site_id", "YEAR")


@query("j8_semi_years", f"WITH {MULTI}, {_GOOD} SELECT site_id, YEAR, count(*) AS n FROM obs SEMI JOIN g USING (site_id, YEAR) GROUP BY 1, 2")
def j8(spark, d):
    obs = obs_multi(spark, d)
    return j.semi_years(obs, _good(obs)).groupBy("site_id", "YEAR").agg(_n())


@query("j9_anti_years", f"WITH {MULTI}, {_GOOD} SELECT site_id, YEAR, count(*) AS n FROM obs ANTI JOIN g USING (site_id, YEAR) GROUP BY 1, 2")
def j9(spark, d):
    obs = obs_multi(spark, d)
    return j.anti_years(obs, _good(obs)).groupBy("site_id", "YEAR").agg(_n())


@query("j10_align_sites", f"WITH {MULTI}, dd AS (SELECT site_id, stamp, avg(TA) AS ta FROM obs GROUP BY 1, 2) SELECT a.stamp, round(a.ta, 6) AS target, round(b.ta, 6) AS donor FROM dd a JOIN dd b USING (stamp) WHERE a.site_id = 1 AND b.site_id = 2")
def j10(spark, d):
    daily = obs_multi(spark, d).groupBy("site_id", "stamp").agg(F.avg("TA").alias("TA"))
    return j.align_sites(daily.filter("site_id = 1"), daily.filter("site_id = 2"), "TA").select("stamp", r6("target").alias("target"), r6("donor").alias("donor"))


@query("j11_config", f"WITH {MULTI} SELECT site_id, CASE WHEN site_id % 2 = 0 THEN site_id * 1.5::DOUBLE ELSE -2.0 END AS ta_min, count(*) AS n FROM obs GROUP BY 1, 2")
def j11(spark, d):
    obs = obs_multi(spark, d)
    config = obs.filter("site_id % 2 = 0").select("site_id").distinct().withColumn("ta_min", F.col("site_id") * 1.5)
    return j.join_config(obs, config, {"ta_min": -2.0}).groupBy("site_id", "ta_min").agg(_n())


@query("j12_months_to_rows", f"WITH {MULTI} SELECT site_id, MONTH, round(sum(TA + MONTH * 10 + site_id), 4) AS warm FROM obs GROUP BY 1, 2")
def j12(spark, d):
    obs = obs_multi(spark, d)
    wide = obs.select("site_id").distinct().select("site_id", *[(F.col("site_id") + m * 10).alias(f"Tmin{m}") for m in range(1, 13)])
    rows = j.months_to_rows(wide, "Tmin").withColumn("MONTH", F.col("MONTH").cast("bigint"))
    return obs.join(j.small(rows), ["site_id", "MONTH"]).groupBy("site_id", "MONTH").agg(F.round(F.sum(F.col("TA") + F.col("value")), 4).alias("warm"))


@query("j13_donor_rows", f"WITH {MULTI}, m AS (SELECT 0 AS target, unnest([3, 5, 7]) AS donor, unnest([0, 1, 2]) AS pos UNION ALL SELECT 1, 3, 0) SELECT target::BIGINT AS target, donor::BIGINT AS donor, pos::BIGINT AS pos, count(*) AS n, round(sum(TA), 4) AS ta FROM m JOIN obs ON donor = site_id GROUP BY 1, 2, 3")
def j13(spark, d):
    obs = obs_multi(spark, d)
    sites = obs.select("site_id").distinct().filter("site_id < 2")
    donors = F.when(F.col("site_id") == 0, F.array(*[F.lit(x).cast("bigint") for x in (3, 5, 7)])).otherwise(F.array(F.lit(3).cast("bigint")))
    return j.donor_rows(sites.select(F.col("site_id").alias("target"), donors.alias("donors")), obs).groupBy("target", "donor", F.col("pos").cast("bigint").alias("pos")).agg(_n(), F.round(F.sum("TA"), 4).alias("ta"))


@query("o1_order_by", f"WITH {MULTI} SELECT site_id, YEAR, round(sum(NEE), 6) AS nee FROM obs GROUP BY 1, 2 ORDER BY site_id, YEAR")
def o1(spark, d):
    return obs_multi(spark, d).groupBy("site_id", "YEAR").agg(r6(F.sum("NEE")).alias("nee")).orderBy("site_id", "YEAR")


@query("o2_first_rows", f"WITH {MULTI} SELECT site_id, YEAR, n FROM (SELECT site_id, YEAR, count(*) AS n FROM obs GROUP BY 1, 2) ORDER BY n DESC, site_id, YEAR LIMIT 3")
def o2(spark, d):
    return obs_multi(spark, d).groupBy("site_id", "YEAR").agg(_n()).orderBy(F.desc("n"), "site_id", "YEAR").limit(3)


@query("o3_union_by_name", f"WITH {MULTI}, {SUB} SELECT kind, count(*) AS n, count(TA) AS n_ta FROM (SELECT 'm' AS kind, TA FROM obs UNION ALL SELECT 's', NULL FROM sub) GROUP BY 1")
def o3(spark, d):
    a = obs_multi(spark, d).select(F.lit("m").alias("kind"), "TA", "NEE")
    b = obs_sub(spark, d).select("NEE", F.lit("s").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(_n(), F.count("TA").alias("n_ta"))


_A, _B = "SELECT site_id, YEAR FROM obs WHERE MONTH = 1", "SELECT site_id, YEAR FROM obs WHERE MONTH = 12 AND DAY > 20"


def _years(spark, d):
    obs = obs_multi(spark, d)
    return obs.filter("MONTH = 1").select("site_id", "YEAR"), obs.filter("MONTH = 12 AND DAY > 20").select("site_id", "YEAR")


@query("o4_union_distinct", f"WITH {MULTI} {_A} UNION {_B}")
def o4(spark, d):
    a, b = _years(spark, d)
    return a.union(b).distinct()


@query("o5_intersect", f"WITH {MULTI} {_A} INTERSECT {_B}")
def o5(spark, d):
    a, b = _years(spark, d)
    return a.intersect(b)


@query("o6_except", f"WITH {MULTI} {_A} AND DAY < 9 EXCEPT {_B}")
def o6(spark, d):
    _, b = _years(spark, d)
    return obs_multi(spark, d).filter("MONTH = 1 AND DAY < 9").select("site_id", "YEAR").subtract(b)


@query("o7_pivot", f"WITH {MULTI} SELECT site_id, round(avg(TA) FILTER (WHERE MONTH = 1), 6) AS t1, round(avg(TA) FILTER (WHERE MONTH = 7), 6) AS t7 FROM obs GROUP BY 1")
def o7(spark, d):
    out = obs_multi(spark, d).groupBy("site_id").pivot("MONTH", [1, 7]).agg(F.avg("TA"))
    return out.select("site_id", r6(F.col("1")).alias("t1"), r6(F.col("7")).alias("t7"))

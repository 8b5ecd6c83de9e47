"""Queries of the fitted models and the jobs composed of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from thermoflux.functions import scalars as sc
from thermoflux.operators import control, curves, drivers, future, gapfill, regression, response, season
from thermoflux.plans.aggregates import RUNS, STATUS, season_rows
from thermoflux.plans.registry import query
from thermoflux.plans.scalars import SOUTH
from thermoflux.plans.views import MULTI, ORDER, SUB, obs_multi, obs_sub, r6, rounded, table
from thermoflux.plans.windows import RING_SQL
from thermoflux.sources.io import stored


@query("m1_ols", f"WITH {MULTI} SELECT site_id, regr_count(NEE, TA) AS n, round(regr_intercept(NEE, TA), 6) AS b0, round(regr_slope(NEE, TA), 6) AS b1, round(regr_r2(NEE, TA), 6) AS r2 FROM obs GROUP BY 1")
def m1(spark, d):
    f = regression.ols(obs_multi(spark, d), "NEE", ["TA"])
    return f.select("site_id", "n", r6(F.element_at("coef", 1)).alias("b0"), r6(F.element_at("coef", 2)).alias("b1"), r6("r2").alias("r2"))


@query("m1b_soil_temperature")
def m1b(spark, d):
    obs = obs_multi(spark, d)
    config = obs.groupBy("site_id").agg(F.min("stamp").alias("start"), F.max("stamp").alias("end")).withColumn("ta_min", F.lit(5.0))
    return regression.soil_temperature(obs.select("site_id", "TS", "TA", *ORDER), config, 4, ORDER).groupBy("site_id", "TS_status").agg(F.count("TS").alias("n"), F.avg("TS").alias("ts"))


@query("m2_donors")
def m2(spark, d):
    obs = obs_multi(spark, d)
    means = obs.groupBy("site_id").agg(F.avg("TA").alias("m"))
    pairs = means.select(F.col("site_id").alias("target"), F.col("m").alias("own")).join(means.withColumnRenamed("site_id", "donor"), F.col("target") != F.col("donor"))
    near = Window.partitionBy("target").orderBy(F.abs(F.col("own") - F.col("m")), "donor")
    donors = pairs.withColumn("k", F.row_number().over(near)).filter("k <= 3").select("target", "donor")
    return regression.reconstruct_from_donors(obs.select("site_id", "TS", "TA", *ORDER), donors, 4, ORDER).groupBy("site_id", "TS_status").agg(F.count("TS").alias("n"), F.avg("TS").alias("ts"))


@query("m3_repair_periods")
def m3(spark, d):
    obs = obs_multi(spark, d)
    # of every site the 31 days of a year with the largest share of missing values
    block = F.floor((F.col("DOY") - 1) / 31)
    share = obs.groupBy("site_id", "YEAR", block.alias("b")).agg(F.avg(F.col("TS").isNull().cast("int")).alias("share"))
    worst = Window.partitionBy("site_id").orderBy(F.desc("share"), "YEAR", "b")
    bad = share.withColumn("k", F.row_number().over(worst)).filter("k = 1").select("site_id", "YEAR", (F.col("b") * 31 + 1).alias("DOY_start"), (F.col("b") * 31 + 31).alias("DOY_end"))
    out = regression.repair_periods(obs.select("site_id", "YEAR", "DOY", "TS", "TA", "QC", *ORDER), bad, 4, ORDER)
    return out.groupBy("site_id", "TS_repair_flag").agg(F.count("*").alias("n"), F.count("TS").alias("n_ts"))


@query("m4_simple_regression", f"WITH {MULTI}, f AS (SELECT site_id, regr_slope(TS, TA) AS b, regr_intercept(TS, TA) AS a FROM obs WHERE TA > 0 GROUP BY 1) SELECT site_id, round(sum(coalesce(TS, a + b * TA)), 4) AS ts FROM obs JOIN f USING (site_id) GROUP BY 1")
def m4(spark, d):
    return regression.fill_by_regression(obs_multi(spark, d), "TS", "TA", train=F.col("TA") > 0).groupBy("site_id").agg(F.round(F.sum("TS"), 4).alias("ts"))


_ANNUAL = "y AS (SELECT site_id, YEAR, avg(TA) AS TA FROM obs GROUP BY 1, 2)"


@query("m5_warming_rate", f"WITH {MULTI}, {_ANNUAL}, g AS (SELECT site_id, regr_count(TA, YEAR) AS n, regr_slope(TA, YEAR) AS b, regr_r2(TA, YEAR) AS r FROM y GROUP BY 1) SELECT site_id, n, round(b, 6) AS slope, round(sign(b) * sqrt(r * (n - 2) / (1 - r)), 4) AS t FROM g")
def m5(spark, d):
    annual = obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.avg("TA").alias("TA"))
    return regression.warming_rate(annual).select("site_id", "n", r6("slope").alias("slope"), F.round("t", 4).alias("t"))


@query("m5b_warming_p")
def m5b(spark, d):
    return regression.with_slope_p(regression.warming_rate(obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.avg("TA").alias("TA"))))


def _season_obs(spark, d):
    """A seasonal course on top of the view, so that seasons can be found."""
    wave = F.sin((F.col("DOY") - 100) * 0.0172)
    return obs_multi(spark, d).withColumns({"NEE": F.col("NEE") + 40 * wave, "TS": F.col("TS") / 10 + 12 * wave, "NIGHT": F.lit(1), "QC": F.lit(0)})


@query("m6_active_season_mean", f"""WITH {MULTI}, s AS (SELECT site_id, YEAR, DOY, NEE + 40 * sin((DOY - 100) * 0.0172::DOUBLE) AS NEE, TS / 10 + 12 * sin((DOY - 100) * 0.0172::DOUBLE) AS TS FROM obs),
fc AS (SELECT site_id, DOY, avg(v) AS v FROM (SELECT site_id, YEAR, DOY, avg(NEE) AS v FROM s WHERE NEE IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
tc AS (SELECT site_id, DOY, avg(v) AS v FROM (SELECT site_id, YEAR, DOY, avg(TS) AS v FROM s WHERE TS IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
fs AS (SELECT site_id, (DOY - 1 + k + 366) % 366 + 1 AS DOY, avg(v) AS f FROM fc, range(-15, 16) t(k) GROUP BY 1, 2), ts AS (SELECT site_id, (DOY - 1 + k + 366) % 366 + 1 AS DOY, avg(v) AS t FROM tc, range(-15, 16) t(k) GROUP BY 1, 2),
lim AS (SELECT site_id, min(f) + 0.2::DOUBLE * (max(f) - min(f)) AS l FROM fs JOIN ts USING (site_id, DOY) GROUP BY 1),
days AS (SELECT fs.site_id, fs.DOY, f > l AND t > 2 AS act, t FROM fs JOIN ts USING (site_id, DOY) JOIN lim USING (site_id)), {RING_SQL} SELECT * FROM runs""")
def m6a(spark, d):
    return season.active_season(_season_obs(spark, d), smooth="mean", half=15)


@query("m6_active_season")
def m6(spark, d):
    return season.active_season(_season_obs(spark, d))


#: Site 3 has days of one season only, 5 no temperature, 6 that of the air alone, 7 is frozen.
_REPORT = f"""WITH {MULTI}, s AS (SELECT site_id, YEAR, DOY, NEE + 40 * sin((DOY - 100) * 0.0172::DOUBLE) AS NEE, CASE WHEN site_id NOT IN (5, 6) THEN TS / 10 + CASE WHEN site_id = 7 THEN -90 ELSE 0 END END AS TS,
 CASE WHEN site_id != 5 THEN TA END AS TA FROM obs WHERE site_id != 3 OR DOY < 100),
fc AS (SELECT site_id, DOY, avg(v) AS v FROM (SELECT site_id, YEAR, DOY, avg(NEE) AS v FROM s WHERE NEE IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
sc AS (SELECT site_id, DOY, avg(v) AS v FROM (SELECT site_id, YEAR, DOY, avg(TS) AS v FROM s WHERE TS IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
ac AS (SELECT site_id, DOY, avg(v) AS v FROM (SELECT site_id, YEAR, DOY, avg(TA) AS v FROM s WHERE TA IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
n AS (SELECT x.site_id, coalesce(f.n, 0) AS nf, coalesce(t.n, 0) AS ns, coalesce(a.n, 0) AS na FROM (SELECT DISTINCT site_id FROM s) x LEFT JOIN (SELECT site_id, count(*) AS n FROM fc GROUP BY 1) f USING (site_id)
 LEFT JOIN (SELECT site_id, count(*) AS n FROM sc GROUP BY 1) t USING (site_id) LEFT JOIN (SELECT site_id, count(*) AS n FROM ac GROUP BY 1) a USING (site_id)),
tc AS (SELECT sc.* FROM sc JOIN n USING (site_id) WHERE ns >= 150 UNION ALL SELECT ac.* FROM ac JOIN n USING (site_id) WHERE ns < 150),
fs AS (SELECT site_id, (DOY - 1 + k + 366) % 366 + 1 AS DOY, avg(v) AS f FROM fc, range(-15, 16) t(k) GROUP BY 1, 2), ts AS (SELECT site_id, (DOY - 1 + k + 366) % 366 + 1 AS DOY, avg(v) AS t FROM tc, range(-15, 16) t(k) GROUP BY 1, 2),
lim AS (SELECT site_id, min(f) + 0.2::DOUBLE * (max(f) - min(f)) AS l FROM fs JOIN ts USING (site_id, DOY) GROUP BY 1),
days AS (SELECT fs.site_id, fs.DOY, f > l AND t > 2 AS act, t FROM fs JOIN ts USING (site_id, DOY) JOIN lim USING (site_id) JOIN n USING (site_id)
 WHERE nf >= 150 AND CASE WHEN ns >= 150 THEN ns ELSE na END >= 150 QUALIFY bool_or(f > l AND t > 2) OVER (PARTITION BY fs.site_id)), {RING_SQL},
rep AS (SELECT n.site_id, nf AS flux_days, CASE WHEN ns >= 150 THEN ns ELSE na END AS temperature_days, CASE WHEN ns >= 150 THEN 'soil' ELSE 'air' END AS temperature_source,
 CASE WHEN nf < 150 THEN 'too few days of night flux' WHEN CASE WHEN ns >= 150 THEN ns ELSE na END < 150 THEN 'too few days of temperature' WHEN gStart IS NULL THEN 'no active day' END AS reason,
 gStart, gEnd, trimmed_days, offStart, offEnd, CASE WHEN nf >= 150 AND CASE WHEN ns >= 150 THEN ns ELSE na END >= 150 THEN round(l, 6) END AS nee_threshold
 FROM n LEFT JOIN lim USING (site_id) LEFT JOIN runs USING (site_id) LEFT JOIN ed USING (site_id))"""


def _report_obs(spark, d):
    obs = _season_obs(spark, d).filter("site_id <> 3 OR DOY < 100")
    ts = F.when(~F.col("site_id").isin(5, 6), F.col("TS") - 12 * F.sin((F.col("DOY") - 100) * 0.0172) - F.when(F.col("site_id") == 7, 90).otherwise(0))
    return obs.withColumns({"TS": ts, "TA": F.when(F.col("site_id") != 5, F.col("TA"))})


@query("m6c_season_status", f"{_REPORT} SELECT site_id, flux_days, temperature_days, reason FROM rep")
def m6c(spark, d):
    return season.season_status(_report_obs(spark, d), min_days=150, smooth="mean")


@query("m6d_season_report", f"{_REPORT} SELECT site_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason, gStart, gEnd, trimmed_days, offStart, offEnd, temperature_source, flux_days, temperature_days, nee_threshold FROM rep")
def m6d(spark, d):
    return rounded(season.season_report(_report_obs(spark, d), min_days=150, smooth="mean"), "nee_threshold")


@query("m6b_season_by_uptake", f"""WITH {MULTI}, c AS (SELECT site_id, DOY, avg(NEE) - 30 AS v, avg(TS) - 20 AS t FROM obs GROUP BY 1, 2), l AS (SELECT site_id, min(v) * 0.2::DOUBLE AS cut, min(DOY) FILTER (WHERE t >= 0) AS thaw FROM c GROUP BY 1),
r AS (SELECT c.site_id, DOY, thaw, row_number() OVER (PARTITION BY c.site_id ORDER BY DOY) AS u, row_number() OVER (PARTITION BY c.site_id ORDER BY DOY DESC) AS e FROM c JOIN l USING (site_id) WHERE v < cut)
SELECT site_id, greatest(max(DOY) FILTER (WHERE u = 7) - 4, any_value(thaw)) AS gStart, max(DOY) FILTER (WHERE e = 7) + 4 AS gEnd FROM r GROUP BY 1""")
def m6b(spark, d):
    clim = obs_multi(spark, d).groupBy("site_id", "DOY").agg((F.avg("NEE") - 30).alias("NEE"), (F.avg("TS") - 20).alias("TS"))
    return season.season_by_uptake(clim)


def _ustar_sql(name: str, rows: str, keys: str, t: int, u: int, least: int, least_in_class: int) -> str:
    """The moving-point test over rows with ``keys``, TA, u and f, as tables that end in ``name`` (keys, threshold, n_classes)."""
    n = name
    return f"""{n}o AS (SELECT * FROM ({rows}) QUALIFY count(*) OVER (PARTITION BY {keys}) >= {least}),
{n}a AS (SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY TA) - 1) * {t} // count(*) OVER (PARTITION BY {keys}) AS t FROM {n}o),
{n}r AS (SELECT {keys}, t FROM {n}a GROUP BY ALL HAVING abs(corr(u, TA)) < 0.5 AND count(*) >= {least_in_class}),
{n}b AS (SELECT *, (rank() OVER (PARTITION BY {keys}, t ORDER BY u) - 1) * {u} // count(*) OVER (PARTITION BY {keys}, t) AS k FROM {n}a SEMI JOIN {n}r USING ({keys}, t)),
{n}c AS (SELECT {keys}, t, k, avg(u) AS u, avg(f) AS f FROM {n}b GROUP BY ALL),
{n}l AS (SELECT *, avg(f) OVER (PARTITION BY {keys}, t ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS later FROM {n}c),
{n}h AS (SELECT {keys}, t, arg_min(u, k) AS th FROM {n}l WHERE f >= 0.99 * later GROUP BY ALL),
{n} AS (SELECT {keys}, quantile_cont(th, 0.5) AS threshold, count(*) AS n_classes FROM {n}h GROUP BY ALL)"""


_USTAR = "SELECT site_id, YEAR, MONTH // 4 AS season, TA, sqrt(l_extendedprice) / 300 AS u, NEE + least(sqrt(l_extendedprice) / 300, 0.5) * 30 AS f FROM obs WHERE NEE IS NOT NULL"
#: Years 1997 and 1998 are thin, 1999 is hardly there.
_THIN = " AND NOT (YEAR = 1997 AND l_partkey % 3 > 0) AND NOT (YEAR = 1998 AND l_partkey % 7 > 0) AND NOT (YEAR = 1999 AND l_partkey % 50 > 0)"


def _ustar_rows(spark, d):
    u = F.sqrt("l_extendedprice") / 300
    return obs_multi(spark, d).select("site_id", "YEAR", F.floor(F.col("MONTH") / 4).alias("season"), "TA", u.alias("USTAR"), (F.col("NEE") + F.least(u, F.lit(0.5)) * 30).alias("NEE"), "l_partkey")


@query("m7_ustar_threshold", f"WITH {MULTI}, {_ustar_sql('th', _USTAR, 'site_id, season', 7, 20, 160, 40)} SELECT site_id, season, round(threshold, 6) AS threshold, n_classes FROM th")
def m7(spark, d):
    return rounded(gapfill.ustar_threshold(_ustar_rows(spark, d), least_in_class=40), "threshold")


@query("m7b_ustar_by_season_and_year", f"""WITH {MULTI}, {_ustar_sql('se', _USTAR + _THIN, 'site_id, YEAR, season', 3, 8, 90, 25)}, ye AS (SELECT site_id, YEAR, max(threshold) AS y FROM se GROUP BY 1, 2),
{_ustar_sql('po', f'SELECT * FROM ({_USTAR}{_THIN}) ANTI JOIN ye USING (site_id, YEAR)', 'site_id, YEAR', 3, 8, 90, 25)},
ev AS (SELECT DISTINCT site_id, YEAR, season FROM ({_USTAR}{_THIN})),
yr AS (SELECT e.site_id, e.YEAR, y, p.threshold AS p FROM (SELECT DISTINCT site_id, YEAR FROM ev) e LEFT JOIN ye USING (site_id, YEAR) LEFT JOIN po p USING (site_id, YEAR)), si AS (SELECT site_id, quantile_cont(coalesce(y, p), 0.5) AS s FROM yr GROUP BY 1)
SELECT ev.site_id, ev.YEAR, ev.season, round(coalesce(se.threshold, y, p, s), 6) AS threshold, CASE WHEN se.threshold IS NOT NULL THEN 'season' WHEN y IS NOT NULL THEN 'year' WHEN p IS NOT NULL THEN 'pooled' WHEN s IS NOT NULL THEN 'site' END AS mode
FROM ev LEFT JOIN se USING (site_id, YEAR, season) JOIN yr USING (site_id, YEAR) JOIN si USING (site_id)""")
def m7b(spark, d):
    rows = _ustar_rows(spark, d).filter("NEE IS NOT NULL AND NOT (YEAR = 1997 AND l_partkey % 3 > 0) AND NOT (YEAR = 1998 AND l_partkey % 7 > 0) AND NOT (YEAR = 1999 AND l_partkey % 50 > 0)")
    return rounded(gapfill.ustar_thresholds(rows, t_classes=3, u_classes=8, least_rows=90, least_in_class=25), "threshold")


def _gap_fill_sql(rows: str) -> str:
    """Every stage by brute force over rows o (site_id, id, x day, h hour, v, SW_IN, TA, VPD)."""
    n = gapfill.TOLERANCE
    radiation = f"abs(g.SW_IN - o.SW_IN) < greatest(least({n['SW_IN']}, g.SW_IN), {gapfill.WEAK_LIGHT})"
    like = f"abs(g.TA - o.TA) < {n['TA']} AND abs(g.VPD - o.VPD) < {n['VPD']}"
    stages = ", ".join(f"({i}, {m}, {k})" for i, (m, k) in enumerate(gapfill.STAGES))
    return f"""o AS ({rows}), g AS (SELECT * FROM o WHERE v IS NULL), k AS (SELECT * FROM o WHERE v IS NOT NULL), st(i, method, days) AS (VALUES {stages}),
w AS (SELECT g.site_id, g.id, greatest(ceil(abs(g.x - o.x) / 7), 1)::INT AS w, count(*) FILTER (WHERE {like}) AS n, coalesce(sum(o.v) FILTER (WHERE {like}), 0) AS s, count(*) AS rn, sum(o.v) AS rs
 FROM g JOIN k o ON g.site_id = o.site_id AND abs(g.x - o.x) <= 70 AND {radiation} GROUP BY 1, 2, 3),
c AS (SELECT g.site_id, g.id, abs(g.x - (o.x * 24 + o.h + z) // 24)::INT AS far, count(*) AS n, sum(o.v) AS s
 FROM g JOIN k o ON g.site_id = o.site_id AND abs(g.x - o.x) <= 211 CROSS JOIN (VALUES (-1), (0), (1)) zz(z) WHERE (o.x * 24 + o.h + z) % 24 = g.h AND abs(g.x - (o.x * 24 + o.h + z) // 24) <= 210 GROUP BY 1, 2, 3),
e AS (SELECT site_id, id, i, method, days, sum(CASE method WHEN 1 THEN n ELSE rn END) AS n, sum(CASE method WHEN 1 THEN s ELSE rs END) AS s FROM w JOIN st ON method IN (1, 2) AND w * 7 <= days GROUP BY 1, 2, 3, 4, 5
 UNION ALL SELECT site_id, id, i, method, days, sum(n), sum(s) FROM c JOIN st ON method = 3 AND far <= days GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT * FROM e WHERE n >= {gapfill.LEAST} QUALIFY row_number() OVER (PARTITION BY site_id, id ORDER BY i) = 1)
SELECT g.site_id, g.id, round(s / n, 6) AS filled, coalesce(n, 0)::BIGINT AS n_used, method::INT AS method, days::INT AS days,
 CASE method WHEN 1 THEN CASE WHEN 2 * days <= 14 THEN 1 WHEN 2 * days <= 56 THEN 2 ELSE 3 END WHEN 2 THEN CASE WHEN 2 * days <= 14 THEN 1 WHEN 2 * days <= 28 THEN 2 ELSE 3 END
 WHEN 3 THEN CASE WHEN 2 * days + 1 <= 1 THEN 1 WHEN 2 * days + 1 <= 5 THEN 2 ELSE 3 END END::INT AS quality FROM g LEFT JOIN b USING (site_id, id)"""


_MDS = "SELECT site_id, event_id AS id, DOY AS x, HOUR AS h, CASE WHEN event_id % 11 != 0 THEN NEE END AS v, (HOUR * 40)::DOUBLE AS SW_IN, TS / 5 AS TA, (MINUTE / 6)::DOUBLE AS VPD FROM sub"
_SPARSE = """SELECT site_id, l_orderkey * 1000003 + l_partkey * 101 + l_linenumber * 7 + l_suppkey * 11 AS id, date_diff('day', DATE '1995-01-01', stamp::DATE) AS x, (l_linenumber * 5) % 24 AS h,
 CASE WHEN l_orderkey % 4 = 0 AND l_partkey % 3 = 0 THEN NEE END AS v, CASE WHEN l_partkey % 19 <> 4 THEN (l_suppkey * 37 % 60 * l_linenumber * 3)::DOUBLE END AS SW_IN, TA * 3 AS TA, CASE WHEN l_partkey % 23 <> 4 THEN SWC * 400 END AS VPD
 FROM obs WHERE site_id < 4 AND (site_id > 0 OR DOY < 40)"""


@query("m8_gap_fill_mds", f"WITH {SUB}, {_gap_fill_sql(_MDS)}")
def m8(spark, d):
    df = obs_sub(spark, d).select(F.col("event_id").alias("id"), "site_id", F.col("DOY").alias("day"), F.when(F.col("event_id") % 11 != 0, F.col("NEE")).alias("NEE"), (F.col("HOUR") * 40).cast("double").alias("SW_IN"), (F.col("TS") / 5).alias("TA"), (F.col("MINUTE") / 6).alias("VPD"), "HOUR")
    return rounded(gapfill.gap_fill_mds(df, "id"), "filled")


@query("m8b_gap_fill_sparse", f"WITH {MULTI}, {_gap_fill_sql(_SPARSE)}")
def m8b(spark, d):
    """Four sites so sparse that every kind of stage is needed: most rows are gaps, drivers are missing, and site 0 has the first days of each year only."""
    obs = obs_multi(spark, d).filter("site_id < 4 AND (site_id > 0 OR DOY < 40)")
    flux = F.when((F.col("l_orderkey") % 4 == 0) & (F.col("l_partkey") % 3 == 0), F.col("NEE"))
    df = obs.select(
        (F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 101 + F.col("l_linenumber") * 7 + F.col("l_suppkey") * 11).alias("id"), "site_id", F.datediff("stamp", F.lit("1995-01-01").cast("date")).cast("long").alias("day"), ((F.col("l_linenumber") * 5) % 24).cast("long").alias("HOUR"),
        flux.alias("NEE"), F.when(F.col("l_partkey") % 19 != 4, F.col("l_suppkey") * 37 % 60 * F.col("l_linenumber") * 3).cast("double").alias("SW_IN"), (F.col("TA") * 3).alias("TA"), F.when(F.col("l_partkey") % 23 != 4, F.col("SWC") * 400).alias("VPD"),
    )
    return rounded(gapfill.gap_fill_mds(df, "id"), "filled")


#: Control year on days 100-300 of both axes; temperatures are complete in this view.
_TABLE = f"""{STATUS}, {RUNS}, tt AS (SELECT site_id, growing_year, avg(TA) AS mean_TS FROM south WHERE DOY BETWEEN 100 AND 300 GROUP BY 1, 2 HAVING count(TA) = count(*)),
both_ AS (SELECT DISTINCT site_id, growing_year FROM ac INTERSECT SELECT site_id, growing_year FROM nn),
ga AS (SELECT site_id, growing_year, string_agg(k::VARCHAR, ', ' ORDER BY a) AS gap_lengths, max(k) AS max_gap, sum(k * k)::BIGINT AS gap_burden FROM runs GROUP BY 1, 2),
co AS (SELECT site_id, growing_year, count(*) FILTER (WHERE unknown_daytime) AS unknown_days FROM st GROUP BY 1, 2),
yt AS (SELECT site_id, growing_year, mean_TS, unknown_days, coalesce(gap_lengths, 'none') AS gap_lengths, coalesce(max_gap, 0) AS max_gap, coalesce(gap_burden, 0) AS gap_burden FROM tt SEMI JOIN both_ USING (site_id, growing_year) LEFT JOIN ga USING (site_id, growing_year) LEFT JOIN co USING (site_id, growing_year)),
yd AS (SELECT yt.*, abs(mean_TS - m) AS dist FROM yt JOIN (SELECT site_id, quantile_cont(mean_TS, 0.5) AS m FROM yt GROUP BY 1) USING (site_id)),
yr AS (SELECT *, rank() OVER (PARTITION BY site_id ORDER BY dist) + (count(*) OVER (PARTITION BY site_id, dist) - 1) / 2 AS r1, rank() OVER (PARTITION BY site_id ORDER BY gap_burden) + (count(*) OVER (PARTITION BY site_id, gap_burden) - 1) / 2 AS r2, rank() OVER (PARTITION BY site_id ORDER BY max_gap) + (count(*) OVER (PARTITION BY site_id, max_gap) - 1) / 2 AS r3 FROM yd)"""


def _yearly(spark, d):
    ac, nights = season_rows(spark, d)
    seasons = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("site_id")).distinct().withColumns({"gStart": F.lit(100), "gEnd": F.lit(300)})
    return control.yearly_table(ac.withColumn("TS", F.col("TA")), nights, seasons)


@query("m9_yearly_table", f"WITH {MULTI}, {SOUTH}, {_TABLE} SELECT site_id, growing_year, round(mean_TS, 6) AS mean_TS, gap_lengths, max_gap, gap_burden, r1 + r2 + r3 AS initial_score FROM yr")
def m9b(spark, d):
    return rounded(_yearly(spark, d).select("site_id", "growing_year", "mean_TS", "gap_lengths", "max_gap", "gap_burden", "initial_score"), "mean_TS")


@query("m9_control_year", f"""WITH {MULTI}, {SOUTH}, {_TABLE}, i AS (SELECT site_id, growing_year AS y0, max_gap AS g0 FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY r1 + r2 + r3, gap_burden, dist, growing_year) AS k FROM yr) WHERE k = 1),
o AS (SELECT site_id, growing_year AS y1 FROM (SELECT yr.*, row_number() OVER (PARTITION BY yr.site_id ORDER BY r1 + 4 * r2 + r3, gap_burden, dist, growing_year) AS k FROM yr JOIN i USING (site_id) WHERE growing_year != y0 AND g0 > 3 AND max_gap <= 3 AND unknown_days <= 400 AND unknown_days = 0) WHERE k = 1)
SELECT site_id, coalesce(y1, y0) AS control_year, y0 AS initial_year, CASE WHEN g0 <= 3 THEN 'initial_equal_weight_selection' WHEN y1 IS NOT NULL THEN 'replacement_for_gap_longer_than_threshold' ELSE 'initial_year_kept_no_acceptable_alternative' END AS reason FROM i LEFT JOIN o USING (site_id)""")
def m9(spark, d):
    return control.control_year(_yearly(spark, d), long_gap=3)


_WIN = "win AS (SELECT DISTINCT site_id, k AS \"window\", 100 + 14 * k AS a, least(100 + 14 * k + 13, 200) AS b FROM obs, range(0, 8) t(k))"


def _windows(spark, d):
    sites = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("site_id")).distinct()
    return sc.season_windows(sites.withColumns({"gStart": F.lit(100), "gEnd": F.lit(200)})).select("site_id", F.col("window").cast("bigint").alias("window"), F.col("w_start").cast("bigint").alias("w_start"), F.col("w_end").cast("bigint").alias("w_end"))


def _rounded_windows(spark, d):
    sites = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("site_id")).distinct()
    return sc.season_windows_rounded(sites.withColumns({"gStart": F.lit(100), "gEnd": F.lit(200)})).select("site_id", *[F.col(c).cast("bigint").alias(c) for c in ("window", "w_start", "w_end")])


@query("m10_adaptive_window", f"""WITH {MULTI}, {_WIN}, n AS (SELECT * FROM obs WHERE NEE IS NOT NULL AND TS IS NOT NULL AND NOT (site_id = 3 AND YEAR = 1998 AND DOY < 230) AND (site_id <> 4 OR DOY % 9 = 0)),
y AS (SELECT DISTINCT site_id, YEAR FROM n), x AS (SELECT unnest(range(0, 25, 3)) AS ext),
e AS (SELECT n.site_id, "window", YEAR, ext, NEE, TS FROM n JOIN win ON n.site_id = win.site_id JOIN x ON DOY BETWEEN a - ext AND b + ext),
g AS (SELECT site_id, "window", YEAR, ext, max(TS) AS warmest, count(*) AS n, quantile_cont(TS, 0.025) AS lo, quantile_cont(TS, 0.975) AS hi, avg(NEE) AS m, quantile_cont(NEE, 0.5) AS md FROM e GROUP BY 1, 2, 3, 4),
t AS (SELECT win.site_id, win."window", y.YEAR, x.ext, b, warmest, coalesce(n, 0) AS n, lo, hi, m, md FROM win JOIN y ON y.site_id = win.site_id CROSS JOIN x
      LEFT JOIN g ON g.site_id = win.site_id AND g."window" = win."window" AND g.YEAR = y.YEAR AND g.ext = x.ext),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, "window", YEAR ORDER BY CASE WHEN n >= 60 AND (25 BETWEEN lo AND hi OR ext > 0 AND b + ext >= 200 AND 25 >= warmest) THEN ext ELSE 1000 - ext END) AS k FROM t)
SELECT site_id, "window", YEAR, ext AS extend_days, n, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(n > 25 AND 25 BETWEEN lo AND hi AND m >= 0.2 AND md >= 0.2, false) AS kept FROM r WHERE k = 1""")
def m10(spark, d):
    """Site 3 has no nights in the season of a year, site 4 few: their rows stay, as not kept."""
    win = _windows(spark, d)
    ref = win.select("site_id", "window", F.lit(25.0).alias("ts_ref"))
    rows = obs_multi(spark, d).dropna(subset=["NEE", "TS"]).filter("NOT (site_id = 3 AND YEAR = 1998 AND DOY < 230) AND (site_id <> 4 OR DOY % 9 = 0)")
    out = curves.adaptive_window(rows, win, ref, needed=60)
    return rounded(out.withColumn("extend_days", F.col("extend_days").cast("bigint")), "lo", "hi")


def _curve_rows(spark, d):
    """Fluxes with a known response to the view's temperatures: C0 2, alpha 0.08, beta -0.001, and the view's flux as noise."""
    t = F.col("TS") * 0.5
    y = 2 * F.exp(0.08 * t - 0.001 * t * t) + (F.col("NEE") - 22) / 40
    obs = obs_multi(spark, d).withColumns({"TS": t, "NEE": y, "GPP": F.col("SWC") * 20, "SWC": F.col("SWC") + 0.1})
    rows = obs.filter("DOY BETWEEN 100 AND 200").withColumn("window", sc.window_id(F.col("DOY"), F.lit(100), F.lit(200)))
    # written once: a fit reads its rows several times
    return stored(rows.drop("DAY", "NIGHT", "QC", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "curve-input")


def _reference(rows):
    return stored(rows.groupBy("site_id", "window").agg(F.avg("TS").alias("TS"), F.avg("SWC").alias("SWC"), F.avg("GPP").alias("GPP")), "references")


@query("m11_er_curve_total")
def m11(spark, d):
    rows = _curve_rows(spark, d)
    return curves.er_curve(rows, _reference(rows))


@query("m11b_er_curve_yearly")
def m11b(spark, d):
    rows = _curve_rows(spark, d)
    ref = _reference(rows)
    pooled = stored(curves.er_curve(rows, ref), "pooled")
    return curves.er_curve(rows, ref, by=("site_id", "window", "YEAR"), priors=pooled, min_rows=10)


@query("m12_er_curve_direct")
def m12(spark, d):
    rows = _curve_rows(spark, d)
    return curves.er_curve(rows, _reference(rows), direct=True)


@query("m12b_er_curve_without_swc")
def m12b(spark, d):
    rows = _curve_rows(spark, d)
    return curves.er_curve(rows, _reference(rows), direct=True, use_swc=False)


@query("m11w_log_quadratic", f"""WITH {MULTI}, o AS (SELECT site_id, MONTH, ln(NEE) AS y, TS AS x, TS * TS AS z FROM obs WHERE NEE > 0 AND TS IS NOT NULL),
m AS (SELECT site_id, MONTH, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM o GROUP BY 1, 2 HAVING count(*) >= 10),
s AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM m)
SELECT site_id, MONTH, n, round(exp(my - a * mx - b * mz), 4) AS C0, round(a, 6) AS alpha, round(b, 6) AS beta FROM s""")
def m11w(spark, d):
    out = curves.log_quadratic_curve(obs_multi(spark, d), ("site_id", "MONTH"))
    return out.select("site_id", "MONTH", "n", F.round("C0", 4).alias("C0"), r6("alpha").alias("alpha"), r6("beta").alias("beta"))


@query("m13_reference_respiration", f"WITH {MULTI}, g AS (SELECT site_id, YEAR, avg(NEE) AS e, stddev_samp(NEE) * 3.4::DOUBLE AS s FROM obs GROUP BY 1, 2) SELECT site_id, YEAR, round(CASE WHEN NOT (e < 0.5::DOUBLE * s) THEN e END, 6) AS ERref FROM g")
def m13(spark, d):
    g = obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.avg("NEE").alias("e"), (F.stddev_samp("NEE") * 3.4).alias("s"))
    return g.select("site_id", "YEAR", r6(curves.reference_respiration(F.col("e"), F.col("s"))).alias("ERref"))


def _er(spark, d):
    return obs_multi(spark, d).groupBy("site_id", F.col("MONTH").alias("window"), F.col("YEAR").alias("growing_year")).agg(F.avg("NEE").alias("ERref"), F.avg("TS").alias("TS"))


_ER = "er AS (SELECT site_id, MONTH AS \"window\", YEAR AS growing_year, avg(NEE) AS ERref, avg(TS) AS TS FROM obs GROUP BY 1, 2, 3)"


@query("m14_ln_ratio", f"WITH {MULTI}, {_ER}, b AS (SELECT site_id, \"window\", coalesce(max(ERref) FILTER (WHERE growing_year = 1996 + site_id % 3), quantile_cont(ERref, 0.5)) AS c FROM er WHERE NOT (site_id = 5 AND growing_year = 1998) GROUP BY 1, 2) SELECT er.site_id, er.\"window\", growing_year, round(ln(ERref / c), 6) AS lnRatio FROM er JOIN b ON er.site_id = b.site_id AND er.\"window\" = b.\"window\" WHERE NOT (er.site_id = 5 AND growing_year = 1998)")
def m14(spark, d):
    er = _er(spark, d).filter("NOT (site_id = 5 AND growing_year = 1998)")
    control_ = er.select("site_id").distinct().withColumn("control_year", 1996 + F.col("site_id") % 3)
    return rounded(curves.ln_ratio(er, control_).select("site_id", "window", "growing_year", "lnRatio"), "lnRatio")


@query("m15_window_screen", f"""WITH {MULTI}, {_WIN}, t AS (SELECT site_id, YEAR, DOY, CASE WHEN NOT (YEAR % 4 = site_id % 4 AND l_partkey % 37 = 0) THEN TA END AS TS, NEE FROM obs WHERE site_id <> 6 OR DOY < 114),
y AS (SELECT t.site_id, "window", YEAR, CASE WHEN count(TS) = count(*) THEN avg(TS) END AS m FROM t JOIN win ON t.site_id = win.site_id AND DOY BETWEEN a AND b GROUP BY 1, 2, 3),
n AS (SELECT t.site_id, "window", count(*) AS n FROM t JOIN win ON t.site_id = win.site_id AND DOY BETWEEN a AND b WHERE TS IS NOT NULL AND NEE IS NOT NULL GROUP BY 1, 2)
SELECT site_id, "window", round(avg(m), 6) AS mean_TS, any_value(n) AS n FROM y JOIN n USING (site_id, "window") GROUP BY 1, 2 HAVING avg(m) BETWEEN 24 AND 25 AND any_value(n) >= 100""")
def m15(spark, d):
    """A quarter of a site's years have missing temperatures; site 6 ends with its first window."""
    win = _windows(spark, d)
    ranges = win.select("site_id").distinct().withColumns({"tStart": F.lit(24.0), "tEnd": F.lit(25.0)})
    missing = (F.col("YEAR") % 4 == F.col("site_id") % 4) & (F.col("l_partkey") % 37 == 0)
    li = obs_multi(spark, d).filter("site_id <> 6 OR DOY < 114").withColumn("TS", F.when(~missing, F.col("TA")))
    return rounded(curves.window_screen(li, li.dropna(subset=["TS", "NEE"]), win, ranges), "mean_TS")


@query("m16_thermal_response")
def m16(spark, d):
    er = _er(spark, d)
    control_ = er.select("site_id").distinct().withColumn("control_year", F.lit(1998))
    return regression.thermal_response(curves.ln_ratio(er, control_))


#: Planted in ``_chain``: degrees that a year is warmer than the one before, and the response of ln flux to them.
_WARMER, _RESPONSE = 0.8, -0.05


def _chain(spark, d):
    """Two sites of nights whose flux follows a curve of temperature, whose years get warmer, and whose level falls by a known response to that; site 1
    has no nights in one year."""
    warm = _WARMER * (F.col("YEAR") - 1998)
    t = F.coalesce("TS", F.lit(25.0)) * 0.12 + 8 + warm
    flux = 2 * F.exp(0.08 * t - 0.001 * t * t + _RESPONSE * warm) * (1 + (F.col("NEE") - 22) / 2000)
    obs = obs_multi(spark, d).withColumns({"site_id": F.col("site_id") % 2, "TS": t, "NEE": flux})
    sites = stored(obs.select("site_id").distinct(), "sites")
    win = sc.season_windows(sites.withColumns({"gStart": F.lit(100), "gEnd": F.lit(200)})).select("site_id", *[F.col(c).cast("bigint").alias(c) for c in ("window", "w_start", "w_end")])
    ranges = sites.withColumns({"tStart": F.lit(0.0), "tEnd": F.lit(40.0)})
    return response.site_years(obs, obs.filter("NOT (site_id = 1 AND YEAR = 1999)"), win, ranges, sites.withColumn("control_year", F.lit(1998)), needed=60)


@query("m16a_site_years")
def m16a(spark, d):
    return _chain(spark, d)


@query("m16b_total_response")
def m16b(spark, d):
    """The whole chain from nights to a response a site."""
    return response.total_response(_chain(spark, d))


_FEATURES = ["MONTH", "TA", "SWC"]


def _features(spark, d):
    g = obs_multi(spark, d).groupBy("site_id", "YEAR", "MONTH").agg(F.avg("NEE").alias("y"), F.avg("TA").alias("TA"), F.avg("SWC").alias("SWC")).dropna()
    return g.withColumn("id", F.col("site_id") * 1000000 + F.col("YEAR") * 100 + F.col("MONTH"))


@query("m17_tune")
def m17t(spark, d):
    return drivers.tune(_features(spark, d), "y", _FEATURES, ["site_id"], "id")


@query("m17_forest")
def m17(spark, d):
    f = drivers.stored(_features(spark, d), "features")
    return drivers.predict(drivers.forest(f, "y", _FEATURES, "id"), f, _FEATURES).select("site_id", "YEAR", "MONTH", "y", "prediction")


@query("m18_permutation_importance")
def m18(spark, d):
    return drivers.permutation_importance(_features(spark, d), "y", _FEATURES, "id")


@query("m18b_normalised_importance", f"WITH {MULTI}, x AS (SELECT site_id, MONTH, avg(NEE) - 25 AS v FROM obs GROUP BY 1, 2) SELECT site_id, MONTH, round(100 * greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY site_id), 6) AS varImp FROM x")
def m18b(spark, d):
    x = obs_multi(spark, d).groupBy("site_id", "MONTH").agg((F.avg("NEE") - 25).alias("varImp"))
    return rounded(drivers.normalised_importance(x, ("site_id",)), "varImp")


@query("m19_partial_dependence")
def m19(spark, d):
    return drivers.partial_bands(drivers.bootstrap_dependence(_features(spark, d), "y", _FEATURES, ["site_id"], "id"))


@query("m19b_partial_bands", f"WITH {MULTI}, g AS (SELECT site_id AS var, MONTH AS x, YEAR, avg(NEE) AS v FROM obs GROUP BY 1, 2, 3) SELECT var, x, round(quantile_cont(v, 0.025), 6) AS q2_5, round(quantile_cont(v, 0.05), 6) AS q5, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(v, 0.975), 6) AS q97_5 FROM g GROUP BY 1, 2")
def m19b(spark, d):
    g = obs_multi(spark, d).groupBy(F.col("site_id").alias("var"), F.col("MONTH").alias("x"), "YEAR").agg(F.avg("NEE").alias("yhat"))
    return rounded(drivers.partial_bands(g), "q2_5", "q5", "q50", "q95", "q97_5")


@query("m20_vif")
def m20(spark, d):
    return regression.vif(_features(spark, d), _FEATURES, ("site_id",))


@query("m20b_multiple_regression", f"""WITH {MULTI}, x AS (SELECT site_id, SWC AS a, TA AS b, NEE AS y FROM obs WHERE NEE IS NOT NULL),
m AS (SELECT site_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM x GROUP BY 1),
c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS c1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM m),
v AS (SELECT *, n * (yy - c1 * ay - c2 * by_) / (n - 3) AS s2, 1 - (yy - c1 * ay - c2 * by_) / yy AS r2, aa * bb / (aa * bb - ab * ab) AS vif FROM c)
SELECT site_id, 'SWC' AS term, n, round(c1, 6) AS estimate, round(sqrt(s2 * bb / (n * (aa * bb - ab * ab))), 6) AS se, round(c1 / sqrt(s2 * bb / (n * (aa * bb - ab * ab))), 4) AS t, round(vif, 6) AS vif, round(r2, 6) AS r2, round(r2 / 2 / ((1 - r2) / (n - 3)), 4) AS f FROM v
UNION ALL SELECT site_id, 'TA', n, round(c2, 6), round(sqrt(s2 * aa / (n * (aa * bb - ab * ab))), 6), round(c2 / sqrt(s2 * aa / (n * (aa * bb - ab * ab))), 4), round(vif, 6), round(r2, 6), round(r2 / 2 / ((1 - r2) / (n - 3)), 4) FROM v""")
def m20b(spark, d):
    table_ = regression.multiple_regression(obs_multi(spark, d), "NEE", ["SWC", "TA"], ("site_id",)).filter("term <> '(intercept)'")
    return rounded(table_.select("site_id", "term", "n", "estimate", "se", F.round("t", 4).alias("t"), "vif", "r2", F.round("f", 4).alias("f")), "estimate", "se", "vif", "r2")


@query("m21_future_respiration")
def m21(spark, d):
    rows = _curve_rows(spark, d).drop("window")
    sites = rows.select("site_id").distinct()
    warming = sites.select("site_id", *[F.lit(1.0 + m / 10).alias(f"Tmin{m}") for m in range(1, 13)])
    return future.future_respiration(rows, _rounded_windows(spark, d), warming, sites.withColumn("TAS", F.lit(-0.02)))


@query("m21c_widened", f"""WITH {MULTI}, {_WIN}, x AS (SELECT o.site_id, "window", YEAR, e, count(*) AS n FROM obs o JOIN win ON o.site_id = win.site_id JOIN range(7, 57, 7) r(e) ON DOY BETWEEN a - e AND b + e WHERE NEE IS NOT NULL AND TS > 1 GROUP BY 1, 2, 3, 4),
g AS (SELECT site_id, "window", YEAR, coalesce(min(e) FILTER (WHERE n >= 120), 56) AS e FROM x GROUP BY 1, 2, 3) SELECT site_id, "window", YEAR, e AS extend_days, n FROM g JOIN x USING (site_id, "window", YEAR, e)""")
def m21c(spark, d):
    out = future.widened(obs_multi(spark, d).filter("TS > 1"), _windows(spark, d), needed=120)
    return out.groupBy("site_id", "window", "YEAR", F.col("extend_days").cast("bigint").alias("extend_days")).agg(F.count(F.lit(1)).alias("n"))


@query("m21b_future_algebra", f"WITH {MULTI}, y AS (SELECT site_id, YEAR, avg(NEE) AS p, avg(TA) AS f, avg(SWC) AS d FROM obs GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY f / p, YEAR) AS r FROM y) SELECT site_id, round(avg(p), 6) AS present, round(avg(f), 6) AS future, round(avg(f) * exp(-0.02::DOUBLE * avg(d)), 6) AS future_response FROM k WHERE r > 1 GROUP BY 1")
def m21b(spark, d):
    y = obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.avg("NEE").alias("present"), F.avg("TA").alias("future"), F.avg("SWC").alias("dTS"))
    out = future.future_summary(y, y.select("site_id").distinct().withColumn("TAS", F.lit(-0.02)))
    return rounded(out.select("site_id", "present", "future", "future_response"), "present", "future", "future_response")


@query("m22_soil_carbon", "WITH f AS (SELECT regr_slope(CASE WHEN p_partkey % 3 != 0 THEN sqrt(p_retailprice) END, p_size) AS b, regr_intercept(CASE WHEN p_partkey % 3 != 0 THEN sqrt(p_retailprice) END, p_size) AS a FROM part) SELECT p_partkey, round(CASE WHEN p_partkey % 3 != 0 THEN sqrt(p_retailprice) ELSE a + b * p_size END, 6) AS carbon FROM part, f")
def m22(spark, d):
    part = table(spark, d, "part").withColumn("obs", F.when(F.col("p_partkey") % 3 != 0, F.sqrt("p_retailprice")))
    return regression.soil_carbon_blend(part, "obs", "p_size").select("p_partkey", r6("carbon").alias("carbon"))

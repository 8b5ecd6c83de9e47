"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermoflux.operators import windows as w
from thermoflux.plans.aggregates import _GAPS, edge_gaps
from thermoflux.plans.registry import query
from thermoflux.plans.views import KEY, MULTI, ORDER, obs_multi, r6, rounded

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_IDS = ", ".join(_ID)
_DAILY = "day AS (SELECT site_id, YEAR, DOY, avg(NEE) AS v, avg(TA) AS ta FROM obs GROUP BY 1, 2, 3)"


def _daily(spark, d):
    return obs_multi(spark, d).groupBy("site_id", "YEAR", "DOY").agg(F.avg("NEE").alias("v"), F.avg("TA").alias("ta"))


@query("w1_previous_mean", f"WITH {MULTI} SELECT {_IDS}, round(coalesce(avg(TS) OVER (PARTITION BY site_id ORDER BY {KEY} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), TS), 6) AS prior FROM obs")
def w1(spark, d):
    return w.previous_means(obs_multi(spark, d), "TS", {"prior": 48}, ["site_id"], ORDER).select(*_ID, r6("prior").alias("prior"))


@query("w2_trailing_mean", f"WITH {MULTI} SELECT {_IDS}, round(CASE WHEN row_number() OVER p >= 24 THEN avg(TS) OVER (PARTITION BY site_id ORDER BY {KEY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END, 6) AS trail FROM obs WINDOW p AS (PARTITION BY site_id ORDER BY {KEY})")
def w2(spark, d):
    return w.trailing_means(obs_multi(spark, d), "TS", {"trail": 24}, ["site_id"], ORDER).select(*_ID, r6("trail").alias("trail"))


@query("w3_lag_gap", f"WITH {MULTI}, {_GAPS} SELECT site_id, YEAR, DOY, gap FROM gg")
def w3(spark, d):
    return edge_gaps(spark, d).select("site_id", "YEAR", F.col("DOY").cast("bigint").alias("DOY"), F.col("gap").cast("bigint").alias("gap"))


@query("w4_rolling3", f"WITH {MULTI}, {_DAILY} SELECT site_id, YEAR, DOY, round(CASE WHEN row_number() OVER p < 3 THEN first_value(ta) OVER p ELSE avg(ta) OVER (PARTITION BY site_id ORDER BY YEAR, DOY ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS roll FROM day WINDOW p AS (PARTITION BY site_id ORDER BY YEAR, DOY)")
def w4(spark, d):
    return w.rolling3(_daily(spark, d), "ta", "roll", ["site_id"], ["YEAR", "DOY"]).select("site_id", "YEAR", "DOY", r6("roll").alias("roll"))


@query("w5_gap_islands", f"WITH {MULTI}, {_DAILY}, i AS (SELECT site_id, YEAR, v IS NULL AS gap, sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY site_id, YEAR ORDER BY DOY ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM day) SELECT site_id, YEAR, run, count(*) AS k FROM i WHERE gap GROUP BY 1, 2, 3")
def w5(spark, d):
    days = _daily(spark, d).withColumn("run", w.islands(F.col("v").isNull(), ["site_id", "YEAR"], ["DOY"]))
    return days.filter("v IS NULL").groupBy("site_id", "YEAR", "run").agg(F.count("*").alias("k"))


@query("w6_window_gap_check", f"""WITH {MULTI}, seen AS (SELECT DISTINCT site_id, YEAR, DOY FROM obs WHERE l_partkey % 3 = 0), y AS (SELECT DISTINCT site_id, YEAR FROM obs),
win AS (SELECT DISTINCT site_id, k AS win, 100 + 14 * k AS a, least(100 + 14 * k + 13, 200) AS b FROM obs, range(0, 8) t(k)),
e AS (SELECT site_id, YEAR, win, unnest(range(a, b + 1)) AS DOY FROM win JOIN y USING (site_id)),
g AS (SELECT e.*, s.DOY IS NULL AS gap FROM e LEFT JOIN seen s ON e.site_id = s.site_id AND e.YEAR = s.YEAR AND e.DOY = s.DOY),
r AS (SELECT *, sum(CASE WHEN gap THEN 0 ELSE 1 END) OVER (PARTITION BY site_id, YEAR, win ORDER BY DOY ROWS UNBOUNDED PRECEDING) AS run FROM g),
q AS (SELECT site_id, YEAR, win, run, count(*) FILTER (WHERE gap) AS k, count(*) AS n FROM r GROUP BY 1, 2, 3, 4)
SELECT site_id, YEAR, win, round(sum(k) / sum(n), 6) AS missing, round(max(k) / sum(n), 6) AS longest FROM q GROUP BY 1, 2, 3 HAVING sum(k) / sum(n) <= 0.75 AND max(k) / sum(n) <= 0.5""")
def w6(spark, d):
    obs = obs_multi(spark, d)
    wins = obs.select("site_id").distinct().withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(7))))
    wins = wins.withColumns({"w_start": 100 + 14 * F.col("window"), "w_end": F.least(113 + 14 * F.col("window"), F.lit(200))})
    out = w.window_gap_check(obs.filter("l_partkey % 3 = 0").select("site_id", "YEAR", "DOY"), wins, obs.select("site_id", "YEAR").distinct())
    return rounded(out.withColumn("win", F.col("window").cast("bigint")).drop("window"), "missing", "longest")


@query("w7_average_rank", f"WITH {MULTI}, n AS (SELECT site_id, YEAR, MONTH, count(*) AS n FROM obs GROUP BY 1, 2, 3) SELECT site_id, YEAR, MONTH, rank() OVER (PARTITION BY site_id ORDER BY n) + (count(*) OVER (PARTITION BY site_id, n) - 1) / 2 AS r FROM n")
def w7(spark, d):
    n = obs_multi(spark, d).groupBy("site_id", "YEAR", "MONTH").agg(F.count("*").alias("n"))
    return n.select("site_id", "YEAR", "MONTH", w.average_rank(F.col("n"), ["site_id"], "n").alias("r"))


@query("w8_pick_best", f"WITH {MULTI}, n AS (SELECT site_id, YEAR, count(*) AS n, round(avg(TA), 6) AS m FROM obs GROUP BY 1, 2) SELECT site_id, YEAR, n FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n % 5, m, n, YEAR) AS r FROM n) WHERE r = 1")
def w8(spark, d):
    n = obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.count("*").alias("n"), r6(F.avg("TA")).alias("m"))
    return w.pick_first(n, ["site_id"], [F.col("n") % 5, "m", "n", "YEAR"]).select("site_id", "YEAR", "n")


_INTER = """f AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER p AS ax, first_value(v IGNORE NULLS) OVER q AS b, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER q AS bx,
 sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER p AS run FROM h WINDOW p AS (PARTITION BY site_id ORDER BY x ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY site_id ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY site_id, run) AS holes FROM f)"""


@query("w9_interpolate", f"WITH {MULTI}, h AS (SELECT site_id, YEAR * 400 + DOY AS x, avg(CASE WHEN DOY % 17 > 8 THEN TA END) AS v FROM obs GROUP BY 1, 2), {_INTER} SELECT site_id, x, round(coalesce(v, CASE WHEN holes <= 8 THEN coalesce(a + (b - a) * (x - ax) / (bx - ax), a, b) END), 6) AS v FROM k")
def w9(spark, d):
    h = obs_multi(spark, d).groupBy("site_id", (F.col("YEAR") * 400 + F.col("DOY")).alias("x")).agg(F.avg(F.when(F.col("DOY") % 17 > 8, F.col("TA"))).alias("v"))
    return rounded(w.interpolate_linear(h, "v", ["x"], max_gap=8, fill_ends=True), "v")


@query("w10_previous_day_fill", f"""WITH {MULTI}, c AS (SELECT site_id, l_linenumber AS HOUR, DOY, avg(CASE WHEN DOY % 5 != 2 AND (DOY > 40 OR l_linenumber = 1) THEN NEE END) AS v FROM obs GROUP BY 1, 2, 3),
f AS (SELECT site_id, v AS v1 FROM c QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY DOY, HOUR) = 1)
SELECT site_id, HOUR, DOY, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY site_id, HOUR ORDER BY DOY ROWS UNBOUNDED PRECEDING), v1), 6) AS v FROM c JOIN f USING (site_id)""")
def w10(spark, d):
    c = obs_multi(spark, d).groupBy("site_id", F.col("l_linenumber").alias("HOUR"), "DOY").agg(F.avg(F.when((F.col("DOY") % 5 != 2) & ((F.col("DOY") > 40) | (F.col("l_linenumber") == 1)), F.col("NEE"))).alias("v"))
    return rounded(w.previous_day_fill(c, "v", ("site_id", "HOUR")), "v")


@query("w11_keep_first", f"WITH {MULTI} SELECT site_id, DOY, {_IDS} FROM (SELECT *, row_number() OVER (PARTITION BY site_id, DOY ORDER BY {KEY}) AS r FROM obs) WHERE r = 1")
def w11(spark, d):
    return w.pick_first(obs_multi(spark, d), ["site_id", "DOY"], ORDER).select("site_id", "DOY", *_ID)


_YEARS = "y AS (SELECT site_id, YEAR, count(*) AS n, avg(TA) AS m FROM obs GROUP BY 1, 2)"


def _years(spark, d):
    return obs_multi(spark, d).groupBy("site_id", "YEAR").agg(F.count("*").alias("n"), F.avg("TA").alias("m"))


@query("w12_candidate_years", f"WITH {MULTI}, {_YEARS}, t AS (SELECT site_id, quantile_cont(n, 0.5) AS mn, quantile_cont(m, 0.5) AS mm FROM y GROUP BY 1) SELECT site_id, YEAR, n FROM (SELECT y.*, row_number() OVER (PARTITION BY y.site_id ORDER BY abs(m - mm), YEAR) AS r FROM y JOIN t USING (site_id) WHERE n > mn) WHERE r <= 3")
def w12(spark, d):
    return w.candidate_years(_years(spark, d), "n", "m").select("site_id", "YEAR", "n")


@query("w13_zscore", f"WITH {MULTI}, {_YEARS} SELECT site_id, YEAR, round((m - avg(m) OVER p) / stddev_samp(m) OVER p, 6) AS m FROM y WINDOW p AS (PARTITION BY site_id)")
def w13(spark, d):
    return rounded(w.zscore(_years(spark, d), ["m"], ("site_id",)).select("site_id", "YEAR", "m"), "m")


#: Runs on the ring by a second copy of the axis: a run that begins in the first turn is followed into the second.
RING_SQL = """r0 AS (SELECT site_id, DOY, act, t, sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY DOY ROWS UNBOUNDED PRECEDING) AS na, sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY site_id) AS nall FROM days),
off AS (SELECT site_id, na % greatest(nall, 1) AS run, avg(t) AS mt, min(DOY) AS d0 FROM r0 WHERE NOT act GROUP BY 1, 2),
cold AS (SELECT site_id, run FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY mt, d0) AS k FROM off) WHERE k = 1),
onn AS (SELECT r0.site_id, DOY, act OR c.run IS NULL OR na % greatest(nall, 1) != c.run AS o FROM r0 LEFT JOIN cold c ON r0.site_id = c.site_id),
pc AS (SELECT site_id, DOY, o, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY DOY ROWS UNBOUNDED PRECEDING) AS p FROM onn),
ed AS (SELECT r0.site_id, min(DOY) FILTER (WHERE na = hi) AS offStart, max(DOY) FILTER (WHERE na = lo) AS offEnd FROM r0 JOIN cold c ON r0.site_id = c.site_id AND na % greatest(nall, 1) = c.run
 JOIN (SELECT r0.site_id, max(na) AS hi, min(na) AS lo FROM r0 JOIN cold c ON r0.site_id = c.site_id AND na % greatest(nall, 1) = c.run WHERE NOT act GROUP BY 1) x ON x.site_id = r0.site_id WHERE NOT act GROUP BY 1),
pp AS (SELECT site_id, p, min(DOY) AS a, max(DOY) AS b, count(*) AS k FROM pc WHERE o GROUP BY 1, 2),
runs AS (SELECT site_id, a AS gStart, b AS gEnd, (tot - k)::BIGINT AS trimmed_days FROM (SELECT *, sum(k) OVER (PARTITION BY site_id) AS tot, row_number() OVER (PARTITION BY site_id ORDER BY k DESC, a) AS r FROM pp) WHERE r = 1)"""


@query("w14_circular_runs", f"WITH {MULTI}, days AS (SELECT site_id, DOY, avg(TA) > 21 AND DOY BETWEEN 20 + site_id * 8 AND 340 AS act, avg(TA) AS t FROM obs GROUP BY 1, 2), {RING_SQL} SELECT site_id, gStart, gEnd, trimmed_days, offStart, offEnd FROM runs LEFT JOIN ed USING (site_id)")
def w14(spark, d):
    days = obs_multi(spark, d).groupBy("site_id", "DOY").agg(F.avg("TA").alias("t"))
    days = days.withColumn("act", (F.col("t") > 21) & F.col("DOY").between(20 + F.col("site_id") * 8, 340))
    return w.circular_runs(days, "act", "t")


@query("w15_closest_year", f"WITH {MULTI}, {_YEARS}, t AS (SELECT site_id, avg(m) AS mm FROM y GROUP BY 1) SELECT site_id, YEAR FROM (SELECT y.*, row_number() OVER (PARTITION BY y.site_id ORDER BY abs(m - mm), YEAR) AS r FROM y JOIN t USING (site_id)) WHERE r = 1")
def w15(spark, d):
    return w.closest_year(_years(spark, d), "m")

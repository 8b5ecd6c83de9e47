"""Windows in two levels against plain ones."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from thermoflux.operators import chunked, windows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = [("one", f"2020-{1 + k // 8064:02d}-{1 + k // 288 % 28:02d} {k // 12 % 24:02d}:{k % 12 * 5:02d}:00", k, None if rng.random() < 0.4 else rng.random()) for k in range(20_000)]
    out += [("two", f"2020-01-01 00:00:{k:02d}", k, float(k) if k % 3 else None) for k in range(7)] + [("same", "2020-01-01 00:00:00", k, 1.0 * k) for k in range(3000)]
    out += [(None, "2021-03-28 02:30:00", 1, 5.0), (None, None, 2, 6.0), ("none", "2020-01-01 00:00:00", 1, None), ("gap", "2020-01-01 00:00:00", 1, None), *[("gap", f"2020-06-{d:02d} 00:00:00", d, 1.0 if d == 20 else None) for d in range(1, 29)]]
    return spark.createDataFrame(out, "site_id string, stamp string, k long, x double").withColumn("stamp", F.col("stamp").cast("timestamp_ntz")).repartition(5).persist()


def same(a, b):
    def of(d):
        return sorted((tuple("" if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in d.collect()), key=str)

    assert a.columns == b.columns and of(a) == of(b)


@pytest.mark.parametrize("size", [64, 700])
def test_frames(spark, rows, size):
    order = ["stamp", "k"]
    for f, sizes in ((windows.previous_means, {"a": 5, "b": 200}), (windows.trailing_means, {"a": 1, "b": 150})):
        same(f(rows, "x", sizes, ["site_id"], order, size), f(rows, "x", sizes, ["site_id"], order, None))
    same(windows.rolling3(rows, "x", "r", ["site_id"], order, size), windows.rolling3(rows, "x", "r", ["site_id"], order, None))


@pytest.mark.parametrize("ends", [False, True])
def test_interpolation(spark, rows, ends):
    at = chunked.axis(rows, "stamp")
    for gap in (None, 2):
        got, want = (windows.interpolate_linear(rows, "x", ["stamp", "k"], axis=at, max_gap=gap, fill_ends=ends, rows=n) for n in (300, None))
        same(got, want)


def test_one_site_uses_many_tasks(spark, rows):
    d, table, several = chunked.chunks(rows, ["site_id"], ["stamp"], 500)
    sizes = {r["_chunk"]: r["_rows"] for r in table.filter("site_id = 'one'").collect()}
    assert several and len(sizes) >= 36 and max(sizes.values()) <= 600
    out = windows.previous_means(rows.filter("site_id = 'one'"), "x", {"a": 48}, ["site_id"], ["stamp", "k"], 500)
    assert "hashpartitioning(site_id" in out._jdf.queryExecution().executedPlan().toString()
    halo = chunked.with_frames(rows.filter("site_id = 'one'"), 48, lambda w, at: {"n": F.count(F.lit(1)).over(w.rowsBetween(-48, -1)), "at": at}, ["site_id"], ["stamp", "k"], 500)
    got = halo.select("k", "n", "at").collect()
    assert sorted(r["k"] + 1 for r in got) == sorted(r["at"] for r in got) and all(r["at"] == r["k"] + 1 and r["n"] == min(48, r["k"]) for r in got)


def test_axis_in_any_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        d = spark.sql("SELECT explode(sequence(timestamp_ntz'2021-03-28 00:00:00', timestamp_ntz'2021-03-28 06:00:00', interval 10 minutes)) AS t")
        got = [r[0] for r in d.select("t", chunked.axis(d, "t").alias("a")).orderBy("t").select("a").collect()]
        assert [b - a for a, b in zip(got, got[1:])] == [600.0] * 36
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_plain_windows_agree_with_spark(spark, rows):
    w = Window.partitionBy("site_id").orderBy("stamp", "k").rowsBetween(-5, -1)
    same(rows.withColumn("a", F.coalesce(F.avg("x").over(w), "x")), windows.previous_means(rows, "x", {"a": 5}, ["site_id"], ["stamp", "k"], 100))


def test_frames_sort_rows_once(spark, rows):
    """Halos come from counted slices: one window over the rows, where numbering them first took a second one."""
    out = windows.previous_means(rows, "x", {"a": 5}, ["site_id"], ["stamp", "k"], 300)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1

"""Forests as rows against forests and averages made one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoflux.operators import drivers, forests


def data(n=90, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, n), rng.normal(size=n).round(2), rng.uniform(size=n).round(1)], axis=1).astype(float)
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0.2, 5.0, 0.0) + rng.normal(size=n) * 0.1
    return x, y, rng.integers(0, 4, n)


@pytest.fixture(scope="module")
def frame(spark):
    x, y, s = data()
    rows = [(i, *map(float, a), float(b), f"s{c}") for i, (a, b, c) in enumerate(zip(x, y, s))]
    return spark.createDataFrame([*rows, (500, None, 1.0, 1.0, 1.0, "s0"), (501, 1.0, 1.0, 1.0, None, "s0")], "id long, a double, b double, c double, y double, s string")


XS = ["a", "b", "c"]


def one_tree(x, y, w, node, mtry, key):
    """A tree grown node by node, all cuts between distinct values tried; nested tuples (mean, n, variable, cut, left, right)."""

    def go(rows, path):
        n, mean = w[rows].sum(), (w[rows] * y[rows]).sum() / w[rows].sum()
        if n <= node:
            return (mean, n)
        variables = np.argsort(forests._mix(path ^ forests._mix(np.arange(1, x.shape[1] + 1))))[:mtry]
        best = None
        for v in variables:
            every = np.unique(x[:, v])
            for cut in (every[1:] + every[:-1]) / 2:
                a, b = rows[x[rows, v] <= cut], rows[x[rows, v] > cut]
                if len(a) and len(b):
                    gain = sum((w[r] * (y[r] - mean)).sum() ** 2 / w[r].sum() for r in (a, b))
                    if gain > (best[0] if best else 0) + 1e-9:
                        best = (gain, v, cut, a, b)
        if best is None:
            return (mean, n)
        _, v, cut, a, b = best
        return (mean, n, v, cut, go(a, forests._mix(path * np.uint64(2))), go(b, forests._mix(path * np.uint64(2) + np.uint64(1))))

    return go(np.flatnonzero(w), key)


def answer(tree, row, stop=0):
    while len(tree) > 2 and tree[1] > stop:
        tree = tree[4] if row[tree[2]] <= tree[3] else tree[5]
    return tree[0]


@pytest.mark.parametrize(("node", "mtry"), [(1, 1), (8, 2), (30, 3)])
def test_trees_grow_as_one_by_one(node, mtry):
    x, y, s = data(60)
    t = forests.Table(x, y, s)
    for numbers, w, g in forests.grown(t, 2, np.arange(9), node, mtry, 7):
        got = g.predict(x)
        for i, k in enumerate(numbers):
            assert w[i].sum() == len(y)
            tree = one_tree(x, y, w[i], node, mtry, forests._key(7, 2, k, -1))
            np.testing.assert_allclose(got[i], [answer(tree, r) for r in x], rtol=1e-9)


def test_draws():
    _, _, s = data(400)
    sizes = np.bincount(s)
    all_ = np.stack([forests.resample(s, 1, r) for r in range(300)])
    assert all((np.array([np.bincount(s, c, 4) for c in all_]) == sizes).all(axis=0))
    assert abs(all_.mean(axis=0) - 1).max() < 0.35 and abs((all_ == 0).mean() - np.exp(-1)) < 0.02
    w = forests.tree_draws(all_[0], 1, 0, np.arange(200))
    assert (w.sum(axis=1) == 400).all() and (w[:, all_[0] == 0] == 0).all()
    assert abs(w.mean(axis=0) - all_[0]).max() < 0.7


def test_forest_does_not_depend_on_tasks(spark, frame, monkeypatch):
    t = forests.table(frame, "y", XS, "id", ["s"])
    assert len(t) == 90
    one = sorted(map(repr, forests.forests(spark, t, 3, 30, 10, 1, 5).collect()))
    monkeypatch.setattr(forests, "TREES_PER_KEY", 7)
    assert sorted(map(repr, forests.forests(spark, t, 3, 30, 10, 1, 5).repartition(5).collect())) == one
    monkeypatch.setattr(forests, "TABLE_BYTES", 100)
    with pytest.raises(ValueError, match="TABLE_BYTES"):
        forests.table(frame, "y", XS, "id")


def test_predict(spark, frame, monkeypatch):
    t = forests.table(frame, "y", XS, "id", ["s"])
    trees = forests.forests(spark, t, 1, 40, 5, 2, 3).persist()
    want = np.mean([g.predict(t.x).mean(axis=0) * len(g) for _, _, g in forests.grown(t, 0, np.arange(40), 5, 2, 3)], axis=0)
    want = sum(g.predict(t.x).sum(axis=0) for _, _, g in forests.grown(t, 0, np.arange(40), 5, 2, 3)) / 40
    for size in (forests.TABLE_BYTES, 3000):  # in one part and in many
        monkeypatch.setattr(forests, "TABLE_BYTES", size)
        got = {r["id"]: r["prediction"] for r in forests.predict(trees, frame, XS).collect()}
        assert got.pop(500) is None and got.pop(501) is not None
        np.testing.assert_allclose([got[i] for i in range(90)], want)
    assert np.corrcoef(want, t.y)[0, 1] > 0.95
    trees.unpersist()


def test_dependence_is_the_average_of_predictions(spark, frame):
    t = forests.table(frame, "y", XS, "id", ["s"])
    trees = forests.forests(spark, t, 2, 30, 6, 1, 9)
    got = {(r["replicate"], r["var"], round(r["x"], 9)): r["yhat"] for r in forests.dependence(trees, t, XS, 11).collect()}
    assert len(got) == 2 * 3 * 11
    for rep in range(2):
        all_ = [g for _, _, g in forests.grown(t, rep, np.arange(30), 6, 1, 9)]
        for v, name in enumerate(XS):
            for value in np.linspace(t.x[:, v].min(), t.x[:, v].max(), 11):
                x = t.x.copy()
                x[:, v] = value
                want = sum(g.predict(x).sum(axis=0) for g in all_).mean() / 30
                assert got[rep, name, round(value, 9)] == pytest.approx(want, rel=1e-9)


def test_nested_scores_are_those_of_separate_trees(spark, frame):
    t = forests.table(frame, "y", XS, "id", ["s"])
    folds = np.arange(90) % 3
    got = {(r["mtry"], r["node"], r["part"]): r for r in forests.nested_scores(spark, t, folds, 12, (1, 2), 20, 4).collect()}
    assert len(got) == 2 * 12 * 2
    for mtry, node in ((1, 1), (1, 7), (2, 12)):
        y, f = {"test": [], "train": []}, {"test": [], "train": []}
        for fold in range(3):
            all_ = [g for _, _, g in forests.grown(t, fold, np.arange(20), node, mtry, 4, (folds != fold).astype(int))]
            hat = sum(g.predict(t.x).sum(axis=0) for g in all_) / 20
            for part, own in (("test", folds == fold), ("train", folds != fold)):
                y[part] += t.y[own].tolist()
                f[part] += hat[own].tolist()
        for part in y:
            e, r = np.subtract(y[part], f[part]), got[mtry, node, part]
            assert r["RMSE"] == pytest.approx(np.sqrt(np.mean(e**2))) and r["MAE"] == pytest.approx(np.abs(e).mean())
            assert r["R2"] == pytest.approx(np.corrcoef(y[part], f[part])[0, 1] ** 2) and r["n"] == len(e)


def test_importance(spark, frame):
    t = forests.table(frame, "y", XS, "id", ["s"])
    got = {(r["replicate"], r["var"]): r for r in forests.permutation_rises(spark, t, XS, 2, 25, 8, 1, 2).collect()}
    for rep in range(2):
        rises = {v: [] for v in XS}
        for numbers, w, g in forests.grown(t, rep, np.arange(25), 8, 1, 2, np.ones(90, int)):
            for i, k in enumerate(numbers):
                out = np.flatnonzero(w[i] == 0)
                for v, name in enumerate(XS):
                    x = t.x.copy()
                    x[out, v] = x[out[np.argsort(forests._key(2, rep, k, -2 - v, out))], v]
                    rises[name].append(((t.y - g.predict(x)[i])[out] ** 2).mean() - ((t.y - g.predict(t.x)[i])[out] ** 2).mean())
        for name, r in rises.items():
            assert got[rep, name]["mean"] == pytest.approx(np.mean(r)) and got[rep, name]["error"] == pytest.approx(np.std(r) / 5)
    shares = {r["var"]: r["varImp"] for r in drivers.permutation_importance(frame, "y", XS, "id", repeats=4, trees=60, node=8).collect()}
    assert sum(shares.values()) == pytest.approx(100) and shares["a"] > shares["c"] and shares["b"] > shares["c"] >= 0


def test_bootstrap_dependence(spark, frame):
    out = drivers.bootstrap_dependence(frame, "y", XS, ["s"], "id", times=3, points=5, trees=20, node=8)
    bands = drivers.partial_bands(out).collect()
    assert len(bands) == 15 and all(r["q2_5"] <= r["q50"] <= r["q97_5"] for r in bands)
    a = sorted((r["x"], r["q50"]) for r in bands if r["var"] == "a")
    assert a[-1][1] - a[0][1] > 3
    assert drivers.bootstrap_dependence(frame.filter(F.col("id") < 0), "y", XS, ["s"], "id", times=2, points=3, trees=5).count() == 0

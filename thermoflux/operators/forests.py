"""Regression forests as rows: a tree is one row with its nodes in arrays, and all trees of all replicates are one job.

The feature table has a row a site (or site and month): it is counted, must stay below ``TABLE_BYTES``, and is broadcast. A task gets
(replicate, tree) keys, draws the rows of each tree by hash as counts (nothing is copied), and grows its trees together, level
by level, from histograms of counts and sums by node and bin. Predictions, partial dependence, nested stopping and importance are
further jobs over the rows of trees.

Growth: a node of more than ``node`` rows is split at the cut with the least squared error among ``mtry`` variables drawn for
it; a node that no cut improves is a leaf. Draws depend on the seed, the replicate, the tree and the path to the node only, never on how trees
are dealt to tasks, so a tree grown to smaller leaves holds the same tree of larger ones. Cuts lie half way between neighbouring distinct values; a variable
with more than ``BINS`` of them is cut at that many quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the feature table that is broadcast, bins of a variable, and histogram cells of the trees that grow together.
TABLE_BYTES, BINS, CELLS = 64 << 20, 256, 1_500_000
#: Trees that one key stands for.
TREES_PER_KEY = 25

_U = np.uint64
TREE = "replicate int, tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, n array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 as a hash of whole numbers."""
    x = np.atleast_1d(np.asarray(x, _U)) + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _key(*parts) -> np.ndarray:
    h = np.zeros(1, _U)
    for p in parts:
        h = _mix(h ^ _mix(np.asarray(p, np.int64).astype(_U)))
    return h


@dataclass
class Table:
    """The feature table: values, target, bins of the values, cuts between bins, and strata as numbers."""

    x: np.ndarray
    y: np.ndarray
    strata: np.ndarray

    def __post_init__(self):
        self.cuts, self.bins = [], np.zeros(self.x.shape, np.int64)
        for j in range(self.x.shape[1]):
            v = np.unique(self.x[:, j])
            if len(v) > BINS:
                v = np.unique(np.quantile(self.x[:, j], np.linspace(0, 1, BINS + 1), method="lower"))
            self.cuts.append((v[1:] + v[:-1]) / 2)
            self.bins[:, j] = np.searchsorted(self.cuts[-1], self.x[:, j], side="left")
        self.width = max((len(c) for c in self.cuts), default=0) + 1

    def __len__(self) -> int:
        return len(self.y)


def table(df: DataFrame, y: str, xs: list[str], id_col: str, strata: list[str] | None = None) -> Table:
    """The complete rows of ``df`` by id, within the bound of what is broadcast."""
    d = df.dropna(subset=[y, *xs]).select(F.col(id_col).alias("_id"), F.xxhash64(*(strata or [F.lit(0)])).alias("_s"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)])
    size = d.count() * 8 * (len(xs) + 3)
    if size > TABLE_BYTES:
        raise ValueError(f"the feature table takes {size} bytes, more than forests.TABLE_BYTES")
    p = d.orderBy("_id", "_s", "_y", *[f"_x{i}" for i in range(len(xs))]).toPandas()
    return Table(p[[f"_x{i}" for i in range(len(xs))]].to_numpy(float).reshape(-1, len(xs)), p["_y"].to_numpy(float), np.unique(p["_s"].to_numpy(), return_inverse=True)[1])


# ---------------------------------------------------------------------------------- draws


def resample(strata: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    """How often each row is drawn when every stratum is drawn anew with replacement; replicate -1 is the table as it is."""
    n = len(strata)
    if replicate < 0 or not n:
        return np.ones(n, np.int64)
    order = np.argsort(strata, kind="stable")
    size = np.bincount(strata)
    start = np.cumsum(size) - size
    pick = (_key(seed, replicate, np.arange(n)) % size[strata].astype(_U)).astype(np.int64)
    return np.bincount(order[start[strata] + pick], minlength=n)


def tree_draws(counts: np.ndarray, seed: int, replicate: int, trees: np.ndarray) -> np.ndarray:
    """(trees x rows) counts: each tree draws as many rows as ``counts`` has, with replacement."""
    n, total = len(counts), int(counts.sum())
    edges = np.cumsum(counts)
    pick = (_key(seed, replicate, np.asarray(trees)[:, None], np.arange(total)[None, :]) % _U(max(total, 1))).astype(np.int64)
    rows = np.searchsorted(edges, pick, side="right")
    return np.bincount((rows + n * np.arange(len(trees))[:, None]).ravel(), minlength=n * len(trees)).reshape(len(trees), n)


# ---------------------------------------------------------------------------------- growth


class Trees:
    """Nodes of several trees in one set of arrays, parents before children; ``roots`` are the first nodes of each."""

    def __init__(self, roots, feature, threshold, left, right, value, n):
        self.roots, self.feature, self.threshold, self.left, self.right, self.value, self.n = roots, feature, threshold, left, right, value, n

    def __len__(self) -> int:
        return len(self.roots)

    def levels(self) -> Iterator[np.ndarray]:
        """Nodes with children, level by level."""
        at = self.roots
        while len(at := at[self.feature[at] >= 0]):
            yield at
            at = np.concatenate([self.left[at], self.right[at]])

    def walk(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node of every tree and row, whether it is new) from the roots on down."""
        at = np.repeat(self.roots[:, None], len(x), axis=1)
        rows = np.arange(len(x))[None, :]
        moved = np.ones(at.shape, bool)
        while moved.any():
            yield at, moved
            f = self.feature[at]
            moved = f >= 0
            at = np.where(moved, np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at]), at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(trees x rows)"""
        for at, _ in self.walk(x):
            pass
        return self.value[at]


def grow(t: Table, w: np.ndarray, keys: np.ndarray, node: int, mtry: int) -> Trees:
    """Trees on the rows of ``t`` counted by ``w`` (trees x rows); ``keys`` seed the choice of variables."""
    p, width = t.x.shape[1], t.width
    tree, row = np.nonzero(w)
    count = w[tree, row].astype(float)
    total = count * t.y[row]
    cuts = np.full((p, width), np.nan)
    for j, c in enumerate(t.cuts):
        cuts[j, : len(c)] = c
    parts: list[list[np.ndarray]] = []
    known, at, path = 0, tree, keys  # number of nodes so far, node of each entry within its level, hash of each node's path
    while len(path):
        a = len(path)
        n, s = np.bincount(at, count, a), np.bincount(at, total, a)
        mean = s / np.maximum(n, 1)
        best, var, cut = np.zeros(a), np.full(a, -1), np.zeros(a, np.int64)
        open_ = np.flatnonzero(n > node)
        if len(open_):
            place = np.full(a, -1)
            place[open_] = np.arange(len(open_))
            own = np.flatnonzero(place[at] >= 0)
            local, r, c = place[at[own]], row[own], count[own]
            # sums about the node's mean, for accuracy
            off = total[own] - c * mean[at[own]]
            order = np.argsort(_mix(path[open_, None] ^ _mix(np.arange(1, p + 1))[None, :]), axis=1)[:, :mtry]
            for m in range(order.shape[1]):
                f = order[:, m]
                cell = local * width + t.bins[r, f[local]]
                hn = np.cumsum(np.bincount(cell, c, len(open_) * width).reshape(-1, width), axis=1)
                hs = np.cumsum(np.bincount(cell, off, len(open_) * width).reshape(-1, width), axis=1)
                rest = hn[:, -1:] - hn
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((hn > 0) & (rest > 0), hs**2 / hn + (hs[:, -1:] - hs) ** 2 / rest, 0.0)
                k = gain.argmax(axis=1)
                g = gain[np.arange(len(k)), k]
                better = g > best[open_] + 1e-12 * np.maximum(1.0, mean[open_] ** 2)
                best[open_[better]], var[open_[better]], cut[open_[better]] = g[better], f[better], k[better]
        split = np.flatnonzero(var >= 0)
        rank = np.full(a, -1)
        rank[split] = np.arange(len(split))
        children = np.where(var >= 0, known + a + rank, -1)
        parts.append([var, np.where(var >= 0, cuts[var, cut], np.nan), children, np.where(var >= 0, children + len(split), -1), mean, n.astype(np.int64)])
        known += a
        stay = np.flatnonzero(rank[at] >= 0)
        old = at[stay]
        right = t.bins[row[stay], var[old]] > cut[old]
        at, row, count, total = rank[old] + right * len(split), row[stay], count[stay], total[stay]
        path = np.concatenate([_mix(path[split] * _U(2)), _mix(path[split] * _U(2) + _U(1))])
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    return Trees(np.arange(len(keys)), *columns)


def grown(t: Table, replicate: int, trees: np.ndarray, node: int, mtry: int, seed: int, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, Trees]]:
    """(tree numbers, draws, trees) of one replicate, as many together as histograms allow. ``rows``: counts to draw from in place of the replicate's."""
    counts = resample(t.strata, seed, replicate) if rows is None else rows
    at_once = max(1, int(CELLS // max(1, len(t) * max(1.0, t.width / (node + 1)))))
    for lo in range(0, len(trees), at_once):
        own = trees[lo : lo + at_once]
        w = tree_draws(counts, seed, replicate, own)
        yield own, w, grow(t, w, _key(seed, replicate, own, -1).ravel(), node, mtry)


# ---------------------------------------------------------------------------------- jobs


def _keys(spark: SparkSession, cases: int, trees: int) -> DataFrame:
    """(case int, first int, last int): keys of at most TREES_PER_KEY trees, dealt out evenly."""
    chunks = -(-trees // TREES_PER_KEY)
    total = cases * chunks
    parts = max(1, min(total, 4 * spark.sparkContext.defaultParallelism))
    d = spark.range(total, numPartitions=parts)
    first = (F.col("id") % chunks * TREES_PER_KEY).cast("int")
    return d.select((F.col("id") / chunks).cast("int").alias("case"), first.alias("first"), F.least(first + TREES_PER_KEY, F.lit(trees)).alias("last"))


def _each_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for case, first, last in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield case, np.arange(first, last)


def forests(spark: SparkSession, t: Table, replicates: int = 1, trees: int = 500, node: int = 30, mtry: int = 1, seed: int = 1, resampled: bool = True) -> DataFrame:
    """The trees of all replicates, a row a tree (``TREE``). Without ``resampled`` every replicate is a forest on the table itself."""
    held = spark.sparkContext.broadcast(t)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["replicate", "tree", "feature", "threshold", "left", "right", "value", "n"]
        for case, own in _each_key(batches):
            for numbers, _, g in grown(held.value, case, own, node, mtry, seed, None if resampled else np.ones(len(held.value), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), case, np.int32)), pa.array(numbers.astype(np.int32)), *_by_tree(g)], names=names)

    return _keys(spark, replicates, trees).mapInArrow(work, TREE)


def _by_tree(g: Trees) -> list[pa.Array]:
    """The node arrays cut into one list a tree, children numbered within it."""
    owner = np.empty(len(g.feature), np.int64)
    owner[g.roots] = np.arange(len(g))
    for at in g.levels():
        owner[g.left[at]] = owner[g.right[at]] = owner[at]
    order = np.argsort(owner, kind="stable")
    size = np.bincount(owner, minlength=len(g))
    start = np.cumsum(size) - size
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - np.repeat(start, size)
    offsets = pa.array(np.append(start, len(order)).astype(np.int32))

    def lists(x: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(kind)))

    child = [np.where(c >= 0, number[c], -1) for c in (g.left, g.right)]
    return [lists(g.feature, np.int32), lists(g.threshold, float), *[lists(c, np.int32) for c in child], lists(g.value, float), lists(g.n, np.int64)]


def _read(b: pa.RecordBatch) -> Trees:
    """The trees of a batch of rows."""
    column = {n: b.column(b.schema.get_field_index(n)) for n in ("feature", "threshold", "left", "right", "value", "n")}
    start = np.asarray(column["feature"].offsets, np.int64)
    size = np.diff(start)
    flat = {n: c.flatten().to_numpy(zero_copy_only=False) for n, c in column.items()}
    base = np.repeat(start[:-1] - start[0], size)
    child = [np.where(flat[c] >= 0, flat[c] + base, -1) for c in ("left", "right")]
    return Trees(start[:-1] - start[0], flat["feature"], flat["threshold"], *child, flat["value"], flat["n"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def dependence(trees: DataFrame, t: Table, xs: list[str], points: int = 51) -> DataFrame:
    """(replicate, var, x, yhat): each forest's mean prediction over the table with a variable set to each of ``points`` values of its range.

    No row is predicted: a leaf counts for the values that its cuts of the variable allow, with as many rows as satisfy its other cuts."""
    spark = trees.sparkSession
    held = spark.sparkContext.broadcast((t.x, len(xs)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, p = held.value
        grid = np.linspace(x.min(axis=0), x.max(axis=0), points, axis=1) if len(x) else np.zeros((p, points))
        for b in _slices(batches):
            g, replicate = _read(b), b.column(0).to_numpy()
            step = np.zeros((len(g), p, points + 1))
            owner, at = np.arange(len(g)), g.roots
            rows = np.ones((p, len(at), len(x)), bool)  # rows that satisfy all cuts of other variables
            low, high = np.zeros((p, len(at)), np.int64), np.full((p, len(at)), points)
            while len(at):
                leaf = g.feature[at] < 0
                size = rows[:, leaf].sum(axis=2)
                for v in range(p):
                    share = g.value[at[leaf]] * size[v]
                    some = high[v, leaf] > low[v, leaf]
                    np.add.at(step, (owner[leaf][some], v, low[v, leaf][some]), share[some])
                    np.add.at(step, (owner[leaf][some], v, high[v, leaf][some]), -share[some])
                at, owner, rows, low, high = at[~leaf], owner[~leaf], rows[:, ~leaf], low[:, ~leaf], high[:, ~leaf]
                if not len(at):
                    break
                f, cut = g.feature[at], g.threshold[at]
                less = x.T[f] <= cut[:, None]
                own = np.arange(p)[:, None] == f[None, :]
                side = np.array([np.searchsorted(grid[v], c, side="right") for v, c in zip(f, cut, strict=True)])
                free = own[:, :, None]
                rows = np.concatenate([rows & (less[None] | free), rows & (~less[None] | free)], axis=1)
                low = np.concatenate([low, np.where(own, np.maximum(low, side), low)], axis=1)
                high = np.concatenate([np.where(own, np.minimum(high, side), high), high], axis=1)
                at, owner = np.concatenate([g.left[at], g.right[at]]), np.concatenate([owner, owner])
            yhat = np.cumsum(step, axis=2)[:, :, :points] / max(1, len(x))
            names, where = np.unique(replicate, return_inverse=True)
            total = np.zeros((len(names), p, points))
            np.add.at(total, where, yhat)
            r, v, k = np.indices(total.shape)
            counts = np.bincount(where)
            yield pa.RecordBatch.from_arrays([pa.array(names[r.ravel()].astype(np.int32)), pa.array(v.ravel().astype(np.int32)), pa.array(k.ravel().astype(np.int32)), pa.array(grid[v.ravel(), k.ravel()]), pa.array(total.ravel()), pa.array(counts[r.ravel()])], names=["replicate", "v", "k", "x", "s", "n"])

    part = trees.mapInArrow(work, "replicate int, v int, k int, x double, s double, n long")
    mean = part.groupBy("replicate", "v", "k", "x").agg((F.sum("s") / F.sum("n")).alias("yhat"))
    return mean.select("replicate", F.element_at(F.array(*[F.lit(c) for c in xs]), F.col("v") + 1).alias("var"), "x", "yhat")


def predict(trees: DataFrame, df: DataFrame, xs: list[str], out: str = "prediction") -> DataFrame:
    """``df`` with the mean prediction of the trees (one replicate's); rows with a missing variable get null.

    The trees are broadcast in parts of bounded size; each part adds to the sum of a row."""
    spark = df.sparkSession
    parts, part, size = [], [], 0
    for r in trees.toLocalIterator():  # a part at a time
        part.append(r)
        size += 40 * len(r["feature"])
        if size > TABLE_BYTES // 2:
            parts.append(_gathered(spark, part))
            part, size = [], 0
    if part:
        parts.append(_gathered(spark, part))
    names = [f"_x{i}" for i in range(len(xs))]
    d = df.select(F.struct("*").alias("_row"), *[F.col(c).cast("double").alias(n) for c, n in zip(xs, names, strict=True)], F.lit(0.0).alias("_sum"), F.lit(0).cast("long").alias("_n"))
    for held in parts:

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            g = held.value
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    c = b.slice(lo, 1000)
                    x = np.stack([c.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(xs))], axis=1)
                    total = g.predict(np.nan_to_num(x)).sum(axis=0) + c.column(len(xs) + 1).to_numpy()
                    n = c.column(len(xs) + 2).to_numpy() + len(g)
                    total[np.isnan(x).any(axis=1)] = np.nan
                    yield pa.RecordBatch.from_arrays([*c.columns[: len(xs) + 1], pa.array(total), pa.array(n)], schema=c.schema)

        d = d.mapInArrow(work, d.schema)
    mean = F.try_divide(F.col("_sum"), F.col("_n"))
    return d.select("_row.*", F.when(~F.isnan(mean), mean).alias(out))


def _gathered(spark: SparkSession, rows: list):
    start = np.cumsum([0, *[len(r["feature"]) for r in rows]])
    flat = {c: np.concatenate([np.asarray(r[c]) for r in rows]) for c in ("feature", "threshold", "left", "right", "value", "n")}
    base = np.repeat(start[:-1], np.diff(start))
    child = [np.where(flat[c] >= 0, flat[c] + base, -1) for c in ("left", "right")]
    return spark.sparkContext.broadcast(Trees(start[:-1], flat["feature"], flat["threshold"], *child, flat["value"], flat["n"]))


def nested_scores(spark: SparkSession, t: Table, folds: np.ndarray, nodes: int = 40, mtries: tuple[int, ...] = (1,), trees: int = 500, seed: int = 1) -> DataFrame:
    """(mtry, node, part 'train' or 'test', RMSE, R2, MAE, n) for every leaf size from 1 to ``nodes``, pooled over the folds.

    Each fold's trees are grown once, to single rows: where a row stops in a tree of leaf size k is the first node on its way with at most k rows."""
    held = spark.sparkContext.broadcast((t, folds))
    k_folds = int(folds.max()) + 1 if len(folds) else 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_t, own_folds = held.value
        sizes = np.arange(1, nodes + 1)
        for case, numbers in _each_key(batches):
            fold, mtry = case % k_folds, mtries[case // k_folds]
            total = np.zeros((len(own_t), nodes))
            for _, _, g in grown(own_t, fold, numbers, 1, mtry, seed, (own_folds != fold).astype(np.int64)):
                found = np.zeros((len(g), len(own_t), nodes))
                open_ = np.ones(found.shape, bool)
                for at, _ in g.walk(own_t.x):
                    stop = open_ & ((g.n[at][:, :, None] <= sizes) | (g.feature[at] < 0)[:, :, None])
                    np.copyto(found, g.value[at][:, :, None], where=stop)
                    open_ &= ~stop
                total += found.sum(axis=0)
            r, k = np.indices(total.shape)
            cell = [np.full(total.size, fold, np.int32), np.full(total.size, mtry, np.int32), r.ravel().astype(np.int32), k.ravel().astype(np.int32) + 1, total.ravel()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cell], pa.array((own_folds[r.ravel()] == fold)), pa.array(own_t.y[r.ravel()])], names=["fold", "mtry", "row", "node", "s", "out", "y"])

    part = _keys(spark, k_folds * len(mtries), trees).mapInArrow(work, "fold int, mtry int, row int, node int, s double, out boolean, y double")
    mean = part.groupBy("fold", "mtry", "row", "node", "out", "y").agg((F.sum("s") / trees).alias("f"))
    off = F.col("y") - F.col("f")
    r = F.corr("y", "f")
    return mean.groupBy("mtry", "node", F.when(F.col("out"), "test").otherwise("train").alias("part")).agg(F.sqrt(F.avg(off * off)).alias("RMSE"), (r * r).alias("R2"), F.avg(F.abs(off)).alias("MAE"), F.count(F.lit(1)).alias("n"))


def permutation_rises(spark: SparkSession, t: Table, xs: list[str], repeats: int = 50, trees: int = 500, node: int = 30, mtry: int = 1, seed: int = 1) -> DataFrame:
    """(replicate, var, mean, error, trees): of ``repeats`` forests, the mean rise over trees of the squared error on the rows that a tree
    did not draw when a variable is permuted among them, and its standard error."""
    held = spark.sparkContext.broadcast(t)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for case, numbers in _each_key(batches):
            out = [[], [], []]
            for trees_, w, g in grown(own, case, numbers, node, mtry, seed, np.ones(len(own), np.int64)):
                base = (own.y - g.predict(own.x)) ** 2
                for i, tree in enumerate(trees_):
                    left = np.flatnonzero(w[i] == 0)
                    if not len(left):
                        continue
                    one = Trees(g.roots[i : i + 1], g.feature, g.threshold, g.left, g.right, g.value, g.n)
                    for v in range(len(xs)):
                        x = own.x[left].copy()
                        x[:, v] = x[np.argsort(_key(seed, case, tree, -2 - v, left)), v]
                        out[0].append(v)
                        out[1].append(int(tree))
                        out[2].append(float(((own.y[left] - one.predict(x)[0]) ** 2).mean() - base[i, left].mean()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), case, np.int32)), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2])], names=["replicate", "v", "tree", "rise"])

    rises = _keys(spark, repeats, trees).mapInArrow(work, "replicate int, v int, tree int, rise double")
    name = F.element_at(F.array(*[F.lit(c) for c in xs]), F.col("v") + 1)
    g = rises.groupBy("replicate", name.alias("var"))
    return g.agg(F.avg("rise").alias("mean"), (F.stddev_pop("rise") / F.sqrt(F.count(F.lit(1)))).alias("error"), F.count(F.lit(1)).alias("trees"))

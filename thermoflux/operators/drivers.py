"""Drivers of the response: forests, permutation importance and partial dependence, all on forests as rows (``forests``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.operators import forests
from thermoflux.sources.io import stored

#: Settings of the forests (fixed values): trees, rows of a node that is not split, variables tried at a split.
TREES, NODE, MTRY = 500, 30, 1


def forest(df: DataFrame, y: str, xs: list[str], id_col: str, trees: int = TREES, node: int = NODE, mtry: int = MTRY, seed: int = 1) -> DataFrame:
    """A forest on the complete rows of ``df``, a row a tree; ``predict`` applies it."""
    return stored(forests.forests(df.sparkSession, forests.table(df, y, xs, id_col), 1, trees, node, mtry, seed, resampled=False), "forest")


predict = forests.predict


def stratified_folds(df: DataFrame, strata: list[str], id_col: str, k: int = 5, seed: int = 1) -> DataFrame:
    """Adds ``fold``: the rows of a stratum are dealt out in a seeded order."""
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def tune(
    df: DataFrame, y: str, xs: list[str], strata: list[str], id_col: str, nodes: int = 40, mtries: tuple[int, ...] | None = None, trees: int = TREES, k: int = 5, seed: int = 1
) -> DataFrame:
    """(mtry, node, part, RMSE, R2, MAE, n): scores of every leaf size from 1 to ``nodes`` and every number of variables, over ``k`` stratified folds.

    One job: the trees of a fold and a number of variables are grown once and hold those of all leaf sizes."""
    d = stored(stratified_folds(df.dropna(subset=[y, *xs]), strata, id_col, k, seed), "folds")
    t = forests.table(d, y, [*xs, "fold"], id_col, strata)
    folds = t.x[:, -1].astype(np.int64)
    own = forests.Table(t.x[:, :-1], t.y, t.strata)
    return forests.nested_scores(df.sparkSession, own, folds, nodes, mtries or tuple(range(1, len(xs) + 1)), trees, seed)


def best_setting(scores: DataFrame) -> DataFrame:
    """(mtry, node, RMSE) of the least error on left-out folds; of equals the smallest."""
    key = F.struct("RMSE", "mtry", "node")
    return scores.filter("part = 'test'").agg(F.min(key).alias("_b")).select("_b.mtry", "_b.node", "_b.RMSE")


def permutation_importance(df: DataFrame, y: str, xs: list[str], id_col: str, repeats: int = 50, trees: int = TREES, node: int = NODE, mtry: int = MTRY, seed: int = 1) -> DataFrame:
    """(var, varImp in %): of ``repeats`` forests, the rise of the squared error over its standard error when a variable is permuted among
    the rows that a tree did not draw; negative ones as 0, normalised to 100 in each forest, then averaged."""
    rises = forests.permutation_rises(df.sparkSession, forests.table(df, y, xs, id_col), xs, repeats, trees, node, mtry, seed)
    scaled = rises.select("replicate", "var", F.coalesce(F.try_divide("mean", "error"), F.lit(0.0)).alias("varImp"))
    return normalised_importance(scaled, ("replicate",)).groupBy("var").agg(F.avg("varImp").alias("varImp"))


def normalised_importance(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Negative importances as 0, the others in % of their sum."""
    pos = F.greatest("varImp", F.lit(0.0))
    total = F.sum(pos).over(Window.partitionBy(*by))
    return df.withColumn("varImp", F.try_divide(100 * pos, total))


def bootstrap_dependence(
    df: DataFrame, y: str, xs: list[str], strata: list[str], id_col: str, times: int = 200, points: int = 51, trees: int = TREES, node: int = NODE, mtry: int = MTRY, seed: int = 1
) -> DataFrame:
    """(replicate, var, x, yhat): partial dependence of every variable under a forest fitted to each of ``times`` stratified resamples.

    All trees of all resamples are grown in one job, whose rows the dependence reads in the same stage."""
    t = forests.table(df, y, xs, id_col, strata)
    grown = forests.forests(df.sparkSession, t, times if len(t) else 0, trees, node, mtry, seed)
    return forests.dependence(grown, t, xs, points)


def partial_bands(replicates: DataFrame, by: tuple[str, ...] = ("var", "x")) -> DataFrame:
    """2.5, 5, 50, 95 and 97.5 % points of yhat over replicates."""
    q = F.percentile("yhat", F.array(*[F.lit(p) for p in (0.025, 0.05, 0.5, 0.95, 0.975)]))
    names = ("q2_5", "q5", "q50", "q95", "q97_5")
    return replicates.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(names)])

"""Quality classifier: naive Bayes support vectors (n-gram indicators scaled by class log-count ratios, linear hinge loss).

Features of a text are indicators, hashed into ``BUCKETS``:
* its words, lower-cased;
* 1- and 2-grams of word shapes (runs of upper-case, lower-case, digits, or one sign; a word equal to the one before
  it has the shape ``=``), each once for being there and once for every share of the words that it reaches (1/32, 1/8, 1/2).

The ratio r of a feature is log((1 + p) / |p|) - log((1 + q) / |q|) over the labelled documents; a row holds r at the indices of
its indicators. Dual coordinate descent fits the hinge-loss model; margins of left-out folds calibrate the probability.

The fit uses at most ``MAX_LABELLED`` labelled documents and ``MAX_FIT_BYTES`` bytes of them (those with the smallest hash of their id), whose hashed
features are collected; scoring runs over all texts with a broadcast weight vector of ``BUCKETS`` floats.

Cases: null and empty texts have no features and get the model's base probability; rows without a label (null, or none in
``labels``) teach nothing; repeated rows count as often as they occur; with one class only every score is that class's share (0 or 1), without
labels 0.5; other columns pass through (score and predicted are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoflux.llm.common import NOT_SPACE, U64, lowered, mix, slices, word_hashes, words
from thermoflux.llm.linear import dual_coordinate_descent, margins, platt, probability

BITS = 18
BUCKETS = 1 << BITS
#: Bound on the labelled documents that the fit uses.
MAX_LABELLED = 8000
MAX_FIT_BYTES = 64 << 20
THRESHOLD = 0.7
_SHARES = (1 / 32, 1 / 8, 1 / 2)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each document, end to end, and their offsets."""
    s, e, count = words(buf, offs, NOT_SPACE)
    n_docs = len(count)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), count)
    word = word_hashes(lowered(buf), s, e)
    shape = _SHAPE[buf]
    first = np.ones(len(buf), dtype=bool)
    first[1:] = shape[1:] != shape[:-1]
    first[s] = True
    at = np.concatenate([[0], np.cumsum(first)])
    sh = word_hashes(shape[first], at[s], at[e])
    same = np.zeros(len(s), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    sh[same] = U64(61)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    grams = np.concatenate([mix(sh), mix(sh[pair] * U64(3) + sh[pair + 1])]) >> U64(64 - BITS)
    key, n = np.unique(np.concatenate([doc, doc[pair]]) << 32 | grams.astype(np.int64), return_counts=True)
    share = n / np.maximum(1, count[key >> 32])
    keys = [key, doc << 32 | (mix(word) >> U64(64 - BITS)).astype(np.int64)]
    for k, least in enumerate(_SHARES, 1):
        part = key[share >= least]
        keys.append(part >> 32 << 32 | (mix((part & 0xFFFFFFFF).astype(U64) + U64(k << 40)) >> U64(64 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return (key & 0xFFFFFFFF).astype(np.int32), np.searchsorted(key >> 32, np.arange(n_docs + 1))


@dataclass
class QualityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = 0.0
    calibration: tuple[float, float] = (0.0, 0.0)
    constant: float | None = 0.5

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, _, buf, offs in slices(texts):
            if self.constant is not None:
                out.append(np.full(len(offs) - 1, self.constant))
                continue
            at, bounds = features(buf, offs)
            total = np.concatenate([[0.0], np.cumsum(self.weights[at], dtype=np.float64)])
            out.append(probability(np.diff(total[bounds]) + self.bias, self.calibration))
        return np.concatenate(out)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    limit: int,
    id_col: str,
    text_col: str,
    max_bytes: int = MAX_FIT_BYTES,
) -> DataFrame:
    """(_id, text, y) of the labelled documents with the smallest hash of their id, ``limit`` labels and ``max_bytes`` bytes of text at most."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"),
        F.col(label).cast("int").alias("y"),
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "y").limit(limit)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "text", "y")
    # at most ``limit`` labels meet here (more rows only if ids repeat)
    sizes = rows.select(
        F.xxhash64("_id").alias("h"),
        "_id",
        F.xxhash64("text").alias("digest"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"),
    ).distinct()
    upto = F.sum("size").over(Window.orderBy("h", "_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0))
    fit_in = sizes.withColumn("sum", upto).filter(F.col("sum") <= max_bytes).select("_id", "digest")
    return rows.withColumn("digest", F.xxhash64("text")).join(F.broadcast(fit_in), ["_id", "digest"]).select("_id", "text", "y")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = MAX_LABELLED,
) -> QualityModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, _, buf, offs in slices(b.column(1)):
                at, bounds = features(buf, offs)
                rows += [at[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["id", "at", "y"])

    sample = labelled_sample(docs, labels, label, limit, id_col, text_col).withColumn("_id", F.xxhash64("_id"))
    got = sample.mapInArrow(run, "id long, at binary, y int").toArrow().sort_by([("id", "ascending"), ("at", "ascending")])
    y = got["y"].to_numpy(zero_copy_only=False).astype(int)
    at = [np.frombuffer(x, dtype=np.int32) for x in got["at"].to_pylist()]
    if len(set(y)) < 2:
        return QualityModel(constant=float(y[0] > 0) if len(y) else 0.5)
    return fit_rows(at, y)


def log_count_ratios(at: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(BUCKETS), np.ones(BUCKETS)
    for x, label in zip(at, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_rows(at: list[np.ndarray], y: np.ndarray, folds: int = 3) -> QualityModel:
    def model(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        r = log_count_ratios([at[i] for i in own], y[own])
        # rows of unit length, so that long texts do not outweigh short ones while fitting
        w, bias = dual_coordinate_descent([(at[i], r[at[i]]) for i in own], y[own], BUCKETS, cost=1e-3)
        return r, w, bias

    fold = np.arange(len(y)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        own = np.flatnonzero(fold != k)
        if len(set(y[own])) == 2:
            r, w, bias = model(own)
            rest = np.flatnonzero(fold == k)
            margin[rest] = margins([(at[i], r[at[i]]) for i in rest], w, bias)
    r, w, bias = model(np.arange(len(y)))
    return QualityModel((w * r).astype(np.float32), bias, platt(margin, y), None)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from ``threshold`` on)."""
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text_col])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [*b.schema.names, "score", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``; columns as given, no shuffle."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Scores do not depend on the number of buckets, nor on whether they are dealt out in one step or two; blobs stay of bounded size an occurrence."""

import random
import time

import numpy as np
import pytest

from thermoflux.llm import katz_lm


def results(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    return {r["doc_id"]: tuple(r)[1:] for r in katz_lm.score(d).collect()}


def test_two_steps_of_buckets(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), i % 3 > 0) for i in range(120)] + [(500, None, True), (501, "only here twice only here", False)]
    monkeypatch.setattr(katz_lm, "KNOWN", 20)
    want = results(spark, rows)
    monkeypatch.setattr(katz_lm, "LEAST_BUCKETS", 40)
    for coarse in (6, 1):
        monkeypatch.setattr(katz_lm, "COARSE", coarse)
        got = results(spark, rows)
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-9)


def test_bytes_of_an_occurrence_with_many_buckets():
    """A chunk of a million occurrences with 100,000 buckets in all: dealt into coarse groups first, then each group into its own buckets."""
    rng = np.random.default_rng(1)
    n, buckets = katz_lm.CHUNK_TOKENS, 100_000
    known = np.unique(rng.integers(10, 2**64, 200_000, dtype=np.uint64))
    v, w = (known[np.minimum(rng.zipf(1.3, n), len(known)) - 1] for _ in range(2))
    doc, c = np.sort(rng.integers(0, 2**40, 3000))[rng.integers(0, 3000, n)], rng.integers(1, 10**6, n)
    bucket = (katz_lm.mix(v ^ katz_lm.mix(w)) % katz_lm.U64(buckets)).astype(int)
    began = time.process_time()
    blobs = [katz_lm.pack_occurrences(v[at], w[at], c[at], doc[at], True, known) for _, at in katz_lm._by_bucket(bucket % katz_lm.COARSE, katz_lm.COARSE)]
    took = time.process_time() - began
    assert len(blobs) <= katz_lm.COARSE and sum(map(len, blobs)) <= 32 * n and took < 60
    # a group of the second step gathers a million occurrences of some seven buckets a group
    own = bucket % katz_lm.COARSE < 160
    size = [len(at) for _, at in katz_lm._by_bucket(bucket[own], buckets)]
    assert len(size) <= 7 * 160

"""Near-dedup of many documents drawn from one template: all links, without comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import shingles, table

from thermoflux.llm import near_dedup


def template(n, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(3, 9))) for _ in range(60)]
    return ["\n".join(x for x in lines if rng.random() >= 0.1) for _ in range(n)]


def by_force(sets, percent):
    """Smallest reachable id of each document, by products of blocks of a set matrix."""
    at = {e: k for k, e in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[e] for e in s]] = 1
    both = m @ m.T
    size = m.sum(axis=1)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    c = np.arange(len(sets))
    while True:
        low = np.where(link, c[None, :], len(sets)).min(axis=1)
        if (low == c).all():
            return c
        c = low


@pytest.mark.parametrize("n, percent, shingle", [(1200, 85, 3), (400, 80, 5)])
def test_template_documents(spark, monkeypatch, n, percent, shingle):
    verified = []
    plain = near_dedup._linked

    def counted(pairs, sets, p):
        verified.append(pairs.count())
        return plain(pairs, sets, p)

    monkeypatch.setattr(near_dedup, "_linked", counted)
    texts = template(n, 5)
    want = by_force([shingles(t, shingle) for t in texts], percent)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, texts), shingle, percent / 100).collect()}
    assert [got[i] for i in range(n)] == want.tolist()
    assert sum(verified) <= 20 * n


def test_parities_lose_no_link(spark):
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 3, 40, 700, 9000):
        base = rng.integers(0, 2**52, size, dtype=np.uint64)
        for share in (0, 0.02, 0.08, 0.1, 0.2, 0.5):
            other = base.copy()
            other[: int(size * share)] = rng.integers(0, 2**52, int(size * share), dtype=np.uint64)
            sets.append(np.unique(other))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "doc long, elements binary")
    ids = df.select("doc")
    pairs = ids.withColumnRenamed("doc", "a").join(ids.withColumnRenamed("doc", "b"), F.expr("a > b"))
    kept = {(r["a"], r["b"]) for r in near_dedup._possible(pairs, near_dedup._parities(df), 85).collect()}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            similarity = both / (len(sets[a]) + len(sets[b]) - both)
            if similarity >= 0.85:
                assert (a, b) in kept
            elif len(sets[a]) < 1000 and similarity < 0.75:
                assert (a, b) not in kept

"""Line dedup against brute force: whole builds, insertions and deletions, filters."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoflux.llm import line_dedup
from thermoflux.llm.cuckoo import Cuckoo, built

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LOW = -(10**9)


def by_force(docs, index_docs=None):
    """{row number: (n_lines, n_dropped, kept)} of rows (id, text)."""
    holders = {}
    for n, (i, text) in enumerate(docs if index_docs is None else index_docs):
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= 20:
                holders.setdefault(key, {})[n] = LOW if i is None else i
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(line.strip(BLANKS).translate(LOWER), {})
            if len(own) < 3 or max(own.values()) == (LOW if i is None else i):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed, n, first=0):
    rng = random.Random(seed)
    common = [f"Éclair line number {k} that many documents hold" for k in range(12)]
    docs = []
    for i in range(first, first + n):
        lines = [rng.choice([rng.choice(common), f"own line {i} {rng.random()} of this text", "short", "", " \t" + rng.choice(common).upper() + " \r"]) for _ in range(rng.randint(1, 9))]
        docs.append((i, "\n".join(lines)))
    return docs


EDGES = [
    (1000, None), (1001, ""), (1002, "\n\n"), (1003, "ééééééééééééééééééé\n" * 3), (1004, "ééééééééééééééééééé"), (1005, "ééééééééééééééééééé"), (None, "a line of rows without any id"), (None, "a line of rows without any id"),
    (None, "A LINE of rows without any id\nx"), (1006, "exactly twenty chars"), (1007, "exactly twenty chars"), (1008, "exactly twenty chars"), (1008, "exactly twenty chars"), (1009, "one\x00 zero byte and more text"),
    (1010, "one\x00 zero byte and more text"), (1011, "one\x00 zero byte and more text\n" * 3), (1012, "\n".join(f"a very long text, line {k % 4000}" for k in range(70_000))), (1013, "a very long text, line 7"), (1014, "a very long text, line 7"),
]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "k", 1, "d", 2) for i, t in docs], "doc_id long, text string, key string, n long, drops string, kept int")


def found(rows):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows.collect()), key=repr)


def test_build_and_drop(spark):
    docs = corpus(1, 120) + EDGES
    d = frame(spark, docs)
    index = line_dedup.build(d)
    assert found(line_dedup.line_report(d, index)) == by_force(docs)
    out = line_dedup.drop_lines(d, index)
    assert out.columns == d.columns
    kept = sorted(x[3] for x in by_force(docs))
    assert sorted(r["text"] or "" for r in out.collect()) == kept
    empty = line_dedup.build(d.limit(0))
    assert line_dedup.line_report(d.limit(0), empty).collect() == []
    assert found(line_dedup.line_report(d, empty)) == by_force(docs, [])


@pytest.mark.parametrize("small", [False, True])
def test_insert_and_delete_are_exact(spark, monkeypatch, small):
    if small:  # several shards, filters that overflow and are built anew, and no broadcast
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", 10)
    first, more = corpus(2, 60) + EDGES[:9], corpus(3, 60, 60) + EDGES[9:14]
    index = line_dedup.build(frame(spark, first))
    index = line_dedup.insert(index, frame(spark, more))
    everything = first + more
    assert found(line_dedup.line_report(frame(spark, everything), index)) == by_force(everything)
    # without the largest holders, without rows of no id
    gone = [i for i, _ in everything if i is None or i % 3 == 0 or i > 110]
    index = line_dedup.delete(index, spark.createDataFrame([(i,) for i in set(gone)] + [(5000,)], "doc_id long"))
    rest = [x for x in everything if x[0] not in gone]
    assert found(line_dedup.line_report(frame(spark, rest), index)) == by_force(rest)
    want = line_dedup.build(frame(spark, rest))
    columns = ["key", "n_docs", "top"]
    assert sorted(map(tuple, index.counts.select(columns).collect())) == sorted(map(tuple, want.counts.select(columns).collect()))
    # and back again
    index = line_dedup.insert(index, frame(spark, [x for x in everything if x[0] in gone]))
    assert found(line_dedup.line_report(frame(spark, everything), index)) == by_force(everything)
    keys = index.counts.filter(F.col("n_docs") >= 3).count()
    assert index.filters.agg(F.sum("keys")).first()[0] == keys


def test_text_ids(spark):
    docs = [(c, "a line that is long enough") for c in "abcd"]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(d, line_dedup.build(d)).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 0}


def test_key_pattern():
    rng = random.Random(4)
    for _ in range(500):
        line = "".join(rng.choice("aZ é\t\x0b\x1c\x85 ß") for _ in range(rng.randint(15, 30)))
        key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)
        assert (line_dedup.line_key(line.encode()) is None) == (len(key) < 20)
        if len(key) >= 20:
            assert line_dedup.line_key(line.encode()) == line_dedup.line_key(key.encode())


@pytest.mark.parametrize("n", [1, 50, 5000, 200_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    f = built(keys)
    assert f.contains(keys).all() and np.count_nonzero(f.table) == len(keys)
    assert f.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.001
    f.remove(keys[::2])
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.001 + 2 / n
    assert f.insert(keys[::2]) and Cuckoo(table=f.tobytes()).contains(keys).all()
    too_many = rng.integers(0, 2**64, 2 * f.table.size, dtype=np.uint64)
    assert not f.insert(too_many) and f.contains(keys).all() and np.count_nonzero(f.table) == len(keys)


def test_cuckoo_filter_equal_fingerprints():
    keys = (np.arange(8, dtype=np.uint64) << np.uint64(20)) + np.uint64(5) + (np.uint64(77) << np.uint64(48))
    f = built(keys)  # eight keys of one fingerprint fill both their buckets
    f.remove(keys[:5])
    assert np.count_nonzero(f.table) == 3 and f.contains(keys).all()

"""Removal of repeated substrings where ids clash or are missing, in long texts, and with either form of shuffled segments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoflux.llm import substring_dedup as sd
from thermoflux.llm.common import U64


def by_force(texts, length=100):
    """(n_bytes, n_removed, n_spans, kept) of each text, in order; equal strings that start earlier, here or in a text before, are removed."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        g = gone[:-1]
        out.append((len(raw), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), np.frombuffer(raw, np.uint8)[~g].tobytes()))
    return out


def text_of(rng, n):
    return "".join(rng.choice("abcdefgh é\0") for _ in range(n))


def rows_with_clashing_ids():
    rng = random.Random(8)
    shared = [text_of(rng, 150) for _ in range(4)]
    rows = [(1, text_of(rng, 900)), (1, text_of(rng, 200) * 2), (None, shared[0] + text_of(rng, 300)), (None, text_of(rng, 200) + shared[0]), (None, text_of(rng, 700)), (None, None), (None, "")]
    rows += [(k % 5, rng.choice(shared) + text_of(rng, 120) + rng.choice(shared)) for k in range(25)]
    return [*rows, rows[0], (2**40, shared[1]), (-5, shared[2] + shared[3])]


def results(out):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()), key=repr)


def expected(spark, rows, kind):
    """Rows in the order of id (nulls first) and text hash; equal rows are one document."""
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string").select("doc_id", "text", F.xxhash64("text").alias("h"))
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or (0 if kind == "long" else ""), r["h"], r["text"]) for r in d.collect()}, key=lambda x: x[:3])
    own = dict(zip([(x[1] if x[0] else None, x[3]) for x in order], by_force([x[3] for x in order]), strict=True))
    return sorted(((i, *own[i, t]) for i, t in rows), key=repr)


@pytest.mark.parametrize("plain", [False, True])
def test_clashing_and_missing_ids(spark, monkeypatch, plain):
    if plain:
        monkeypatch.setattr(sd, "BLOB_SEGMENTS", 10**6)
    rows = rows_with_clashing_ids()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, doc int").repartition(5)
    assert results(sd.remove_repeats(d)) == expected(spark, rows, "long")
    only = [(1, rows[0][1]), (1, rows[1][1])]
    got = {r["n_bytes"]: r["n_removed"] for r in sd.remove_repeats(spark.createDataFrame(only, "doc_id long, text string")).collect()}
    assert sorted(got.values())[0] == 0 and len(got) == 2  # the unique text loses nothing


def test_text_ids(spark):
    rows = [(None if i is None else f"d{i}", t) for i, t in rows_with_clashing_ids()]
    assert results(sd.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))) == expected(spark, rows, "string")


def test_many_buckets_as_rows(spark, monkeypatch):
    """With buckets as for many TB segments travel as rows of bounded size, with the same result."""
    rng = random.Random(9)
    rows = [(i, text_of(rng, 80) + f"{'common line ' * 12}{i % 3}" + text_of(rng, 150)) for i in range(60)]
    want = results(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    monkeypatch.setattr(sd, "BUCKET_SEGMENTS", 1)
    monkeypatch.setattr(sd, "CHUNK_SEGMENTS", 640)
    assert results(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    runs = np.zeros(1000, sd._RUN)
    runs["key"], runs["seg"], runs["doc"] = np.arange(1000), np.arange(1000) * 7, np.arange(1000)
    batch = sd._plain(runs, 100_000)
    assert batch.num_rows == 1000 and batch.nbytes <= 40 * 1000
    assert np.array_equal(np.sort(sd._rows_of(batch.to_pandas()), order=["doc"]), runs)


def test_long_text_in_passes(spark, monkeypatch):
    rng = random.Random(10)
    part = text_of(rng, 700)
    rows = [(1, text_of(rng, 9000) + part + text_of(rng, 5000) + part + text_of(rng, 900)), (2, text_of(rng, 333) + part), (3, "ab" * 4000)]
    buf = np.frombuffer(rows[0][1].encode(), np.uint8)
    monkeypatch.setattr(sd, "PASS_BYTES", 1000)
    none = np.zeros(0, U64)
    parts = list(sd.all_segments(buf, np.array([0, len(buf)]), 100, none))
    assert len(parts) > 10
    at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for p in parts for r in p])
    assert np.array_equal(at, np.arange(len(buf) - 99))  # every window start once
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [x[1:] for x in results(sd.remove_repeats(d))] == by_force([t for _, t in rows])


def test_two_hashes_are_independent():
    rng = random.Random(12)
    buf = np.frombuffer(text_of(rng, 5000).encode(), np.uint8)
    offs = np.array([0, len(buf)])
    plain = sd.segments(buf, offs, 100, np.zeros(0, U64))
    fine = sd.segments(buf, offs, 100, np.unique(plain["key"]))  # all minimisers common: windows by themselves
    assert len(fine) > 4000 and not (fine["key"] == fine["seg"]).any()
    for name in ("key", "seg"):
        assert len(np.unique(fine[name])) == len(fine)
    bits = np.unpackbits((fine["key"] ^ fine["seg"]).view(np.uint8)).mean()
    assert 0.49 < bits < 0.51
    same = sd._unpack(sd._pack(fine))
    assert np.array_equal(same, fine)  # all 64 bits of both travel

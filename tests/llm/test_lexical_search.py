"""Ranked lexical search against brute force, and what its bounds skip."""

import collections
import math
import random
import re

import numpy as np

from thermoflux.llm import lexical_search as ls

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def by_force(docs, items, k=10):
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        found.sort()
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=repr)


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdÉéß7") for _ in range(rng.randint(1, 4))) for _ in range(150)]

    def text(size):
        return rng.choice([" ", "-", "\n"]).join(words[min(149, int(rng.expovariate(0.04)))] for _ in range(size))

    passage = text(20)
    docs = [(i, text(rng.randint(1, 60)) + (" " + passage if i % 17 == 0 else "")) for i in range(n)]
    docs += [(1000 + i, passage) for i in range(30)] + [(None, passage), (None, passage), (7, docs[7][1]), (2000, None), (2001, ""), (2002, "!?_`"), (2003, passage.upper()), (2004, "aB\0Ab ab"), (2005, "b" * 5000)]
    items = [(1, passage), (2, text(15)), (2, text(3)), (3, None), (4, ""), (5, "nowhere7nowhere"), (None, text(8)), (6, "AB b"), (7, text(200)), (8, passage + " " + passage)]
    return docs, items


def run(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "y", 2) for i, t in items], "item_id long, text string, doc_id string, rank int")
    return sorted((tuple(r) for r in ls.search(ls.build_index(d), q, k).collect()), key=repr)


def test_search(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(ls, "ITEMS", 4)  # several blocks of items
    got = run(spark, docs, items)
    assert got == by_force(docs, items)
    assert run(spark, docs, items, 1) == by_force(docs, items, 1)


def test_edges(spark):
    docs, items = corpus(1, 20)
    assert run(spark, docs[:0], items) == [] and run(spark, docs, items[:0]) == []
    assert run(spark, [(1, None), (2, "")], items) == []
    assert run(spark, [(1, "one word")], [(1, "word")]) == by_force([(1, "one word")], [(1, "word")])
    d = spark.createDataFrame([("b", "same words"), ("a", "same words"), ("c", "other")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "words")], "item_id string, text string")
    assert [r["doc"] for r in ls.search(ls.build_index(d), q).collect()] == ["a", "b"]


def test_long_text_by_blocks(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abé1") for _ in range(rng.randint(1, 9))) for _ in range(20_000)) + " " + "z" * 3000
    low = ls.lowered(np.frombuffer(text.encode(), np.uint8))
    whole = ls._segment(low, np.array([0, len(low)]))
    monkeypatch.setattr(ls, "BLOCK_BYTES", 1000)
    parts = ls._long_segment(low)
    for c in ("sizes", "hashes", "words", "word_ends", "starts", "docs", "counts"):
        assert np.array_equal(whole[1][c], parts[1][c]), c


def row_groups(table):
    """(rows, bytes) of every row group of a stored table."""
    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    return [(g.num_rows, g.total_byte_size) for m in files for g in map(m.row_group, range(m.num_row_groups))]


def test_stored_segments_are_read_some_at_a_time(spark):
    """Parquet looks at the size of a row group after a hundred rows first, so that a file of fewer segments was one row group, which a reader holds whole."""
    rng = np.random.default_rng(1)
    docs = [" ".join(map(str, rng.integers(0, 60_000, 250_000))) for _ in range(3)]  # a segment each
    docs += [" ".join(f"w{i}" for i in range(1000))] * 1200  # some segments of lists that compress to little
    docs, items = list(enumerate(docs)), [(1, "w1 w2 " + docs[0][:200]), (2, docs[2][:200])]
    index = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    block = ls.Block([t for _, t in docs[:4]])
    block.weigh(len(docs), 1_950_000, {t: 1 for t in range(len(block.vocabulary))})
    for table in (index, ls.impact_lists(index, spark.sparkContext.broadcast(block))):
        groups = row_groups(table)
        assert sum(n for n, _ in groups) >= 6 and all(n == 1 or size <= 8 << 20 for n, size in groups), groups
    found = ls.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == by_force(docs, items)


def segments(docs, items, size):
    """The lists of segments of ``size`` documents, made without Spark."""
    import pyarrow as pa

    parts = []
    for lo in range(0, len(docs), size):
        texts = [(t or "").encode() for _, t in docs[lo : lo + size]]
        part = ls._segment(ls.lowered(np.frombuffer(b"".join(texts), np.uint8)), np.r_[0, np.cumsum([len(t) for t in texts])])
        if part is not None:
            parts.append((lo + part[0], part[1]))
    block = ls.Block([t for _, t in items])
    df = collections.Counter()
    for _, p in parts:
        ends, text = p["word_ends"], p["words"].tobytes()
        for k in range(len(ends)):
            w = text[ends[k - 1] if k else 0 : ends[k]]
            if w in block.vocabulary:
                df[block.vocabulary.index(w)] += int(p["starts"][k + 1] - p["starts"][k])
    block.weigh(sum(len(t) for t, _ in parts), sum(int(p["sizes"].sum()) for _, p in parts), df)
    out = []
    for there, p in parts:
        types = {"sizes": np.int64, "hashes": np.uint64, "words": np.uint8, "word_ends": np.int64, "starts": np.int64, "docs": np.int32, "counts": np.int64}
        out.append({"ids": pa.scalar(there.tolist())} | {c: pa.scalar(p[c].astype(t).tobytes()) for c, t in types.items()})
    return block, out


def test_bounds_hold_and_pairs_tighten(spark):
    docs, items = corpus(5, 400)
    block, parts = segments(docs, items, 10)
    rows = spark.createDataFrame([{k: v.as_py() for k, v in p.items()} for p in parts], "ids array<long>, sizes binary, hashes binary, words binary, word_ends binary, starts binary, docs binary, counts binary")
    lists = ls.impact_lists(rows, spark.sparkContext.broadcast(block)).toArrow()
    assert len(block.pairs) > 20 and len(set(block.pairs.ravel().tolist())) == block.pairs.size
    tighter = 0
    for b in lists.to_batches():
        for row in ls._rows([b]):
            s = ls.Segment(row, block)
            independent = np.array([int(s.most[f].sum()) for f in block.terms])
            totals = s.totals()
            assert (totals <= independent).all()
            tighter += int((totals < independent).sum())
            for i in range(len(items)):
                exact = dict(zip(*[x.tolist() for x in s.candidates(i, 1)], strict=True))
                if exact:
                    assert max(exact.values()) <= totals[i]
                for least in (10**6, max(exact.values(), default=1), max(exact.values(), default=1) + 1):
                    cand, score = s.candidates(i, least)
                    assert dict(zip(cand.tolist(), score.tolist(), strict=True)) == {d: v for d, v in exact.items() if v >= least}
    assert tighter > len(items)

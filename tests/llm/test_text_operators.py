"""The text operators against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns of clashing names."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermoflux.llm import chat_format, common, decontaminate, exact_dedup, katz_lm, language_id, mixing, near_dedup, quality, queries, substring_dedup, toxicity
from thermoflux.llm.linear import dual_coordinate_descent, probability

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, size string, position int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, texts, ids=None):
    """Documents with further columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 4}", 7, "k", "s", "z", 5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (t or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abcdéñß") for _ in range(rng.randint(1, 6))) for _ in range(80)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = text(150), text(40)
    near = base.split()
    near[70] = "zzz"
    out = [None, "", " \n\t ", "!", "one", "Two words", base, base, " ".join(near), base.upper(), text(30) + " " + passage + " " + text(20), passage, text(9), "a" * 700, "ab " * 400, text(20000), base + "\0x", "\0" * 150]
    return out + [text(rng.randint(1, 60)) for _ in range(20)]


def test_decontaminate(spark, texts):
    items = [(1, texts[11]), (2, texts[11]), (3, "Two words"), (4, None), (5, ""), (6, texts[6]), (6, texts[6]), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        ws = words_of(t, pattern)
        for k in range(max(0, len(ws) - min(10, len(ws)) + 1)) if ws else ():
            windows.setdefault(tuple(ws[k : k + min(10, len(ws))]), set()).add(str(i) if i is not None else "null")
    want = {}
    for i, t in enumerate(texts):
        ws, hit, found = words_of(t, pattern), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        want[i] = (len(ws), len(hit), sorted(found))
    docs = table(spark, texts)
    for most in (10**6, 40):  # one broadcast set, and several
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.scan(docs, bench, max_windows=most).collect()}
        assert got == want
        kept = decontaminate.drop_contaminated(docs, bench, max_windows=most)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if not x[1]}
    again = table(spark, [texts[6], texts[6], texts[11], texts[11], None, "clean"], [4, 4, None, None, None, None])
    rows = [sorted((str(r["doc_id"]), r["n_hit"], str(r["spans"])) for r in decontaminate.scan(again, bench, max_windows=most).collect()) for most in (10**6, 40)]
    assert rows[0] == rows[1] and len(rows[0]) == 6 and sum(n > 0 for _, n, _ in rows[0]) == 4
    assert [decontaminate.drop_contaminated(again, bench, max_windows=most).count() for most in (10**6, 40)] == [2, 2]
    named = docs.withColumn("_hit_id", F.lit("h")).withColumn("_spans", F.lit("s"))
    assert decontaminate.cut_spans(named, decontaminate.scan(named, bench)).select("_hit_id", "_spans").distinct().collect() == [("h", "s")]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, decontaminate.scan(docs, bench)).collect()}
    assert cut[0] is None and cut[12] == texts[12] and words_of(texts[11])[5] + " " + words_of(texts[11])[6] not in cut[10]
    assert decontaminate.scan(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


def test_exact_dedup(spark, texts):
    docs = table(spark, texts + texts[6:8] + ["", None], list(range(len(texts))) + [900, 900, 7000, None])
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    got = exact_dedup.exact_duplicates(docs, support=0.05).collect()
    assert len(got) == docs.count()
    for r in got:
        own = groups[r["text"] or ""]
        keep = max((x for x in own if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.filter("keep_id <> 'k'").count() == 0
    assert {r["text"] or "" for r in kept.collect()} == set(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def components_by_force(sets, percent):
    ids = list(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def shingles(t, n):
    ws = words_of(t)
    return {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def test_near_dedup(spark, texts):
    rng = random.Random(1)
    chain = texts[6].split()
    family = []
    for k in range(25):  # copies of copies, and copies too far from each other
        chain = list(chain)
        for _ in range(rng.choice((1, 2, 6))):
            chain[rng.randrange(len(chain))] = f"edit{k}{rng.random()}"
        family.append(" ".join(chain))
    every = texts + family
    docs = table(spark, every)
    for n, s in ((3, 0.85), (5, 0.8), (1, 0.5)):
        sets = {i: shingles(t, n) for i, t in enumerate(every)}
        want = components_by_force(sets, round(100 * s))
        got = near_dedup.near_duplicates(docs, n, s).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(components_by_force({i: shingles(t, 5) for i, t in enumerate(every)}, 80).values()))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    repeated = near_dedup.near_duplicates(table(spark, [texts[6], texts[6], None], [4, 4, None])).collect()
    assert len(repeated) == 3 and all(r["kept"] for r in repeated)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**52, 600, dtype=np.uint64)
    b = np.concatenate([a[:500], rng.integers(0, 2**52, 100, dtype=np.uint64)])
    e = [(near_dedup.superminhash(np.concatenate([a ^ np.uint64(k), b ^ np.uint64(k)]), np.array([0, 600, 1200]), 128)) for k in range(20)]
    assert np.mean([(s[0] == s[1]).mean() for s in e]) == pytest.approx(500 / 700, abs=0.03)


def test_chat_format(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, None, "alone"), (5, None, "user", ""), (5, None, "user", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = chat_format.pair_conversations(df)
    got = chat_format.format_pairs(pairs).collect()
    ids = sorted(x for r in got for x in (r["chosen_id"], r["rejected_id"]) if x is not None)
    assert ids == [1, 2, 3, 4, 5]
    for r in got:
        for side in ("chosen", "rejected"):
            if r[f"{side}_id"] is None:
                assert r[side] is None and r[f"{side}_mask"] is None
                continue
            own = [(x[2] or "null", x[3] or "") for x in turns if x[0] == r[f"{side}_id"]]
            full = "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in own)
            assert r["prompt"] + r[side] == full
            trained = [r[side][m["start"] : m["end"]] for m in r[f"{side}_mask"]]
            assert trained == [b + "<|im_end|>" for a, b in own[r["n_common"] :] if a == "assistant"]
    assert chat_format.pair_conversations(df.limit(0)).count() == 0


def repeats_by_force(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone |= set(range(k, k + length))
            seen.add(s)
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), kept)
    return out


def test_substring_dedup(spark, texts):
    docs = table(spark, texts)
    want = repeats_by_force([(i, t) for i, t in enumerate(texts)], 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and want[13][1] > 0
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    twice = substring_dedup.remove_repeats(table(spark, [texts[6], texts[6], texts[6]], [3, 3, 9])).collect()
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in twice) == [(3, False), (3, False), (9, True)]


def test_common_minimisers_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    docs = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + line + "".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(60)] + [line * 3]
    monkeypatch.setattr(substring_dedup, "PLAN_EVERY", 1)
    monkeypatch.setattr(substring_dedup, "PLAN_LEAST", 5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(table(spark, docs)).collect()}
    assert got == repeats_by_force(list(enumerate(docs)), 100)


def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "er", "sh"], "de": ["sch", "ung", "ä", "ei"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(10)), lang) for i in range(200) for lang in [rng.choice(["en", "de"])]]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "de"), (902, "123 --", "en"), (903, "x" * 100_000, None)], "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows if i % 2) >= 98
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902)) and got[903]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_many_languages_in_blocks(spark):
    """1,100 languages; blocks of languages change nothing, nor do clashing names, ties, repeated rows or a language without texts."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} ab", f"l{i:04d}") for i in range(1100)] + [(2000, None, "only-null"), (3, f"{chr(0x4E03)} ab", "l0003")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit("mine"))
    own = 400 * 4 * language_id.BUCKETS
    model = language_id.train(docs, max_bytes=own)
    got = language_id.identify(docs, model, max_bytes=own).collect()
    assert len(got) == len(rows) and sum(r["lang_pred"] == r["lang"] for r in got) >= 1090
    few = docs.filter("lang < 'l0004'")
    whole, parts = (language_id.identify(few, language_id.train(few, max_bytes=m), max_bytes=m).collect() for m in (1 << 26, 4 * language_id.BUCKETS))
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in whole) == sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in parts)
    alike = spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string")
    tied = language_id.identify(alike, language_id.train(alike)).collect()
    assert [(r["lang_pred"], r["score"]) for r in tied] == [("a", 0.5)] * 2


def test_naive_bayes_equals_brute_force(spark):
    rows = [(0, "abc ab", "x"), (1, "bca", "y"), (2, "abé", "x"), (3, "AB", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)

    def grams(t):
        t = t.translate(LOWER)
        return [t[i : i + n] for n in language_id.ORDERS for i in range(len(t) - n + 1)]

    counts = {k: collections.Counter(g for _, t, lang in rows if lang == k for g in grams(t)) for k in "xy"}
    total = {k: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for k, c in counts.items()}
    for r in language_id.identify(docs, model).collect():
        logp = {k: math.log({"x": 2 / 3, "y": 1 / 3}[k]) + sum(math.log((counts[k][g] + language_id.SMOOTHING) / total[k]) for g in grams(r["text"])) for k in "xy"}
        best = max(logp, key=logp.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - logp[best]) for v in logp.values()), rel=1e-3)


@pytest.mark.parametrize("operator,label,bad", [(quality, "quality", "word%%% other### "), (toxicity, "toxic", "the idiot was ")])
def test_classifiers(spark, operator, label, bad):
    rng = random.Random(5)

    def clean():
        return " ".join("".join(rng.choice(["an", "er", "th", "on", "is"]) for _ in range(rng.randint(1, 3))) for _ in range(40))

    toxic = label == "toxic"
    rows = [(i, clean() if i % 3 else clean()[:60] + " " + bad * (1 if toxic else 10) + clean()[:40]) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 50_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int((i % 3 == 0) == toxic)) for i in range(300)] + [(901, None), (None, 1), (5000, 0)], f"doc_id long, {label} int")
    model = operator.fit(docs, labels.filter("doc_id % 2 = 0 OR doc_id > 800"), label)
    got = {r["doc_id"]: r for r in operator.score(docs, model).collect()}
    assert len(got) == 303 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    right = [got[i]["predicted"] == int((i % 3 == 0) == toxic) for i in range(1, 300, 2)]
    assert sum(right) >= 0.97 * len(right)
    only = operator.fit(docs, labels.filter(f"{label} = 1"), label)
    assert {r["predicted"] for r in operator.score(docs, only).collect()} == {1}
    none = operator.fit(docs, labels.limit(0), label)
    assert {r["score"] for r in operator.score(docs, none).collect()} == {0.5}


def kernel_by_force(text, mark):
    """The largest capped sum over all windows of the padded text."""

    def weights(s):
        out = collections.Counter()
        for c in itertools.combinations(range(len(s)), toxicity.ORDER):
            if all(b - a <= toxicity.GAP + 1 for a, b in itertools.pairwise(c)):
                out[c[0], bytes(s[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    own = collections.Counter()
    for (_, g), w in weights(mark).items():
        own[g] += w
    here, best = weights(text), 0.0
    for lo in range(len(text)):
        held = collections.Counter()
        for (at, g), w in here.items():
            if lo <= at < lo + len(mark) + toxicity.SLACK and g in own:
                held[g] += w
        best = max(best, sum(min(w, own[g]) * own[g] for g, w in held.items()) / sum(w * w for w in own.values()))
    return best if best >= toxicity.LEAST else 0.0


def test_string_kernel_equals_brute_force():
    marks = [b" idiot ", " réeux".encode(), b" worthless "]
    units = ["idiot", "idixot", "id iot", "worthless", "wort hlss", "abcd", "", "RÉEUXOU", "ab réxeux", "loweick"]
    got = toxicity.kernel([u.encode() for u in units], marks)
    want = [[kernel_by_force(b" " + u.lower().encode() + b" ", m) for m in marks] for u in units]
    assert np.allclose(got, want, atol=1e-5)
    buf = "so I-d-I-o-T s c u m!|RÉ É".encode()
    text, offs = toxicity.stream(np.frombuffer(buf, np.uint8), np.array([0, buf.index(b"|"), buf.index(b"|"), len(buf)]))
    docs = [text[i:j].tobytes().rstrip(b"\0") for i, j in zip(offs[:-1], offs[1:], strict=True)]
    assert docs == [b" so idiot scum ", b" ", " ré é ".encode()]


def test_toxicity_fit_and_score_by_force(spark):
    """The model's score is the calibrated hinge-loss margin of the brute-force kernel values; altered insults reach 0.7, neighbours do not."""
    rng = random.Random(6)
    insults = ["idiot", "scumbag", "worthless"]
    clean = [" ".join("".join(rng.choice(["an", "er", "th", "on", "is", "ea", "ly"]) for _ in range(rng.randint(1, 3))) for _ in range(30)) for _ in range(240)]
    texts = [t if i % 4 else t[:50] + f" {insults[i // 4 % 3]} " + t[50:] for i, t in enumerate(clean)]
    y = np.array([int(i % 4 == 0) for i in range(240)])
    streams = []
    for t in texts:
        s, o = toxicity.stream(*toxicity._joined([t.encode()]))
        streams.append(s[: o[1] - toxicity._PAD].tobytes())
    model = toxicity.fit_texts(streams, y)
    assert {b" idiot ", b" scumbag ", b" worthless "} <= set(model.landmarks)
    odd = ["idixot", "idizot", "scvumbag", "worthxless", "worth less", "id iot", "i-d-i-o-t", "w o r t h l e s s", "wothless", "wortless", "IDIOT!"]
    p = model.probability([f"an er {t} thon is".encode() for t in odd])
    assert (p >= 0.7).all(), dict(zip(odd, p, strict=True))
    near = ["island", "thistle", "worn", "idle", "scan", "less", "an er thon is", ""]
    assert (model.probability([t.encode() for t in near]) < 0.7).all()
    for t in odd[:4] + near:
        values = np.zeros((1, toxicity.RANKS, len(model.landmarks)))
        values[0, 0] = [kernel_by_force(b" " + " ".join(t.lower().split()).encode() + b" ", m) for m in model.landmarks]
        want = (toxicity.excess(values)[0] * model.weights).sum() + model.bias
        if len(t.split()) == 1:
            assert model.of([t.encode()])[0] == pytest.approx(want, abs=1e-4)
    rows = [(1, texts[0], "k"), (1, texts[0], "k"), (None, None, "k"), (2, "", "k"), (3, "idiot", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and [r["predicted"] for r in got] == [1, 1, 0, 0, 1]
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_toxicity_held_out(spark):
    """Every held-out toxic document of the given tables that holds any sign of it, and at most one clean one in a hundred."""
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["toxic"] is not None and got[r["doc_id"]]["held_out"]]
    toxic, clean = ([got[r["doc_id"]]["predicted"] for r in labels if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_very_long_texts_in_blocks(monkeypatch):
    """Texts beyond a block give what they give in one piece."""
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefgh \n\xc3\xa9", dtype=np.uint8)
    buf = letters[rng.integers(0, 10, 60_000)].copy()
    buf[20_000:31_000] = ord("x")  # one word longer than a block
    s, e, _ = common.words(buf, np.array([0, len(buf)]), common.NOT_SPACE)
    whole = common.span_hashes(common.byte_values()[buf], s, e)
    monkeypatch.setattr(common, "BLOCK_BYTES", 4096)
    assert (common.word_hashes(buf, s, e) == whole).all()

    text = " ".join(["".join(rng.choice(list("abcdé"), 5)) for _ in range(4000)]).encode()
    model = np.log(rng.random((language_id.BUCKETS, 2))).astype(np.float32)
    whole, letter = language_id.log_posteriors(model, np.zeros(2), pa.array([text]))
    monkeypatch.setattr(language_id, "PART_BYTES", 1000)
    parts, _ = language_id.log_posteriors(model, np.zeros(2), pa.array([text]))
    assert letter.all() and np.allclose(whole, parts)

    words_ = text.split()
    for at, w in ((100, b"idiot"), (1500, b"idixot"), (3900, b"worthless")):
        words_[at] = w
    toxic = toxicity.ToxicityModel([b" idiot ", b" worthless "], rng.random((toxicity.RANKS * len(toxicity.LEVELS), 2)), -1.0, (1.0, 0.0), None)
    whole = toxic.of([b" ".join(words_)])
    monkeypatch.setattr(toxicity, "PASS_BYTES", 1000)
    monkeypatch.setattr(toxicity, "OVERLAP", 200)
    assert toxic.of([b" ".join(words_)]) == pytest.approx(whole)


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_ties_repeats_and_nothing(spark, operator, label):
    rows = [(i, "good plain words here" if i % 2 else "###!! idiot ###!!") for i in range(60)] * 2 + [(None, None), (None, "good plain words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"predicted": F.lit("mine"), "y": F.lit(1), "_id": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 2 == (label == "quality"))) for i in range(60)] * 2, f"doc_id long, {label} int")
    model = operator.fit(docs, labels, label)
    got = operator.score(docs, model).collect()
    assert len(got) == len(rows) and {(r["y"], r["_id"]) for r in got} == {(1, 2)}
    assert len({(r["text"], r["score"]) for r in got}) == 3  # equal texts score alike
    assert operator.score(docs.limit(0), model).count() == 0
    empty = operator.fit(docs.limit(0), labels, label)
    assert {r["score"] for r in operator.score(docs, empty).collect()} == {0.5}
    again = operator.score(docs, operator.fit(docs.repartition(7), labels, label)).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)
    few = operator.fit(docs, labels, label, max_bytes=100) if operator is toxicity else None  # fewer bytes, fewer documents
    assert few is None or few.constant is not None or few.landmarks is not None


def quality_features_by_force(text):
    """The indicators of a text as names: words, shapes, pairs of shapes, and the shares that they reach."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [w.translate(LOWER) for w in ws]
    shape = []
    for i, w in enumerate(ws):
        s = re.sub(r"[a-z\u0080-\uffff]+", "a", re.sub(r"[0-9]+", "0", re.sub(r"[A-Z]+", "A", w)))
        shape.append("=" if i and low[i] == low[i - 1] else re.sub(r"(.)\1+", r"\1", s))
    grams = collections.Counter([("s", x) for x in shape] + [("p", a, b) for a, b in itertools.pairwise(shape)])
    out = {("w", w) for w in low} | set(grams)
    return out | {(g, k) for g, n in grams.items() for k, least in enumerate(quality._SHARES, 1) if n / len(ws) >= least}


def test_quality_by_force():
    """Features are those of the plain version, ratios are add-one log count ratios, and the weights meet the conditions of the hinge-loss optimum."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["Good", "plain", "word", "and", "more"] if i % 2 else ["BUY", "now!!", "$$$", "click", "1234", "buy", "buy"]) for _ in range(rng.randint(3, 30))) for i in range(80)]
    y = np.array([i % 2 for i in range(80)])
    at, bounds = quality.features(*toxicity._joined([t.encode() for t in texts]))
    own = [at[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    names = [quality_features_by_force(t) for t in texts]
    assert [len(x) for x in own] == [len(x) for x in names]
    for i, j in itertools.combinations(range(0, 80, 7), 2):
        assert len(np.intersect1d(own[i], own[j])) == len(names[i] & names[j])
    r = quality.log_count_ratios(own, y)
    p, q = (collections.Counter(f for x, label in zip(own, y, strict=True) if label == k for f in x.tolist()) for k in (1, 0))
    n = [sum(c.values()) + quality.BUCKETS for c in (p, q)]
    for f in set(p) | set(q):
        assert r[f] == pytest.approx(math.log((p[f] + 1) / n[0]) - math.log((q[f] + 1) / n[1]))
    cost = 1e-3
    w, bias = dual_coordinate_descent([(x, r[x]) for x in own], y, quality.BUCKETS, cost=cost, epochs=400)
    sign = np.where(y > 0, 1, -1)
    dense = np.zeros((80, quality.BUCKETS))
    for i, x in enumerate(own):
        dense[i, x] = r[x]

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + cost * np.maximum(0, 1 - sign * (dense @ w + b)).sum()

    best, gen = loss(w, bias), np.random.default_rng(3)
    for scale in (1e-3, 1e-2, 0.1):
        for _ in range(20):
            assert loss(w + scale * np.abs(w).max() * gen.normal(size=len(w)) * (w != 0), bias + scale * gen.normal() * abs(bias)) >= best - 1e-7
    model = quality.fit_rows(own, y)
    got = model.score(pa.array(texts))
    want = probability(np.array([model.weights[x].astype(float).sum() + model.bias for x in own]), model.calibration)
    assert got == pytest.approx(want) and ((got >= 0.5) == (y == 1)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name,columns", [
    ("op2_language_id", "doc_id bigint, held_out boolean, lang_pred string, score double"), ("op5_suffix_dedup", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"),
    ("op7_toxicity", "doc_id bigint, held_out boolean, score double, predicted int"), ("op10_quality", "doc_id bigint, held_out boolean, score double, predicted int"),
    ("op8_katz_lm", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"),
])
def test_queries_keep_their_contract(spark, name, columns):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == columns
    got = out.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    rule = {"op2_language_id": (5, 0), "op7_toxicity": (3, 1), "op8_katz_lm": (5, 1), "op10_quality": (4, 2)}.get(name)
    for r in got:
        assert rule is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % rule[0] == rule[1])
        if "predicted" in out.columns:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    if name == "op8_katz_lm":
        want = katz_by_force(docs, {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}, check=False)
        assert {r["doc_id"]: tuple(r)[2:] for r in got} == {i: (*x[:3], pytest.approx(x[3], rel=1e-9), pytest.approx(x[4], rel=1e-9)) for i, x in want.items()}


def katz_by_force(docs, train, check=True):
    seq = {i: [*words_of(t), None] for i, t in docs.items()}
    c = collections.Counter(w for i in train for w in seq[i])
    total, types = sum(c.values()), len(c)
    b = collections.Counter((v, w) for i in train for v, w in zip(["<s>", *seq[i]], seq[i]))
    of = [katz_lm.discounts(np.array([sum(x == r for x in m.values()) for r in range(1, katz_lm.K + 2)], float)) for m in (c, b)]

    def cut(x, d):
        return x * (d[x - 1] if x <= katz_lm.K else 1)

    unknown = 1 - sum(cut(x, of[0]) for x in c.values()) / total
    p = {w: cut(x, of[0]) / total for w, x in c.items()}
    ctx, seen, mass = collections.Counter(), collections.Counter(), collections.Counter()
    for (v, _), x in b.items():
        ctx[v] += x
    # the extra count only where no count of the context is discounted
    below = {v: n + (0 if any(x <= katz_lm.K for (u, _), x in b.items() if u == v) else 1) for v, n in ctx.items()}
    for (v, w), x in b.items():
        seen[v] += cut(x, of[1]) / below[v]
        mass[v] += p[w]

    def prob(v, w):
        if b[v, w]:
            return cut(b[v, w], of[1]) / below[v]
        return ((1 - seen[v]) / (1 - mass[v]) if ctx[v] else 1) * p.get(w, unknown)

    for v in ["<s>", *[w for w in c if w is not None], "never seen"] if check else ():  # every context sums to 1
        assert sum(prob(v, w) for w in c) + prob(v, "unknown word") == pytest.approx(1)
    return {i: (len(s), sum(c[w] > 0 for w in s), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in s), sum(math.log10(prob(v, w)) for v, w in zip(["<s>", *s], s))) for i, s in seq.items()}


@pytest.mark.parametrize("known", [1 << 18, 64])
def test_katz(spark, texts, known, monkeypatch):
    monkeypatch.setattr(katz_lm, "KNOWN", known)
    monkeypatch.setattr(katz_lm, "CHUNK_TOKENS", 500)
    docs = dict(enumerate(texts))
    want = katz_by_force(docs, {i for i in docs if i % 3})
    got = katz_lm.score(table(spark, texts).withColumn("train", F.col("doc_id") % 3 != 0)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:4] == want[r["doc_id"]][:3]
        assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][3:], rel=1e-9)
    named = table(spark, texts).withColumn("train", F.col("doc_id") % 3 != 0).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"]: r["score"] for r in katz_lm.score(named).collect()} == pytest.approx({f"d{i}": x[4] for i, x in want.items()}, rel=1e-9)
    empty = table(spark, texts).limit(0).withColumn("train", F.lit(True))
    assert katz_lm.score(empty).count() == 0
    nothing = katz_lm.score(table(spark, ["a b", None]).withColumn("train", F.lit(False))).collect()
    assert [(r["n_known"], r["score"]) for r in nothing] == [(0, 0.0), (0, 0.0)]


def test_katz_frees_mass_in_hot_contexts_too(spark, monkeypatch):
    """Contexts all of whose words are frequent, hot and spread over buckets: the divisor is settled once all buckets are known."""
    monkeypatch.setattr(katz_lm, "LEAST_BUCKETS", 7)
    texts = ["a b a b a b a b a b"] * 12 + ["a c", "b d e", "x a b"] + ["a"] * 9
    docs = dict(enumerate(texts))
    want = katz_by_force(docs, {i for i in docs if i % 5})
    got = katz_lm.score(table(spark, texts).withColumn("train", F.col("doc_id") % 5 != 0)).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({i: x[4] for i, x in want.items()}, rel=1e-9)


def test_mix_targets_and_positions(spark, texts, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 2)
    docs = table(spark, texts)
    options = {"weights": [5.0, 2.0, 1.0], "share": 1.5, "max_passes": 2}
    total = {r["doc_id"]: r for r in mixing.mix_summary(docs, **options).collect()}
    size = {i: len(words_of(t)) for i, t in enumerate(texts)}
    assert {i: r["size"] for i, r in total.items()} == size
    per = collections.defaultdict(lambda: [0, 0.0])
    for r in docs.collect():
        per[r["source"]][0] += total[r["doc_id"]]["taken"]
        per[r["source"]][1] = total[r["doc_id"]]["target"]
        assert total[r["doc_id"]]["taken"] <= 2 * size[r["doc_id"]]
    assert all(abs(taken - target) <= 1 for taken, target in per.values())
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(size.values()))
    mixed = mixing.mix(docs, **options).collect()
    got = collections.Counter()
    for r in mixed:
        got[r["doc_id"]] += r["taken"]
        assert 0 <= r["position"] <= 1 and len(words_of(r["text"])) == r["taken"]
    assert {i: n for i, n in got.items()} == {i: r["taken"] for i, r in total.items() if r["taken"]}
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)
    assert sorted(map(tuple, mixing.mix(docs, **options).collect())) == sorted(map(tuple, mixed))
    assert mixing.mix(docs.limit(0), **options).count() == 0 and mixing.mix_summary(docs.limit(0), **options).count() == 0


def test_mix_summary_sums_the_ordered_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 2)
    # repeated ids, an empty and a null text, and a source of which little is taken
    rows = [(1, "a", "x y"), (1, "a", "x y"), (2, "a", None), (2, "a", None), (3, None, "u v w")] + [(i, "b", "p q r s") for i in range(4, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_summary(docs, [1.0, 1.0, 1.0], 0.4, 2).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    mixed = mixing.mix(docs, [1.0, 1.0, 1.0], 0.4, 2, every=True).collect()
    placed = [r for r in mixed if r["pass_no"] is not None]
    knots = spark.range(1).select(mixing.demand_curve(mixing.default_knots(F.lit(1.0), [1.0])).alias("c")).first()["c"]
    for r in placed:  # the default schedule of equal weights
        need = (r["pass_no"] * r["source_size"] + r["start"]) / r["target"]
        assert np.interp(r["position"], [k["t"] for k in knots], [k["rate"] for k in knots]) > 0
        assert np.trapezoid(np.interp(x := np.linspace(0, r["position"], 2001), [k["t"] for k in knots], [k["rate"] for k in knots]), x) == pytest.approx(need, abs=1e-6)
    assert sum(r["taken"] for r in placed) == sum(r["taken"] for r in got)
    assert {r["taken"] for r in mixed if r["pass_no"] is None} == {0} and any(r["taken"] == 0 for r in got)


def test_mix_defines_odd_weights_and_schedules(spark):
    rows = [(i, "abc"[i % 3], "w " * (i + 1)) for i in range(30)] + [(40, None, "n n n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    none = {r["source"]: r["target"] for r in mixing.mix(docs, [0.0, 1.0, 0.0], 0.5, 2, every=True).select("source", "target").distinct().collect()}
    assert none["a"] == none["c"] == 0 and none["b"] == pytest.approx(0.5 * sum(len(r[2].split()) for r in rows))
    every = mixing.mix_summary(docs, [0.0, 1.0, 0.0], 1.9, 2).collect()  # more than the only weighted source can give
    assert sum(r["taken"] for r in every) == 2 * sum(len(r[2].split()) for r in rows if r[1] == "b")
    for bad in ([], [0.0], [-1.0, 2.0], [float("nan")]):
        with pytest.raises(ValueError):
            mixing.mix_summary(docs, bad)
    level = {(r["doc_id"], r["pass_no"]): r["position"] for r in mixing.mix(docs, [1.0], 1.0, 1, knots=spark.createDataFrame([(x, [(0.0, 1.0), (1.0, 1.0)]) for x in "abc"], "source string, knots array<struct<t:double,rate:double>>")).collect()}
    for odd in ([], [(0.5, 3.0)], [(0.0, 0.0), (1.0, 0.0)], [(1.0, 2.0), (0.0, 2.0)], [(0.0, None), (0.0, 1.0), (1.0, 1.0)], [(None, 4.0), (1.0, 1.0), (0.0, 1.0)]):
        knots = spark.createDataFrame([(x, odd) for x in "abc"], "source string, knots array<struct<t:double,rate:double>>")
        got = {(r["doc_id"], r["pass_no"]): r["position"] for r in mixing.mix(docs, [1.0], 1.0, 1, knots=knots).collect()}
        assert got.keys() == level.keys() and all(0 <= p <= 1 for p in got.values())
        if odd != [(0.0, None), (0.0, 1.0), (1.0, 1.0)]:
            assert got == pytest.approx(level)


def test_mix_summary_moves_no_texts(spark, texts):
    docs = table(spark, texts)
    plan = mixing.mix_summary(docs, [5.0, 2.0, 1.0])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    # the text is read by the word count at the scan, and nowhere cut or carried
    assert "array_join" not in plan and "regexp_extract_all" not in plan.split("size(regexp_extract_all")[0]


def test_demand_curve_is_inverted(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("rate")) for t, r in ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 1.0))])
    df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("c", mixing.demand_curve(knots)).withColumn("t", mixing.invert_demand(F.col("c"), F.col("u")))

    def area(t):
        x = np.linspace(0, t, 20001)
        return np.trapezoid(np.interp(x, [0, 0.25, 0.5, 1], [0, 2, 2, 1]), x)

    for r in df.select("u", "t").collect():
        assert area(r["t"]) / area(1.0) == pytest.approx(r["u"], abs=1e-4)

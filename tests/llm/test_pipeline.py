"""The corpus pipeline stage by stage against brute force over the smallest tables."""

import os
import re

import pytest
from pyspark.sql.functions import lit
from test_text_operators import LOWER, components_by_force, shingles, words_of

import corpus_pipeline
from thermoflux.llm import mixing, quality
from thermoflux.llm.common import staged

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    columns = docs.columns

    def run(name, df):
        out = stages[name](spark, df, DATA)
        assert name == "mix" or out.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{os.getpid()}"
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    good = run("quality", docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    right = [(i in ids) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids == {r["doc_id"] for r in quality.score(docs, model).filter("score >= 0.5").collect()}

    exact = run("exact_dedup", good)
    last = {}
    for r in good.collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert {r["doc_id"] for r in exact.collect()} == set(last.values())

    near = run("near_dedup", exact)
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in exact.collect()}
    assert {r["doc_id"] for r in near.collect()} == set(components_by_force(sets, 80).values())

    clean = run("decontaminate", near)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words_of(r["text"], pattern)
        windows |= {" ".join(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    joined = re.compile("|".join(rf"(?:^| ){re.escape(w)}(?: |$)" for w in sorted(windows)))
    want = {r["doc_id"] for r in near.collect() if not joined.search(" ".join(words_of(r["text"], pattern)))}
    assert {r["doc_id"] for r in clean.collect()} == want

    mixed = run("mix", clean)
    taken = mixing.mix_summary(clean, **corpus_pipeline.MIX)
    want = {r["doc_id"]: r["taken"] for r in taken.collect() if r["taken"]}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert got == want and LOWER


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_nulls_and_clashing_columns_pass_all_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ["score", "predicted", "keep_id", "group_size", "component_id", "kept", "text_sha256", "y", "_id", "_row", "_text", "_gone", "digest", "_k1", "_spans", "_hit_id"]
    nothing = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None), (90001, None, None, "src1", None), (90002, " ", "en", None, 1)], docs.schema)
    docs = docs.unionByName(nothing).select("*", *[lit(f"own {c}").alias(c) for c in names])
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, DATA), f"odd-{name}")
        assert name == "mix" or out.columns == docs.columns
        assert set(docs.columns) <= set(out.columns) and out.count() > 0
        for c in names:
            if c not in ("size", "taken"):
                assert [r[0] for r in out.select(c).distinct().collect()] == [f"own {c}"]
        docs = out
        sizes.append(docs.count())
    assert sizes[4] <= sizes[3] <= sizes[2] <= sizes[1] <= sizes[0]

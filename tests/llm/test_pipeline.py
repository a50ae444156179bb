"""The pipeline's stages against plain Python on the smallest tables."""

import corpus_pipeline as pipeline
from freshet.llm import decontam, near_dedup, quality

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(pipeline.STAGES)
    good = steps["quality_rules"](spark, docs, DATA)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    single = steps["near_duplicates"](spark, good, DATA)
    assert single.columns == docs.columns
    stays = {r["doc_id"] for r in near_dedup.near_duplicates(good).filter("kept").collect()}
    assert single.count() == len(stays)
    assert {r["doc_id"] for r in single.collect()} == stays
    clean = steps["decontamination"](spark, single, DATA)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontam.leaks(single, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == stays - leaking
    mixed = steps["mix_sources"](spark, clean, DATA)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= stays - leaking
    assert steps["shard"](spark, mixed, DATA).count() == mixed.count()


def test_stages_pass_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in pipeline.STAGES[:-1]:
        assert step(spark, docs, DATA).collect() == []
    assert pipeline.shard(spark, docs, DATA).collect() == []


def test_near_duplicates_go_by_row(spark):
    a, b = "the first text has some ten words of its own in it", "another text about quite different things that nobody else has written"
    rows = [(5, a), (1, a), (5, b), (None, a), (None, a), (2, None), (2, ""), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (2, None), (2, ""), (None, "short")], key=str)

"""The pipeline's stages, each against what its operator says."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyfold.llm import jaccard, pii, quality, registry, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    try:
        d = spark.read.parquet(f"{DATA}/documents.parquet")
    except Exception:
        pytest.skip("no test tables")
    more = spark.createDataFrame([(None, None, "en", "s", 0), (70_001, "", "en", "s", 0), (70_002, None, None, None, None)], d.schema)
    return d.unionByName(more).withColumn("quality_score", F.lit("mine")).withColumn("Toxicity_Grade", F.lit(1))


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(quality.classify(docs, labels).filter("score >= 0.3"))
    clean = corpus_pipeline.toxicity_stage(spark, kept, DATA)
    assert clean.columns == docs.columns
    assert ids(clean) == ids(toxicity.grade(kept, labels).filter("toxic = 0"))
    one = corpus_pipeline.near_duplicate_stage(spark, clean, DATA)
    assert one.columns == docs.columns
    assert ids(one) - {None} == ids(jaccard.components(clean).filter("component_id = doc_id"))
    private = corpus_pipeline.pii_stage(spark, one, DATA)
    assert private.columns == docs.columns and private.count() == one.count()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in private.collect():
        assert (r.text is None) == (before[r.doc_id] is None)
        for e in pii.detect(before[r.doc_id] or ""):
            assert before[r.doc_id][e.start : e.end] not in r.text
    packed = corpus_pipeline.packing_stage(spark, private, DATA)
    assert ids(packed) == ids(private)


def test_empty_and_whole_run(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
    out = corpus_pipeline.run(spark, DATA)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "pii", "packing"]


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in registry.queries())
    assert numbers == list(range(1, 11))

"""The corpus pipeline and the registered queries on the smallest driver tables."""

import os

import pytest
from oracle_check import difference, duck

import corpus_pipeline
from tropicast.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.where("length > 1024").count() == 0


def test_redacted_secrets_are_gone(spark):
    docs = corpus_pipeline.secret_scan(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert docs.where(r"text RLIKE '[0-9a-f]{24,}'").count() == 0


@pytest.mark.parametrize("key", sorted(registry.oracles()))
def test_oracle(spark, key):
    assert difference(registry.queries()[key](spark, SF), registry.oracles()[key], duck(SF)) is None


@pytest.mark.parametrize("key", sorted(set(registry.queries()) - set(registry.oracles())))
def test_rows(spark, key):
    table = {"op2_ann": "embeddings", "op8_html": "pages", "op11_whitening": "embeddings"}.get(key, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = registry.queries()[key](spark, SF).count()
    assert got >= rows if key not in ("op2_ann",) else got == 5 * -(-rows // 50)

"""The pipeline's stages on odd rows and on empty tables: nulls, empty and very long texts, repeated rows, ties, extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = "the house by the water and the old town are calm in the evening light"
ROWS = [(i, f"{PLAIN} {i} " * 3, "en", "s", 0) for i in range(12)]
ODD = [(20, None, None, None, None), (21, "", "en", "s", 0), (22, " \n ", "en", None, 0), (23, (PLAIN + "\n") * 3000, "en", "s", 0), (None, PLAIN * 2, "en", "s", 0), (3, ROWS[3][1], "en", "s", 0), (24, "12 34", "en", "s", 0)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, *ODD], SCHEMA).withColumn("_id", F.lit("x")).withColumn("gone", F.lit(1))


def test_filters_keep_what_is_clean(spark, docs, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, sf_dir)
    assert known.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in known.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted([*range(12), 3, 23]) and None in ids  # texts without letters go
    lines = stages["line_dedup"](spark, docs, sf_dir)
    assert lines.count() == len(ROWS) + len(ODD) and lines.columns == list(corpus_pipeline.COLUMNS)
    assert lines.filter("n_chars <> length(text)").isEmpty()
    single = stages["simhash_near_dedup"](spark, docs, sf_dir)
    kept = [r.doc_id for r in single.select("doc_id").collect()]
    assert single.columns == list(corpus_pipeline.COLUMNS) and None in kept and {20, 23, 24} <= set(kept) and not {21, 22} & set(kept)


def test_mixing_and_packing(spark, docs, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, sf_dir)
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and set(r.doc_id for r in mixed.select("doc_id").collect()) <= {r[0] for r in [*ROWS, *ODD]}
    packed = stages["best_fit_packing"](spark, docs, sf_dir)
    spans = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end")).collect()
    assert {r.doc_id for r in spans} == {r[0] for r in [*ROWS, *ODD]}
    assert all(r.n == r.end * (2 if r.doc_id == 3 else 1) for r in spans)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n <> end OR n > 2048").isEmpty()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, sf_dir, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), sf_dir).isEmpty()

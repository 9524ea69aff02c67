"""Copies of a document are not boilerplate in the pipeline."""

import corpus_pipeline


def test_copied_document_keeps_its_lines(spark):
    rows = [(i, "only here\nand here") for i in range(10)] + [(10 + i, f"head\nbody {i}") for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert all(got[i] == "only here\nand here" for i in range(10))
    assert all(got[10 + i] == f"body {i}" for i in range(10))

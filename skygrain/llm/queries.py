"""The registered queries of the corpus operators: each on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import cap_filters, exact_dedup, language_id, line_dedup, mixing, packing, records, secrets, simhash, toxicity
from .common import read_table
from .tokens import default_path


def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = language_id.fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), model, with_hits=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), default_path(), capacity=2048)


def op4_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    net = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_token_records(spark, sf_dir):
    out_dir, manifest = records.write_records(read_table(spark, sf_dir, "documents"), default_path())
    return records.read_records(spark, out_dir, manifest, with_ids=False)


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), words=4, radius=4).select("doc_id", "fingerprint", "component_id")


#: Shares of the corpus's words that each domain of the labelled table is to have.
TARGETS = {"high": 0.80, "low": 0.18, "toxic": 0.02}


def domains_of(labels):
    """The domain of each labelled document: toxic, else by its quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op8_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mixing_rates(docs, domains_of(read_table(spark, sf_dir, "labels")), TARGETS)


def op9_embedding_near_dedup(spark, sf_dir):
    return cap_filters.cap_links(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_best_fit_packing, op4_language_id, op5_exact_dedup, op6_token_records, op7_simhash_near_dedup, op8_mixing, op9_embedding_near_dedup, op10_secret_scan)}

ORACLES = {"op1_line_dedup": line_dedup.oracle_sql(), "op5_exact_dedup": exact_dedup.ORACLE_SQL}

"""From raw documents to packed training sequences: language id, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame: the columns of ``documents`` from all but the last, one row a packed piece from the last.
Empty tables pass through; null ids and texts are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrain.llm import language_id, line_dedup, mixing, packing, shingles
from skygrain.llm.common import cut, read_table
from skygrain.llm.queries import TARGETS, domains_of
from skygrain.llm.tokens import default_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose likeliest language has less than this mean probability over its windows is rejected.
LEAST_LANGUAGE_SCORE = 0.35
#: Words that a worker's tokenizer keeps a table: fewer than by default, since the workers hold four other stages' memory too.
TOKENIZER_WORDS = 50_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a known language; texts without letters and undecided ones go."""
    guessed = language_id.predict(docs.select(*COLUMNS), language_id.train(docs))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return guessed.filter(known).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that too many different pages of a source share; ``n_chars`` follows the text."""
    cleaned = line_dedup.line_dedup(docs.select(*COLUMNS), host_col="source", distinct=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return shingles.shingle_dedup(docs.select(*COLUMNS), words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the labelled domains' expected shares of words match the targets."""
    return mixing.mix_documents(docs.select(*COLUMNS), domains_of(read_table(spark, sf_dir, "labels")), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences of 2048 ids; one row a piece."""
    return packing.pack_documents(docs, default_path(), capacity=2048, max_words=TOKENIZER_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network, the fingerprints and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None

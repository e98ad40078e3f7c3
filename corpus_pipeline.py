"""A training corpus from raw documents, stage by stage.

Every stage gets what the one before it kept, as written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import decontaminate, languages, pieces, secrets, similar
from hindcast.llm.queries import DROPOUT, SEED, table, vocabulary
from hindcast.sources.shared import settle

MIN_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the corpus itself names.

    Documents without a letter go, and those of which under half of the letter n-grams are
    known to any language.
    """
    filters = languages.learn_languages(docs.filter(~languages.held_out()))
    told = languages.predict_languages(docs, filters)
    kept = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return told.filter(kept).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    return similar.one_of_each(docs, similar.similar_documents(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that repeat ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with its secrets masked."""
    return secrets.mask_secrets(docs, secrets.secret_scan(docs)).withColumn("n_chars", F.char_length("text").cast("long"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left for training."""
    return pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), DROPOUT, SEED)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_similar),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("sentencepiece", as_pieces),
]

# Learned filters, minimum-cost merges and similarity by signature have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

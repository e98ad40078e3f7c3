"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import anomalies, chosen_paths, decontaminate, languages, licenses, pieces, prefix_trie, secrets, similar, substrings, tokens, toxicity, whitening

DROPOUT, SEED = 0.1, 20240229
COMPONENTS = 32


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), DROPOUT, SEED)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_documents(table(spark, sf_dir, "documents")).drop("text_hash", "is_lead")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    names = F.transform("matches", lambda m: m["name"])
    return found.select("doc_id", "n_windows", F.size("matches").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.token_counts(docs, vocabulary("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", languages.held_out())
    filters = languages.learn_languages(docs.filter("NOT held_out"))
    return languages.predict_languages(docs, filters, ["doc_id", "held_out"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels know two categories; the second sees the probability of the first."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    low = labels.withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit_chain(docs, low, ["low_quality", "toxic"])
    return toxicity.predict_toxicity(docs, chain)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(secrets.secret_scan(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return anomalies.apply_rules(docs, anomalies.fit_rules(docs, labels))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_paths.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fit = whitening.fit_whitening(vectors)
    error = fit.identity_error(COMPONENTS) if fit else 0.0
    return whitening.whiten(vectors, fit, COMPONENTS).withColumn("identity_error", F.lit(error))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

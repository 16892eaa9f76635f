"""The queries of this folder's operators over the given tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import decontaminate, jaccard, lm, negatives, packing, pieces, pii, quality, search, secrets, substrings, tokenstore, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Attention and unigram scores of each document."""
    return lm.score(_table(spark, folder, "documents"), lm.Config(tokenizer_file("piece_bpe_32k.model")))


def op2_benchmark_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that lie in 10-word runs of benchmark items, and the items that occur."""
    return decontaminate.digest(decontaminate.scan(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark")))


def op3_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of each page."""
    return warc.digest(warc.derive(warc.responses(_table(spark, folder, "pages"))))


def op4_context_mixing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written in compressed files and read back."""
    return tokenstore.read(tokenstore.write(_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json")))


def op5_sentencepiece_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each document by the batched Viterbi search, and whether decoding gives the text again."""
    return pieces.digest(_table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of each document and its number of verified links."""
    return jaccard.classes(_table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def op7_semi_markov_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in each document."""
    return pii.digest(pii.scan(_table(spark, folder, "documents").select("doc_id", "text")))


def op8_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and the verdict of the quality rules for each document."""
    judged = quality.judge(_table(spark, folder, "documents"), columns=("doc_id",))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_zstd_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in each document."""
    return secrets.digest(secrets.scan(_table(spark, folder, "documents").select("doc_id", "text")))


def op10_difference_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that lie in repeated 20-word passages."""
    return substrings.dedup(_table(spark, folder, "documents"))


def op11_angular_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of the anchors among all vectors; every seventh vector's label is moved on by one first."""
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)


def op12_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 50 of all documents for each benchmark item."""
    return search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_minimum_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents in sequences of 4,096 tokens."""
    return packing.pack(_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_attention_lm": op1_attention_lm,
    "op2_benchmark_ngrams": op2_benchmark_ngrams,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_context_mixing_ids": op4_context_mixing_ids,
    "op5_sentencepiece_viterbi": op5_sentencepiece_viterbi,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_semi_markov_pii": op7_semi_markov_pii,
    "op8_distribution_divergence": op8_distribution_divergence,
    "op9_zstd_novelty": op9_zstd_novelty,
    "op10_difference_cover": op10_difference_cover,
    "op11_angular_negatives": op11_angular_negatives,
    "op12_hybrid_search": op12_hybrid_search,
    "op13_minimum_slack_packing": op13_minimum_slack_packing,
}
ORACLES: dict[str, str] = {
    "op2_benchmark_ngrams": decontaminate.oracle_sql(),
    "op3_warc_derivatives": warc.oracle_sql(),
    "op8_distribution_divergence": quality.oracle_sql(),
    "op10_difference_cover": substrings.oracle_sql(),
    "op11_angular_negatives": negatives.oracle_sql(),
    "op12_hybrid_search": search.oracle_sql(),
}

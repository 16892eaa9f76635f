"""The corpus pipeline: quality rules, near-duplicate join, decontamination, secret scans and SentencePiece ids, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The first four return the columns of ``documents``: rejected,
repeated and contaminated documents go, secrets are masked. The last adds the ids of each text.

Every stage takes texts whole, however long. An empty table stays one. Columns beside doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import decontaminate, jaccard, pieces, quality, secrets
from pagewarden.llm.common import materialize
from pagewarden.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. A null or empty text has too few words and goes; an unknown or null language is judged by the base rules alone; repeated rows are judged alike."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class (a null one only where no other is there; of rows with one doc_id the one with the least hash). Null and empty texts are one class, and of repeated rows one stays."""
    return jaccard.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. A null or empty text has none and stays; repeated rows are treated alike, and without benchmark items all stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and ``n_chars`` set anew where there is a text. A null text stays null, an empty one empty; of overlapping secrets the whole stretch is masked, in repeated rows alike."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their texts. A null or empty text has no ids; of equally good segmentations the one whose last piece is shortest is taken; repeated rows are encoded alike."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_masking),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: SQL has no Viterbi search; tests hold the result against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs

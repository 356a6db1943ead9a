"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, jaccard, language, pieces, secrets
from emberlog.llm.common import fresh, table, work_path

#: A text with less of its n-grams in any language's filter is no text of a known language.
MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: without letters, or with a score below ``MIN_SCORE``.

    The filters are learned from the documents' own language labels; a label that differs from the prediction is no
    reason to go.  Without any label nothing can be judged, and all stay."""
    filters = language.learn(docs)
    if not filters.languages:
        return docs
    pred, score = fresh(docs, "pred", "score")
    judged = language.identify(docs, filters, pred, score)
    return judged.filter((F.col(pred) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)).drop(pred, score)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return jaccard.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with secrets masked."""
    return secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    vocabulary = pieces.Vocabulary.load()
    both = pieces.encode(docs.select("doc_id", "text"), vocabulary, back="decoded")
    return both.select("doc_id", "text", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece),
]
#: Suffix arrays, filters of learned n-grams and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

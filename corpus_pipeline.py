"""A corpus pipeline of five text operators.

Each stage takes (spark, docs, sf_dir), works on every row it is given and
returns a DataFrame; its output is written as Parquet and read again as the next
stage's input.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import common, decontaminate, jaccard_join, line_dedup, pieces, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents the classifier accepts."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of all documents but the last that has them."""
    return line_dedup.rewrite_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text with merge-dropout, and a check that they decode
    to the text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.with_checked_pieces(docs, model, "__pieces")
    return coded.select(
        "doc_id", "lang", "source", F.col("__pieces.ids").alias("piece_ids"), F.size("__pieces.ids").cast("long").alias("n_pieces"),
        "__pieces.ids_crc32", "__pieces.decoded_sha256", "__pieces.lossless",
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: A boosted classifier cannot be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage{k}")
    return docs

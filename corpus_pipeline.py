"""A training corpus from ``documents``: filters, deduplication and encoding in stages.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.llm import decontaminate, jaccard, labelled, secrets, sentencepieces, toxicity
from marketpulse.llm.common import shared_folder, texts
from marketpulse.llm.registry import query, table

#: Neither learned filters nor the encoding can be expressed in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the lexicon from the labelled documents and drop what it rejects."""
    settings = toxicity.Settings()
    labels = table(spark, sf_dir, "labels")
    rows = labelled.sample(docs, labels, "toxic", 5, 0, settings.max_rows)
    return toxicity.drop_toxic(docs, toxicity.fit(rows, settings))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents keep the one with the smallest id.

    Near copies share 0.8 or more of their five-word shingles.
    """
    return jaccard.one_of_each_group(docs, settings=jaccard.Settings(width=5, num=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` follows."""
    out = secrets.redact(docs, secrets.learn_formats(texts(docs)))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text left, with begin and end."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    # Workers go on to other stages: a smaller codec than usual, which ends with its task.
    return sentencepieces.piece_codes(docs, model, with_ids=True, cache=100_000, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per document left."""
    folder = shared_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

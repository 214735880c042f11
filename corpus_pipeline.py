"""Documents made ready for training: toxic ones, near-duplicates and benchmark passages go, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from boxquery.llm import decontaminate, sentencepiece, similar, toxicity
from boxquery.llm.common import table
from boxquery.session import released, ship, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 1 scores below 0.7; it learns from the given documents and labels."""
    ship(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by SimHash at a similarity of 0.8 of five-word shingles."""
    ship(spark)
    return similar.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of the benchmark."""
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, score, ids, round_trip) of every document; a null text has null ids."""
    ship(spark)
    with open(MODEL, "rb") as file:
        model = file.read()
    found = sentencepiece.encoded(docs.select("doc_id", "text"), model, same_col="round_trip")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# Neither a trained classifier nor a Viterbi search can be said in SQL: tests/llm/test_pipeline.py stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs

"""A corpus pipeline over ``documents``: toxicity, exact dedup, near-dedup, decontamination, SentencePiece coding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next stage's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossgrid.llm import decontaminate, exact_dedup, near_dedup, pieces, toxicity
from crossgrid.llm.queries import tokenizer_path, training_rows
from crossgrid.session import Tables, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the model learns from labelled rows of ``docs``."""
    model = toxicity.train(docs, training_rows(Tables(spark, sf_dir).labels))
    return toxicity.score(docs, model, out="_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lies in benchmark windows go."""
    marked = decontaminate.contamination(docs, Tables(spark, sf_dir).benchmark, carry=True)
    return marked.filter("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text they decode to."""
    coded = pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_pieces", "n_byte_pieces", "piece_ids", "decoded", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL expresses neither the learned scores nor the piece search; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

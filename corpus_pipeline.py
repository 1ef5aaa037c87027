"""From documents to sampled training pieces, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelake.llm import block_naming, mixing, near_dups, segmentation, toxicity
from storelake.llm.queries import MODEL_FILE, table
from storelake.session import ship_package, written

#: The classifier, the hashed words and the Gumbel noise are not for SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject at their language's threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A to Z in lower case) the one with the largest id."""
    ship_package(spark)
    return block_naming.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest id."""
    ship_package(spark)
    return near_dups.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes of each document, in the order of the training."""
    ship_package(spark)
    return mixing.training_order(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text; copies of a document get the same ones."""
    ship_package(spark)
    return segmentation.sample_segmentations(docs, segmentation.load_pieces(MODEL_FILE))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_duplicates),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", segment),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

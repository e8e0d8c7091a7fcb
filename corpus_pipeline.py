"""A corpus from raw documents to packed training sequences.

STAGES: documents that the quality classifier rejects go; repeated windows of lines are cut; one
document of each group of near duplicates stays; secrets are masked; what is left is packed. All
stages but the last return the columns of `documents` (`n_chars` follows the text), and each works
on everything that the one before kept. The labels the classifier learns from are read from
`sf_dir`; its bounded sample comes from the stage's own input.

Nulls in any column, empty texts, repeated rows and empty tables pass through as the operators
define it; columns that the table has besides are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import classifier
from rollbook.llm.line_dedup import line_dedup
from rollbook.llm.near_dup import near_duplicates
from rollbook.llm.packing import packed
from rollbook.llm.queries import ACCEPTED, tokenizer_path
from rollbook.llm.secrets import redacted
from rollbook.session import materialize


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `docs` with n_chars, where there is one, of the present text."""
    return docs.select(*[
        F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (classifier.scored(docs, model, score_column="quality_score_")
            .where(F.col("quality_score_") >= ACCEPTED).select(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of lines that stand earlier in the corpus."""
    return _recounted(line_dedup(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by a mark."""
    return _recounted(redacted(docs), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_copies),
    ("secret scans", masked),
    ("best-fit packing", sequences),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

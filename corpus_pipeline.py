"""A corpus pipeline of four stages over the table of documents; part of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts.llm import common
from bytefacts.llm.packing import pack
from bytefacts.llm.pii import redact
from bytefacts.llm.quality import kept
from bytefacts.llm.simhash import first_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Each row is decided by its own text, so rows of one id may part, and null ids are scored too.

    Null and empty texts are kept, as is everything where no document is trusted; repeated rows share their fate; an empty table stays empty;
    columns come back as they are, whatever their names.
    """
    return kept(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: shingles of five words, similarity 0.8 or more.

    The row of the smallest id stays, one of a null id only where there is no other; rows are told apart by id and text; repeated
    rows are copies, as are all texts without words (null ones too); an empty table stays empty.
    """
    return first_of_each(docs, words=5, similarity=0.8)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars, where there is such a column, follows the new text.

    Null texts stay null (n_chars too), empty ones empty; rows, repeated ones too, and other columns stay as they are.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, as of pack: a null text is empty (one token), repeated rows are packed each time,
    null ids stay, columns besides id and text are left behind, an empty table gives no piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("packing", packing),
]

#: Model scores and fingerprints have no SQL form; tests hold each stage against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each earlier one is written to the shared folder and read again. Edge cases are those of the stages."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = common.fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)

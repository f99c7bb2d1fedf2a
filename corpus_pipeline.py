"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; a stage's
result is written as Parquet and read again before the next one.  All stages but the last return
the columns of documents.  Nulls, empty texts, repeated rows and empty tables pass as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import WHITE_SPACE, table
from quantloom.llm.decontaminate import remove_contaminated
from quantloom.llm.line_dedup import remove_repeated_lines
from quantloom.llm.near_dedup import one_of_each
from quantloom.llm.packing import pack_documents
from quantloom.llm.quality_model import keep_good
from quantloom.llm.queries import tokenizer_path
from quantloom.storage import discard, materialise, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject.

    A null or empty text is scored as one without words; rows of a repeated id are judged one by one.
    Without usable labels all documents have one score and stay or go together; no documents give none.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that had nothing else goes, n_chars follows the text.

    Null and empty texts, and texts without a repeated passage, stay as they are.  Of documents with one
    passage the smallest id keeps it, null ids come last, and rows of one id are one document.
    """
    done = remove_repeated_lines(docs)
    blank = F.length(F.translate("text", WHITE_SPACE, "")) == 0
    left = done.filter((F.col("n_removed_lines") == 0) | ~blank)
    n_chars = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Null and empty texts have fingerprint zero and are one group; rows without an id stay; of rows
    with one id and one fingerprint one stays.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and empty texts hold none, and null or empty items are nowhere."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; a null text is an empty one, of its end alone."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: A learned model, an iterative search and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch():  # a stage's own tables go once its result is written
            done = materialise(stage(spark, docs, sf_dir), result=True)
        discard(docs)
        docs = done
    return docs

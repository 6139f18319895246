"""A training corpus in four stages, each written as Parquet and read again by the next.

Documents without a language go, one of each group of near copies stays, long strings that come more than once are cut
out, and what is left is packed into sequences.

Each stage takes documents (doc_id, text, lang, ...) in any number of rows, none as well. All but the last return rows with
the same columns. Rows may share a doc_id or have none, and may repeat. What each stage does with such rows, with nulls
and with ties is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, packing, repeats, simhash
from ledgerloom.llm.queries import table, tokenizer_file
from ledgerloom.llm.scratch import Scratch, released


MOST_LANGUAGES = 512


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose text is null, has no letter or no clear language go.

    Clear is a posterior of at least a half. Null languages teach nothing, and without any no document stays. Repeated rows
    teach and stay each.
    """
    return langid.with_language(docs, most=MOST_LANGUAGES)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: sets of five-word shingles whose exact similarity is 0.8 or more link, the smallest doc_id of each group stays.

    Null, empty and blank texts have the same, empty, set. Of rows with the doc_id that stays all stay, and so do rows
    without one.
    """
    return simhash.near_copies_out(docs, words=5).select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of strings of 200 bytes, which nearly all runs of over 50 words reach, that come more than once go.

    All places of a string are cut, none is kept; n_chars, where it is there, follows. Null texts become ''. All other columns
    stay as they are.
    """
    own = {c: f"{c} of the input" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text") if c in docs.columns}
    left = repeats.without_repeats(docs.withColumnsRenamed(own), length=200).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast("long"))
    return left.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1,024 tokens; a document of which nothing is left is the end id alone.

    Each row is packed, whether or not its doc_id is there or comes again. Columns other than doc_id and text are dropped.
    """
    return packing.pack_documents(docs, tokenizer_file(), capacity=1024, end_id=2)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeated_strings), ("best-fit packing", packing_plan)]

#: Hashing, suffixes and byte-pair encoding have no SQL; tests/llm/test_pipeline.py compares each stage and run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage writes for itself goes when its result has been written.

    The results of stages, and what the last one is read from, belong to the caller, who may run this inside released().
    """
    docs, results = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        with released(spark):
            docs = results.keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

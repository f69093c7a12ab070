"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.llm import jaccard, jobs, langid, lines, mixing, packing
from weftlens.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown (no letters, null text) or has under half of the text.

    The model is fitted on the labelled rows.  Repeated rows stay or go together; a null id, source or lang doesn't matter; other
    columns stay as they are, whatever their names.  No rows, or none with a label: no rows.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines, and documents of which nothing else is left; n_chars, where there is one, becomes the length left.

    Null and empty texts stay.  Of equal lines the one with the smallest doc_id stays (null last), in it the first.  Rows equal in doc_id
    and text count as one document and come out equal.  Other columns stay as they are.  No rows: no rows.
    """
    counted = next((c for c in docs.columns if c.lower() == "n_chars"), None)
    removed = jobs.fresh(docs.columns, "removed")
    out = lines.dedup_lines(docs.drop(*(c for c in docs.columns if c.lower() in ("n_lines", "n_removed")))).withColumnRenamed("n_removed", removed)
    left = out.where(~((F.col(removed) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    if counted:
        left = left.withColumn(counted, F.length("text").cast(docs.schema[counted].dataType))
    return left.select(*[c for c in docs.columns if c in left.columns])


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a Jaccard similarity of 0.8 or more on five-word shingles: the one with the smallest doc_id.

    Rows without words all stay, and so do rows with a null doc_id; repeated rows stay once.  Columns stay as they are.  No rows: no rows.
    """
    return jaccard.keep_one(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document that the mix of sources takes.

    A null source is a source of its own; rows without words are never taken; repeated rows are rows of their own.  A partial
    copy holds its first words.  Other columns stay as they are.  No rows: no rows.
    """
    return mixing.copies(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 4096: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, and one token; repeated rows are packed each; a null doc_id gives rows too.  No rows: no rows.
    """
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, fingerprints and tokens can't be expressed in SQL; tests/llm/test_pipeline.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = jobs.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. What it returns is
written as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import bpe, byte_cnn, fm_index, jaccard_regions, sentence_spans
from shelfwise.llm.batches import renamed
from shelfwise.llm.registry import table
from shelfwise.sources.staging import stage

#: A document of known letters goes only where the network is hardly surer of a language than of none.
LEAST_SCORE = 0.3
#: Near copies share so much of their shingles of so many words; the query op7_jaccard_join has figures of its own.
NEAR_WORDS, NEAR = 5, Fraction(4, 5)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or no language ahead of the others."""
    predicted = byte_cnn.predict(docs, byte_cnn.fit(docs))
    kept = (F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return renamed(predicted.filter(kept), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links connect, the one with the smallest id; documents without words are no group."""
    return jaccard_regions.keep_one(docs, k=NEAR_WORDS, threshold=NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; a stored length (``n_chars``, if there is one) follows its text.

    Null and empty texts stay as they are; rows equal in id and text are one document; no row goes, and an empty table stays empty.
    """
    count = "removed_" + "_".join(docs.columns)  # no column of docs can have this name
    cut = sentence_spans.remove_repeats(docs).toDF(*docs.columns, count)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the contamination rule finds. Null and empty texts have no words and stay; each of repeated rows is judged alike."""
    return fm_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a proof that they decode to its text. A null text is the empty one and has no ids; repeated rows stay."""
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The first stage's network and the last one's merges have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

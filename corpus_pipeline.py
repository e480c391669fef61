"""A training-data pipeline: language ID, toxicity, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``, and any further ones. Between
stages the rows are written as Parquet into the shared folder and read again; a stage's table is
deleted when the next one is written.

Every stage gives an empty result for an empty table, and takes whole texts, however long. A row
repeated in every column gets the answer of its like, except where copies are what a stage is about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, langid, mixing, simhash, toxicity
from seqloom.llm.common import read_table, remove, scratch_path
from seqloom.llm.queries import tokenizer_path

#: Below this mean probability the language is not told.
LANGUAGE_SCORE = 0.4
TOXIC_SCORE = 0.7
#: Near-duplicates share this much (Jaccard) of their sets of shingles of this many words.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty texts among them, or whose language cannot be told, go.

    The network learns from the stage's own input; a null ``lang`` teaches nothing. Ids may be null.
    """
    told = langid.predict(docs, langid.fit(docs))
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select("rec.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a calibrated probability of 0.7 or more go.

    Null texts count as empty. Ids without a label, or null, are scored like the others; without any
    labels nothing is learned and everything stays.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_SCORE).select("rec.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are 0.8 alike or more, pair by pair.

    It is the one of the smallest doc_id, any one of rows that tie in it. Texts without words, null
    or empty, have equal sets and are one group; a null id stays only where its group has no other.
    """
    return simhash.keep_one(docs, width=SHINGLE_WORDS, similarity=SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, at most twice.

    A null source is a source, the last in order. Null and empty texts have no words and stay as
    often as all documents of their source do for certain. Rows that share an id are drawn one by one.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row per input row; a null text is an empty one."""
    coded = bpe.encode_decode(docs, tokenizer_path(), ["doc_id", "lang", "source"])
    return coded.select("rec.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mixed), ("tokens", tokens)]

#: SQL has no networks or trees; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

"""The corpus pipeline: language, repeated lines, near duplicates, repeated passages, packing.

Each stage takes all that the stage before it kept. All but the last return the columns of ``documents``; a text that a
stage shortens gets its new ``n_chars``, and a document that a stage leaves without a line or a word goes. Null texts go with the
first stage, which finds no letter in them. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import jaccard, langid, line_dedup, substring_dedup
from tagloom.llm.common import materialize
from tagloom.llm.queries import MIN_CHARS, MIN_LINES, language_model, packed_documents

#: A document stays if one language has at least this share of its bytes, on the mean of their probabilities.
LEAST_SCORE = 0.35


def _shortened(docs: DataFrame, cleaned: DataFrame, left: Column) -> DataFrame:
    """The columns of ``docs``, from rows whose text a stage has shortened; those with nothing left go."""
    sized = cleaned.filter(left).select(*docs.columns)
    return sized.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else sized


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language; a missing ``lang`` is filled in."""
    told = docs.withColumn("_told", langid.predict_column(F.col("text"), spark, language_model(docs)))
    kept = told.filter((F.col("_told.lang_pred") != "und") & (F.col("_told.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "_told.lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs."""
    cleaned = line_dedup.deduplicate(docs, min_lines=MIN_LINES, min_chars=MIN_CHARS)
    return _shortened(docs, cleaned, F.col("n_removed") < F.col("n_lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: that of least id."""
    return jaccard.one_of_each_class(docs, width=5, threshold=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 13-word windows that a document of smaller id has too."""
    return _shortened(docs, substring_dedup.deduplicate(docs, window=13), F.col("n_removed") < F.col("n_words"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packed_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: Language identification is a trained network: no SQL gives its rows. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Writers. Outputs are immutable folders; a rewrite is a new version under another name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def jsonl(df: DataFrame, path: str, rows_a_file: int = 0) -> None:
    """JSON lines; letters beyond ASCII stay as they are. ``rows_a_file`` cuts files after so many rows."""
    writer = df.write.mode("errorifexists")
    (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).json(path)


def projected_jsonl(df: DataFrame, path: str, columns: list[str] = ("audio_filepath", "text", "duration")) -> None:
    """A fixed projection; a missing duration is 0."""
    jsonl(df.select(*[F.coalesce(c, F.lit(0.0)).alias(c) if c == "duration" else F.col(c) for c in columns]), path)


def routed(df: DataFrame, path: str, route: str = "route") -> None:
    """A folder a route."""
    df.write.mode("errorifexists").partitionBy(route).json(path)


def valid_and_invalid(df: DataFrame, path: str, reason: str = "reason") -> None:
    """Rows without and with a reason in folders of their own, from one pass over the input."""
    routed(df.withColumn("route", F.when(F.col(reason).isNull(), "valid").otherwise("invalid")), path)


def by_family(df: DataFrame, path: str, family: str = "lang_family") -> None:
    df.write.mode("errorifexists").partitionBy(family).parquet(path)


def parquet(df: DataFrame, path: str, rows_a_file: int = 50_000) -> None:
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file).parquet(path)


def csv_and_jsonl(df: DataFrame, path: str) -> None:
    """The same rows twice; nested columns are JSON in the CSV."""
    flat = df.select(*[F.to_json(c).alias(c) if not isinstance(df.schema[c].dataType, StringType) and df.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c) for c in df.columns])
    flat.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    df.write.mode("errorifexists").json(f"{path}/jsonl")


def rewritten_if_changed(df: DataFrame, changed: str, path: str, version: str) -> bool:
    """A new version folder, only if a row is marked as changed; the old one stays as the backup."""
    if df.filter(F.col(changed)).isEmpty():
        return False
    df.drop(changed).write.mode("errorifexists").json(f"{path}/{version}")
    return True


def vocabulary_file(tokens: DataFrame, path: str, token: str = "token", number: str = "id") -> None:
    """One text file whose line numbers are the ids."""
    tokens.repartition(1).sortWithinPartitions(number).select(token).write.mode("errorifexists").text(path)


def summary(df: DataFrame, path: str) -> None:
    """A small aggregate as JSON."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def families(spark: SparkSession, metadata: dict, path: str) -> None:
    """Language -> tokenizer and shared tokens, as one JSON text."""
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def tables(frames: dict[str, DataFrame], path: str) -> None:
    """A report of several tables, each a folder."""
    for name, frame in frames.items():
        frame.write.mode("errorifexists").parquet(f"{path}/{name}")

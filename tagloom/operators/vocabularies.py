"""Algebra of vocabularies: tables (id, token), one or many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.relations import numbered


def aggregated(tokens: DataFrame, lang: str = "lang", local: str = "local_id", token: str = "token") -> DataFrame:
    """(id, token, default_lang, langs) of several vocabularies: one entry a token, in order of (language, local id)."""
    firsts = tokens.groupBy(token).agg(F.min(F.struct(lang, local)).alias("_f"), F.min(lang).alias("default_lang"), F.array_sort(F.collect_set(lang)).alias("langs"))
    ordered = firsts.select(token, "default_lang", "langs", F.col("_f")[lang].alias("_lang"), F.col("_f")[local].alias("_local"))
    return numbered(ordered, ["_lang", "_local", token]).select("id", token, "default_lang", "langs")


def local_to_global(tokens: DataFrame, vocabulary: DataFrame, lang: str = "lang", local: str = "local_id", token: str = "token") -> DataFrame:
    """(lang, local id, id) by token."""
    return tokens.join(vocabulary.select("id", token), token).select(lang, local, "id")


def restricted(vocabulary: DataFrame, families: list[str], family: str = "family", token: str = "token") -> DataFrame:
    """The tokens that one of the families has, renumbered without gaps in their order."""
    kept = vocabulary.filter(F.col(family).isin(families)).groupBy(token).agg(F.min("id").alias("_old"))
    return numbered(kept, ["_old"]).select("id", token)


def missing(wanted: DataFrame, have: DataFrame, key: str = "lang") -> DataFrame:
    """Wanted values that are not there, once each."""
    return wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def grown(have: DataFrame, batches: DataFrame, target: int, token: str = "token", batch: str = "batch") -> DataFrame:
    """(token, first batch) of a set that takes whole batches in order until it has ``target`` distinct tokens."""
    seen = have.select(token, F.lit(-1).cast("long").alias("_b")).unionByName(batches.select(token, F.col(batch).cast("long").alias("_b")))
    firsts = seen.groupBy(token).agg(F.min("_b").alias("first_batch"))
    from pyspark.sql.window import Window as W

    # a row a batch
    sizes = firsts.groupBy("first_batch").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("first_batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return firsts.join(before.filter(F.col("_before") < target).select("first_batch"), "first_batch").select(token, "first_batch")


def done_before(output: DataFrame | None, expected: int) -> bool:
    """Whether an output already has the rows expected, so that a job can be passed over."""
    return output is not None and output.count() >= expected

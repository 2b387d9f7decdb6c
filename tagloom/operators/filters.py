"""Filters with reasons, and routes. A reason column keeps what a filter drops countable; null means kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import lexicon as lx
from tagloom.functions import tags
from tagloom.functions.metadata import seconds
from tagloom.functions.text import any_of, words


def first_reason(ladder: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; a null condition does not."""
    out = None
    for name, condition in ladder:
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, name) if out is None else out.when(held, name)
    return out


def in_band(duration: Column, low: float | None, high: float | None) -> Column:
    """Whether a duration lies in a band, ends included; a missing end is open."""
    ok = duration.isNotNull()
    if low is not None:
        ok = ok & (duration >= low)
    return ok & (duration <= high) if high is not None else ok


def merge_reason(duration: Column, text: Column, path: Column, low: float = 0.3, high: float = 20.0) -> Column:
    """duration, empty_text or bad_audio; a missing duration counts as 0."""
    return first_reason([
        ("duration", ~in_band(F.coalesce(duration, F.lit(0.0)), low, high)),
        ("empty_text", F.btrim(F.coalesce(text, F.lit(""))) == ""),
        ("bad_audio", F.coalesce(path, F.lit("")) == ""),
    ])


def annotator_reason(duration: Column, path: Column, tagged: Column, low: float = 0.5, high: float = 30.0) -> Column:
    """bad_duration (a string that is no number), duration, no_audio (missing or NA), no_text."""
    s = seconds(F.coalesce(duration, F.lit("0")))
    return first_reason([("bad_duration", s.isNull()), ("duration", ~in_band(s, low, high)), ("no_audio", F.coalesce(path, F.lit("NA")).isin("NA", "")), ("no_text", F.coalesce(tagged, F.lit("")) == "")])


def missing_keys(raw: Column, keys: list[str]) -> Column:
    """missing:<key> of the first key that a JSON object does not have (a null value is there); malformed if it is none."""
    parsed = F.try_parse_json(raw)
    have = F.json_object_keys(raw)
    return first_reason([("malformed", parsed.isNull() | have.isNull()), *[(f"missing:{k}", ~F.array_contains(have, k)) for k in keys]])


def unknown_tags(text: Column, known: Column) -> Column:
    """ARRAY of the tags of a text that a vocabulary does not have."""
    return F.array_except(tags.tags(text), known)


def language_route(lang: Column, codes: dict[str, str], families: list[str] = lx.LEGACY_FAMILY_NAMES, fallback: str = "INDIAN_LOW_RESOURCE") -> Column:
    """STRUCT<route, lang_family>: kept by code, by family name, or with the fallback for null; else removed."""
    from tagloom.functions.text import lookup

    known = lookup(lang, codes)
    family = F.when(known.isNotNull(), known).when(lang.isin(families), lang).when(lang.isNull(), fallback)
    return F.struct(F.when(family.isNotNull(), "kept").otherwise("removed").alias("route"), family.alias("lang_family"))


def alignable(clean: Column, target: Column, factor: float = 2.0, longest: int | None = None) -> Column:
    """Whether a target of labels can be aligned with a text of so many characters: not empty, not too long, room enough."""
    ok = (F.length(clean) > 0) & (F.length(target) > 0) & (F.length(clean) * factor >= F.length(target))
    return F.coalesce(ok & (F.length(clean) <= longest) if longest else ok, F.lit(False))


def single_label(labels: Column, excluded: list[str]) -> Column:
    return (F.size(labels) == 1) & ~F.try_element_at(labels, F.lit(1)).isin(excluded)


def language_of_source(source: Column, table: dict[str, str]) -> Column:
    """Language by source name, else the last part behind an underscore."""
    from tagloom.functions.text import lookup

    return lookup(source, table, F.when(F.contains(source, F.lit("_")), F.substring_index(source, "_", -1)))


def one_of(label: Column, allowed: list[str]) -> Column:
    """Whether a label is one of a set; a missing one is not."""
    return F.coalesce(label.isin(allowed), F.lit(False))


def says_something(text: Column) -> Column:
    """Whether a text has a word that is no tag."""
    return F.coalesce(F.exists(words(text), lambda w: ~tags.is_tag(w)), F.lit(False))


def all_tags_in(text: Column, frequent: Column) -> Column:
    return F.forall(tags.tags(text), lambda t: F.array_contains(frequent, t))


def shorter_than(text: Column, n: int = 100) -> Column:
    return F.size(words(text)) < n


def needs_intent(text: Column) -> Column:
    return text.rlike("\\b(?:AGE|GENDER|EMOTION)_\\S+") & ~text.rlike("\\bINTENT_\\S+")


def already_tagged(text: Column) -> Column:
    return text.rlike("\\bAGE_\\S+") & text.rlike("\\bGENDER_\\S+") & text.rlike("\\bEMOTION_\\S+")


def capped(text: Column, n: int = 500) -> Column:
    """The first n characters; "..." for nothing."""
    return F.when(F.btrim(F.coalesce(text, F.lit(""))) == "", "...").otherwise(F.left(text, F.lit(n)))


def has_sentence_tag(text: Column) -> Column:
    return text.rlike(f"\\b{any_of(lx.SENTENCE_PREFIXES)}\\S+")


def split_by_reason(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a frame with a reason column."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def unprocessed(df: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Rows whose key a progress table does not have; null keys are unprocessed."""
    return df.join(progress.select(key).distinct(), key, "left_anti")


def with_rare_words(words_df: DataFrame, counts: DataFrame, word: str = "word", count: str = "n", below: int = 5, shortest: int = 3) -> DataFrame:
    """Words that a frequency table has, but fewer than ``below`` times; once whatever their case."""
    rare = counts.filter(F.col(count) < below).select(F.lower(word).alias("_w")).distinct()
    keyed = words_df.withColumn("_w", F.lower(word)).filter(F.length("_w") >= shortest).join(rare, "_w", "left_semi")
    return keyed.groupBy("_w").agg(F.min(word).alias(word)).drop("_w")

"""Counts over manifests: totals, distributions, tag histograms, vocabularies.

A text is split once and its tags exploded; all counters of one grouping come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions import lexicon as lx
from tagloom.functions import tags
from tagloom.functions.text import any_of, words


def totals(df: DataFrame, text: str = "text", duration: str = "duration") -> DataFrame:
    """One row: samples, hours, mean duration, and samples with and occurrences of each tag family."""
    families = ["AGE", "GENDER", "EMOTION", "INTENT", "ENTITY"]
    hits = df.withColumn("_w", words(F.col(text)))
    metrics = [F.count("*").alias("samples"), F.round(F.sum(duration) / 3600, 4).alias("hours"), F.round(F.avg(duration), 4).alias("mean_duration")]
    begins = lambda family: lambda w: F.startswith(w, F.lit(f"{family}_"))
    for f in families:
        n = F.size(F.filter("_w", begins(f)))
        metrics += [F.count_if(n > 0).alias(f"samples_with_{f.lower()}"), F.sum(n).cast("long").alias(f"{f.lower()}_tags")]
    return hits.agg(*metrics)


def shares(df: DataFrame, key: str | Column, name: str = "value") -> DataFrame:
    """Rows of each value and their percentage, to two places."""
    counts = df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", F.round(100 * F.col("n") / F.col("_all"), 2).alias("percent"))


def by_dataset(df: DataFrame, dataset: str, duration: str, lang: str, family: str, order: str) -> DataFrame:
    """Samples, hours, last family in order and the sorted languages of each dataset."""
    return df.groupBy(dataset).agg(
        F.count("*").alias("samples"),
        F.round(F.sum(duration) / 3600, 4).alias("hours"),
        F.max_by(family, order).alias("last_family"),
        F.array_join(F.array_sort(F.collect_set(lang)), ",").alias("langs"),
    )


def tag_counts(df: DataFrame, text: str = "text", normalized: bool = True) -> DataFrame:
    """Occurrences of each tag."""
    source = tags.normalize(F.col(text)) if normalized else F.col(text)
    return df.select(F.explode(tags.tags(source)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_histogram(df: DataFrame, text: str = "text", families: list[str] = ("AGE", "GENDER", "EMOTION", "INTENT", "ENTITY", "DIALECT")) -> DataFrame:
    """Occurrences of each value of each family."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"\\b({'|'.join(families)})_(\\S+)"), F.lit(0))
    split = df.select(F.explode(found).alias("t")).select(F.substring_index("t", "_", 1).alias("family"), F.regexp_replace("t", "^[A-Z]+_", "").alias("value"))
    return split.groupBy("family", "value").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, *ties: str, n: str = "n") -> DataFrame:
    """The k greatest counts; ties by the columns named."""
    return counts.orderBy(F.desc(n), *ties).limit(k)


def special_tokens(df: DataFrame, text: str = "text", prefixes: list[str] | None = None) -> DataFrame:
    """(rank, token, n) of upper-cased words without outer punctuation that begin with a prefix (without prefixes: that have a
    cased letter and an underscore). By count, ties by token; END is last, whether it occurs or not."""
    token = F.upper(F.btrim(F.col("w"), F.lit(".,;:!?\"'()[]{}")))
    words_df = df.select(F.explode(words(F.col(text))).alias("w")).select(token.alias("token"))
    wanted = F.col("token").rlike(f"^{any_of([p.upper() for p in prefixes])}") if prefixes else F.col("token").rlike("_") & (F.lower("token") != F.col("token"))
    counts = words_df.filter(wanted & (F.col("token") != "")).groupBy("token").agg(F.count("*").alias("n"))
    end = df.sparkSession.createDataFrame([("END", 0)], "token string, n long")
    all_counts = counts.unionByName(end).groupBy("token").agg(F.sum("n").alias("n"))
    # a vocabulary of tags: small by nature
    order = W.orderBy(F.col("token") == "END", F.desc("n"), "token")
    return all_counts.select((F.row_number().over(order) - 1).alias("rank"), "token", "n")


def languages(df: DataFrame, *fields: str) -> DataFrame:
    """Distinct upper-cased languages from the first field that has one."""
    return df.select(F.upper(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])).alias("lang")).filter("lang is not null").distinct()


def piece_vocabulary(df: DataFrame, text: str = "text", min_count: int = 5, most: int = 10_000) -> DataFrame:
    """(piece, n) of the pieces of tags seen ``min_count`` times, weighted by their tags; by count, then piece; the first ``most``."""
    pieces = tag_counts(df, text).filter(F.col("n") >= min_count).select(F.explode(tags.decompose(F.col("tag"))).alias("piece"), "n")
    return pieces.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)


def character_vocabulary(df: DataFrame, text: str = "text", min_count: int = 10) -> DataFrame:
    """(letter, n) of the characters of clean texts, the blanks between words among them.

    Words are counted first: only different words are taken apart.
    """
    clean = F.filter(words(tags.normalize(F.col(text))), lambda w: ~tags.is_tag(w))
    # the words of a text, and one row for its blanks
    rows = df.select(clean.alias("w")).select(F.explode(F.concat(F.transform("w", lambda w: F.struct(w.alias("w"), F.lit(1).cast("long").alias("n"))), F.array(F.struct(F.lit(" ").alias("w"), F.greatest(F.size("w") - 1, F.lit(0)).cast("long").alias("n"))))).alias("x"))
    counted = rows.groupBy("x.w").agg(F.sum("x.n").alias("n"))
    letters = counted.select(F.explode(F.filter(F.split("w", ""), lambda c: c != "")).alias("letter"), "n")
    return letters.groupBy("letter").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def new_tokens(df: DataFrame, vocabulary: DataFrame, text: str = "text", min_count: int = 10, prefixes: list[str] = lx.NEW_TOKEN_PREFIXES) -> DataFrame:
    """(token, n) of tags that a vocabulary does not have, with or without its word mark."""
    pattern = "^[A-Z][A-Z0-9_]*_[A-Z0-9_<>+.]*$|^END$"
    found = df.select(F.explode(words(F.col(text))).alias("token")).filter(F.col("token").rlike(pattern))
    known = vocabulary.select(F.explode(F.array("token", F.ltrim("token", F.lit("▁")))).alias("token")).distinct()
    counts = found.groupBy("token").agg(F.count("*").alias("n")).filter((F.col("n") >= min_count) & F.col("token").rlike(f"^{any_of(prefixes)}"))
    return counts.join(known, "token", "left_anti")


def prefix_rollup(counts: DataFrame) -> DataFrame:
    """Tag counts summed by what stands before the first underscore."""
    return counts.groupBy(F.substring_index("tag", "_", 1).alias("prefix")).agg(F.sum("n").alias("n"))


def frequent_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes with ``least`` rows or more; the classes are joined back after pre-aggregation."""
    keep = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return df.join(keep, label)


def family_weights(df: DataFrame, family: str, temperature: float = 0.2) -> DataFrame:
    """(family, n, probability, inverse): counts raised to 1/temperature and normalized, and N / (K n)."""
    counts = df.groupBy(family).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    powered = counts.crossJoin(F.broadcast(total)).withColumn("_p", F.pow(F.col("n") / F.col("_all"), F.lit(1 / temperature)))
    # a row a family
    return powered.select(family, "n", (F.col("_p") / F.sum("_p").over(W.partitionBy(F.lit(1)))).alias("probability"), (F.col("_all") / (F.col("_k") * F.col("n"))).alias("inverse"))


def keyphrase_weight(text: Column, factor: float = 1.0) -> Column:
    """1 and ``factor`` for every entity tag and END."""
    return 1 + factor * F.size(F.filter(words(text), lambda w: F.startswith(w, F.lit("ENTITY_")) | (w == "END")))


def change_counts(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """(change, n): how many rows each named condition holds for, in one pass."""
    flags = df.agg(*[F.count_if(c).alias(name) for name, c in changes.items()])
    return flags.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, changes)), F.array(*[F.col(f"`{n}`") for n in changes]))).alias("change", "n"))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def deduplicated_vocabulary(tokens: DataFrame, lang: str = "lang", position: str = "position", token: str = "token") -> DataFrame:
    """(token, lang, position, langs): first occurrence by (language, position), the least language, all languages."""
    return tokens.groupBy(token).agg(F.min(F.struct(lang, position)).alias("_f"), F.array_join(F.array_sort(F.collect_set(lang)), ",").alias("langs")).select(token, F.col("_f")[lang].alias(lang), F.col("_f")[position].alias(position), "langs")


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The commonest value of each key; of equals the first seen."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value), F.max("_n").alias("n"))


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """(label, id): sorted distinct labels from 0 (a row a class)."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(W.orderBy(label)) - 1).alias("id"))


def tag_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct alphanumeric parts of tags of two letters or more."""
    parts = F.flatten(F.transform(tags.tags(F.col(text)), lambda t: F.split(t, "_")))
    return df.select(F.explode(parts).alias("part")).filter(F.col("part").rlike("^[A-Za-z0-9]{2,}$")).distinct()


def encoded(text: Column, ids: Column, length: int, pad: int = 0, unknown: int = 1) -> Column:
    """Lower-cased letters as ids of a MAP, cut and padded to a length."""
    letters = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")
    found = F.transform(letters, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(unknown)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(pad), length)), 1, length)


def examples(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("row", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("row") <= k)


def first_seen(df: DataFrame, text: str, order: str) -> DataFrame:
    """(token, first): distinct keywords by first occurrence; ties within a row by place."""
    seen = df.select(order, F.posexplode(tags.keywords(F.col(text))).alias("place", "token"))
    return seen.groupBy("token").agg(F.min(F.struct(order, "place")).alias("first")).select("token", F.col("first")[order].alias(order), F.col("first.place").alias("place"))


def ids_to_text(ids: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, place, id) rows as texts: tokens in order, ▁ as a blank; ids without a token are passed over."""
    joined = ids.join(vocabulary, "id")
    ordered = F.array_sort(F.collect_list(F.struct("place", "token")))
    return joined.groupBy(key).agg(F.btrim(F.replace(F.array_join(F.transform(ordered, lambda x: x["token"]), ""), F.lit("▁"), F.lit(" "))).alias("text"))

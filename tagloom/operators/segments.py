"""Turns and segments: islands of roles, pairs of turns, speaker splits, chunks, voice activity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.functions.text import words


def islands(df: DataFrame, group: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows within groups: a new one at each row where ``starts`` holds. Rows before the first are 0."""
    window = W.partitionBy(*group).orderBy(order)
    return df.withColumn(name, F.sum(starts.cast("int")).over(window.rowsBetween(W.unboundedPreceding, 0)))


def role_segments(df: DataFrame, group: str, order: str, role: str, text: str) -> DataFrame:
    """Neighbouring turns of one role as one segment: (group, island, role, first, last, turns, text)."""
    window = W.partitionBy(group).orderBy(order)
    changed = F.coalesce(F.col(role) != F.lag(role).over(window), F.lit(True))
    numbered = islands(df, [group], order, changed)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return numbered.groupBy(group, "island").agg(F.first(role).alias(role), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("turns"), joined.alias("text"))


def marked_segments(df: DataFrame, group: str, order: str, token: str, start: str, duration: str, roles: dict[str, str]) -> DataFrame:
    """Word timings with role markers (tokens such as "D:") as segments: role, start of the marker, end of the last word, text.

    The last segment is kept too; words before the first marker belong to none.
    """
    role = None
    for marker, name in roles.items():
        role = F.when(F.col(token) == marker, name) if role is None else role.when(F.col(token) == marker, name)
    numbered = islands(df.withColumn("_role", role), [group], order, F.col("_role").isNotNull()).filter("island > 0")
    spoken = F.filter(F.array_sort(F.collect_list(F.struct(order, "_role", token))), lambda x: x["_role"].isNull())
    return numbered.groupBy(group, "island").agg(
        F.max("_role").alias("role"), F.min(start).alias("start"), F.max(F.when(F.col("_role").isNull(), F.col(start) + F.col(duration))).alias("end"),
        F.array_join(F.transform(spoken, lambda x: x[token]), " ").alias("text"),
    ).filter("text <> ''")


def next_turns(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Each turn beside the next of its group, as next_<column>; the last has none and goes."""
    window = W.partitionBy(group).orderBy(order)
    return df.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns} | {"_next": F.lead(order).over(window)}).filter("_next is not null").drop("_next")


def speaker_changes(df: DataFrame, group: str, order: str, speaker: str) -> DataFrame:
    """``changed``: whether the speaker is another than in the row before; false at the first."""
    return df.withColumn("changed", F.coalesce(F.col(speaker) != F.lag(speaker).over(W.partitionBy(group).orderBy(order)), F.lit(False)))


def ends_from_starts(df: DataFrame, group: str, start: str, whole: Column | None = None) -> DataFrame:
    """``end``: the next start; of the last row the whole length, if given."""
    end = F.lead(start).over(W.partitionBy(group).orderBy(start))
    return df.withColumn("end", F.coalesce(end, whole) if whole is not None else end)


def split_at_changes(df: DataFrame, text: str, changes: str, duration: str, offset: Column | None = None, least: float = 0.3) -> DataFrame:
    """Segments between speaker changes (word places), times in proportion to words: piece, piece_text, piece_offset, piece_duration.

    Places outside the text are passed over, fractions cut. Pieces under ``least`` seconds go; rows without any piece left,
    or without changes, are one piece, themselves.
    """
    spoken, n = words(F.col(text)), F.size(words(F.col(text)))
    at = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(changes, F.array().cast("array<double>")), lambda c: c.cast("int")), lambda c: (c > 0) & (c < n))))
    bounds = F.concat(F.array(F.lit(0)), at, F.array(n))
    share = lambda x: x / F.greatest(n, F.lit(1))
    base = offset if offset is not None else F.lit(0.0)
    made = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(bounds) - 1), lambda i: i < F.size(bounds) - 1),
        lambda i: F.struct(
            i.alias("piece"), F.array_join(F.slice(spoken, F.get(bounds, i) + 1, F.get(bounds, i + 1) - F.get(bounds, i)), " ").alias("piece_text"),
            F.bround(base + share(F.get(bounds, i)) * F.col(duration), 3).alias("piece_offset"), (share(F.get(bounds, i + 1)) - share(F.get(bounds, i))).alias("_part"),
        ),
    )
    timed = F.transform(made, lambda x: F.struct(x["piece"], x["piece_text"], x["piece_offset"], F.bround(x["_part"] * F.col(duration), 3).alias("piece_duration"), (x["_part"] * F.col(duration)).alias("_exact")))
    kept = F.filter(timed, lambda x: (x["_exact"] >= least) & (x["piece_text"] != ""))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col(text).alias("piece_text"), base.alias("piece_offset"), F.col(duration).alias("piece_duration"), F.col(duration).alias("_exact")))
    pieces = F.when((n == 0) | (F.size(at) == 0) | (F.size(kept) == 0), whole).otherwise(kept)
    return df.withColumn("_p", F.explode(pieces)).select(*df.columns, "_p.piece", "_p.piece_text", "_p.piece_offset", "_p.piece_duration")


def trimmed(text: Column, duration: Column, longest: float) -> Column:
    """STRUCT<text, duration>: words in proportion to the longest duration, one at least."""
    spoken = words(text)
    keep = F.greatest(F.floor(F.size(spoken) * F.least(longest / duration, F.lit(1.0))), F.lit(1)).cast("int")
    return F.struct(F.array_join(F.slice(spoken, F.lit(1), keep), " ").alias("text"), F.least(duration, F.lit(longest)).alias("duration"))


def time_chunks(df: DataFrame, duration: str, length: float, least: float = 1.0) -> DataFrame:
    """(chunk, chunk_start, chunk_end) of fixed length; a last one under ``least`` seconds goes."""
    n = F.ceil(F.col(duration) / length).cast("int")
    chunk = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)).alias("chunk")
    cut = df.select("*", chunk).withColumns({"chunk_start": F.col("chunk") * length, "chunk_end": F.least((F.col("chunk") + 1) * length, F.col(duration))})
    return cut.filter(F.col("chunk_end") - F.col("chunk_start") >= least)


def named_segments(df: DataFrame, base: Column, times: str) -> DataFrame:
    """Rows of ARRAY<STRUCT<start, end>> with names base_segment_0001_<start>_<end>."""
    rows = df.select("*", F.posexplode(times).alias("_i", "_t")).select(*df.columns, F.col("_i").alias("segment"), "_t.start", "_t.end")
    return rows.withColumn("name", F.format_string("%s_segment_%04d_%s_%s", base, F.col("segment"), F.col("start").cast("string"), F.col("end").cast("string")))


def text_chunks(df: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """(chunk, chunk_text) of ``size`` characters, each beginning ``size - overlap`` behind the last; blank ones go."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.greatest(F.ceil((F.length(text) - overlap) / stride), F.when(F.length(text) > 0, 1).otherwise(0)).cast("int")
    chunk = F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: i < n)).alias("chunk")
    return df.select("*", chunk).withColumn("chunk_text", F.substring(F.col(text), F.col("chunk") * stride + 1, F.lit(size))).filter(F.btrim("chunk_text") != "")


def timed_spans(df: DataFrame, key: str, place: str, token: str, stride: float) -> DataFrame:
    """(key, label, start, end, phrase) of NER_ ... END spans in a stream of tokens at a fixed stride."""
    window = W.partitionBy(key).orderBy(place)
    opened = islands(df, [key], place, F.col(token).startswith("NER_"), "span").filter("span > 0")
    closing = F.min(F.when(F.col(token) == "END", F.col(place))).over(W.partitionBy(key, "span"))
    inside = opened.withColumn("_end", closing).filter((F.col("_end").isNotNull()) & (F.col(place) <= F.col("_end")))
    del window
    ordered = F.array_sort(F.collect_list(F.struct(place, token)))
    phrase = F.array_join(F.filter(F.transform(ordered, lambda x: x[token]), lambda t: (t != "END") & ~F.startswith(t, F.lit("NER_"))), " ")
    return inside.groupBy(key, "span").agg(F.min_by(token, place).alias("label"), (F.min(place) * stride).alias("start"), (F.max(place) * stride).alias("end"), phrase.alias("phrase")).drop("span")


def voiced_segments(df: DataFrame, group: str, order: str, voiced: str, ring: int = 10, share: float = 0.9) -> DataFrame:
    """(group, segment, first, last): frames between the points where ``share`` of the last ``ring`` are voiced, and unvoiced.

    One recording a task group: its frames are a sequence that has to be walked.
    """
    schema = f"{group} {df.schema[group].dataType.simpleString()}, segment int, first {df.schema[order].dataType.simpleString()}, last {df.schema[order].dataType.simpleString()}"

    def walk(key: tuple[object, ...], frames: pd.DataFrame) -> pd.DataFrame:
        rows, window, begun = [], [], None
        for at, on in frames.sort_values(order)[[order, voiced]].itertuples(index=False):
            window = [*window, (at, bool(on))][-ring:]
            if len(window) < ring:
                continue
            n = sum(v for _, v in window)
            if begun is None and n > share * ring:
                begun, window = window[0][0], []
            elif begun is not None and ring - n > share * ring:
                rows.append((key[0], len(rows), begun, at))
                begun, window = None, []
        if begun is not None:
            rows.append((key[0], len(rows), begun, frames[order].max()))
        return pd.DataFrame(rows, columns=[group, "segment", "first", "last"])

    return df.groupBy(group).applyInPandas(walk, schema)


def parity_pairs(df: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """Alternating token and tag lines, sentences ended by blank lines: (group, sentence, pair, token, tag)."""
    blank = F.btrim(F.col(line)) == ""
    window = W.partitionBy(group).orderBy(order)
    numbered = df.withColumn("sentence", F.sum(blank.cast("int")).over(window.rowsBetween(W.unboundedPreceding, 0))).filter(~blank)
    inside = numbered.withColumn("_i", F.row_number().over(W.partitionBy(group, "sentence").orderBy(order)) - 1)
    return inside.groupBy(group, "sentence", F.expr("_i div 2").alias("pair")).agg(F.max(F.when(F.col("_i") % 2 == 0, F.col(line))).alias("token"), F.max(F.when(F.col("_i") % 2 == 1, F.col(line))).alias("tag"))

"""Joins, deduplication and set operations, with the duplicate and miss rules of manifest tools.

Every join is an equi-join on a key; Spark chooses the strategy from sizes. Only a side whose size is given by the
format (a vocabulary of labels, a family table) is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def distinct_on(df: DataFrame, keys: list[str], order: list, keep_null_keys: bool = True) -> DataFrame:
    """The first row of each key by ``order`` (reverse the order for the last). Rows with a null key are all kept.

    Aggregated before the shuffle: a key of any number of rows costs one row a task. Of rows that tie the one of least
    hash stays (over the columns that are no maps).
    """
    columns = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    ranks = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], tie.alias("tie"))
    keyed = df if not keep_null_keys else df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    firsts = keyed.groupBy(*keys).agg(F.min_by(row, ranks).alias("_row"))
    out = firsts.select(*[F.col(k) if k in keys else F.col(f"_row.`{k}`").alias(k) for k in df.columns])
    return out.unionByName(df.filter(" or ".join(f"`{k}` is null" for k in keys))) if keep_null_keys else out


def first_unless_exempt(df: DataFrame, key: str, order: str, exempt: Column) -> DataFrame:
    """First row of each key, except that exempt rows always stay. An exempt row earlier in order still counts as seen.

    Rows that tie for the first all stay.
    """
    seen = df.groupBy(key).agg(F.min(order).alias("_first"))
    joined = df.join(seen, df[key].eqNullSafe(seen[key])).drop(seen[key])
    return joined.filter(exempt | (F.col(order) == F.col("_first"))).drop("_first")


def matched(left: DataFrame, right: DataFrame, key: str, last: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(inner join, left rows without a match). With ``last`` the right side keeps the last row of each key by it."""
    side = right if last is None else right.groupBy(key).agg(F.max_by(F.struct(*[c for c in right.columns if c != key]), last).alias("_r")).select(key, "_r.*")
    return left.join(side, key), left.join(side.select(key).distinct(), key, "left_anti")


def strict_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails on the first left row without a match."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), key, "left")
    return joined.withColumn("_hit", F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"no match for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(True)).filter("_hit").drop("_hit")


def enriched_or_passed(rows: DataFrame, index: DataFrame, key: str, text: str, fallback: str) -> DataFrame:
    """Rows with the index's text (else their own); an index without rows lets all pass, else misses go."""
    known = index.select(key, F.col(text).alias("_text")).withColumn("_hit", F.lit(True))
    joined = rows.join(known, key, "left")
    if not index.isEmpty():
        joined = joined.filter("_hit")
    return joined.withColumn(text, F.coalesce("_text", fallback)).drop("_text", "_hit")


def point_lookup(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by composite key, as shard and row number."""
    return rows.join(wanted.select(*keys).distinct(), keys)


def paired_by_hash(left: DataFrame, right: DataFrame, key: str, seed: int, n_right: int, number: str = "number") -> DataFrame:
    """One pseudo-random row of ``right`` (numbered from 0) for each of ``left``: fixed by key and seed."""
    return left.withColumn(number, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n_right))).join(right, number)


def grid(left: DataFrame, right: DataFrame, most_right: int = 1000) -> DataFrame:
    """Every combination with a small parameter table, whose size is checked."""
    n = right.limit(most_right + 1).count()
    if n > most_right:
        raise ValueError(f"the right side of a grid has more than {most_right} rows")
    values = [r.asDict(recursive=True) for r in right.collect()]
    if not values:
        return left.join(right.limit(0), F.lit(True))
    options = F.array(*[F.struct(*[F.lit(v[c]).cast(right.schema[c].dataType).alias(c) for c in right.columns]) for v in values])
    return left.withColumn("_option", F.explode(options)).select(*left.columns, "_option.*")


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of two files by file and line number."""
    return left.join(right, keys)


def stacked(*frames: DataFrame) -> DataFrame:
    """Union of all rows; columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def repeated(df: DataFrame, times: int | Column) -> DataFrame:
    """Each row ``times`` times with ``copy`` from 1; none for 0 or less."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i > 0)))


def vocabulary_extended(vocabulary: DataFrame, tokens: DataFrame, token: str = "token", number: str = "id") -> DataFrame:
    """A vocabulary with unseen tokens behind its last id, in token order.

    Ids go on without gaps: the new tokens are counted by first letters, so that no single task orders all of them.
    """
    last = vocabulary.agg(F.coalesce(F.max(number), F.lit(-1)).alias("_last"))
    fresh = tokens.select(token).distinct().join(vocabulary.select(token), token, "left_anti")
    return vocabulary.select(number, token).unionByName(numbered(fresh, [token], number).crossJoin(F.broadcast(last)).select((F.col(number) + F.col("_last") + 1).cast("long").alias(number), token))


def numbered(df: DataFrame, order: list[str], number: str = "id") -> DataFrame:
    """Numbers from 0 in ``order``, gapless, without one task seeing all rows.

    Rows are dealt by ranges of the order; each partition counts its own, and the counts of the partitions before it
    (one row a partition) are added.
    """
    # the same ranges must hold for both passes: they are written into the rows by one shuffle that both read
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    placed = dealt.withColumn("_part", part).join(F.broadcast(base), "_part")
    return placed.withColumn(number, (F.col("_base") + inside).cast("long")).drop("_part", "_base", "_at")


def fan_out(df: DataFrame, many: str, one: str, keep_empty: bool = False) -> DataFrame:
    """A row an entry of an array (as recordings of a sentence); rows without entries go, or stay with null."""
    return df.select(*[c for c in df.columns if c != many], (F.explode_outer(many) if keep_empty else F.explode(many)).alias(one))

"""Splits and samples. Order comes from a hash of the key and a seed, so that a split is the same however rows are dealt.

Exact cut points need exact ranks: ``ranked`` gives them without one task seeing all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.operators.relations import numbered


def lot(key: Column, seed: int) -> Column:
    """A hexadecimal lot of a key; equal in any engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _ranked_within(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rank`` from 1 in ``order`` within groups, and their sizes ``n``. Rows are dealt by ranges, not by groups."""
    rows = numbered(df, [*by, *order], "_r")
    groups = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_r").alias("_first"), F.count("*").alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])
    return rows.join(groups, same).withColumn("rank", F.col("_r") - F.col("_first") + 1).select(*df.columns, "rank", "n")


def ranked(df: DataFrame, key: str, seed: int, by: list[str] = ()) -> DataFrame:
    """``rank`` from 1 in order of lots, and ``n``; over all rows, or within groups.

    Rows are dealt by ranges of group and lot: a group that a third of all rows are in is no task of its own.
    """
    drawn = df.withColumn("_lot", lot(F.col(key), seed))
    if by:
        return _ranked_within(drawn, by, ["_lot", key]).select(*df.columns, "rank", "n")
    return numbered(drawn, ["_lot", key], "_r").crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).withColumn("rank", F.col("_r") + 1).drop("_lot", "_r")


def split(df: DataFrame, key: str, parts: list[tuple[str, float]], rest: str, seed: int = 42, by: list[str] = (), least_first: int = 0) -> DataFrame:
    """``split`` by shares: each part gets floor(n * share) rows in turn (the first ``least_first`` at least), the rest what is left."""
    rows = ranked(df, key, seed, by)
    end, out = F.lit(0), None
    for i, (name, share) in enumerate(parts):
        size = F.floor(F.col("n") * share)
        end = end + (F.greatest(size, F.lit(least_first)) if i == 0 else size)
        out = F.when(F.col("rank") <= end, name) if out is None else out.when(F.col("rank") <= end, name)
    return rows.withColumn("split", out.otherwise(rest)).drop("rank", "n")


def positional_split(df: DataFrame, order: list[str]) -> DataFrame:
    """90 / 5 / 5 in the order of the rows, by integer division: the remainder goes last."""
    rows = numbered(df, order, "_r").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    train, valid = F.expr("_n * 90 div 100"), F.expr("_n * 5 div 100")
    return rows.withColumn("split", F.when(F.col("_r") < train, "train").when(F.col("_r") < train + valid, "valid").otherwise("test")).drop("_r", "_n")


def topped_up(train: DataFrame, valid: DataFrame, key: str, least: int = 500, share: float = 0.05, seed: int = 42) -> DataFrame:
    """``split``: a validation set of fewer than ``least`` rows takes max(least - v, floor(n share)) rows from training."""
    sizes = train.agg(F.count("*").alias("_t")).crossJoin(valid.agg(F.count("*").alias("_v")))
    take = F.when(F.col("_v") >= least, 0).otherwise(F.greatest(least - F.col("_v"), F.floor(F.col("_t") * share)))
    moved = ranked(train, key, seed).crossJoin(F.broadcast(sizes)).withColumn("split", F.when(F.col("rank") <= take, "valid").otherwise("train"))
    return moved.select(*train.columns, "split").unionByName(valid.withColumn("split", F.lit("valid")))


def within_budget(df: DataFrame, order: list[str], amount: str, budget: float, by: list[str] = ()) -> DataFrame:
    """Rows in order until the amounts before a row reach the budget."""
    if by:
        before = F.coalesce(F.sum(amount).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("_before", before).filter(F.col("_before") < budget).drop("_before")
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    sums = dealt.groupBy("_part").agg(F.sum(amount).alias("_s"))
    base = sums.select("_part", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_in", inside).join(F.broadcast(base), "_part").filter(F.col("_base") + F.col("_in") < budget).drop("_part", "_in", "_base")


def quotas(families: DataFrame, family: str, total: int) -> DataFrame:
    """(family, n, probability, quota): shares of a total, rounded half-even; the largest takes what rounding leaves over."""
    alone = W.partitionBy(F.lit(1))  # a row a family
    rounded = families.withColumn("_q", F.bround(F.col("probability") * total).cast("long"))
    first = F.row_number().over(alone.orderBy(F.desc("probability"), family)) == 1
    return rounded.withColumn("quota", F.col("_q") + F.when(first, total - F.sum("_q").over(alone)).otherwise(0)).drop("_q")


def balanced(df: DataFrame, key: str, family: str, weight: str, total: int, temperature: float = 0.2, seed: int = 42) -> DataFrame:
    """A sample with each family's quota (see ``quotas``), weighted within families.

    Without replacement where a family has rows enough: the smallest keys -ln(u) / weight. With replacement otherwise:
    each draw takes the row in whose stretch of the running sum of weights it falls. ``draw`` numbers a family's draws.
    """
    from tagloom.operators.audits import family_weights

    shares = quotas(family_weights(df, family, temperature), family, total).select(family, F.col("n").alias("_n"), F.col("quota").alias("_quota"))
    uniform = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    rows = df.join(shares, family)
    once = rows.filter("_quota <= _n").withColumn("_key", -F.log(uniform(F.col(key))) / F.col(weight))
    once = _ranked_within(once, [family], ["_key", key]).withColumnRenamed("rank", "draw").filter(F.col("draw") <= F.col("_quota"))
    few = rows.filter("_quota > _n")
    # (such a family has fewer rows than the sample)
    running = W.partitionBy(family).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    spans = few.withColumn("_to", F.sum(weight).over(running)).withColumn("_from", F.col("_to") - F.col(weight))
    # stretches and draws meet in bins of a row's mean weight
    totals = spans.groupBy(family).agg(F.max("_to").alias("_all"))
    bin_of = lambda at: F.floor(at * F.col("_n") / F.col("_all"))
    binned = spans.join(totals, family).withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.col("_to")))))
    draws = shares.filter("_quota > _n").join(totals, family).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_quota").cast("int"))))
    drawn = draws.withColumn("_u", uniform(F.col(family), F.col("draw")) * F.col("_all")).select(F.col(family).alias("_of"), "draw", "_u", bin_of(F.col("_u")).alias("_at"))
    again = binned.join(drawn, (F.col(family) == F.col("_of")) & (F.col("_bin") == F.col("_at"))).filter((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    return once.select(*df.columns, F.col("draw").cast("int").alias("draw")).unionByName(again.select(*df.columns, "draw"))


def batch_counts(n: Column, batch: int, ranks: int = 1) -> Column:
    """STRUCT<batches, per_rank>: whole batches, and at most how many a rank gets."""
    whole = F.floor(n / batch)
    return F.struct(whole.alias("batches"), F.ceil(whole / ranks).alias("per_rank"))

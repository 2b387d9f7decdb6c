"""Approximate nearest neighbours: an inverted file whose lists are scanned by adaptive dimensions.

Vectors are rotated by a random orthogonal matrix, so that the first d of D rotated coordinates give an unbiased
estimate of a distance: partial * D / d. The rotated vectors of a list lie in blocks of columns. A query scans a list
block by block; a candidate is abandoned once its estimate is so far beyond the query's k-th distance that the
hypothesis of its being nearer is rejected: sqrt(estimate) > (1 + epsilon / sqrt(d)) * threshold. Survivors of all
blocks are measured exactly, in double precision on the original vectors.

Centroids come from a bounded sample (by a hash of the id: 16 times the root of the number of rows, from ``sample_size``
up to ten times that); every vector is indexed. There is a list to every ``per_list`` rows, as long as the sample has eight
vectors for it. Lists are dealt out in parts of about ``part_size`` vectors, so that a list may hold any share of all
rows, and queries are grouped likewise. The nearest list is searched first: the k-th distance there is the threshold that
the scan of all further lists starts from.

Vectors that are null, zero, of another length than ``dim`` (by default the commonest one), or hold a null or a
non-finite component take no part. Ties of distance go to the smaller id. An id may have several rows: it is asked for
once with each of its distinct vectors, and the distance of two ids is the least between their rows, so that a query has
another id among its neighbours once, and never its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tagloom.llm.common import arrow_column, bounded_batches, discard, materialize, spread

QUERIES_TOGETHER = 4096


@dataclass
class Index:
    """Rotation, centroids (of rotated vectors), and the lists that a query must probe for the recall asked for."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector of this length can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def commonest_dim(df: DataFrame, vector_col: str) -> int:
    sizes = df.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count()
    row = sizes.orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def fit(vectors: DataFrame, id_col: str, vector_col: str, sample_size: int = 20_000, per_list: int = 1_000, recall: float = 0.96, k: int = 10, seed: int = 7) -> Index:
    """Rotation and centroids from a sample; ``vectors`` hold usable vectors only.

    The number of probes is the least by which 256 vectors of the sample find this share of their ``k`` nearest in the
    sample (by brute force). Over all rows the recall is about that: the README has the measured figures.
    """
    rows = vectors.count()
    wanted = min(10 * sample_size, max(sample_size, 16 * math.isqrt(rows)))
    share = F.lit(min(1.0, wanted / max(1, rows)))
    lot = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = vectors.filter(lot < share).select(id_col, vector_col).limit(2 * wanted).collect()
    sample = np.array([r[1] for r in sorted(drawn, key=lambda r: (str(r[0]), list(r[1])))], np.float64)
    if not len(sample):
        first = vectors.select(vector_col).first()
        sample = np.array([first[0]] if first else [[0.0]], np.float64)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
    x = (sample @ rotation).astype(np.float32)
    lists = int(max(1, min(rows // per_list, len(x) // 8)))
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(8):
        near = _nearest(x, centroids, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        used, starts, sizes = np.unique(near[order], return_index=True, return_counts=True)
        centroids[used] = np.add.reduceat(x[order], starts, axis=0) / sizes[:, None].astype(np.float32)
    return Index(rotation, centroids, _probes(x, centroids, k, recall))


def _probes(x: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    asked = np.arange(0, len(x), max(1, len(x) // 256))
    far = (x**2).sum(axis=1)[None, :] - 2 * x[asked] @ x.T
    far[np.arange(len(asked)), asked] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = _nearest(x[asked], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), axis=1)
    lists = _nearest(x, centroids, 1)[:, 0]
    reached = np.take_along_axis(place, lists[near], axis=1)
    return int(np.quantile(reached, recall, method="higher")) + 1


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        far = (centroids**2).sum(axis=1)[None, :] - 2 * x[i : i + 4096] @ centroids.T
        out.append(far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def _assign(shared, n: int):
    def assign(vectors: pa.Array) -> pa.Array:
        index = shared.value
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        near = _nearest((x @ index.rotation).astype(np.float32), index.centroids, n).astype(np.int32)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))

    return lambda *columns: arrow_column(assign, T.ArrayType(T.IntegerType()), *columns)


def scan(
    queries: np.ndarray, rows: np.ndarray, k: int, block: int, epsilon: float, asked: np.ndarray | None = None, ids: np.ndarray | None = None, limits: np.ndarray | None = None
) -> list[np.ndarray]:
    """For each rotated query, which rotated rows survive the scan by blocks of columns (at least its k nearest but for chance).

    With the ids ``asked`` of the queries and ``ids`` of the rows, rows of a query's own id are left out, and the k
    nearest are rows of as many ids; k rows of different ids survive wherever there are so many, unless ``limits`` (squared
    distances that k rows elsewhere keep) say that none of these is needed.
    """
    dim = rows.shape[1]
    error = 1e-6 * np.sqrt(dim) * float(max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)))
    roomy = lambda square: (np.sqrt(square) * (1 + 1e-4) + error) ** 2  # noqa: E731  (for the error of single precision)
    columns = [np.ascontiguousarray(rows[:, c : c + block]) for c in range(0, dim, block)]
    ids = np.arange(len(rows)) if ids is None else ids
    by_id = np.argsort(ids, kind="stable")
    n_ids = len(np.unique(ids))
    repeated = n_ids < len(ids)
    found = []
    for i, q in enumerate(queries):
        own = by_id[:0] if asked is None else by_id[np.searchsorted(ids, asked[i], "left", by_id) : np.searchsorted(ids, asked[i], "right", by_id)]
        if n_ids - (len(own) > 0) <= k:
            found.append(np.setdiff1d(np.arange(len(rows)), own))
            continue
        # the first k by estimate of the first block set the threshold that candidates are tested against
        partial = ((columns[0] - q[:block]) ** 2).sum(axis=1)
        partial[own] = np.inf
        head = _least(partial, ids, k, repeated)
        limit = ((rows[head] - q) ** 2).sum(axis=1).max()
        known = limits is not None and limits[i] < limit
        limit = roomy(limits[i] if known else limit)
        alive, d = np.arange(len(rows)), min(block, dim)
        for c in range(1, len(columns)):
            stays = partial * (dim / d) <= (1 + epsilon / np.sqrt(d)) ** 2 * limit
            alive, partial = alive[stays], partial[stays]
            partial = partial + ((columns[c][alive] - q[d : d + block]) ** 2).sum(axis=1)
            d = min(d + block, dim)
        best = _least(partial, ids[alive], k, repeated)
        if known:
            alive = alive[partial <= (limit if len(best) < k else min(limit, roomy(partial[best].max())))]
        elif len(best) < k:
            alive = np.union1d(alive, head)
        elif len(alive) > k:
            alive = alive[partial <= roomy(partial[best].max())]
        found.append(alive)
    return found


def _least(values: np.ndarray, ids: np.ndarray, k: int, repeated: bool) -> np.ndarray:
    """Places of the k least values, one of an id; fewer if there are fewer ids."""
    if not repeated:
        return np.argpartition(values, k - 1)[:k] if len(values) > k else np.arange(len(values))
    order = np.lexsort((ids, values))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, dim: int | None = None,
    index: Index | None = None, probes: int | None = None, block: int = 16, epsilon: float = 2.1, part_size: int = 20_000,
) -> DataFrame:
    """(query_id, rank, ``id_col``, score): for each query id the k nearest other ids found, by Euclidean distance.

    ``queries`` has the columns of ``vectors``; a row of the query's own id is no candidate. A query that finds fewer
    than k in its probed lists goes on to further ones, twice as many each time, until it has k or has read all lists.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    dim = commonest_dim(vectors, vector_col) if dim is None else dim
    # (single precision stays so on the way: half the bytes)
    vector = F.col(vector_col) if vectors.schema[vector_col].dataType.elementType == T.FloatType() else F.col(vector_col).cast("array<double>")
    good = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    rows, asked = good(vectors), materialize(good(queries).distinct(), "asked")
    index = index or fit(rows, "id", "v", k=k)
    probes = probes or index.probes
    shared = spark.sparkContext.broadcast(index)
    lists = len(index.centroids)
    # (rows are dealt by a number of their own, as any share of them may have one id)
    placed = materialize(rows.withColumn("list", _assign(shared, 1)("v")[0]).withColumn("row", F.monotonically_increasing_id()), "lists")
    sizes = placed.groupBy("list").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / part_size).cast("int"))
    sizes = materialize(sizes.select("list", "parts"), "list-sizes")  # a row a list, at most max_lists
    inner = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts")).cast("int"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part (``q`` false) come before the queries that probe it (``q`` true)."""
        now, ids, originals, waiting = None, [], [], []

        def answer():
            if not waiting or not ids:
                return
            own, x = np.concatenate(ids), np.concatenate(originals)
            rotated, wanted = x @ shared.value.rotation, np.array([v for _, v, _ in waiting]) @ shared.value.rotation
            # to one scale, in which no square is too large for single precision
            scale = max(float(np.abs(rotated).max()), float(np.abs(wanted).max()))
            asks, limits = np.array([query for query, _, _ in waiting]), (np.array([limit for _, _, limit in waiting]) / scale) ** 2
            out = {"query_id": [], "id": [], "score": []}
            alives = scan((wanted / scale).astype(np.float32), (rotated / scale).astype(np.float32), k, block, epsilon, asks, own, limits)
            for (query, v, _), alive in zip(waiting, alives):
                exact = np.sqrt(((x[alive] - v) ** 2).sum(axis=1))
                best = _least(exact, own[alive], k, True)
                out["query_id"] += [query] * len(best)
                out["id"] += own[alive][best].tolist()
                out["score"] += exact[best].tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

        for batch in batches:
            place = list(zip(batch.column("list").to_pylist(), batch.column("part").to_pylist()))
            cuts = [0, *[i for i in range(1, len(place)) if place[i] != place[i - 1]], len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if place[a] != now:
                    yield from answer()
                    now, ids, originals, waiting = place[a], [], [], []
                piece = batch.slice(a, b - a)
                asks = piece.column("q").to_numpy(zero_copy_only=False)
                x = piece.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                number = piece.column("id").to_numpy()
                if not asks.all():
                    ids.append(number[~asks])
                    originals.append(x[~asks])
                waiting += list(zip(number[asks].tolist(), x[asks], piece.column("limit").to_numpy()[asks].tolist()))
                if len(waiting) >= QUERIES_TOGETHER:
                    yield from answer()
                    waiting = []
        yield from answer()

    far = F.lit(float("inf"))

    def answers(who: DataFrame, a: int, b: int) -> DataFrame:
        """What queries find in their lists from the a-th nearest to before the b-th."""
        outer = who.withColumn("list", F.explode(F.slice(_assign(shared, b)("v"), a + 1, b - a))).join(F.broadcast(sizes), "list")
        outer = outer.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "id", "v", "limit")
        scanned = inner
        if a > 1:  # few queries go on: lists that none of them reads stay where they are
            outer = materialize(outer, "asked-on")
            scanned = inner.join(F.broadcast(outer.select("list").distinct()), "list", "left_semi")
        both = scanned.select("list", "part", F.lit(False).alias("q"), "id", "v", far.alias("limit")).unionByName(outer.select("list", "part", F.lit(True).alias("q"), "id", "v", "limit"))
        dealt = both.repartition(spread(spark), "list", "part").sortWithinPartitions("list", "part", "q", "id")
        return dealt.mapInArrow(part, "query_id long, id long, score double")

    def nearest(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
        order = W.partitionBy("query_id").orderBy("score", "id")
        return materialize(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "nearest")

    read = min(probes, lists)
    near = nearest(answers(asked.withColumn("limit", far), 0, 1))
    if read > 1:
        kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
        further = answers(asked.join(kth, "id", "left").withColumn("limit", F.coalesce("limit", far)), 1, read)
        near = nearest(near.drop("rank").unionByName(further))
    while read < lists:
        whole = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
        short = asked.join(whole, "id", "left_anti").withColumn("limit", far)
        if short.isEmpty():
            break
        more = min(lists, 2 * read)
        near = nearest(near.drop("rank").unionByName(answers(short, read, more)))
        read = more
    discard(placed)
    discard(asked)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

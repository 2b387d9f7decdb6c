import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import ann, queries, sharding
from tagloom.llm.sharding import Shard, Store, plan, tier


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def arrival(spark, a, b):
    return spark.range(a, b).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("text"), F.lit("own").alias("_shard"), F.lit(1).alias("_group"))


def test_appends_are_versions(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.append(arrival(spark, 0, 100)) == 1
    assert store.append(arrival(spark, 100, 150)) == 2
    assert store.append(arrival(spark, 0, 0)) == 3
    assert (store.read(1).count(), store.read(2).count(), store.read().count()) == (100, 150, 150)
    assert sum(s.rows for s in store.manifest().shards) == 150


def test_compaction_keeps_every_row(spark, store):
    for i in range(6):
        store.append(arrival(spark, 50 * i, 50 * i + 50).repartition(3))
    before, rows = store.manifest(), sorted(map(tuple, store.read().collect()), key=str)
    store.compact(target=1 << 20)
    after = store.manifest()
    assert len(after.shards) < len(before.shards) and after.version > before.version
    assert sorted(map(tuple, store.read().collect()), key=str) == rows
    assert max(s.size for s in after.shards) <= 1 << 20
    again = store.version()
    assert store.compact(target=1 << 20) == again


def test_shards_stay_where_nothing_is_to_merge(spark, store):
    store.append(arrival(spark, 0, 30).coalesce(1))
    store.append(arrival(spark, 30, 60).coalesce(1))
    assert store.compact(target=1 << 20) == 2
    assert store.compact(target=1 << 20, everything=True) > 2 and len(store.manifest().shards) == 1


def test_one_writer_wins_a_version(spark, store):
    store.append(arrival(spark, 0, 10))
    now = store.manifest()
    store._commit(sharding.Manifest(now.version + 1, now.schema, now.parts))
    with pytest.raises(sharding.ConflictError):
        store._commit(sharding.Manifest(now.version + 1, now.schema, ()))
    assert store.manifest() == sharding.Manifest(2, now.schema, now.parts)


def test_an_append_between_survives_a_merge(spark, store):
    """A merge that finds a newer version commits on top of it."""
    for i in range(4):
        store.append(arrival(spark, 10 * i, 10 * i + 10).coalesce(1))
    groups = plan(list(store.manifest().shards), 1 << 20)
    read, other = store.manifest, Store(spark, store.folder)
    calls = []

    def late(version=None):
        if version is None:
            calls.append(1)
            if len(calls) == 2:
                found = read()
                other.append(arrival(spark, 100, 105))
                return found
        return read(version)

    store.manifest = late
    store._merge(groups)
    store.manifest = read
    assert store.read().count() == 45
    store.vacuum(older_than=-60)
    assert store.read().count() == 45


def test_a_vacuum_leaves_an_append_in_flight(spark, store, monkeypatch):
    store.append(arrival(spark, 0, 10))
    written = store._written

    def and_vacuum(older_than):
        def write(rows, partition_by=None):
            made = written(rows, partition_by)
            Store(spark, store.folder).vacuum(*older_than)
            return made

        return write

    monkeypatch.setattr(store, "_written", and_vacuum(()))
    store.append(arrival(spark, 10, 20))
    assert store.read().count() == 20
    monkeypatch.setattr(store, "_written", and_vacuum((-60,)))
    with pytest.raises(RuntimeError, match="retention"):
        store.append(arrival(spark, 20, 30))
    assert store.read().count() == 20


def test_a_reader_goes_on_across_compaction(spark, store):
    for i in range(5):
        store.append(arrival(spark, 10 * i, 10 * i + 10).coalesce(1))
    reader = store.read()
    store.compact(target=1 << 20)
    store.vacuum()
    assert reader.count() == 50 and store.read(5).count() == 50
    store.vacuum(older_than=-60)
    assert store.read().count() == 50
    assert len(list(spark.sparkContext._jvm.java.io.File(f"{store.folder}/versions/parts").list())) <= 2  # (with a checksum)


def test_arrivals_with_other_columns(spark, store):
    store.append(spark.range(4).select("id", F.lit("a").alias("text")))
    store.append(spark.range(4, 6).select("id", F.lit("b").alias("Text"), F.lit(1.5).alias("more")))
    store.append(spark.range(6, 8).select("id"))
    with pytest.raises(ValueError, match="text"):
        store.append(spark.range(9, 10).select("id", F.lit(1).alias("text")))
    expected = [(i, "a" if i < 4 else "b" if i < 6 else None, 1.5 if i in (4, 5) else None) for i in range(8)]
    assert store.read().columns == ["id", "text", "more"]
    assert sorted(map(tuple, store.read().collect())) == expected
    store.compact(target=1 << 20, everything=True)
    assert sorted(map(tuple, store.read().collect())) == expected and len(store.manifest().shards) == 1


def test_parts_of_a_manifest(monkeypatch):
    monkeypatch.setattr(sharding, "PART_SHARDS", 3)
    shards = [Shard(str(i), 1, 1) for i in range(8)]
    parts = sharding.with_shards((), shards)
    assert [len(p.shards) for p in parts] == [3, 3, 2]
    more = sharding.with_shards(parts, [Shard("8", 1, 1), Shard("9", 1, 1)])
    assert more[:2] == parts[:2] and sorted(s.path for p in more for s in p.shards) == [str(i) for i in range(10)]
    less = sharding.with_shards(more, [], frozenset({"0", "9"}))
    assert less[0] == parts[1] and sorted(s.path for p in less for s in p.shards) == [str(i) for i in range(1, 9)]


def test_tiers_and_plans():
    target = 64
    assert [tier(s, target) for s in (64, 32, 31, 8, 7, 2, 1)] == [0, 0, 1, 2, 2, 3, 3]
    shards = [Shard(str(i), s, 1) for i, s in enumerate([1, 1, 1, 1, 1, 30, 31, 60, 9])]
    (group,) = plan(shards, target)
    assert sorted(s.size for s in group) == [1, 1, 1, 1, 1]
    assert all(sum(s.size for s in g) <= target for g in plan([Shard(str(i), 20, 1) for i in range(11)], target))


def vectors(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 3
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(12)] + rng.standard_normal(dim)]) for i in range(n)]


def brute(rows, k=10):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in good if i != q)[:k]
    return out


KIND = "vec_id long, embedding array<float>"


def test_recall_and_scores(spark):
    rows = vectors(3000)
    df = spark.createDataFrame(rows, KIND).repartition(4)
    index = ann.fit(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), "id", "v", per_list=100)
    got = ann.search(df, df.filter("vec_id % 100 = 0"), index=index, part_size=120).collect()
    expected, hits = brute(rows), 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(found) == set(expected)
    for q, best in expected.items():
        own = sorted(found[q])
        assert [x[0] for x in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        hits += len({i for _, i in best} & {x[2] for x in own})
        exact = {i: s for s, i in best}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for _, s, i in own if i in exact)
    assert hits / sum(map(len, expected.values())) >= 0.9
    assert index.probes < len(index.centroids)


def test_odd_vectors_and_ties(spark):
    rows = vectors(150)
    rows[100] = (100, rows[7][1])
    rows += [(200, None), (201, [0.0] * 24), (202, [1.0] * 23), (203, [float("nan")] * 24), (204, [float("inf")] + [1.0] * 23), (205, [None] + [1.0] * 23), (300, []), (7007, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, KIND).withColumn("score", F.lit("own"))
    got = {}
    for r in ann.search(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    expected = brute(rows)
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == expected
    assert [i for s, i in expected[100] if s == 0] == [7, 7007]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame(vectors(4), KIND)
    assert ann.search(few, few.filter("vec_id % 100 = 0")).count() == 3
    none = few.limit(0)
    assert ann.search(none, none).count() == 0


def test_probes_are_for_the_k_nearest(spark, monkeypatch):
    asked, real = [], ann._probes
    monkeypatch.setattr(ann, "_probes", lambda x, centroids, k, recall: asked.append((len(centroids), k)) or real(x, centroids, k, recall))
    df = spark.createDataFrame(vectors(600), KIND)
    for per_list in (300, 20):
        ann.fit(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), "id", "v", per_list=per_list, k=10)
    assert asked == [(2, 10), (30, 10)]


def test_repeated_ids(spark):
    """An id of many rows is one query and one neighbour, by the nearest of its rows."""
    rows = vectors(400)
    rows += [rows[100]] * 15 + [(200, rows[7][1]), (200, rows[8][1])] + [(7, rows[9][1])] * 20 + [rows[11]] * 30
    rows += [(300, [float(np.float32(x + 0.001 * j)) for x in rows[11][1]]) for j in range(12)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    expected = {}
    for q in (0, 100, 200, 300):
        own = [np.array(v) for i, v in rows if i == q]
        least = {}
        for i, v in rows:
            if i != q:
                least[i] = min(least.get(i, np.inf), *[float(np.sqrt(((np.array(v) - u) ** 2).sum())) for u in own])
        expected[q] = sorted((s, i) for i, s in least.items())[:10]
    for size in (20_000, 40):
        got = {}
        for r in ann.search(df, df.filter("vec_id % 100 = 0"), part_size=size).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        assert {q: [x[0] for x in sorted(g)] for q, g in got.items()} == {q: list(range(1, 11)) for q in expected}
        for q, best in expected.items():
            assert [x[2] for x in sorted(got[q])] == [i for _, i in best]
            assert [x[1] for x in sorted(got[q])] == pytest.approx([s for s, _ in best], rel=1e-12)


def test_queries_with_few_neighbours_read_on(spark):
    """Outliers with tiny lists of their own get as many neighbours as there are."""
    rows = vectors(60) + [(100, [90.0] * 24), (200, [91.0] * 24), (300, [-90.0] * 24)]
    df = spark.createDataFrame(rows, KIND)
    centroids = np.array([[0.0] * 24, [90.0] * 24, [-90.0] * 24, [500.0] * 24, [-500.0] * 24], np.float32)
    for k in (10, 80):
        got = {}
        for r in ann.search(df, df.filter("vec_id % 100 = 0"), k=k, index=ann.Index(np.eye(24), centroids, 1)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert {q: len(x) for q, x in got.items()} == dict.fromkeys((0, 100, 200, 300), min(k, 62))
        for q in (100, 200, 300):
            assert [i for _, i in sorted(got[q])] == [i for _, i in brute(rows, k)[q]]


def test_scan_leaves_out_the_own_id():
    rng = np.random.default_rng(2)
    rows = np.concatenate([np.repeat(rng.standard_normal((1, 32)), 30, axis=0), rng.standard_normal((500, 32))]).astype(np.float32)
    ids = np.concatenate([np.full(30, 5), np.arange(1000, 1500)])
    (alive,) = ann.scan(rows[:1], rows, 10, 16, 2.1, np.array([5]), ids)
    true = 30 + np.argsort(((rows[30:] - rows[0]) ** 2).sum(axis=1))[:10]
    assert 5 not in ids[alive] and len(set(true) & set(alive.tolist())) >= 9 and len(alive) >= 10


def test_abandoned_candidates_are_far():
    rng = np.random.default_rng(1)
    rows, asked = rng.standard_normal((2000, 64)).astype(np.float32), rng.standard_normal((30, 64)).astype(np.float32)
    kept = 0
    for q, alive in zip(asked, ann.scan(asked, rows, 10, 16, 2.1)):
        true = np.argsort(((rows - q) ** 2).sum(axis=1))[:10]
        kept += len(set(true) & set(alive.tolist()))
        assert len(alive) < 50
    assert kept / 300 > 0.97


def test_limits_from_elsewhere():
    """With a threshold carried along nothing nearer is lost, and little else survives."""
    rng = np.random.default_rng(3)
    rows, asked = rng.standard_normal((2000, 64)).astype(np.float32), rng.standard_normal((30, 64)).astype(np.float32)
    far = ((rows[None, :, :].astype(np.float64) - asked[:, None, :]) ** 2).sum(axis=2)
    limits = np.sort(far, axis=1)[:, 3]
    for f, limit, alive in zip(far, limits, ann.scan(asked, rows, 10, 16, 3.5, limits=limits)):
        assert set(np.flatnonzero(f <= limit)) <= set(alive.tolist()) and len(alive) <= 8


def test_extreme_vectors(spark):
    """Squares of finite components beyond single precision lose nothing."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * 10.0 ** rng.integers(-30, 37)]) for i in range(300)]
    df = spark.createDataFrame(rows, KIND)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 100 = 0"), index=ann.Index(np.eye(8), np.zeros((1, 8), np.float32), 1)).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    expected = brute(rows)
    for q, best in expected.items():
        assert [s for s, _ in sorted(got[q])] == pytest.approx([s for s, _ in best], rel=1e-12)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="no such table here")
def test_recall_of_the_query_on_the_given_table(spark):
    """The registered query, with its own parameters, against brute force over every query of the table."""
    folder = os.environ.get("RECALL_DIR", "/root/testdata/sf0.1")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").filter("embedding is not null").select("vec_id", "embedding").collect()
    usable = [r for r in table if all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    ids, x = np.array([r[0] for r in usable]), np.array([r[1] for r in usable], np.float64)
    got = {}
    for r in queries.op10_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = wanted = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        far[ids == ids[i]] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        assert sorted(got[ids[i]]) == list(range(1, 11))
        hits += len({v for v, _ in got[ids[i]].values()} & set(best.tolist()))
        wanted += 10
    print(f"recall {hits / wanted:.4f} of {wanted // 10} queries among {len(ids)} vectors")
    assert hits / wanted >= 0.9

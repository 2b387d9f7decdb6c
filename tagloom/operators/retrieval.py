"""Exact vector retrieval and centroids, in built-in expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.when(norm > 0, norm).otherwise(1))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str, metric: str = "cosine") -> DataFrame:
    """The k nearest rows to a vector: greatest cosine or least L2, ties by key."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    score = cosine(F.col(vector), asked) if metric == "cosine" else l2(F.col(vector), asked)
    rows = vectors.withColumn("score", score).filter("score is not null")
    return rows.orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), key).limit(k)


def centroid(vectors: DataFrame, vector: str, by: list[str] = ()) -> DataFrame:
    """The mean vector, of all rows or of each group: averages by dimension, pre-aggregated in every task."""
    long = vectors.select(*by, F.posexplode(vector).alias("_d", "_x"))
    means = long.groupBy(*by, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias("centroid"))


def nearest_to_centroid(vectors: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """The k rows least far (L2) from the mean of all: an extract of a text's chunks."""
    middle = centroid(vectors, vector)
    return vectors.crossJoin(F.broadcast(middle)).withColumn("score", l2(F.col(vector), F.col("centroid"))).drop("centroid").orderBy("score", key).limit(k)


class VectorTable:
    """Chunks with vectors and metadata in a Parquet folder of immutable parts: create, add, delete, search.

    A deletion writes a tombstone part; readers leave out keys that one names.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = "id string, text string, source string, embedding array<float>"):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        for part, kind in (("rows", schema), ("gone", "id string, at string")):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
            if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{self.folder}/{part}")

    def add(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("append").parquet(f"{self.folder}/rows")

    def delete(self, keys: DataFrame) -> None:
        keys.select(F.col("id"), F.lit(uuid.uuid4().hex).alias("at")).write.mode("append").parquet(f"{self.folder}/gone")

    def rows(self) -> DataFrame:
        gone = self.spark.read.schema("id string, at string").parquet(f"{self.folder}/gone").select("id").distinct()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows").join(gone, "id", "left_anti")

    def search(self, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
        return nearest(self.rows(), query, k, "id", "embedding", metric)

"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class TwoGenerationCache(dict):
    """A memo of at most about ``2 * limit`` entries; entries used since the last turnover survive it.

    ``cache[key]`` computes ``make(key)`` on a miss. Keys longer than ``longest`` are computed each time, so that the
    memo is bounded in bytes too. Results never depend on what is cached.
    """

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > self.longest:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_HELD: dict = {}


def held(key, make: Callable):
    """``make()`` for a key, kept in this process until another key is asked for.

    Workers outlive the stages of a pipeline: what one operator remembers must not stay when the next one runs.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Forgets what this process remembers for another operator."""
    _HELD.clear()


#: Bytes of an Arrow batch between JVM and Python: batches of very long texts have few rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, unless the session's bound is lower already."""
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def arrow_column(function: Callable, kind, *columns: Column, chained: bool = False) -> Column:
    """An Arrow function over columns, in batches of bounded size.

    It is marked as not deterministic, though it is: else a filter on its result would be moved below the projection
    and the function run twice. ``chained``: it is not, so that functions of its result run in the same worker.
    """
    bounded_batches(SparkSession.active())
    made = F.arrow_udf(function, kind)
    return (made if chained else made.asNondeterministic())(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default is set only where the session has none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not context.master.startswith("local") and warehouse.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir: the executors do not share the driver's folders")
        folder = f"{warehouse.rstrip('/')}/_tagloom_shared"
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and rereads it: lineage ends at files every executor sees.

    ``discard`` deletes the table; one that a result still reads goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this job are of no use once the table is there
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **columns) -> DataFrame:
    """The rows of ``df`` as one struct ``_row`` beside the columns named: no column of ``df`` can clash with another's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], changed: dict | None = None, added: dict | None = None) -> DataFrame:
    """The columns of ``_row``, those of ``changed`` as given there, then those of ``added``, in the place of any so named."""
    changed, added = changed or {}, added or {}
    new = {name.lower() for name in added}
    kept = [c for c in columns if c.lower() not in new]
    return df.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in kept], *[c.alias(name) for name, c in added.items()])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: Characters that a sampled word keeps.
WORD_CHARS = 240


def some_words(text: Column, key: Column, blocks: int, block_words: int) -> Column:
    """A text of at most ``blocks`` runs of ``block_words`` words, chosen by a hash of the key and their place, in order.

    For samples that go to the driver: longer texts are cut where they are, so that a sample of rows is one of bytes.
    """
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.ceil(F.size(words) / block_words).cast("int")
    drawn = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(F.xxhash64(key, b).alias("lot"), b.alias("at")))), 1, blocks)
    runs = F.transform(F.array_sort(F.transform(drawn, lambda x: x["at"])), lambda at: F.slice(words, at * block_words + 1, F.lit(block_words)))
    return F.array_join(F.transform(F.flatten(runs), lambda w: F.substring(w, 1, WORD_CHARS)), " ")


def spread(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how wide small keyed tables are dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

"""A store of immutable Parquet shards under a versioned manifest, kept in order by size-tiered compaction.

``append`` writes an arrival as it comes, in shards of any small size. Shards below the target size fall into tiers by
the logarithm of their size; ``compact`` merges runs of at least ``least_runs`` shards of one tier into shards of up to
the target size, tier by tier, until no tier has enough. What is left over in a tier waits for further arrivals, or is
merged too with ``everything``. No row is read by a merge that does not change its shard.

A version is one JSON file that names the schema and the parts of its manifest; a part is an immutable JSON file of up to
``PART_SHARDS`` shards, and a commit rewrites only parts that it changes. The version is written under another name and
renamed, without overwriting: readers see a version whole or not at all, and of two writers of one version one fails,
reads the new version and tries again. That needs a file system whose rename is atomic and refuses to overwrite, as HDFS
and local ones do; on an object store without that, let one writer commit at a time.

Merged shards and shards that no version names (of writers in flight, or failed) stay until ``vacuum``, which leaves
everything that was replaced, or written, within its retention time: a reader of a replaced version has that long to
finish, a writer that long from writing to commit. A commit checks that its new shards are still there.

An arrival may bring new columns, which older rows have as null, or lack columns; one whose column has another type than
before is refused. Nulls and extra columns are kept as they are. An arrival without rows adds no shard, but makes a version.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import CLEANUP, free_name

#: Shards in a part of a manifest.
PART_SHARDS = 10_000
#: Seconds that replaced and uncommitted files stay.
RETENTION = 7 * 24 * 3600.0


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    size: int  # bytes
    rows: int


@dataclass(frozen=True)
class Part:
    name: str
    shards: tuple[Shard, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON
    parts: tuple[Part, ...]

    @property
    def shards(self) -> tuple[Shard, ...]:
        return tuple(s for p in self.parts for s in p.shards)


class ConflictError(RuntimeError):
    """Another writer has committed the version."""


def _parts(shards: Iterable[Shard]) -> tuple[Part, ...]:
    listed = tuple(shards)
    return tuple(Part(uuid.uuid4().hex, listed[i : i + PART_SHARDS]) for i in range(0, len(listed), PART_SHARDS))


def with_shards(parts: tuple[Part, ...], made: list[Shard], gone: frozenset[str] = frozenset()) -> tuple[Part, ...]:
    """Parts without the shards of ``gone`` and with those of ``made``; parts that neither concerns stay the same."""
    kept, loose = [], []
    for part in parts:
        left = tuple(s for s in part.shards if s.path not in gone)
        if len(left) < len(part.shards) or (made and len(left) < PART_SHARDS):
            loose += left
        else:
            kept.append(part)
    return (*kept, *_parts([*loose, *made]))


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both; names that differ in case only are one column. Another type of a column is an error."""
    if old is None:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in new])
    known = {f.name.lower(): f for f in old}
    plain = lambda kind: kind.simpleString()  # noqa: E731  (without what may be null)
    for field in new:
        had = known.get(field.name.lower())
        if had is not None and plain(had.dataType) != plain(field.dataType):
            raise ValueError(f"column {field.name} is {plain(had.dataType)} in the store, {plain(field.dataType)} in the arrival")
    return T.StructType([*old, *[T.StructField(f.name, f.dataType, True) for f in new if f.name.lower() not in known]])


class Store:
    """Shards in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)
        self._known: dict[str, Part] = {}  # parts never change

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    # versions

    def version(self) -> int:
        """The latest; 0 before the first."""
        folder = self._path("versions")
        if not self.files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if not version:
            return Manifest(0, "", ())
        held = self._read_json(f"versions/{version:012d}.json")
        return Manifest(held["version"], held["schema"], tuple(self._part(name) for name in held["parts"]))

    def _part(self, name: str) -> Part:
        if name not in self._known:
            self._known[name] = Part(name, tuple(Shard(**s) for s in self._read_json(f"versions/parts/{name}.json")))
        return self._known[name]

    def _read_json(self, name: str):
        stream = self.files.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, path, body) -> None:
        stream = self.files.create(path, False)
        try:
            stream.write(bytearray(json.dumps(body).encode()))
        finally:
            stream.close()

    def _commit(self, manifest: Manifest, made: Iterable[Shard] = ()) -> None:
        """Writes a version; ``made`` are its new shards, which must be there still."""
        for shard in made:
            if not self.files.exists(self._path(shard.path)):
                raise RuntimeError(f"{shard.path} was deleted before its commit: retention is too short for this writer")
        for part in manifest.parts:
            if part.name not in self._known:
                self._write_json(self._path(f"versions/parts/{part.name}.json"), [asdict(s) for s in part.shards])
                self._known[part.name] = part
        draft, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{manifest.version:012d}.json")
        self._write_json(draft, {"version": manifest.version, "schema": manifest.schema, "parts": [p.name for p in manifest.parts]})
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            self.hadoop.FileContext.getFileContext(draft.toUri(), self.conf).rename(draft, final, options)
        except Exception as error:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise ConflictError(f"version {manifest.version} exists") from error
            raise

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a store without versions cannot be read."""
        manifest = self.manifest(version)
        if not manifest.version:
            raise ValueError("the store has no version yet")
        schema, shards = self._schema(manifest), manifest.shards
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{s.path}" for s in shards])

    @staticmethod
    def _schema(manifest: Manifest) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(manifest.schema)) if manifest.version else None

    def _written(self, rows: DataFrame, partition_by: str | None = None) -> list[Shard]:
        name = f"shards/{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = rows.write.mode("errorifexists")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        sizes, found = {}, self.files.listFiles(self._path(name), True)
        while found.hasNext():
            status = found.next()
            path = status.getPath().toString()
            if path.endswith(".parquet"):
                sizes[path[path.index(name) :]] = status.getLen()
        if not sizes:
            return []
        # row counts stand in the files' footers; one row a shard comes back
        counted = self.spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(f"{self.folder}/{name}")
        counts = {r[0][r[0].index(name) :]: r[1] for r in counted.groupBy(F.col("_metadata.file_path")).count().collect()}
        return [Shard(p, n, counts[p]) for p, n in sorted(sizes.items()) if counts.get(p)]

    def append(self, rows: DataFrame, tries: int = 10) -> int:
        """Adds an arrival; gives the version that has it. A column of another type than the store's is an error."""
        merged_schema(self._schema(self.manifest()), rows.schema)
        shards = self._written(rows)
        for _ in range(tries):
            now = self.manifest()
            schema = merged_schema(self._schema(now), rows.schema)
            try:
                self._commit(Manifest(now.version + 1, schema.json(), with_shards(now.parts, shards)), shards)
                return now.version + 1
            except ConflictError:
                continue
        raise ConflictError("other writers kept committing")

    # compaction

    def compact(self, target: int = 64 << 20, least_runs: int = 4, everything: bool = False, waves: int = 4) -> int:
        """Merges until no tier has ``least_runs`` shards; gives the latest version.

        A round is rewritten in ``waves``, each committed, so that a failure costs one wave. Sources stay for ``vacuum``.
        """
        done: set[str] = set()
        while True:
            groups = plan([s for s in self.manifest().shards if s.path not in done], target, least_runs, everything)
            if not groups:
                return self.version()
            for i in range(min(waves, len(groups))):
                made = self._merge(groups[i :: min(waves, len(groups))])
                done |= {s.path for s in made} if everything else set()

    def _merge(self, groups: list[list[Shard]], tries: int = 10) -> list[Shard]:
        sources = [s for g in groups for s in g]
        rows = self.spark.read.schema(self._schema(self.manifest())).parquet(*[f"{self.folder}/{s.path}" for s in sources])
        where, group = free_name(rows, "_shard"), free_name(rows, "_group")
        # a row a source shard; what a merge lists is metadata of this wave
        of = self.spark.createDataFrame([(s.path, i) for i, g in enumerate(groups) for s in g], f"{where} string, {group} int")
        base = F.substring_index(F.col("_metadata.file_path"), "/shards/", -1)
        placed = rows.withColumn(where, F.concat(F.lit("shards/"), base)).join(F.broadcast(of), where).drop(where)
        made = self._written(placed.repartitionById(len(groups), group), group)  # a task a group
        gone = frozenset(s.path for s in sources)
        if sum(s.rows for s in made) != sum(s.rows for s in sources):
            raise RuntimeError("a merge must keep every row")
        for _ in range(tries):
            now = self.manifest()
            if not gone <= {s.path for s in now.shards}:
                raise ConflictError("another writer has merged these shards")
            try:
                self._commit(Manifest(now.version + 1, now.schema, with_shards(now.parts, made, gone)), made)
                return made
            except ConflictError:
                continue
        raise ConflictError("other writers kept committing")

    def vacuum(self, older_than: float = RETENTION) -> None:
        """Deletes versions replaced more than ``older_than`` seconds ago, and the shards and parts that are as old and
        that no version left names."""
        folder, cutoff = self._path("versions"), (time.time() - older_than) * 1000
        if not self.files.exists(folder):
            return
        written = {}
        for status in self.files.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                written[int(name[:-5])] = status.getModificationTime()
        kept = [v for v in written if v + 1 not in written or written[v + 1] >= cutoff]
        manifests = [self.manifest(v) for v in kept]
        named = {s.path for m in manifests for s in m.shards} | {f"versions/parts/{p.name}.json" for m in manifests for p in m.parts}
        for version in written.keys() - set(kept):
            self.files.delete(self._path(f"versions/{version:012d}.json"), False)
        for below in ("versions/parts", "shards"):
            if not self.files.exists(self._path(below)):
                continue
            found, stale = self.files.listFiles(self._path(below), True), []
            while found.hasNext():
                status = found.next()
                text = status.getPath().toString()
                if status.getModificationTime() < cutoff and text[text.rindex(f"{below}/") :] not in named:
                    stale.append(status.getPath())
            for path in stale:
                self.files.delete(path, False)


def tier(size: int, target: int, factor: int = 4) -> int:
    """0 for shards of half the target or more, which are done; else how many times smaller, in steps of ``factor``."""
    return 0 if 2 * size >= target else 1 + int(math.log(target / (2 * max(1, size)), factor))


def plan(shards: list[Shard], target: int, least_runs: int = 4, everything: bool = False) -> list[list[Shard]]:
    """Groups of similarly sized shards to merge, each of up to the target size."""
    tiers: dict[int, list[Shard]] = {}
    for shard in shards:
        level = tier(shard.size, target)
        if level:
            tiers.setdefault(1 if everything else level, []).append(shard)
    groups = []
    for level in sorted(tiers, reverse=True):
        runs = sorted(tiers[level], key=lambda s: (s.size, s.path))
        if len(runs) < (2 if everything else least_runs):
            continue
        group: list[Shard] = []
        for shard in runs:
            if group and sum(s.size for s in group) + shard.size > target:
                groups.append(group)
                group = []
            group.append(shard)
        groups.append(group)
    return [g for g in groups if len(g) > 1]

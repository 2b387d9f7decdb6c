"""Near-duplicate join: pairs of documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more.

Words are runs of anything but ASCII white space, unchanged; a text of fewer words than ``width`` has one shingle, all
of it, and a text without words is like no other. Documents of the same set are one class entry (a *text*) throughout,
so that copies cost nothing and are never expanded into pairs.

Candidates come from a MinHash LSH forest. A text has a path of ``LEVELS`` MinHash values in each of ``TREES`` trees; a
tree is the sorted list of its paths, in which the texts below a trie node lie side by side, so that the longest prefix
that a text shares with any other is one that it shares with its neighbour. Each text starts from its whole paths and
shortens them, in all trees at once, until the chance that a partner shares a prefix in some tree reaches ``recall``; the
chance is that of the least similarity that sets of its size can have at or above the threshold, so that small sets stop
at longer prefixes and sets that can have no partner never start. Trees in which nobody shares the prefix that is left
give no candidates. Of texts below one node, pairs whose signatures agree by far less than the threshold are set aside
(at five standard deviations: of pairs at the threshold 3 in 10 million; ``sifted=False`` sets none aside), the others
are linked to one of them, and linked texts form components. Within a component every pair is verified from the sets of
shingles themselves.

Nodes and components of more than ``BLOCK`` texts are dealt out as pairs of blocks, so that no task holds a group that
grows with the input; tasks return a row a text, never the pairs.

Nulls: a null text is taken as empty. A null id is an id like any other, the least. Rows of one id are separate
documents of that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_column, bounded_batches, discard, materialize, spread
from tagloom.llm.substring_dedup import chunks, mixed, window_hashes, word_hashes, words_of

TREES, LEVELS, BLOCK = 24, 6, 1000
_BASE = 0x9E3779B97F4A7C15
_SEEDS = mixed(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix under which pairs at the threshold meet in some tree with this chance."""
    for depth in range(LEVELS, 0, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return depth
    return 1


def least_similarity(n: int, threshold: float) -> float | None:
    """The least similarity, at or above the threshold, of a set of ``n`` to another set; None if there is none."""
    found = []
    for m in range(int(n * threshold), int(n / threshold) + 2):
        for common in range(max(1, int(threshold * (n + m) / (1 + threshold)) - 1), min(n, m) + 1):
            if common < max(n, m) and common / (n + m - common) >= threshold:
                found.append(common / (n + m - common))
                break
    return min(found, default=None)


def depths_by_size(threshold: float, recall: float, sizes: int = 200) -> list[int]:
    """The prefix that texts of 1, 2, ... ``sizes`` or more shingles search by; 0 for those that can have no partner."""
    least = [least_similarity(n, threshold) for n in range(1, sizes)]
    return [depth_for(x, recall) if x is not None else 0 for x in least] + [depth_for(threshold, recall)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: the distinct shingle hashes of each, sorted, and where they start."""
    starts, ends, counts = words_of(raw, offsets)
    words = word_hashes(raw, starts, ends, _BASE)
    n = np.diff(counts)
    row = np.repeat(np.arange(len(n)), n)
    long = window_hashes(words, width, _BASE)
    inside = np.arange(len(long)) + width <= counts[row[: len(long)] + 1]
    values, rows = [mixed(long[inside])], [row[: len(long)][inside]]
    for size in range(1, width):
        short = np.flatnonzero(n == size)
        if len(short):
            values.append(mixed(window_hashes(words, size, _BASE)[counts[short]] + np.uint64(size)))
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], np.searchsorted(row[fresh], np.arange(len(n) + 1))


def _names(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the set of each text, in which order plays no part."""
    some = np.flatnonzero(np.diff(bounds))
    pair = np.zeros((len(bounds) - 1, 2), np.uint64)
    if len(some):
        at = bounds[:-1][some]
        pair[some, 0] = np.add.reduceat(mixed(values), at)
        pair[some, 1] = np.add.reduceat(mixed(values ^ np.uint64(_BASE)), at)
    return pair


_SIGNED = pa.struct([("n", pa.int64()), ("sid", pa.binary()), ("paths", pa.list_(pa.binary())), ("brief", pa.binary())])
_SIGNED_SPARK = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("paths", T.ArrayType(T.BinaryType())), T.StructField("brief", T.BinaryType()),
])
#: Bytes of a path: that of the tree, and two a level.
PATH_BYTES = 1 + 2 * LEVELS


def _fixed(x: np.ndarray, width: int) -> pa.Array:
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(-1, width)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _sign(width: int):
    """Size and 128-bit name of a text's set, its path in each tree, and a byte of each MinHash value."""

    def sign(texts: pa.Array) -> pa.Array:
        sizes, names, paths, briefs = [], [], [], []
        for _, _, raw, offsets in chunks(texts):
            values, bounds = shingle_sets(raw, offsets, width)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            minima = np.zeros((len(n), TREES * LEVELS), np.uint64)
            if len(some):
                at = bounds[:-1][some]
                for k, seed in enumerate(_SEEDS.tolist()):
                    spun = values * np.uint64(seed)
                    spun ^= spun >> np.uint64(32)
                    minima[some, k] = np.minimum.reduceat(spun, at)
            minima = mixed(minima)
            path = np.empty((len(n), TREES, PATH_BYTES), np.uint8)
            path[:, :, 0] = np.arange(TREES)
            path[:, :, 1:] = (minima >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(len(n), TREES, 2 * LEVELS)
            sizes.append(n)
            names.append(_names(values, bounds))
            paths.append(path)
            briefs.append((minima >> np.uint64(32)).astype(np.uint8))
        n = np.concatenate(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TREES), _fixed(np.concatenate(paths), PATH_BYTES))
        return pa.StructArray.from_arrays([pa.array(n), _fixed(np.concatenate(names), 16), lists, _fixed(np.concatenate(briefs), TREES * LEVELS)], fields=list(_SIGNED))

    return lambda *columns: arrow_column(sign, _SIGNED_SPARK, *columns)


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of paths in sorted order, those that share a prefix of ``depth`` levels with a neighbour.

    What the neighbours beyond the ends of a partition are is not known here: the rows at its ends stay.
    """
    held, shared = None, LEVELS
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch])
        whole = table.combine_chunks().to_batches()[0]
        paths = np.frombuffer(b"".join(whole.column("path").to_pylist()), np.uint8).reshape(-1, PATH_BYTES)
        same = paths[1:] == paths[:-1]
        levels = np.cumprod(same[:, 1::2] & same[:, 2::2] & same[:, :1], axis=1).sum(axis=1)
        before = np.r_[shared, levels]
        longest = np.maximum(before[:-1], levels)
        yield whole.slice(0, whole.num_rows - 1).filter(pa.array(longest >= whole.column("depth").to_numpy()[:-1]))
        held, shared = whole.slice(whole.num_rows - 1), int(before[-1])
    if held is not None:
        yield held


def in_blocks(rows: DataFrame, group: list[str], size: str, member: str) -> DataFrame:
    """Adds ``one`` and ``two``: each row once for every pair of blocks of its group that its own block is in.

    A group of up to BLOCK rows has the one pair (0, 0). ``mine`` is the block of the row.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64(member, F.lit("block")), blocks).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.withColumns({"one": F.least("mine", "_other"), "two": F.greatest("mine", "_other")}).drop("_other")


def _by_run(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of equal keys, and where the runs start."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None and held.num_rows else [batch])
        whole = table.combine_chunks().to_batches()[0]
        starts = _run_starts(whole, keys)
        held = whole.slice(int(starts[-1]))
        if starts[-1] > 0:
            yield whole.slice(0, int(starts[-1])), starts[:-1]
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _run_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for key in keys:
        x = batch.column(key).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in the component of each of n, given linked pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _likely_pairs(brief: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs: every text of a run is compared with all that no earlier comparison has linked it with."""
    ends = np.r_[starts[1:], len(brief)]
    size = ends - starts
    lefts, rights = [], []
    for g in np.unique(size[(size > 1) & (size <= 8)]).tolist():
        first = starts[size == g]
        for i in range(g):
            for j in range(i + 1, g):
                alike = (brief[first + i] == brief[first + j]).mean(axis=1) >= least
                lefts.append(first[alike] + i)
                rights.append(first[alike] + j)
    for s, e in zip(starts[size > 8].tolist(), ends[size > 8].tolist()):
        rest, queue = np.arange(s, e), []
        while len(rest) or queue:
            at = queue.pop() if queue else rest[0]
            rest = rest[rest != at]
            alike = rest[(brief[rest] == brief[at]).mean(axis=1) >= least]
            lefts.append(np.full(len(alike), at))
            rights.append(alike)
            queue += alike.tolist()
            rest = np.setdiff1d(rest, alike, assume_unique=True)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _candidates(least: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _by_run(batches, ["path", "one", "two"]):
            width = len(batch.column("brief")[0].as_py())
            brief = np.frombuffer(b"".join(batch.column("brief").to_pylist()), np.uint8).reshape(-1, width)
            root = _roots(batch.num_rows, *_likely_pairs(brief, starts, least))
            # to the least of the component here, which is the same in most tries: few different links remain
            linked = np.flatnonzero(root != np.arange(len(root)))
            sid = batch.column("sid")
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(linked)), sid.take(pa.array(root[linked]))], names=["a", "b"])

    return link


def components(edges: DataFrame) -> DataFrame:
    """(sid, root): for every end of an edge the least ``sid`` that edges lead to.

    Labels are taken over from neighbours and then from the label's own label, until none changes: as many rounds as
    the logarithm of the longest chain, about.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        taken = labels.join(near, labels["sid"] == near["a"]).select("sid", F.least("root", "m").alias("to"), F.col("root").alias("was"))
        own = labels.select(F.col("sid").alias("to"), F.col("root").alias("further"))
        ahead = materialize(taken.join(own, "to").select("sid", F.least("to", "further").alias("root"), "was"), "labels")
        discard(labels)
        labels = ahead.select("sid", "root")
        if ahead.filter("root != was").isEmpty():
            discard(both)
            return labels


def _members(width: int):
    """The sets of shingles of texts, where they are the ones named (an id may have other texts too)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in chunks(batch.column("text")):
                values, bounds = shingle_sets(raw, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                part = batch.slice(first, end - first)
                named = [a.tobytes() == b for a, b in zip(_names(values, bounds), part.column("sid").to_pylist())]
                columns = [part.column(c) for c in ("sid", "root", "size", "docs")]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["sid", "root", "size", "docs", "shingles"]).filter(pa.array(named, pa.bool_()))

    return sets


def _common(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of ``left`` (rows) shares with each of ``right`` (columns)."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(column):
        return np.zeros((len(left), len(right)), np.int64)
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    total = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int(column[-1]) + 1, 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        has = np.zeros((len(lists), 4096), np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        total += has[left] @ has[right].T
    return total.astype(np.int64)


def _verify(threshold: float):
    """For every text of a pair of blocks: its links there, in texts and documents, and the least text linked to."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _by_run(batches, ["root_key", "one", "two"]):
            sid, docs, mine, one, two = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "docs", "mine", "one", "two"))
            lists = batch.column("shingles")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out: dict[str, list] = {"sid": [], "links": [], "linked_docs": [], "least": []}
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                sets = [values[offsets[i] : offsets[i + 1]] for i in range(s, e)]
                sizes = np.diff(offsets[s : e + 1])
                if one[s] == two[s]:
                    left = right = np.arange(e - s)
                else:
                    left, right = np.flatnonzero(mine[s:e] != two[s]), np.flatnonzero(mine[s:e] == two[s])
                if not len(left) or not len(right):
                    continue
                common = _common(sets, left, right)
                linked = common / (sizes[left][:, None] + sizes[right][None, :] - common) >= threshold
                if left is right:
                    np.fill_diagonal(linked, False)
                a, b = np.nonzero(linked)
                a, b = left[a], right[b]
                if left is not right:
                    a, b = np.r_[a, b], np.r_[b, a]
                if not len(a):
                    continue
                texts = np.bincount(a, minlength=e - s)
                whole = np.bincount(a, weights=docs[s:e][b].astype(np.float64), minlength=e - s)
                root = _roots(e - s, a, b)
                for i in np.flatnonzero(texts).tolist():
                    out["sid"].append(sid[s + i])
                    out["links"].append(int(texts[i]))
                    out["linked_docs"].append(int(whole[i]))
                    out["least"].append(sid[s + int(root[i])])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("sid", pa.binary()), ("links", pa.int64()), ("linked_docs", pa.int64()), ("least", pa.binary())]))

    return verify


def _near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.99999, sifted: bool = True
) -> DataFrame:
    spark = documents.sparkSession
    bounded_batches(spark)
    depths = depths_by_size(threshold, recall)
    wide = spread(spark)
    docs = documents.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("_t"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    signed = materialize(docs.withColumn("s", _sign(width)("text")).select("doc", "_t", "s.n", "s.sid", "s.paths", "s.brief"), "signatures")

    # one text a set of shingles; its documents are a class of copies
    first = F.min(F.struct("doc")).alias("_least"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("brief").alias("brief")
    texts = materialize(signed.filter("n > 0").groupBy("sid").agg(*first).select("sid", F.col("_least.doc").alias("rep"), "docs", "n", "paths", "brief"), "texts")

    # the sorted tries, by ranges: a node that a third of all texts are below spreads over as many tasks as it needs
    depth = F.element_at(F.array(*map(F.lit, depths)), F.least("n", F.lit(len(depths))).cast("int"))
    searching = texts.select("sid", "paths", depth.alias("depth")).filter("depth > 0").select("sid", "depth", F.explode("paths").alias("path"))
    tries = searching.repartitionByRange(wide, "path", "sid").sortWithinPartitions("path", "sid")
    sharing = tries.mapInArrow(_sharing, tries.schema)
    # (small sets search by longer prefixes: below a node of the shortest they may meet more than they need)
    prefix = F.xxhash64(F.substring("path", 1, 1 + 2 * min(d for d in depths if d)))
    members = materialize(sharing.select("sid", prefix.alias("path")), "trie-nodes")
    nodes = members.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
    below = members.join(nodes.hint("merge"), "path").join(texts.select("sid", "brief").hint("merge"), "sid")
    dealt = in_blocks(below, ["path"], "size", "sid").repartition(wide, "path", "one", "two").sortWithinPartitions("path", "one", "two", "sid")
    agreement = threshold - 5 * float(np.sqrt(threshold * (1 - threshold) / (TREES * LEVELS))) if sifted else -1.0
    edges = materialize(dealt.select("path", "one", "two", "sid", "brief").mapInArrow(_candidates(agreement), "a binary, b binary").distinct(), "likely-pairs")
    discard(members)
    grouped = components(edges)
    sizes = grouped.groupBy("root").agg(F.count("*").alias("size"))
    placed = materialize(grouped.join(sizes, "root").join(texts.select("sid", "rep", "docs"), "sid"), "placed")

    # verification from the texts themselves; of rows of one id the one of the right set stays
    # (merge: the same plan at every size, rather than a broadcast of what grows with the documents)
    named = docs.drop("_t").join(placed.hint("merge"), docs["doc"].eqNullSafe(placed["rep"])).select("sid", "root", "size", "docs", "text")
    kinds = "sid binary, root binary, size long, docs long, shingles array<long>"
    sets = named.mapInArrow(_members(width), kinds).dropDuplicates(["sid"])
    sets = materialize(sets, "sets")
    keyed = in_blocks(sets.withColumn("root_key", F.xxhash64("root")), ["root_key"], "size", "sid")
    runs = keyed.select("root_key", "one", "two", "mine", "sid", "docs", "shingles").repartition(wide, "root_key", "one", "two").sortWithinPartitions("root_key", "one", "two", "sid")
    links = materialize(runs.mapInArrow(_verify(threshold), "sid binary, links long, linked_docs long, least binary"), "links")
    discard(sets)
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    joined = components(links.select(F.col("sid").alias("a"), F.col("least").alias("b")))
    reps = texts.select("sid", "rep")
    least = joined.join(reps, "sid").groupBy("root").agg(F.min(F.struct("rep")).alias("_least"))
    classes = materialize(joined.join(least, "root").join(counts, "sid").select("sid", F.col("_least.rep").alias("class_id"), "links", "linked_docs"), "classes")

    discard(placed)
    discard(links)
    told = texts.join(classes, "sid", "left").select("sid", "docs", F.when(F.col("links").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), "links", "linked_docs")
    told = materialize(told, "told")
    for table in (edges, classes, texts):
        discard(table)
    out = signed.select("doc", "_t", "sid", "n").join(told, "sid", "left")
    empty = F.col("n") == 0
    return out.select(
        F.col("doc").alias(id_col),
        "_t",
        F.when(empty, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.coalesce("linked_docs", F.lit(0)) + F.col("docs") - 1).cast("long").alias("n_links"),
        F.when(empty, F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_linked_texts"),
    )


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row a document: ``class_id``, the least id of the documents that links lead to (its own, if to none);
    ``n_links``, the number of other documents like it, and ``n_linked_texts``, that of other sets of shingles among them.
    """
    return _near_duplicates(documents, id_col, text_col, **options).drop("_t")


def one_of_each_class(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` without those whose class has a document of smaller id; of rows of one id and text one stays.

    Texts without words are like no other: each of another id stays.
    """
    told = _near_duplicates(documents, id_col, text_col, **options)
    stays = told.filter(F.col("class_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("_stays"), F.col("_t").alias("_of")).distinct()
    kept = documents.join(stays, documents[id_col].eqNullSafe(stays["_stays"]) & (F.xxhash64(documents[text_col]) == stays["_of"]), "left_semi")
    return kept.dropDuplicates([id_col, text_col])

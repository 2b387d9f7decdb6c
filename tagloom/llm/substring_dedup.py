"""Removal of word windows that repeat across documents, by level-wise doubling.

A window is ``window`` consecutive words of one document. The first level looks at windows of at most ``SEED`` words,
each further level at windows of twice the length (one word less where ``window`` makes it so), the last one at whole
windows: 7 and 13 words, or 7, 13, 25 and 50. At a level below the last, the part of a window that has the least hash
stands for it, so that equal windows are stood for by equal parts at the same place (of 13 words, about a quarter of all
places are looked at). Only windows whose part occurs in more than one document are extended to the next level, until none
is left. The last level groups windows by 96-bit hashes. Longer repeats are unions of windows.

Documents of the same text as one with a smaller id need no windows at all: each of theirs starts in that document.

A window is a repeat if its words also start in a document with a smaller id, in the input; a word covered by a repeat
is removed. Nulls: a null text has no words and stays null; a null id is neither smaller nor larger than another. Rows
that agree in the id do not remove each other's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tagloom.llm.common import arrow_column, bounded_batches, discard, materialize, packed, release, spread, unpacked

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Texts are looked at together up to so many bytes.
CHUNK = 1 << 19
#: The first level's windows have at most so many words.
SEED = 8


def lengths(window: int) -> list[int]:
    """The words that the windows of each level have, each at most twice as many as those before, ``window`` the last."""
    found = [window]
    while found[0] > SEED:
        found.insert(0, (found[0] + 1) // 2)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): runs of texts of about CHUNK bytes. Nulls count as empty."""
    release()
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts laid end to end start and end, and the number of words before each text."""
    word = np.empty(len(raw) + 1, bool)
    np.logical_not((raw == 32) | ((raw >= 9) & (raw <= 13)), out=word[:-1])
    word[-1] = False
    start, end = word[:-1].copy(), word[:-1].copy()
    start[1:] &= ~word[:-2]
    end &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(max(20, int(len(raw)).bit_length()), base)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Of every window of ``length`` words, put together from windows of half the length, level by level."""
    power, level, size = base, words, 1
    for bit in bin(length)[3:]:
        if len(level) <= size:
            return np.empty(0, np.uint64)
        level = level[:-size] * np.uint64(power) + level[size:]
        power, size = power * power % 2**64, 2 * size
        if bit == "1":
            if len(words) <= size:
                return np.empty(0, np.uint64)
            level = level[: len(words) - size] * np.uint64(base) + words[size:]
            power, size = power * base % 2**64, size + 1
    return level if len(words) >= length else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, length: int) -> np.ndarray:
    size = 1
    while size < length:
        step = min(size, length - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def _stand_ins(words: np.ndarray, counts: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows within one text each, the parts of ``length`` words that stand for them, and the row of each."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    least = sliding_min(mixed(window_hashes(words, length, _B1)), window - length + 1)
    row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= counts[row + 1])
    return at, least[at], row[at]


def _kept(words: np.ndarray, counts: np.ndarray, window: int, before: int, lists: pa.Array | None, first: int, end: int) -> np.ndarray | None:
    """Which windows have their part of ``before`` words in the list of their row; None for all, without a level before."""
    if lists is None:
        return None
    offsets, keys = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    of = np.repeat(np.arange(end - first), np.diff(offsets[first : end + 1])).astype(np.uint64) * np.uint64(_B2)
    _, least, row = _stand_ins(words, counts, window, before)
    return np.isin(least + row.astype(np.uint64) * np.uint64(_B2), keys[offsets[first] : offsets[end]] + of)


def _parts(window: int, length: int, before: int | None):
    """The distinct neighbours among the parts of ``length`` words that stand for the windows still in question."""

    def lists(texts: pa.Array, keys: pa.Array | None = None) -> pa.Array:
        sizes, values = [np.zeros(1, np.int64)], [np.empty(0, np.uint64)]
        for first, end, raw, offsets in chunks(texts):
            starts, ends, counts = words_of(raw, offsets)
            words = word_hashes(raw, starts, ends, _B1)
            _, least, row = _stand_ins(words, counts, window, length)
            kept = _kept(words, counts, window, before, keys, first, end)
            if kept is not None:
                least, row = least[kept], row[kept]
            fresh = np.ones(len(least), bool)
            fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            values.append(least[fresh])
            sizes.append(np.bincount(row[fresh], minlength=end - first))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(values).view(np.int64)))

    kind = T.ArrayType(T.LongType(), False)
    if before is None:
        return lambda text: arrow_column(lambda texts: lists(texts), kind, text)
    return lambda *columns: arrow_column(lambda texts, keys: lists(texts, keys), kind, *columns)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, the number of the run of equal keys that each is in, and where the runs start."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _in_two_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document, those whose key has two documents; the ends of a batch stay unseen."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run, starts = _runs(batch.column("key").to_numpy())
        ids = batch.column("_d").to_numpy(zero_copy_only=False)
        ends = np.r_[starts[1:], len(run)] - 1
        alive = ids[starts] != ids[ends]
        alive[0] = alive[-1] = True
        yield batch.filter(pa.array(alive[run]))


def _extend(window: int, before: int | None):
    """Whole windows still in question, by 96 bits of hashes."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, marks = batch.column("keys") if before else None, [batch.column("_d"), batch.column("_t")]
            for first, end, raw, offsets in chunks(batch.column("text")):
                starts, ends, counts = words_of(raw, offsets)
                words = word_hashes(raw, starts, ends, _B1)
                at, _, row = _stand_ins(words, counts, window, window)
                kept = _kept(words, counts, window, before, lists, first, end)
                if kept is not None:
                    at, row = at[kept], row[kept]
                if not len(at):
                    continue
                one = window_hashes(words, window, _B1)[at]
                two = mixed(window_hashes(word_hashes(raw, starts, ends, _B2), window, _B2)[at]) >> np.uint64(32)
                rows = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [*(m.take(rows) for m in marks), pa.array((at - counts[row]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.astype(np.uint32).view(np.int32))],
                    names=["_d", "_t", "place", "h1", "h2"],
                )

    return extend


def _after_the_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hashes and document: those that a smaller document of the same partition has too.

    Rows of the first key of a partition that are not that come as ``open``; the last key comes as ``last`` with its
    least document here, and so does the first: an earlier partition may hold the document that decides.
    """
    key, least, opening = None, None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "_d"))
        run, starts = _runs(h1, h2)
        lows = ids[starts].copy()
        if key == (h1[0], h2[0]):
            lows[0] = least
        elif key is not None:
            opening = False
        later = ids > lows[run]
        state = np.where(later, 0, -1)
        if opening:
            state[(run == 0) & ~later] = 1
            if run[-1] > 0:
                opening = False
        stays = state >= 0
        key, least = (h1[-1], h2[-1]), lows[-1]
        yield batch.append_column("state", pa.array(state.astype(np.int32))).filter(pa.array(stays))
        kept = batch.slice(n - 1, 1)
    if key is not None:
        last = pa.RecordBatch.from_arrays(
            [pa.array([least], kept.schema.field("_d").type) if c == "_d" else kept.column(c) for c in kept.schema.names] + [pa.array([2], pa.int32())],
            names=[*kept.schema.names, "state"],
        )
        yield last


def _later_copies(windows: DataFrame, spark) -> tuple[DataFrame, DataFrame]:
    """(_d, _t, place) of the windows whose words a document of smaller id has too, and the table that it reads.

    The windows are dealt by ranges of (hashes, document), so that a window that a third of all documents have spreads
    over as many tasks as it needs. What one partition cannot know of its first window, the last windows of the
    partitions before it tell: one row a partition, joined to the rows left open.
    """
    dealt = windows.repartitionByRange(spread(spark), "h1", "h2", "_d").sortWithinPartitions("h1", "h2", "_d")
    schema = T.StructType([*windows.schema.fields, T.StructField("state", T.IntegerType())])
    seen = materialize(dealt.mapInArrow(_after_the_first, schema), "later-windows")
    lasts = seen.filter("state = 2").groupBy("h1", "h2").agg(F.min("_d").alias("_lo"))
    opened = seen.filter("state = 1").join(F.broadcast(lasts), ["h1", "h2"]).filter("_d > _lo")
    return seen.filter("state = 0").select("_d", "_t", "place").unionByName(opened.select("_d", "_t", "place")), seen


def _documents(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(_d, _t, text) of the documents that can take part, (_d, _t, _a, _u, _n) of the same, and whether an id has two rows."""
    taking = documents.select(F.col(id_col).alias("_d"), F.col(text_col).cast("binary").alias("text")).filter("_d is not null and text is not null")
    marks = materialize(taking.select("_d", F.xxhash64("text").alias("_a"), F.xxhash64(F.lit("\u0001"), "text").alias("_u"), F.length("text").alias("_n")), "marks")
    repeated = not marks.groupBy("_d").count().filter("count > 1").isEmpty()
    mark = lambda text_hash: text_hash if repeated else F.lit(0).cast("long")
    return taking.withColumn("_t", mark(F.xxhash64("text"))), marks.withColumn("_t", mark(F.col("_a"))), repeated


def repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> tuple[DataFrame, bool]:
    """(_d, _t, whole, runs): of each document that loses words, whether all, or the runs (from, to) of places of words.

    ``_d`` is the id and ``_t`` 0, or a hash of the text if an id has two rows; the second value says which.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs, marks, by_hash = _documents(documents, id_col, text_col)

    # copies of a text under a larger id
    # (merge, here and below: the same plan at every size, rather than a broadcast of what grows with the documents)
    classes = marks.groupBy("_a", "_u", "_n").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).filter("_lo < _hi").drop("_hi")
    classes = materialize(classes, "classes")  # a table of its own, so that the join deals out both sides and a large class can be split
    copies = materialize(marks.join(classes.hint("merge"), ["_a", "_u", "_n"]).filter("_d > _lo").select("_d", "_t").distinct(), "copies")
    discard(classes)
    discard(marks)

    # parts of windows, level by level; a copy has no part in them once the first level has counted it
    shared, before = None, None
    for length in lengths(window)[:-1]:
        if shared is None:
            lists = docs.select("_d", "_t", _parts(window, length, None)("text").alias("keys"))
        else:
            lists = docs.join(shared.hint("merge"), ["_d", "_t"]).select("_d", "_t", _parts(window, length, before)("text", "keys").alias("keys"))
        lists = materialize(lists.filter("size(keys) > 0"), "parts")
        dealt = lists.select("_d", "_t", F.explode("keys").alias("key")).repartitionByRange(spread(spark), "key", "_d").sortWithinPartitions("key", "_d")
        survivors = dealt.mapInArrow(_in_two_documents, dealt.schema).groupBy("_d", "_t").agg(F.collect_set("key").alias("keys"))
        last, shared = shared, materialize(survivors if shared is not None else survivors.join(copies.hint("merge"), ["_d", "_t"], "left_anti"), "shared-parts")
        before = length
        discard(lists)
        if last is not None:
            discard(last)
        if shared.isEmpty():
            break

    # whole windows
    schema = T.StructType([docs.schema["_d"], T.StructField("_t", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType())])
    asked = docs.join(copies.hint("merge"), ["_d", "_t"], "left_anti") if shared is None else docs.join(shared.hint("merge"), ["_d", "_t"]).select("_d", "_t", "text", "keys")
    windows = materialize(asked.mapInArrow(_extend(window, before), schema), "windows")
    if shared is not None:
        discard(shared)
    covered, seen = _later_copies(windows, spark)
    discard(windows)
    order = W.partitionBy("_d", "_t").orderBy("place")
    islands = covered.withColumn("_new", F.when(F.col("place") - F.lag("place").over(order) <= window, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    runs = islands.groupBy("_d", "_t", "_run").agg(F.min("place").alias("a"), (F.max("place") + window).alias("b"))
    listed = runs.groupBy("_d", "_t").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    everything = listed.select("_d", "_t", F.lit(False).alias("whole"), "runs").unionByName(copies.select("_d", "_t", F.lit(True).alias("whole"), F.lit(None).cast(listed.schema["runs"].dataType).alias("runs")))
    found = materialize(everything, "repeats")
    discard(seen)
    discard(copies)
    return found, by_hash


def word_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    raw = np.frombuffer(text, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(np.r_[False, word, False]))
    return edges[::2], edges[1::2]


def _cut(window: int):
    kinds = pa.struct([("text", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def cut(texts: pa.Array, wholes: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, whole, spans in zip(texts.to_pylist(), wholes.to_pylist(), runs.to_pylist()):
            if text is None:
                out.append({"text": None, "n_words": 0, "n_removed": 0})
                continue
            if not whole and spans is None:
                out.append({"text": text, "n_words": len(word_starts(text)[0]), "n_removed": 0})
                continue
            starts, ends = word_starts(text)
            n = len(starts)
            if whole:
                spans = [{"a": 0, "b": n}] if n >= window else []
            kept, at = [], 0
            for span in spans:
                a, b = span["a"], span["b"]
                kept.append(text[at : starts[a]])
                at = starts[b] if b < n else ends[-1]
            kept.append(text[at:])
            out.append({"text": b"".join(kept), "n_words": n, "n_removed": sum(s["b"] - s["a"] for s in spans)})
        return pa.array(out, kinds)

    return lambda *columns: arrow_column(cut, T.StructType([T.StructField("text", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]), *columns)


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``documents`` without the words that repeats cover, and with ``n_words`` and ``n_removed``, in the place of any so named.

    The white space after a removed run goes with it; all other text stays as it is. Order of rows is not kept.
    """
    found, by_hash = repeats(documents, id_col, text_col, window)
    found = found.withColumnsRenamed({"_d": "_rd", "_t": "_rt"})
    text = F.col(f"`{text_col}`").cast("binary")
    keyed = packed(documents, _d=F.col(f"`{id_col}`"), _t=F.xxhash64(text) if by_hash else F.lit(0).cast("long"), _text=text)
    joined = keyed.join(found.hint("merge"), (F.col("_d") == F.col("_rd")) & (F.col("_t") == F.col("_rt")), "left")
    cut = joined.withColumn("_cut", _cut(window)("_text", "whole", "runs"))
    return unpacked(cut, documents.columns, {text_col: F.col("_cut.text").cast("string")}, {c: F.col(f"_cut.{c}") for c in ("n_words", "n_removed")})

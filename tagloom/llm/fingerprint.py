"""Context-triggered piecewise hashes of documents.

A rolling hash over seven bytes ends a chunk wherever its value is block size - 1 modulo the block size; a chunk's
hash becomes one of 64 letters. A fingerprint holds the letters at a block size and at twice that size. The block size
is three times the least power of two, from one that depends on the length alone, under which at most 63 chunks end:
every byte of a text counts, however long it is.

Two fingerprints are compared where their block sizes are equal or one is twice the other: without a common run of
five letters their likeness is 0, else 1 - d / (m + n), where d is the edit distance (insertions and deletions; a
replaced letter is one of each) of the m and n letters. Equal fingerprints have likeness 1.

Nulls: a null text is taken as empty. Documents are ordered by descending id, nulls last, and then by a hash of the text;
equal rows follow each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tagloom.llm.common import bounded_batches, materialize, spread

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LEAST, _MOST, _RUN = 3, 63, 5


def rolling(raw: np.ndarray) -> np.ndarray:
    """The hash of the seven bytes up to each place: their sum, their weighted sum and shifted bits."""
    x = np.zeros(len(raw) + 6, np.uint32)
    x[6:] = raw
    sums = np.cumsum(x, dtype=np.uint32)
    plain = sums[6:].copy()
    plain[1:] -= sums[:-7]
    before = np.zeros(len(raw), np.uint32)
    before[1:] = plain[:-1]
    weighted = np.cumsum(np.uint32(7) * x[6:] - before, dtype=np.uint32)
    two = x.copy()
    two[1:] ^= x[:-1] << np.uint32(5)
    four = two.copy()
    four[2:] ^= two[:-2] << np.uint32(10)
    bits = four[6:] ^ (two[2:-4] << np.uint32(20)) ^ (x[:-6] << np.uint32(30))
    return plain + weighted + bits


def fingerprint(data: bytes) -> str:
    raw = np.frombuffer(data, np.uint8)
    size = _LEAST
    while size * 256 < len(raw):
        size *= 2
    values = rolling(raw)
    ends = np.flatnonzero(values % np.uint32(size) == size - 1)
    values = values[ends]
    while len(ends) > _MOST:
        size *= 2
        stay = values % np.uint32(size) == size - 1
        ends, values = ends[stay], values[stay]
    coarse = ends[values % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{_letters(data, ends)}:{_letters(data, coarse)}"


def _letters(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *(ends + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    crc = zlib.crc32
    return "".join([_LETTERS[crc(data[a:b]) >> 26] for a, b in zip(cuts, cuts[1:])])


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    m, fine_a, coarse_a = a.split(":")
    n, fine_b, coarse_b = b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(fine_a, fine_b), _alike(coarse_a, coarse_b))
    if m == 2 * n:
        return _alike(fine_a, coarse_b)
    if n == 2 * m:
        return _alike(coarse_a, fine_b)
    return 0.0


def _alike(a: str, b: str) -> float:
    if len(a) < _RUN or len(b) < _RUN:
        return 0.0
    runs = {a[i : i + _RUN] for i in range(len(a) - _RUN + 1)}
    if runs.isdisjoint([b[i : i + _RUN] for i in range(len(b) - _RUN + 1)]):
        return 0.0
    # the longest common subsequence, a bit for each letter of a
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for letter in b:
        hit = state & masks.get(letter, 0)
        state = ((state + hit) | (state - hit)) & full
    common = len(a) - state.bit_count()
    return 2 * common / (len(a) + len(b))


_RESULT = pa.schema([
    ("kind", pa.int32()), ("place", pa.int32()), ("doc", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_SPARK = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
_PAIR, _FIRST, _LAST = 0, 1, 2


def _compared(doc: int | None, text: str, own: str, after_text: str, after: str) -> dict:
    n = len(text)
    edited = (text[: n - n // 2] + after_text[: n // 2]).encode("utf-8", "surrogatepass")
    changed = fingerprint(edited)
    return {
        "kind": _PAIR, "doc": doc, "n_chars": n, "edited_sha256": sha256(edited).hexdigest(), "fingerprint": own,
        "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, after),
    }


def _print(text: str) -> str:
    return fingerprint(text.encode("utf-8", "surrogatepass"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted documents, each against the next; the first and the last of the partition are told on with their texts."""
    part, held, rows = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            piece = batch.slice(start, 128)
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                text = text or ""
                now = (doc, text, _print(text))
                if held is None:
                    rows.append({"kind": _FIRST, "place": part, "doc": doc, "text": text})
                else:
                    rows.append(_compared(*held, text, now[2]))
                held = now
            yield pa.RecordBatch.from_pylist(rows, _RESULT)
            rows = []
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"kind": _LAST, "place": part, "doc": held[0], "text": held[1]}], _RESULT)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of a partition against the first of the next that has any."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([_compared(row["doc"], row["text"], _print(row["text"]), row["after"], _print(row["after"]))], _RESULT)


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its fingerprint, that of its edited text, and how near it is to that and to the next document.

    The edited text has the last half of its characters replaced by the first as many of the next document by
    descending id (after the last, the first). The texts are shuffled once, by ranges of the id. Ids are integers (another
    value is cast to one, or null; null comes last); rows of one id follow by a hash of their text. Other columns are
    left out.
    """
    bounded_batches(documents.sparkSession)
    keyed = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    order = [F.col("doc").desc_nulls_last(), F.xxhash64("text").asc()]  # (bounds are sampled to the driver: no texts in them)
    dealt = keyed.repartitionByRange(spread(documents.sparkSession), *order).sortWithinPartitions(*order)
    done = materialize(dealt.mapInArrow(_neighbours, _SPARK), "fingerprints")
    # the next partition with a document: from a row of two numbers a partition
    firsts = done.filter(F.col("kind") == _FIRST).select(F.col("place").alias("at"), F.col("text").alias("after"))
    lasts = done.filter(F.col("kind") == _LAST).select("place", "doc", "text")
    ordered = W.orderBy("place")
    places = lasts.select("place").select("place", F.coalesce(F.lead("place").over(ordered), F.min("place").over(W.partitionBy())).alias("at"))
    seams = lasts.join(places, "place").join(firsts, "at").select("doc", "text", "after").mapInArrow(_seams, _SPARK)
    columns = [F.col("doc").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return done.filter(F.col("kind") == _PAIR).unionByName(seams).select(*columns)

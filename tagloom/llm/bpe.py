"""Byte-level BPE by a hierarchical-bitmap rank queue.

Every pair of neighbouring tokens that the vocabulary can merge waits in the bucket of its merge rank; a bucket
holds positions of a linked list over the pre-token. A two-level bitmap marks the buckets in use: find-first-set on
the upper level names a word, find-first-set on the word names the rank. Entries whose pair has changed since they
were queued are stale and are skipped when they come up. The cost is O(n log n) for a pre-token of n bytes, so a
pre-token of a million letters is no special case.

Nulls: a null text has no ids (an empty array) and a null id array decodes to empty bytes. Invalid ids raise.
"""

from __future__ import annotations

import base64
import re
import struct
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import TwoGenerationCache, arrow_column, held

_BIT = [1 << i for i in range(1 << 12)]
_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]


#: Latin-1's letters, numbers and white space, as Unicode has them.
_LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}


def _latin_twin(pattern: str) -> str | None:
    """A pattern with its classes spelled out that finds the same in Latin-1 texts; None if there is no obvious one.

    The library module for plain patterns is much faster than the one that knows Unicode classes.
    """

    def plain(m: re.Match) -> str:
        inside = re.sub(r"\\p\{[LN]\}|\\s", lambda c: _LATIN[c[0]], m[0])
        if m[0] == r"\S":
            return f"[^{_LATIN[chr(92) + 's']}]"
        return inside if m[0].startswith("[") else f"[{inside}]"

    twin = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", plain, pattern)
    return None if re.search(r"\\[a-zA-Z]|\(\?[a-zA-Z>]|&&|--|[*+?}]\+", twin) else twin


class BytePairCoder:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, ranks_path: str, pattern: str, memo: int = 600_000):
        with open(ranks_path, "rb") as lines:
            self.rank_of = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.token_of = [b""] * (max(self.rank_of.values()) + 1)
        for token, rank in self.rank_of.items():
            self.token_of[rank] = token
        self.find, plain = regex.compile(pattern).findall, _latin_twin(pattern)
        self.find_latin = re.compile(plain).findall if plain else self.find
        self.words = [0] * ((len(self.token_of) >> 8) + 1)  # the lower level of the bitmap, 256 bits a word
        self.buckets: list = [None] * len(self.token_of)  # by rank; all are empty again after a merge
        self.two = [self.rank_of.get(bytes(divmod(pair, 256)), -1) for pair in range(1 << 16)]
        self.up, self.down = list(range(130)), list(range(-1, 129))
        self.memo = TwoGenerationCache(self._packed, memo)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: always the mergeable pair of least rank, the leftmost of equals, first."""
        rank_of = self.rank_of.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = (self.up[1 : n + 2], self.down[: n + 1]) if n < len(self.up) - 2 else (list(range(1, n + 2)), list(range(-1, n)))
        rank_at, words, two, bit = [-1] * (n + 1), self.words, self.two, _BIT
        # a bucket is None, a position, or a heap of positions once it has held two
        buckets = self.buckets
        summary, i, last = 0, -1, 0
        for byte in piece:
            if i >= 0:
                r = two[last << 8 | byte]
                if r >= 0:
                    rank_at[i] = r
                    heap = buckets[r]
                    if heap is None:
                        buckets[r] = i
                        words[r >> 8] |= bit[r & 255]
                        summary |= bit[r >> 8]
                    elif type(heap) is int:
                        buckets[r] = [heap, i]
                    else:
                        heap.append(i)  # ascending positions are a heap already
            last = byte
            i += 1
        while summary:
            w = (summary & -summary).bit_length() - 1
            word = words[w]
            low = word & -word
            r = (w << 8) + low.bit_length() - 1
            i = buckets[r]
            if type(i) is not int:
                heap, i = i, heappop(i)
            else:
                heap = None
            if not heap:
                buckets[r] = None
                words[w] = word ^ low
                if word == low:
                    summary ^= bit[w]
            if rank_at[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            rank_at[j] = rank_at[i] = -1
            if k < n:
                q = rank_of(piece[i : after[k]])
                if q is not None:
                    rank_at[i] = q
                    heap = buckets[q]
                    if heap is None:
                        buckets[q] = i
                        words[q >> 8] |= bit[q & 255]
                        summary |= bit[q >> 8]
                    else:
                        if type(heap) is int:
                            heap = buckets[q] = [heap]
                        heappush(heap, i)
            i = before[i]
            if i >= 0:
                q = rank_of(piece[i:k])
                if q is None:
                    rank_at[i] = -1
                else:
                    rank_at[i] = q
                    heap = buckets[q]
                    if heap is None:
                        buckets[q] = i
                        words[q >> 8] |= bit[q & 255]
                        summary |= bit[q >> 8]
                    else:
                        if type(heap) is int:
                            heap = buckets[q] = [heap]
                        heappush(heap, i)
        ids, i, rank_of = [], 0, self.rank_of
        while i < n:
            j = after[i]
            ids.append(rank_of[piece[i:j]])
            i = j
        return ids

    def _packed(self, pretoken: str) -> bytes:
        ids = self.merge(pretoken.encode("utf-8", "surrogatepass"))
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            text.encode("latin-1")
            found = self.find_latin(text)
        except UnicodeEncodeError:
            found = self.find(text)
        return b"".join(map(self.memo.__getitem__, found))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


def coder(ranks_path: str, pattern: str) -> BytePairCoder:
    """One coder a worker process, whose memo outlives the batches."""
    return held(("bpe", ranks_path, pattern), lambda: BytePairCoder(ranks_path, pattern))


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    values = np.frombuffer(b"".join(packed), "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids of each text as ARRAY<INT>; null texts give empty arrays."""

    def encode(texts: pa.Array) -> pa.Array:
        code = coder(ranks_path, pattern).encode_packed
        return _lists([code(t) if t else b"" for t in texts.to_pylist()])

    return arrow_column(encode, T.ArrayType(T.IntegerType(), False), text, chained=True)


def decode_column(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes that the ids of each row stand for; null arrays give empty bytes."""

    def decode(rows: pa.Array) -> pa.Array:
        back = coder(ranks_path, pattern).decode
        starts, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        valid = rows.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([back(values[a:b].tolist()) if v else b"" for a, b, v in zip(starts[:-1], starts[1:], valid)], pa.binary())

    return arrow_column(decode, T.BinaryType(), ids, chained=True)


def packed_ids_column(ids: Column) -> Column:
    """ARRAY<INT> as BINARY: little-endian unsigned 32-bit integers."""

    def pack(rows: pa.Array) -> pa.Array:
        starts, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        raw = np.ascontiguousarray(values, "<i4").tobytes()
        valid = rows.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([raw[4 * int(a) : 4 * int(b)] if v else b"" for a, b, v in zip(starts[:-1], starts[1:], valid)], pa.binary())

    return arrow_column(pack, T.BinaryType(), ids, chained=True)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` to every row of ``df``; nothing is shuffled."""
    return df.withColumn(ids_col, encode_column(F.col(text_col), ranks_path, pattern))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of ``ids_col`` to every row of ``df``."""
    return df.withColumn(bytes_col, decode_column(F.col(ids_col), ranks_path, pattern))

"""Packing of documents into fixed-length sequences by the sum-of-squares rule.

A bin's *gap* is the room it has left. N(g) counts the open bins of gap g; a piece goes where the sum of N(g)^2 over
all gaps becomes smallest (of equals, into the smallest gap). Only pieces longer than a sequence are cut. Pieces that
fill a sequence take one alone; all others are dealt into groups of about ``GROUP_PIECES`` by a hash of their key, and each
group is packed by itself: groups hold alike mixtures of lengths, so the loss is a few open bins a group, however many
groups there are. A group is packed three times by the rule - longest first with new bins only where nothing fits,
longest first, in key order - and the packing of fewest sequences stays.

Nulls: a null text counts as empty and still has its end id. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import TwoGenerationCache, arrow_column, held, packed, unpacked


_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]
#: Normalizer and pre-tokenizer steps under which a word of Latin letters can go straight to the model.
_DIRECT_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


class WordTokenizer:
    """A ``tokenizers`` file whose tokens never span white space, applied word by word with a memo.

    Words within Latin-1 skip the library's pipeline, which costs more than its merges: NFC leaves them as they are,
    lower-casing is by character, and the split pattern and the byte alphabet are applied here.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = TwoGenerationCache(self._one, memo)
        self.special = [t["content"] for t in plan["added_tokens"]]
        self.model = self.tokenizer.model
        try:
            steps = [x["type"] for x in plan["normalizer"]["normalizers"]], [x["type"] for x in plan["pre_tokenizer"]["pretokenizers"]]
            self.split = regex.compile(plan["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            self.direct = steps == _DIRECT_STEPS
        except (KeyError, TypeError):
            self.direct = False
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the letter that stands for each byte: from the library, two bytes of a character at a time
        self.alphabet = {}
        for code in range(256):
            shown = level.pre_tokenize_str(chr(code))[0][0]
            self.alphabet |= dict(zip(chr(code).encode(), shown))

    def _one(self, word: bytes) -> bytes:
        text = word.decode()
        if self.direct and (text.isascii() or max(text) < "\u0100") and not any(t in text for t in self.special):
            tokens = []
            for part in self.split(text.lower()):
                tokens += self.model.tokenize(part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.alphabet))
            ids = [t.id for t in tokens]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def encode_packed(self, text: bytes) -> bytes:
        # split() knows ASCII white space only; the tokenizer handles any other within a word
        return b"".join(map(self.memo.__getitem__, text.split()))


def word_tokenizer(path: str) -> WordTokenizer:
    return held(("words", path), lambda: WordTokenizer(path))


def token_bytes_column(text: Column, tokenizer_path: str, end_id: int) -> Column:
    """Ids of each text and then ``end_id``, as little-endian unsigned 32-bit integers."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(texts: pa.Array) -> pa.Array:
        code = word_tokenizer(tokenizer_path).encode_packed
        return pa.array([code(t) + end if t else end for t in texts.to_pylist()], pa.binary())

    return arrow_column(encode, T.BinaryType(), text.cast("binary"))


def cut(df: DataFrame, ids_col: str, capacity: int) -> DataFrame:
    """One row a piece: ``piece``, ``start``, ``length`` and ``piece_ids`` (bytes) beside the columns of ``df``, in the
    place of any so named. Null or empty ids have no piece."""
    rows = packed(df, _ids=F.col(f"`{ids_col}`")).withColumn("_n", F.expr("octet_length(_ids) div 4")).filter("_n > 0")
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / capacity).cast("int"))))
    added = {
        "piece": F.col("_piece"),
        "start": F.col("_piece").cast("long") * capacity,
        "length": F.least(F.lit(capacity), F.col("_n") - F.col("_piece") * capacity).cast("long"),
        "piece_ids": F.expr(f"substring(_ids, _piece * {4 * capacity} + 1, {4 * capacity})"),
    }
    return unpacked(pieces, df.columns, added=added)


def sum_of_squares(lengths: np.ndarray, capacity: int, sparing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in the order given: the bin of each (numbered from 0) and its offset there.

    ``sparing``: a new bin is opened only for a piece that fits nowhere, not where it would lower the sum.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum: 2 (N(g-s) - N(g)) + 2 into gap g, less where nothing is left; 2 N(c-s) + 1 for a new bin
        change = 2 * (counts[: capacity - s + 1] - counts[s:]) + 2
        change[0] -= 1
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        fresh = 2 * counts[capacity - s] + 1 if s < capacity else 0
        if counts[best + s] and (sparing or change[best] <= fresh):
            gap = best + s
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


#: Pieces that are packed together.
GROUP_PIECES = 20_000


def pack(pieces: DataFrame, key_cols: list[str], capacity: int, n_groups: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (which has ``length``). Sequences are numbered with gaps.

    Pieces that fill a sequence have ids below zero and are not shuffled. The rest is counted for the number of groups,
    unless that is given.
    """
    pieces = pieces.drop("sequence_id", "offset")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < capacity)
    groups = n_groups or max(1, -(-rest.count() // GROUP_PIECES))

    def fill(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        dealt = rows.sort_values(key_cols, kind="stable")
        longest = dealt.sort_values("length", ascending=False, kind="stable")
        tried = [(r, *sum_of_squares(r["length"].to_numpy(), capacity, sparing)) for r, sparing in ((longest, True), (longest, False), (dealt, False))]
        rows, bins, offsets = min(tried, key=lambda x: x[1].max())
        return rows.assign(sequence_id=bins + (int(key[0]) << 36), offset=offsets)

    return rest.groupBy(F.pmod(F.xxhash64(*key_cols), F.lit(groups))).applyInPandas(fill, schema).unionByName(full)

"""Word edit distance. Spark's own counts characters only; these run over Arrow batches, many pairs at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = T.StructType([T.StructField(n, T.LongType()) for n in ("errors", "words", "insertions", "deletions", "substitutions")])
_ARROW = pa.struct([(n, pa.int64()) for n in ("errors", "words", "insertions", "deletions", "substitutions")])


#: An error, and in the low digits that it is an insertion or a deletion.
_ERROR, _SHIFT = 1 << 32, (1 << 32) + 1
#: Cells of a row of many pairs.
_CELLS = 1 << 18


def _coded(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    names: dict[str, int] = {}
    code = lambda ws: np.fromiter((names.setdefault(w, len(names)) for w in ws), np.int64, len(ws))
    return [(code(a), code(b)) for a, b in pairs]


def counts_of_pairs(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """(insertions, deletions, substitutions) of each (hypothesis, reference): of the alignments of least cost one with the
    fewest insertions and deletions. Pairs of similar length go through the table together, a row of it at a time."""
    out = np.zeros((len(pairs), 3), np.int64)
    coded = _coded(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if a != b), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    while order:
        widest, n = len(pairs[order[-1]][0]) + 1, 1
        while n < len(order) and (n + 1) * widest <= _CELLS:
            n += 1
        group, order = order[-n:], order[:-n]
        lengths = np.array([(len(coded[i][0]), len(coded[i][1])) for i in group])
        hyps, refs = np.full((n, widest - 1), -1), np.full((n, int(lengths[:, 1].max())), -2)
        for k, i in enumerate(group):
            hyps[k, : lengths[k, 0]], refs[k, : lengths[k, 1]] = coded[i]
        along = np.arange(widest) * _SHIFT
        row = np.broadcast_to(along, (n, widest)).copy()
        found = row[np.arange(n), lengths[:, 0]]
        for j in range(refs.shape[1]):
            best = row + _SHIFT
            np.minimum(best[:, 1:], row[:, :-1] + (hyps != refs[:, j : j + 1]) * _ERROR, out=best[:, 1:])
            row = np.minimum.accumulate(best - along, axis=1) + along
            ends = np.flatnonzero(lengths[:, 1] == j + 1)
            found[ends] = row[ends, lengths[ends, 0]]
        errors, shifts = found >> 32, found & (_ERROR - 1)
        longer = lengths[:, 0] - lengths[:, 1]
        out[group] = np.stack([(shifts + longer) // 2, (shifts - longer) // 2, errors - shifts], axis=1)
    return out


def counts(hypothesis: list[str], reference: list[str]) -> tuple[int, int, int]:
    """(insertions, deletions, substitutions) of one pair."""
    return tuple(counts_of_pairs([(hypothesis, reference)])[0].tolist())


def word_errors(hypothesis: Column, reference: Column, characters: bool = False) -> Column:
    """STRUCT<errors, words, insertions, deletions, substitutions> of a pair of texts; null counts as empty.

    ``words`` is the length of the reference, ``characters``: both compared letter by letter.
    """

    def compare(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        split = list if characters else str.split
        pairs = [(split(h or ""), split(r or "")) for h, r in zip(hyps.to_pylist(), refs.to_pylist())]
        kinds, lengths = counts_of_pairs(pairs), np.array([len(r) for _, r in pairs], np.int64)
        columns = [kinds.sum(axis=1), lengths, *kinds.T]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(_ARROW))

    return F.arrow_udf(compare, _KIND)(hypothesis, reference)


# Full-width punctuation and what stands for it.
FULL_WIDTH = {"，": ",", "。": ".", "！": "!", "？": "?", "；": ";", "：": ":", "（": "(", "）": ")", "【": "[", "】": "]", "“": '"', "”": '"', "‘": "'", "’": "'", "、": ","}


def half_width(text: Column) -> Column:
    """NFC, and full-width punctuation as half-width."""
    table = str.maketrans(FULL_WIDTH)

    def change(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t).translate(table) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(change, T.StringType())(text)


def code_points(text: Column) -> Column:
    """U+XXXX of each character and its name, joined by " | "."""

    def name(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " | ".join(f"U+{ord(c):04X} {unicodedata.name(c, 'UNKNOWN')}" for c in t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(name, T.StringType())(text)


def number_words(n: int) -> str:
    """English words of a whole number, British style, up to a million millions."""
    small = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
    if n < 0:
        return f"minus {number_words(-n)}"
    if n < 20:
        return small[n]
    if n < 100:
        return tens[n // 10] + (f"-{small[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{small[n // 100]} hundred" + (f" and {number_words(n % 100)}" if n % 100 else "")
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= size:
            rest = n % size
            joint = " and " if 0 < rest < 100 else ", "
            return f"{number_words(n // size)} {name}" + (f"{joint}{number_words(rest)}" if rest else "")
    raise AssertionError


def spell_all_numbers(text: Column) -> Column:
    """Every whole number of up to 15 digits in words; longer ones stay."""
    import re

    def change(texts: pa.Array) -> pa.Array:
        spell = lambda m: number_words(int(m[0])) if len(m[0]) <= 15 else m[0]
        return pa.array([None if t is None else re.sub(r"\b\d+\b", spell, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(change, T.StringType())(text)

"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word (lower-cased UTF-8 bytes between two marks) in both directions and labels every byte with a
probability for each language; a document's probability is the mean over the bytes of its words. Words of more than
``MAX_BYTES`` bytes are read in pieces, so that text without white space is no special case. Words without a letter
take no part. What the network says of a word depends on the word alone, so it is kept for a word's next occurrence.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Training takes whole documents of a bounded
sample: at most about ``per_language`` documents of each language, and ``words_each`` words of each.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import gru
from tagloom.llm.common import arrow_column, held, packed, some_words, unpacked

MAX_BYTES = 24
_START, _END = 256, 257
_KEEP = 200_000


@dataclass
class LanguageModel:
    languages: list[str]
    weights: dict[str, np.ndarray]
    name: str = ""


def pieces(word: str) -> list[bytes]:
    """The bytes of a word as the network reads them; none if it has no letter."""
    if not any(map(str.isalpha, word)):
        return []
    data = word.lower().encode("utf-8", "surrogatepass")
    return [data[i : i + MAX_BYTES] for i in range(0, len(data), MAX_BYTES)]


def _codes(group: list[bytes]) -> np.ndarray:
    """(time, batch) codes of pieces of one length, with the marks."""
    raw = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), -1).T
    codes = np.empty((raw.shape[0] + 2, raw.shape[1]), np.int64)
    codes[0], codes[-1], codes[1:-1] = _START, _END, raw
    return codes


def _forward(w: dict, codes: np.ndarray, keep: bool = False):
    forwards = gru.run(w["in_f"][codes], w["rec_f"], keep)
    backwards = gru.run(w["in_b"][codes[::-1]], w["rec_b"], keep)
    states_f, states_b = (forwards[0], backwards[0]) if keep else (forwards, backwards)
    both = np.concatenate([states_f, states_b[::-1]], axis=2)
    scores = both @ w["out"] + w["bias"]
    scores -= scores.max(axis=2, keepdims=True)
    chances = np.exp(scores)
    chances /= chances.sum(axis=2, keepdims=True)
    return (chances, both, forwards[1], backwards[1]) if keep else chances


def train(texts: list[str], labels: list[str], units: int = 16, epochs: int = 3, words_each: int = 60, seed: int = 1) -> LanguageModel:
    """Every byte of every sampled word is labelled with its document's language."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    index = {x: i for i, x in enumerate(languages)}
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for text, label in zip(texts, labels):
        words = [p for word in text.split() for p in pieces(word)]
        for k in rng.permutation(len(words))[:words_each].tolist():
            by_length.setdefault(len(words[k]), []).append((words[k], index[label]))
    n = max(1, len(languages))
    w = {
        "in_f": gru.glorot(rng, 258, 3 * units) * 4, "in_b": gru.glorot(rng, 258, 3 * units) * 4, "rec_f": gru.glorot(rng, units, 3 * units),
        "rec_b": gru.glorot(rng, units, 3 * units), "out": gru.glorot(rng, 2 * units, n), "bias": np.zeros(n, np.float32),
    }
    adam = gru.Adam(w, 0.01)
    for epoch in range(epochs):
        batches = []
        for length in sorted(by_length):
            order = rng.permutation(len(by_length[length]))
            batches += [(length, order[i : i + 256]) for i in range(0, len(order), 256)]
        adam.rate = 0.01 / (1 + epoch)
        for b in rng.permutation(len(batches)).tolist():
            length, rows = batches[b]
            chosen = [by_length[length][i] for i in rows.tolist()]
            codes, target = _codes([x for x, _ in chosen]), np.array([y for _, y in chosen])
            chances, both, kept_f, kept_b = _forward(w, codes, keep=True)
            d = chances.copy()
            d[:, np.arange(len(target)), target] -= 1
            d /= d.shape[0] * d.shape[1]
            d_both = d @ w["out"].T
            d_in_f, d_rec_f = gru.backward(d_both[:, :, :units], kept_f)
            d_in_b, d_rec_b = gru.backward(d_both[::-1, :, units:], kept_b)
            grads = {"rec_f": d_rec_f, "rec_b": d_rec_b, "out": np.einsum("tbi,tbj->ij", both, d), "bias": d.sum(axis=(0, 1))}
            for name, at, g in (("in_f", codes, d_in_f), ("in_b", codes[::-1], d_in_b)):
                grads[name] = np.zeros_like(w[name])
                np.add.at(grads[name], at.ravel(), g.reshape(-1, 3 * units))
            adam.step(grads)
    return LanguageModel(languages, w)


class Reader:
    """Applies a model, remembering what it said of words."""

    def __init__(self, model: LanguageModel):
        self.model, n = model, len(model.languages)
        self.rows: dict[bytes, int] = {}
        self.sums = np.zeros((_KEEP, n + 1), np.float32)  # over the bytes of a word; last: their number

    def _learn(self, words: list[bytes]) -> None:
        by_length: dict[int, tuple[list[int], list[bytes]]] = {}
        if len(self.rows) + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(words), _KEEP), self.sums.shape[1]), np.float32)])
        for word in words:
            row = self.rows[word] = len(self.rows)
            self.sums[row] = 0
            for piece in pieces(word.decode("utf-8", "replace")):
                rows, group = by_length.setdefault(len(piece), ([], []))
                rows.append(row)
                group.append(piece)
        for length, (rows, group) in by_length.items():
            for i in range(0, len(group), 2048):
                chances = _forward(self.model.weights, _codes(group[i : i + 2048]))[1:-1].sum(axis=0)
                np.add.at(self.sums, rows[i : i + 2048], np.concatenate([chances, np.full((len(chances), 1), length, np.float32)], axis=1))

    def read(self, texts: list[bytes]) -> np.ndarray:
        """For each text the summed probabilities and the number of bytes."""
        split = [t.split() for t in texts]
        if len(self.rows) > _KEEP:
            self.rows.clear()
        known = self.rows
        fresh = {w for words in split for w in words if w not in known}
        if fresh:
            self._learn(sorted(fresh))
        out = np.zeros((len(texts), self.sums.shape[1]), np.float64)
        row_of = known.__getitem__
        for i, words in enumerate(split):
            if words:
                # each word as often as it occurs, added up in a fixed order
                out[i] = self.sums[np.fromiter(map(row_of, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return out


def predict_column(text: Column, spark, model: LanguageModel) -> Column:
    """STRUCT<lang_pred, score> of each text, the whole of it."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(texts: pa.Array) -> pa.Array:
        reader = held(("langid", shared.value.name), lambda: Reader(shared.value))
        languages, found = np.array(shared.value.languages, object), []
        for start in range(0, len(texts), 64):
            sums = reader.read([t or b"" for t in texts[start : start + 64].to_pylist()])
            chances = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
            best = chances.argmax(axis=1)
            some = sums[:, -1] > 0
            found += zip(np.where(some, languages[best], "und"), np.where(some, chances[np.arange(len(best)), best], 0.0))
        return pa.array([{"lang_pred": str(a), "score": float(min(1.0, b))} for a, b in found], kind)

    kinds = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_column(predict, kinds, text.cast("binary"))


def sample(
    documents: DataFrame, eligible: Column, per_language: int, words_each: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> list[tuple[str, str]]:
    """``words_each`` words of at most about ``per_language`` texts of each language, both chosen by a hash of the id, in a
    fixed order. Words are drawn where the texts are, and are of bounded length: so is what comes to the driver."""
    rows = documents.filter(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    lot = F.pmod(F.xxhash64(F.col(id_col), F.lit("languages")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    words = some_words(F.col(text_col), F.col(id_col), words_each, 1)
    chosen = rows.filter(lot < share).select(F.col(id_col).alias("id"), words.alias("words"), F.col(lang_col).alias("lang"))
    # (twice as many rows are there only if ids have many rows)
    some = chosen.orderBy(F.xxhash64("id", "words")).limit(2 * per_language * len(counts)).collect()
    return [(r[1], r[2]) for r in sorted(some, key=lambda r: (str(r[0]), r[1]))]


def fit(documents: DataFrame, eligible: Column, per_language: int = 600, words_each: int = 60, **names) -> LanguageModel:
    """A model from the ``eligible`` rows of ``documents``: ``words_each`` words of about ``per_language`` texts a language."""
    pairs = sample(documents, eligible, per_language, words_each, **names)
    model = train([t for t, _ in pairs], [lang for _, lang in pairs], words_each=words_each)
    model.name = uuid.uuid4().hex
    return model


def identify(documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, in the place of any so named."""
    told = packed(documents, _text=F.col(f"`{text_col}`"))
    told = told.withColumn("_told", predict_column(F.col("_text"), documents.sparkSession, model))
    return unpacked(told, documents.columns, added={"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")})

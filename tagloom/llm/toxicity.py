"""Toxicity scores by a bidirectional gated recurrent network with attention pooling over words.

A word enters as two vectors side by side: one of the word (hashed, lower-cased, without outer punctuation) and one of
its characters (the greatest value in each dimension over its hashed runs of three to five characters, with its ends
marked). The network reads windows of ``WINDOW`` words, each overlapping the last; attention weighs the states of a
window, and a document scores as its highest window. All windows of a whole text are scored.

Training learns from the highest window of each document, chosen anew each epoch, and from one at random of the clean
ones. The first dimension of both inputs starts from how much more often the word or run occurs in toxic documents of
the sample, in standard deviations. The sample is bounded: at most about ``per_label`` documents of each label.

Nulls: a null text is taken as empty; a text without words scores 0.
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
from tagloom.llm.common import arrow_column, held, some_words

WINDOW, STRIDE, UNITS, DIMS = 32, 24, 8, 4
_WORDS, _RUNS, _KEEP = 1 << 15, 1 << 17, 300_000


@dataclass
class ToxicityModel:
    weights: dict[str, np.ndarray]
    name: str = ""


def plain(word: bytes) -> bytes:
    text = word.decode("utf-8", "replace").lower()
    start, end = 0, len(text)
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return text[start:end].encode("utf-8", "surrogatepass")


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its hash, where its runs of characters start, and the hashes of the runs."""
    data = np.frombuffer(b"".join([b"\x01" + (w or b"\x03") + b"\x02" for w in words]), np.uint8).astype(np.uint64)
    lengths = np.array([max(1, len(w)) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(data))  # bytes of the word from here on
    prime, code = np.uint64(0x100000001B3), data.copy()
    owners, codes = [], []
    for n in range(2, 6):
        code = code[:-1] * prime + data[n - 1 :]
        if n > 2:
            fits = left[: len(code)] >= n
            owners.append(owner[: len(code)][fits])
            codes.append((code[fits] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17))
    whose, runs = np.concatenate(owners), np.concatenate(codes).astype(np.int64)
    order = np.argsort(whose, kind="stable")
    # polynomial over the bytes of the whole word
    weights = np.cumprod(np.full(int(lengths.max()), prime, np.uint64))
    place = np.arange(len(data)) - (ends - lengths)[owner]
    whole = np.add.reduceat(data * weights[place], ends - lengths)
    return ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64), np.searchsorted(whose[order], np.arange(len(words))), runs[order]


_PART = 20_000  # words looked at together


def _in_parts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of any number of words, in memory for a part of them."""
    hashes, starts, runs, n = [], [], [], 0
    for i in range(0, len(words), _PART):
        h, s, r = features(words[i : i + _PART])
        hashes.append(h)
        starts.append(s + n)
        runs.append(r.astype(np.int32))
        n += len(r)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(runs)


def windows(n: int) -> np.ndarray:
    """Where the windows of a text of n words start; the last one reaches its end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _forward(w: dict, x_f: np.ndarray, x_b: np.ndarray, filled: np.ndarray, keep: bool = False):
    """Scores of windows: inputs (time, window, 3 units) in both directions, and which places hold a word."""
    forwards, backwards = gru.run(x_f, w["rec_f"], keep), gru.run(x_b[::-1], w["rec_b"], keep)
    states_f, states_b = (forwards[0], backwards[0]) if keep else (forwards, backwards)
    both = np.concatenate([states_f, states_b[::-1]], axis=2)
    notice = both @ w["attend"]
    notice[~filled] = -30
    notice -= notice.max(axis=0)
    weight = np.exp(notice)
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * both).sum(axis=0)
    score = pooled @ w["out"] + w["bias"][0]
    return (score, both, weight, pooled, forwards[1], backwards[1]) if keep else score


def _gathered(tokens: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (time, windows) of the words of a text's windows, and which places hold one."""
    at = windows(len(tokens))[None, :] + np.arange(WINDOW)[:, None]
    filled = at < len(tokens)
    return base + np.minimum(at, len(tokens) - 1), filled


def _excess(presence: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """How much more often than by chance each feature is in toxic documents: deviations beyond four, scaled."""
    seen, bad = np.zeros(size), np.zeros(size)
    for rows, label in zip(presence, toxic):
        rows = np.unique(rows)
        seen[rows] += 1
        bad[rows] += label
    share = toxic.mean()
    z = (bad - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return np.clip((z - 4) / 4, 0, 2).astype(np.float32)


def train(texts: list[str], toxic: list[int], toxic_share: float | None = None, epochs: int = 8, seed: int = 1) -> ToxicityModel:
    """``toxic_share``: of toxic documents among all labelled ones, to which scores are calibrated; None: as in the texts."""
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    cache: dict[bytes, bytes] = {}
    documents = []
    for text in texts:
        words = [cache.setdefault(x, plain(x)) for x in text.encode("utf-8", "surrogatepass").split()]
        documents.append(np.array([index.setdefault(x, len(index)) for x in words], np.int64))
    labels = np.array(toxic, np.float32)
    used = [i for i, d in enumerate(documents) if len(d)]
    # a word or run that was never seen says nothing
    w = {
        "words": np.zeros((_WORDS, DIMS), np.float32), "runs": np.zeros((_RUNS, DIMS), np.float32),
        "in_f": gru.glorot(rng, 2 * DIMS, 3 * UNITS), "in_b": gru.glorot(rng, 2 * DIMS, 3 * UNITS), "rec_f": gru.glorot(rng, UNITS, 3 * UNITS),
        "rec_b": gru.glorot(rng, UNITS, 3 * UNITS), "scale": np.array([1, 0], np.float32), "attend": gru.glorot(rng, 2 * UNITS, 1)[:, 0], "out": gru.glorot(rng, 2 * UNITS, 1)[:, 0], "bias": np.full(1, -2, np.float32),
    }
    if not used or labels[used].min() == labels[used].max():
        w["out"][:] = 0
        w["bias"][:] = 0.5 if used and labels[used].max() > 0 else -5
        return ToxicityModel(w)
    hashes, starts, runs = _in_parts(list(index))
    bounds = np.r_[starts, len(runs)]
    runs_of = lambda d: np.concatenate([runs[bounds[i] : bounds[i + 1]] for i in np.unique(d).tolist()])
    w["words"][:, 0] = _excess([hashes[documents[i]] for i in used], labels[used], _WORDS)
    w["runs"][:, 0] = _excess([runs_of(documents[i]) for i in used], labels[used], _RUNS)
    adam = gru.Adam({k: v for k, v in w.items() if k != "scale"}, 0.02)
    for epoch in range(epochs):
        adam.rate = 0.02 * 0.7**epoch
        table_f, table_b = _tables(w, hashes, starts, runs)
        chosen = []
        for i, scores in _all_scores(w, table_f, table_b, documents, used):
            chosen.append((i, int(scores.argmax())))
            if not labels[i]:
                chosen.append((i, int(rng.integers(len(scores)))))
        order = rng.permutation(len(chosen))
        for b in range(0, len(order), 128):
            batch = [chosen[k] for k in order[b : b + 128].tolist()]
            _learn(w, adam, batch, documents, labels, hashes, bounds, runs)
    tables = _tables(w, hashes, starts, runs)
    highest = np.array([scores.max() for _, scores in _all_scores(w, *tables, documents, used)])
    w["scale"] = _calibrated(highest, labels[used], toxic_share if toxic_share is not None else float(labels[used].mean()))
    return ToxicityModel(w)


def _all_scores(w: dict, table_f: np.ndarray, table_b: np.ndarray, documents: list[np.ndarray], used: list[int]):
    """(document, scores of its windows), many documents at a time."""
    held, size = [], 0
    for i in used:
        at, filled = _gathered(documents[i], 0)
        held.append((i, documents[i][at], filled))
        size += at.shape[1]
        if size >= 1024 or i == used[-1]:
            rows, mask = np.concatenate([h[1] for h in held], axis=1), np.concatenate([h[2] for h in held], axis=1)
            scores = _forward(w, table_f[rows], table_b[rows], mask)
            cuts = np.cumsum([h[1].shape[1] for h in held])[:-1]
            yield from zip([h[0] for h in held], np.split(scores, cuts))
            held, size = [], 0


def _calibrated(score: np.ndarray, label: np.ndarray, share: float) -> np.ndarray:
    """Factor and offset under which the score is the log odds of a label, at this share of toxic documents."""
    found = label.mean()
    weight = np.where(label > 0, share / found, (1 - share) / (1 - found))
    x, theta = np.stack([score, np.ones(len(score))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (chance - label)) + 0.01 * len(label) * np.array([theta[0] - 1, 0]) * 0.01
        curve = (x * (weight * chance * (1 - chance))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return np.array([max(theta[0], 0.2), theta[1]], np.float32)


def _inputs(w: dict, hashes: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return np.concatenate([w["words"][hashes], np.maximum.reduceat(w["runs"][runs], starts)], axis=1)


def _tables(w: dict, hashes: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    forwards, backwards, bounds = [], [], np.r_[starts, len(runs)]
    for i in range(0, len(hashes), _PART):
        part = slice(i, i + _PART)
        own = runs[bounds[i] : bounds[min(i + _PART, len(hashes))]]
        x = _inputs(w, hashes[part], starts[part] - starts[i], own)
        forwards.append(x @ w["in_f"])
        backwards.append(x @ w["in_b"])
    return np.concatenate(forwards), np.concatenate(backwards)


def _learn(w, adam, batch, documents, labels, hashes, bounds, runs) -> None:
    places, masks = [], []
    for i, window in batch:
        at, filled = _gathered(documents[i], 0)
        places.append(documents[i][at[:, window]])
        masks.append(filled[:, window])
    rows, filled = np.stack(places, axis=1), np.stack(masks, axis=1)
    words, inverse = np.unique(rows, return_inverse=True)
    inverse = inverse.reshape(rows.shape)
    spans = [runs[bounds[k] : bounds[k + 1]] for k in words.tolist()]
    own = np.concatenate(spans)
    starts = np.r_[0, np.cumsum([len(s) for s in spans])[:-1]]
    values = w["runs"][own]
    greatest = np.maximum.reduceat(values, starts)
    x = np.concatenate([w["words"][hashes[words]], greatest], axis=1)
    x_f, x_b = (x @ w["in_f"])[inverse], (x @ w["in_b"])[inverse]
    score, both, weight, pooled, kept_f, kept_b = _forward(w, x_f, x_b, filled, keep=True)
    target = np.array([labels[i] for i, _ in batch], np.float32)
    d_score = (gru.sigmoid(score) - target) / len(batch)
    d_pooled = d_score[:, None] * w["out"][None, :]
    along = (both * d_pooled[None]).sum(axis=2)
    d_notice = weight * (along - (weight * along).sum(axis=0))
    d_both = weight[:, :, None] * d_pooled[None] + d_notice[:, :, None] * w["attend"]
    d_xf, d_rec_f = gru.backward(np.ascontiguousarray(d_both[:, :, :UNITS]), kept_f)
    d_xb, d_rec_b = gru.backward(np.ascontiguousarray(d_both[::-1, :, UNITS:]), kept_b)
    d_f, d_b = np.zeros((len(words), 3 * UNITS), np.float32), np.zeros((len(words), 3 * UNITS), np.float32)
    np.add.at(d_f, inverse.ravel(), d_xf.reshape(-1, 3 * UNITS))
    np.add.at(d_b, inverse[::-1].ravel(), d_xb.reshape(-1, 3 * UNITS))
    d_x = d_f @ w["in_f"].T + d_b @ w["in_b"].T
    grads = {
        "in_f": x.T @ d_f, "in_b": x.T @ d_b, "rec_f": d_rec_f, "rec_b": d_rec_b, "out": pooled.T @ d_score, "bias": np.array([d_score.sum()], np.float32),
        "attend": np.einsum("tbi,tb->i", both, d_notice), "words": np.zeros_like(w["words"]), "runs": np.zeros_like(w["runs"]),
    }
    np.add.at(grads["words"], hashes[words], d_x[:, :DIMS])
    owner = np.repeat(np.arange(len(words)), np.diff(np.r_[starts, len(own)]))
    top = values == greatest[owner]
    np.add.at(grads["runs"], own, top * d_x[owner, DIMS:])
    adam.step(grads)


class Reader:
    """Applies a model, keeping what words enter as."""

    def __init__(self, model: ToxicityModel):
        self.w, self.rows = model.weights, {}
        self.table_f = np.zeros((_KEEP, 3 * UNITS), np.float32)
        self.table_b = np.zeros((_KEEP, 3 * UNITS), np.float32)

    def score(self, texts: list[bytes]) -> list[float]:
        split = [t.split() for t in texts]
        if len(self.rows) > _KEEP:
            self.rows.clear()
        known = self.rows
        fresh = sorted({x for words in split for x in words if x not in known})
        if fresh:
            base, n = len(known), len(known) + len(fresh)
            if n > len(self.table_f):
                self.table_f, self.table_b = (np.concatenate([t, np.zeros((n, 3 * UNITS), np.float32)]) for t in (self.table_f, self.table_b))
            for i in range(0, len(fresh), 20_000):
                part = fresh[i : i + 20_000]
                self.table_f[base + i : base + i + len(part)], self.table_b[base + i : base + i + len(part)] = _tables(self.w, *features([plain(x) for x in part]))
            known.update(zip(fresh, range(base, n)))
        out = [0.0] * len(texts)
        batch, places, masks, size = [], [], [], 0
        for i, words in enumerate(split):
            if not words:
                continue
            tokens = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            at, filled = _gathered(tokens, 0)
            for k in range(0, at.shape[1], 1024):
                batch.append((i, len(at[0, k : k + 1024])))
                places.append(tokens[at[:, k : k + 1024]])
                masks.append(filled[:, k : k + 1024])
                size += batch[-1][1]
                if size >= 1024:
                    self._flush(batch, places, masks, out)
                    batch, places, masks, size = [], [], [], 0
        if batch:
            self._flush(batch, places, masks, out)
        return out

    def _flush(self, batch, places, masks, out) -> None:
        rows = np.concatenate(places, axis=1)
        scores = _forward(self.w, self.table_f[rows], self.table_b[rows], np.concatenate(masks, axis=1))
        scores = gru.sigmoid(scores * self.w["scale"][0] + self.w["scale"][1])
        at = 0
        for i, n in batch:
            out[i] = max(out[i], float(scores[at : at + n].max()))
            at += n


def score_column(text: Column, spark, model: ToxicityModel) -> Column:
    """The score of each text from 0 to 1, over the whole of it."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        reader = held(("toxicity", shared.value.name), lambda: Reader(shared.value))
        found = []
        for start in range(0, len(texts), 64):
            found += reader.score([t or b"" for t in texts[start : start + 64].to_pylist()])
        return pa.array(found, pa.float64())

    return arrow_column(score, T.DoubleType(), text.cast("binary"))


#: Words of a sampled text: so many runs of so many.
SAMPLE_BLOCKS, SAMPLE_BLOCK = 32, 128


def sample(
    documents: DataFrame, labels: DataFrame, eligible: Column, per_label: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[list[tuple[str, int]], float]:
    """At most about ``per_label`` toxic texts and twice as many clean ones, chosen by a hash of the id, in a fixed order.

    Also the share of toxic ones among all labelled. Of texts of more than ``SAMPLE_BLOCKS * SAMPLE_BLOCK`` words so many
    are drawn, in runs, where the texts are: what comes to the driver is bounded.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & eligible).select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, F.lit(min(1.0, per_label / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, 2 * per_label / max(1, counts.get(0, 0)))))
    lot = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = known.filter(lot < share).orderBy(F.xxhash64(id_col, "_label")).limit(4 * per_label)
    texts = documents.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    words = some_words(F.col(text_col), F.col(id_col), SAMPLE_BLOCKS, SAMPLE_BLOCK)
    labelled = texts.join(F.broadcast(drawn), id_col).select(F.col(id_col).alias("id"), words.alias("words"), "_label")
    chosen = labelled.orderBy(F.xxhash64("id", "_label", "words")).limit(4 * per_label).collect()
    pairs = [(r[1], r[2]) for r in sorted(chosen, key=lambda r: (str(r[0]), r[1], r[2]))]
    return pairs, counts.get(1, 0) / max(1, sum(counts.values()))


def fit(documents: DataFrame, labels: DataFrame, eligible: Column, per_label: int = 1500, **names) -> ToxicityModel:
    """A model from the ``eligible`` rows of ``labels`` and their documents."""
    pairs, share = sample(documents, labels, eligible, per_label, **names)
    model = train([t for t, _ in pairs], [y for _, y in pairs], share)
    model.name = uuid.uuid4().hex
    return model


def score(documents: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``documents`` with ``score_col``."""
    return documents.withColumn(score_col, score_column(F.col(text_col), documents.sparkSession, model))

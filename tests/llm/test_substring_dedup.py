import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import substring_dedup as sd


def brute(rows, window=13):
    least = {}
    lists = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    for d, words in lists:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for d, words in lists:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and least[tuple(words[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_levels_double_up_to_the_window():
    assert [sd.lengths(n) for n in (5, 8, 13, 50)] == [[5], [8], [7, 13], [7, 13, 25, 50]]
    assert all(b <= 2 * a for n in range(1, 300) for a, b in zip(sd.lengths(n), sd.lengths(n)[1:]))


@pytest.mark.parametrize("window", [13, 5, 8, 20])
def test_against_every_window(documents, corpus, window):
    rows = sd.deduplicate(documents, window=window).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    got = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in rows), key=key)
    assert got == sorted(brute(corpus, window), key=key)
    assert all(r["_d"] == "own _d" and r["_row"] == "own _row" and r["runs"] == "own runs" for r in rows)
    assert sum(r.text is None for r in rows) == sum(t is None for _, t in corpus)


def test_untouched_text_stays_as_it_is(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"first\n\n{shared}"), (2, f"\tmine  is\n{shared}\n\n here ")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in sd.deduplicate(docs).collect()}
    assert got == {1: f"first\n\n{shared}", 2: "\tmine  is\nhere "}


def test_common_window_over_many_ranges(spark):
    """One passage in every document: its windows are dealt over several tasks, and still have one first document."""
    rng = random.Random(1)
    shared = " ".join(f"w{i}" for i in range(15))
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(5)) + " " + shared) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.doc_id: r.n_removed for r in sd.deduplicate(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: 0 if i == 0 else 15 for i in range(400)}


def test_words_and_hashes():
    texts = pa.array([b" a bb\n", b"", None, b"ccc", b"d a"], pa.binary())
    ((first, end, raw, offsets),) = list(sd.chunks(texts))
    starts, ends, counts = sd.words_of(raw, offsets)
    assert [bytes(raw[a:b]) for a, b in zip(starts, ends)] == [b"a", b"bb", b"ccc", b"d", b"a"]
    assert counts.tolist() == [0, 2, 2, 2, 3, 5] and (first, end) == (0, 5)
    hashes = sd.word_hashes(raw, starts, ends, sd._B1)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    sliced = list(sd.chunks(texts.slice(3)))
    assert bytes(sliced[0][2]) == b"cccd a"


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7, 8, 13])
def test_windows_from_halves(length):
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    naive = []
    for i in range(40 - length + 1):
        h = 0
        for w in words[i : i + length].tolist():
            h = (h * sd._B1 + w) % 2**64
        naive.append(h)
    assert sd.window_hashes(words, length, sd._B1).tolist() == naive
    assert len(sd.window_hashes(words[: length - 1], length, sd._B1)) == 0
    assert sd.sliding_min(words, length).tolist() == [words[i : i + length].min() for i in range(40 - length + 1)]


def test_empty_table(no_documents):
    assert sd.deduplicate(no_documents).count() == 0

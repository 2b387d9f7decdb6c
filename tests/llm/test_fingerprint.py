from hashlib import sha256

import numpy as np
import pytest

from tagloom.llm import fingerprint as fp
from text_order import order_of


def test_rolling_hash_by_definition():
    data = np.frombuffer(("some bytes, été " * 9).encode(), np.uint8)
    for i, value in enumerate(fp.rolling(data).tolist()):
        last = [int(data[i - j]) if i >= j else 0 for j in range(7)]
        bits = 0
        for c in reversed(last):
            bits = (bits << 5 ^ c) & 0xFFFFFFFF
        assert value == (sum(last) + sum((7 - j) * c for j, c in enumerate(last)) + bits) & 0xFFFFFFFF


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
    return row[-1]


@pytest.mark.parametrize("a, b", [("ABCDEFGHIJ", "ABCDEXGHIJ"), ("AAAAABBBBB", "BBBBBAAAAA"), ("ABCDEFG", "XABCDEFGY"), ("ABCDE", "ABCDE")])
def test_likeness_is_edit_distance(a, b):
    assert fp._alike(a, b) == pytest.approx(1 - edit_distance(a, b) / (len(a) + len(b)))


def test_compatible_sizes():
    assert fp.likeness("3:ABCDEFG:ABC", "3:ABCDEFG:ABC") == 1
    assert fp.likeness("6:ABCDEFG:ABC", "3:QQ:ABCDEFX") == pytest.approx(12 / 14)
    assert fp.likeness("3:QQ:ABCDEFX", "6:ABCDEFG:ABC") == pytest.approx(12 / 14)
    assert fp.likeness("12:ABCDEFG:ABC", "3:ABCDEFG:ABC") == 0
    assert fp.likeness("3:ABCDQ:A", "3:ABCDX:A") == 0


def test_whole_texts_count():
    for text in (b"", b"a", b"x" * 100_000, bytes(range(256)) * 500):
        size, fine, coarse = fp.fingerprint(text).split(":")
        assert int(size) >= 3 and len(fine) <= 64 and len(coarse) <= 64
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 50_000).astype(np.uint8).tobytes()
    assert fp.fingerprint(data) != fp.fingerprint(data[:-1] + b"!")
    assert fp.likeness(fp.fingerprint(data), fp.fingerprint(data[:20_000] + b"inserted" + data[20_000:])) > 0.9


def test_next_documents(documents, corpus):
    rows = fp.with_next(documents).collect()
    ordered = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), order_of(r[1])))
    expected = []
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other = fp.fingerprint(text.encode()), fp.fingerprint(edited.encode())
        expected.append((str(doc), len(text), sha256(edited.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, fp.fingerprint(after.encode()))))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows]
    assert sorted(got) == sorted(expected)


def test_small_tables(spark, no_documents):
    assert fp.with_next(no_documents).count() == 0
    one = fp.with_next(spark.createDataFrame([(1, "abcd")], "doc_id int, text string")).first()
    assert one.edited_sha256 == sha256(b"abab").hexdigest() and one.near_next == 1

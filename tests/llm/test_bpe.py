import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tagloom.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(RANKS, P.PATTERN, memo=50)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.rank_of, special_tokens={})


def test_as_the_library(coder, reference):
    rng = random.Random(1)
    letters = "ab aé\x1c\x85 \n\t'sthe日本🙂​ \xa0123!?_-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(400)]
    for text in [*texts, "", "a" * 3000, "ab" * 2000, "<|endoftext|>", " " * 500, "l" * 1000 + "'ll", "\x00\x7f"]:
        ids = np.frombuffer(coder.encode_packed(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), text[:60]
        assert coder.decode(ids) == text.encode()


def test_rank_order_against_rescanning(coder):
    """The queue against the rule itself: look for the least rank anew after every merge."""
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"thesingrda ") for _ in range(rng.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranks = [(coder.rank_of.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min(ranks, default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert [coder.rank_of[p] for p in parts] == coder.merge(piece) or coder.rank_of.get(piece) is not None


def test_vocabulary_without_order():
    """Ranks by chance, so that merges can make pairs of lower rank than their own."""
    rng = random.Random(3)
    tokens = [bytes([b]) for b in range(256)] + sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(60)})
    order = list(range(256, len(tokens)))
    rng.shuffle(order)
    ranks = {t: i if i < 256 else order[i - 256] for i, t in enumerate(tokens)}
    own = bpe.BytePairCoder.__new__(bpe.BytePairCoder)
    own.rank_of, own.words, own.buckets = ranks, [0] * 8, [None] * len(ranks)
    own.two = [ranks.get(bytes(divmod(pair, 256)), -1) for pair in range(1 << 16)]
    own.up, own.down = list(range(130)), list(range(-1, 129))
    library = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        assert own.merge(piece) == library.encode_ordinary(piece.decode())


def test_frames(documents, corpus, reference):
    both = bpe.decode(bpe.encode(documents, RANKS, P.PATTERN, ids_col="keys"), RANKS, P.PATTERN, ids_col="keys", bytes_col="score")
    rows = both.select("doc_id", "text", "keys", "score", "sid").collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert list(r["keys"]) == reference.encode_ordinary(r.text or "")
        assert bytes(r.score) == (r.text or "").encode() and r.sid == "own sid"


def test_packed_ids_and_empty_tables(spark, no_documents):
    row = spark.sql("select array(1, 258) as ids union all select cast(null as array<int>)").select(bpe.packed_ids_column(F.col("ids")).alias("b")).collect()
    assert sorted(bytes(r.b) for r in row) == [b"", b"\x01\0\0\0\x02\x01\0\0"]
    assert bpe.encode(no_documents, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("pattern, found", [(P.PATTERN, True), (r"\p{Lu}+|.", False), (r"a++|.", False), (r"(?i)a|.", False)])
def test_latin_twins(pattern, found):
    assert (bpe._latin_twin(pattern) is not None) is found


def test_latin_twin_finds_the_same(coder):
    rng = random.Random(7)
    assert coder.find_latin is not coder.find
    for _ in range(3000):
        text = "".join(chr(rng.randint(0, 255)) if rng.random() < 0.5 else rng.choice(" ab1.'st\n") for _ in range(rng.randint(0, 30)))
        assert coder.find_latin(text) == coder.find(text), repr(text)

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import packing
from tagloom.llm.queries import packed_documents

PATH = P.path("word_bpe_49k.json")


def test_tokens_as_the_library():
    rng, own, library = random.Random(2), packing.WordTokenizer(PATH, memo=50), Tokenizer.from_file(PATH)
    assert own.direct
    letters = "aB éÀß×÷ªºµ²¼'stdlr\x85\xa0\x1c\x00<|endoftext|>日本ΣİǅÞÿ́\n\t!?.,09\x7f\xad"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for text in [*texts, "<|endoftext|>", "a<|endoftext|>b x", "a" * 3000, *[chr(c) + "x" for c in range(256)]]:
        assert np.frombuffer(own.encode_packed(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("sparing", [True, False])
def test_rule_against_its_definition(sparing):
    rng, capacity = random.Random(3), 20
    lengths = [rng.randint(1, capacity) for _ in range(150)]
    bins, offsets = packing.sum_of_squares(np.array(lengths), capacity, sparing)
    used: dict[int, int] = {}
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        gaps = [capacity - u for u in used.values() if u < capacity]

        def squares(after):
            return sum(after.count(g) ** 2 for g in set(after) if g)

        options = {}
        for g in set(gaps):
            if g >= s:
                rest = list(gaps)
                rest.remove(g)
                options[g] = squares([*rest, g - s])
        fresh = squares([*gaps, capacity - s])
        assert used.get(b, 0) == o and o + s <= capacity
        if b in used:
            assert options[capacity - o] == min(options.values()) and (sparing or options[capacity - o] <= fresh)
        else:
            assert not options or (not sparing and fresh < min(options.values()))
        used[b] = o + s


def test_every_piece_has_its_place(documents, corpus):
    rows = packed_documents(documents).collect()
    library, expected = Tokenizer.from_file(PATH), []
    for doc, text in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        expected += [(doc if doc is not None else -1, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= sum(e[3] for e in expected) // 2048 + 3


def test_groups_and_empty_tables(spark, no_documents):
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 700 + 1).alias("length"))
    packed = packing.pack(pieces, ["doc_id"], 1000, n_groups=4)
    assert packed.count() == 500 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1000").count() == 0
    full = spark.range(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15, 1000).otherwise(400).alias("length"))
    rows = packing.pack(full, ["doc_id"], 1000).collect()
    assert len({r.sequence_id for r in rows if r.length == 1000}) == 15 and len({r.sequence_id for r in rows}) == 18
    assert packed_documents(no_documents).count() == 0
    assert packing.cut(spark.sql("select cast(null as binary) as ids, 'own' as piece"), "ids", 10).count() == 0

"""The pipeline against plain Python, stage by stage, each on its own input."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as brute_jaccard
from test_line_dedup import brute as brute_lines
from test_substring_dedup import brute as brute_windows
from tokenizers import Tokenizer

import corpus_pipeline
from tagloom.llm import langid
from tagloom.llm.queries import language_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents in two made-up languages, with copies, shared lines and passages, and odd rows."""
    rng = random.Random(9)
    letters = {"en": "abcdefg", "de": "mnopqürß"}

    def prose(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "", ".\n"]) for _ in range(n))

    passage, line = prose("en", 40).replace("\n", ""), "This very line is on every other page of them all.\n"
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        text = prose(lang, rng.randint(20, 90))
        if i % 7 == 0:
            text = f"{text} {passage} {prose(lang, 20)}"
        if i % 5 == 0:
            text = f"{prose(lang, 9)}\n{line}{text}"
        rows.append((i, text, lang if i % 4 else None, f"src{i % 3}"))
    for i in range(20):
        words = rows[i][1].replace("\n", " ").split(" ")
        words[len(words) // 2] = f"abc{i}"
        rows.append((200 + i, " ".join(words), "en", "src1"))
        rows.append((300 + i, rows[i][1], "en", "src2"))
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (402, "12 34 ...", None, "s"), (403, "\n \n", "de", "s"), (404, prose("en", 4000), "en", "s")]
    folder = tmp_path_factory.mktemp("tables")
    data = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(data, KIND).repartition(4).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def read(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_each_stage(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = read(docs)
        out = stage(spark, docs, tables)
        assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = read(docs)
        texts = {r[0]: r[1] for r in before}
        if name == "language":
            reader = langid.Reader(language_model(spark.createDataFrame(before, KIND)))
            sums = reader.read([(r[1] or "").encode() for r in before])
            best = sums[:, :-1].max(axis=1) / np.maximum(sums[:, -1], 1)
            assert [r[0] for r in after] == [r[0] for r, p in zip(before, best) if p >= corpus_pipeline.LEAST_SCORE]
            assert {400, 401, 402, 403} & {r[0] for r in after} == set() and len(after) == len(before) - 4
            assert all(r[2] for r in after)
        elif name == "lines":
            kept = {d: t[0] for (d, _), t in brute_lines([r[:2] for r in before]).items() if t[2] < t[1]}
            assert {r[0]: r[1] for r in after} == kept and len(kept) < len(before)
        elif name == "near_duplicates":
            stays = {d for d, least, _, _ in brute_jaccard([r[:2] for r in before]) if d == least}
            assert [r[0] for r in after] == [r[0] for r in before if r[0] in stays] and len(after) < len(before)
            assert all(texts[r[0]] == r[1] for r in after)
        else:
            expected = {d: words for d, n, gone, words in brute_windows([r[:2] for r in before]) if gone < n}
            assert {r[0]: " ".join(re.findall("[^\x20\x09-\x0d]+", r[1])) for r in after} == expected
        assert all(r[4] == len(r[1]) for r in after)


def test_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), KIND)
    library, expected = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        expected += [(r.doc_id, i // 2048, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    rows = corpus_pipeline.run(spark, tables).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == sorted(expected)


def test_extra_columns_and_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(40)
    wide = docs.select("*", *[F.lit("own").alias(c) for c in ("_told", "score", "n_lines", "_row", "sid", "_stays", "piece")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, tables)
        assert out.columns == wide.columns and out.filter("score <> 'own' or _row <> 'own' or _stays <> 'own'").count() == 0
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), tables).count() == 0

import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is was for that on with as by at from this have are not but his her they all one you were their there been".split()


def prose(rng, n, lines=True):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".\n" if lines else ".", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages and lines, and every odd case."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage, line = prose(rng, 30, lines=False), "All of this is said once and for all, and nobody minds.\n"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(6)] + [(150 + i, base[7]) for i in range(5)]
    for i in range(8):  # near copies: a word of many changed
        words = base[i + 10].split(" ")
        words[len(words) // 2] = f"changed{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 25)}") for i in range(6)]
    rows += [(400 + i, f"{prose(rng, 12)}\n{line}{prose(rng, 12)}") for i in range(6)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "..."), (504, "word"), (505, "été ñandú straße"), (None, base[0]), (None, None)]
    rows += [(506, "Ble " * 3000), (507, "\n".join(["same line again"] * 40)), (508, "x" * 5000), (3, base[3]), (3, base[3]), (4, "another text of id four, of some words more than five")]
    rows.append((600, prose(rng, 9000)))
    return rows


#: Names that operators use inside, or add.
CLASHING = ["_d", "_t", "_row", "_text", "keys", "sid", "piece", "start", "n_lines", "n_words", "n_removed", "score", "lang_pred", "doc", "seq", "runs", "_told"]


@pytest.fixture
def documents(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    return df.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

import os
import re

import pytest
from pyspark.sql import functions as F

from tagloom.functions import spoken
from tagloom.operators import vocabularies
from tagloom.plans import QUERIES
from tagloom.plans.views import tagged


@pytest.mark.parametrize(
    "text, expected",
    [
        ("twenty three dollars", "$23"),
        ("one hundred and forty five", "145"),
        ("तेईस", "23"),
        ("पाँच सौ", "500"),
        ("एक हजार", "1000"),
        ("दो लाख", "200000"),
        ("छबीस रुपये", "₹26"),
        ("एक हजार दो सौ पैंतालीस रूपए", "₹1245"),
        ("पचास परसेंट", "50%"),
        ("twenty three dollars and fifty cents", "$23.50"),
        ("two million three hundred thousand and five", "2300005"),
        ("three crore twenty lakh", "32000000"),
        ("one apple and two pears", "one apple and two pears"),
        ("thirteen of them", "13 of them"),
        ("twenty twenty", "20 20"),
        ("twelve percent", "12%"),
        ("", ""),
        ("and hundred", "and hundred"),
    ],
)
def test_written(text, expected):
    assert spoken.written(text) == expected


def test_numbers_read_back():
    from tagloom.functions.edit import number_words

    for n in [13, 20, 21, 99, 100, 101, 110, 999, 1000, 1001, 1100, 12_345, 100_000, 123_456, 999_999, 1_000_000, 7_654_321, 10**9 + 1]:
        assert spoken.written(number_words(n).replace(",", "").replace("-", " ")) == str(n)


def test_entities(value):
    assert value(spoken.formatted_entities, "NER_CARDINAL twenty two END for NER_PERSON jean-luc picard END NER_DATE  today END") == "NER_CARDINAL 22 END for NER_PERSON Jean-luc Picard END NER_DATE today END"
    assert value(spoken.with_punctuation, "Wake me, at nine. Please!", "wake me at ENTITY-4 nine END please") == "Wake me, at ENTITY-4 nine END. Please!"
    got = value(spoken.located_entities, "NER_CITY rome END and rome")
    assert [(r["label"], r["phrase"], r["start"], r["end"]) for r in got] == [("NER_CITY", "rome", 9, 13), ("NER_CITY", "rome", 22, 26)]
    assert value(spoken.with_emotion_mark, " hi ", "Sad") == "<sigh> hi" and value(spoken.with_emotion_mark, "hi", "neu") == "hi"


def test_mixing(spark):
    df = spark.createDataFrame([([0.5, -0.5, 0.5, -0.5], [0.1, 0.1, -0.1], 0.0), ([0.1], None, 0.0), ([], [1.0], 5.0)], "c array<double>, n array<double>, r double")
    got = [r.x for r in df.select(spoken.mixed_at_snr(F.col("c"), F.col("n"), F.col("r")).alias("x")).collect()]
    assert got[0] == pytest.approx([0.99, 0.0, 0.0, 0.0], abs=1e-9) and got[1:] == [[0.1], []]


def test_vocabularies(spark):
    tokens = spark.createDataFrame([("EN", 0, "a"), ("EN", 1, "b"), ("DE", 0, "b"), ("DE", 1, "c")], "lang string, local_id int, token string")
    made = vocabularies.aggregated(tokens)
    assert sorted((r.id, r.token, r.default_lang, r.langs) for r in made.collect()) == [(0, "b", "DE", ["DE", "EN"]), (1, "c", "DE", ["DE"]), (2, "a", "EN", ["EN"])]
    assert sorted(map(tuple, vocabularies.local_to_global(tokens, made).collect())) == [("DE", 0, 0), ("DE", 1, 1), ("EN", 0, 2), ("EN", 1, 0)]
    wide = made.withColumn("family", F.col("default_lang"))
    assert sorted(map(tuple, vocabularies.restricted(wide, ["EN"]).collect())) == [(0, "a")]
    langs = spark.createDataFrame([("EN",), ("FR",)], "lang string")
    assert [r.lang for r in vocabularies.missing(langs, tokens).collect()] == ["FR"]
    batches = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (2, "w")], "batch int, token string")
    got = vocabularies.grown(spark.createDataFrame([("x",)], "token string"), batches, 3)
    assert sorted(r.token for r in got.collect()) == ["x", "y", "z"]
    assert vocabularies.done_before(batches, 4) and not vocabularies.done_before(None, 1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_every_place_of_every_entity(spark):
    """All tagged documents, against brute force and against the operator."""
    docs = tagged(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    expected = []
    for doc, text in docs.collect():
        for label, phrase in re.findall(r"(ENTITY_\w+) (.*?) END", text or ""):
            expected += [(doc, label, phrase, i, i + len(phrase)) for i in range(len(text)) if text.startswith(phrase, i)]
    rows = sorted(map(tuple, QUERIES["prj72_every_entity_place"](spark, "/root/testdata/sf0.001").collect()))
    operator = docs.select("doc_id", F.explode(spoken.located_entities(F.col("text"), "ENTITY_")).alias("e")).select("doc_id", "e.*")
    assert rows == sorted(expected) == sorted(map(tuple, operator.collect()))
    assert {r[0] % 5 for r in rows} >= {1, 2}

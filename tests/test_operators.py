import os

import pytest
from pyspark.sql import functions as F

from tagloom.functions import edit, metadata
from tagloom.operators import audits, filters, metrics, plugins, relations, retrieval, sampling, segments
from tagloom.plans.views import predicted_turns
from tagloom.streaming import events as streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# functions of fields


@pytest.mark.parametrize("years, scheme, expected", [(17.9, "schema", "0_18"), (18.0, "schema", "18_30"), (60.0, "schema", "60PLUS"), (24.9, "decades", "18_24"), (90.0, "decades", "65PLUS")])
def test_age_brackets(value, years, scheme, expected):
    assert value(metadata.age_bracket, years, scheme=scheme) == expected


def test_unknown_ages(value):
    assert value(metadata.age_bracket, -1.0, scheme="inclusive", unknown="UNKNOWN") == "UNKNOWN"
    assert value(metadata.age_of_word, "sixties") == "60PLUS" and value(metadata.age_of_word, "teens") == "18_30"


def test_scripts_and_families(value):
    assert value(metadata.script_family, "привет мир") == "SLAVIC"
    assert value(metadata.script_family, "नमस्ते दुनिया AGE_30_45") == "INDO_ARYAN"
    assert value(metadata.script_family, "AGE_30_45") == "MULTI"
    family = lambda lang, given, text: metadata.language_family(lang, given, text)
    assert value(family, "MULTI", None, "hello there") == "ENGLISH"
    assert value(family, "hi", None, "x") == "INDO_ARYAN"
    assert value(family, "SLAVIC", "ENGLISH", "x") == "SLAVIC"
    assert value(family, "xx", "MINE", "x") == "MINE"


def test_configured_families():
    assert metadata.configured_families({"english": ["en", "en_in"]}) == {"EN": "ENGLISH", "EN_IN": "ENGLISH"}
    assert metadata.configured_families(["fr", {"slavic": ["ru"]}]) == {"FR": "FR", "RU": "SLAVIC"}
    with pytest.raises(ValueError):
        metadata.configured_families({})


def test_paths(value):
    assert value(metadata.rooted, "a/b.wav", root="/data") == "/data/a/b.wav"
    assert value(metadata.rooted, "/old/b.wav", root="/data", remap=("/old", "/new")) == "/new/b.wav"
    assert value(metadata.file_stem, "/x/y.tar.gz") == "y.tar" and value(metadata.file_stem, "/x/.hidden") == ".hidden"
    assert value(metadata.mapped, "cv/en/1.mp3", table=[("cv/", "commonvoice")], root="/n") == "/n/commonvoice/en/1.mp3"
    assert value(metadata.with_extension, "/a.b/c.mp3", extension="wav") == "/a.b/c.wav"
    assert value(metadata.speaker_id, "/d/dev-clean/84/x.flac", "librispeech") == "SPK_ls_84"
    assert value(metadata.speaker_id, "/d/common_voice_fr_123.mp3", "commonvoice_fr") == "SPK_cv_fr_123"
    assert value(metadata.speaker_id, "/mls/audio/77/9/a.flac", "mls_german") == "SPK_mls_german_77"


def test_times_and_replies(value):
    assert value(metadata.clock, "02:05") == 125 and value(metadata.clock, "1:00:01") == 3601
    assert value(metadata.seconds, "n/a") is None and value(metadata.clamped, "9.7") == 5 and value(metadata.clamped, "x") == 3
    got = value(metadata.reply, '```json\n{"a": "b"}\n```', schema="a string", defaults={"a": "d"})
    assert (got["a"], got["broken"]) == ("b", False)
    assert value(metadata.reply, "nonsense", schema="a string", defaults={"a": "d"})["a"] == "d"
    assert value(metadata.prediction_text, '{"text": "hi"}') == "hi"
    assert value(metadata.prediction_text, '["first", "second"]') == "first"
    assert value(metadata.prediction_text, "plain words") == "plain words"
    assert value(metadata.boost_words, "['a', 'b']") == ["a", "b"] and value(metadata.boost_words, "a b") == ["a b"]


def test_repeated_words(spark, value):
    counted = lambda text: metadata.disfluency(text, ["um"], F.lit(0.0))
    for text, fillers, repeats in (("The the THE um\tum\nend", 2, 3), ("a b a", 0, 0), ("a", 0, 0), (" ", 0, 0)):
        got = value(counted, text)
        assert (got.fillers, got.repeats) == (fillers, repeats), text
    assert value(counted, "um um a a a").score == pytest.approx(10 * (2 / 20 * 0.5 + 3 / 10 * 0.2))
    words = [f"w{i % 7 // 2}" for i in range(20_000)]
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.concat(F.lit("w"), F.floor(i % 7 / 2).cast("string"))), " ").alias("text"))
    made = long.select(counted(F.col("text"))["repeats"].alias("repeats"))
    # a text is divided once, not once more for every word of it
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert made.first().repeats == sum(a == b for a, b in zip(words, words[1:]))


# edit distance


@pytest.mark.parametrize("hyp, ref, expected", [("a b c", "a b c", (0, 0, 0)), ("a c", "a b c", (0, 1, 0)), ("a x c", "a b c", (0, 0, 1)), ("a b b c", "a b c", (1, 0, 0)), ("", "a b", (0, 2, 0)), ("a", "", (1, 0, 0)), ("", "", (0, 0, 0))])
def test_word_errors(hyp, ref, expected):
    assert edit.counts(hyp.split(), ref.split()) == expected


def test_word_errors_against_plain_programming():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        ins, dels, subs = edit.counts(a, b)
        assert ins + dels + subs == table[-1][-1] and ins - dels == len(a) - len(b)
        least = {(0, 0): (0, 0)}  # (errors, insertions and deletions)
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [(least[i - 1, j], 1, 1)] if i else []
                ways += [(least[i, j - 1], 1, 1)] if j else []
                ways += [(least[i - 1, j - 1], int(a[i - 1] != b[j - 1]), 0)] if i and j else []
                if ways:
                    least[i, j] = min((x[0] + e, x[1] + s) for x, e, s in ways)
        assert (ins + dels + subs, ins + dels) == least[len(a), len(b)]


def test_pairs_of_all_lengths_together(monkeypatch):
    import random

    rng = random.Random(2)
    pairs = [tuple([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2)) for _ in range(200)]
    alone = [edit.counts(*p) for p in pairs]
    for cells in (1, 50, 1 << 18):
        monkeypatch.setattr(edit, "_CELLS", cells)
        assert list(map(tuple, edit.counts_of_pairs(pairs).tolist())) == alone


def test_numbers_and_letters(value):
    assert value(edit.spell_all_numbers, "12 and 1001 x2") == "twelve and one thousand and one x2"
    assert edit.number_words(1_234_567) == "one million, two hundred and thirty-four thousand, five hundred and sixty-seven"
    assert value(edit.half_width, "ｅ́，好。") == "ｅ́,好."
    assert value(edit.code_points, "a") == "U+0061 LATIN SMALL LETTER A"


# filters


def test_reasons(spark):
    df = spark.sql("select * from values (0.1, 'a', 'p'), (1.0, ' ', 'p'), (1.0, 'a', null), (20.0, 'a', 'p'), (null, 'a', 'p') t(d, t, p)")
    got = [r.reason for r in df.select(filters.merge_reason(F.col("d").cast("double"), F.col("t"), F.col("p")).alias("reason")).collect()]
    assert got == ["duration", "empty_text", "bad_audio", None, "duration"]


def test_missing_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"a": 1}',), ("{broken",), ("[1]",)], "v string")
    assert [r.r for r in df.select(filters.missing_keys(F.col("v"), ["a", "b"]).alias("r")).collect()] == [None, "missing:b", "malformed", "malformed"]


def test_routes_and_labels(value):
    assert value(filters.language_route, "en", codes={"en": "ENGLISH"}).asDict() == {"route": "kept", "lang_family": "ENGLISH"}
    assert value(filters.language_route, None, codes={"en": "ENGLISH"})["lang_family"] == "INDIAN_LOW_RESOURCE"
    assert value(filters.language_route, "zz", codes={"en": "ENGLISH"})["route"] == "removed"
    assert value(filters.single_label, ["a"], excluded=["b"]) is True and value(filters.single_label, ["a", "c"], excluded=[]) is False
    assert value(filters.capped, " ") == "..." and value(filters.capped, "x" * 600) == "x" * 500
    assert value(filters.all_tags_in, "hi AGE_1 END", ["AGE_1", "END"]) is True


def test_rare_words(spark):
    words = spark.createDataFrame([("Ab",), ("Rare",), ("rare",), ("common",), ("unseen",)], "word string")
    counts = spark.createDataFrame([("rare", 2), ("common", 9), ("ab", 1)], "word string, n int")
    assert rows(filters.with_rare_words(words, counts)) == [("Rare",)]


# relations


def test_distinct_on_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, o int")
    assert rows(relations.distinct_on(df, ["k"], ["o"])) == [("a", 1), (None, 3), (None, 4)]


def test_exempt_rows_stay(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 4, "y")], "k string, o int, s string")
    assert rows(relations.first_unless_exempt(df, "k", "o", F.col("s") == "x"), "o") == [(1,), (3,), (4,)]


def test_strict_lookup(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert rows(relations.strict_lookup(left.filter("k = 1"), right, "k")) == [(1, "x")]
    with pytest.raises(Exception, match="no match for k 2"):
        relations.strict_lookup(left, right, "k").collect()


def test_empty_index_lets_all_pass(spark):
    df = spark.createDataFrame([(1, "own")], "k int, sentence string")
    index = spark.createDataFrame([(2, "other")], "k int, text string")
    assert rows(relations.enriched_or_passed(df, index, "k", "text", "sentence")) == []
    assert rows(relations.enriched_or_passed(df, index.limit(0), "k", "text", "sentence")) == [(1, "own", "own")]


def test_numbered_without_one_task(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    got = relations.numbered(df, ["v"]).collect()
    assert sorted((r.v, r.id) for r in got) == [(i, i) for i in range(1000)]


def test_repeats_and_grids(spark):
    df = spark.createDataFrame([(1, 0), (2, 3)], "k int, n int")
    assert rows(relations.repeated(df, F.col("n"))) == [(2, 3, 1), (2, 3, 2), (2, 3, 3)]
    with pytest.raises(ValueError):
        relations.grid(df, spark.range(10), most_right=5)
    assert relations.grid(df, spark.range(3)).count() == 6


# audits and metrics


def test_new_tokens(spark):
    df = spark.createDataFrame([("ENTITY_CITY x END NOPE_X",)] * 15 + [("AGE_1",), (None,)], "text string")
    known = spark.createDataFrame([("▁END",)], "token string")
    assert rows(audits.new_tokens(df, known)) == [("ENTITY_CITY", 15)]
    assert rows(audits.new_tokens(df, known, min_count=1), "token") == [("AGE_1",), ("ENTITY_CITY",)]


def test_special_tokens_end_is_last(spark):
    df = spark.createDataFrame([("(Age_1) age_1, b_c",), ("b_c",)], "text string")
    assert rows(audits.special_tokens(df)) == [(0, "AGE_1", 2), (1, "B_C", 2), (2, "END", 0)]


def test_span_scores(spark):
    df = spark.createDataFrame([(1, "ENTITY_A x END", "ENTITY_A x END ENTITY_A x END"), (2, "none", "ENTITY_B y END"), (3, "ENTITY_B z END", "none")], "k int, ref string, hyp string")
    got = {r.label: r for r in metrics.span_scores(df, "k", F.col("hyp"), F.col("ref")).collect()}
    assert (got["ENTITY_A"].tp, got["ENTITY_A"].gt, got["ENTITY_A"].pred, got["ENTITY_A"].precision, got["ENTITY_A"].recall) == (1, 1, 2, 0.5, 1.0)
    assert (got["ENTITY_B"].tp, got["ENTITY_B"].gt, got["ENTITY_B"].pred) == (0, 1, 1)
    assert got["overall_micro"].precision == pytest.approx(1 / 3)
    assert metrics.span_scores(df.limit(0), "k", F.col("hyp"), F.col("ref")).filter("label = 'overall_macro'").first().fscore is None


def test_error_rates(spark):
    df = spark.createDataFrame([("f", "a b", "a"), ("f", "a", "a b"), ("g", "", "")], "fam string, hyp string, ref string")
    got = metrics.error_rate(df, F.col("hyp"), F.col("ref")).first()
    assert (got.errors, got.words, got.wer, got.ins_rate, got.del_rate) == (2, 3, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert metrics.error_rate(df.filter("fam = 'g'"), F.col("hyp"), F.col("ref")).first().wer == float("inf")
    family = {(r.fam, r.everything): r.errors for r in metrics.family_error_rate(df, F.col("hyp"), F.col("ref"), "fam").collect()}
    assert family == {("f", 0): 2, ("g", 0): 0, (None, 1): 2}
    assert metrics.mean_error_rate(df, F.col("hyp"), F.col("ref")).first().mean_wer == pytest.approx((1 + 0.5 + 0) / 3)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_dropped_words_of_every_turn(spark):
    """All turns, those with newlines, double blanks or blanks at an end among them, against brute force."""
    turns = predicted_turns(spark, "/root/testdata/sf0.001")
    kept = F.expr("array_join(filter(split(text, ' '), (x, i) -> (i + turn) % 5 <> 0), ' ')")
    expected = {}
    for r in turns.select("role", "turn", "text").collect():
        hypothesis = " ".join(x for i, x in enumerate((r.text or "").split(" ")) if (i + r.turn) % 5 != 0)
        errors, words = expected.get(r.role, (0, 0))
        expected[r.role] = (errors + _distance((r.text or "").split(), hypothesis.split()), words + len((r.text or "").split()))
    got = {r.role: (r.errors, r.words) for r in metrics.error_rate(turns, kept, F.col("text"), by=["role"]).collect()}
    assert got == expected


def test_labelled_error_rate(spark):
    df = spark.createDataFrame([("<N1> a b", "<N1> a b"), ("<N2> a", "<N1> a"), ("a", "a")], "hyp string, ref string")
    got = metrics.labelled_error_rate(df, F.col("hyp"), F.col("ref")).first()
    assert (got.labelled_wer, got.unlabelled_wer, got.label_accuracy) == (pytest.approx(1 / 6), 0.0, 0.5)


def test_collapsed_frames(value):
    assert value(metrics.collapse_repeats, [0, 1, 1, 0, 1, 2, 2], blank=0) == [1, 1, 2]


# samples and segments


def test_splits_are_exhaustive(spark):
    for n in (0, 1, 19, 20, 200):
        df = sampling.split(spark.range(n), "id", [("valid", 0.05)], "train", least_first=1)
        got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
        assert sum(got.values()) == n and got.get("valid", 0) == min(n, max(1, n // 20))
        assert got == {r.split: r["count"] for r in df.groupBy("split").count().collect()}


def test_balanced_sampling(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "small", 1.0) for i in range(100)], "id int, fam string, w double")
    got = sampling.balanced(df, "id", "fam", "w", 40, temperature=2.0).collect()
    assert len(got) == 40
    shares = {f: sum(r.fam == f for r in got) for f in ("big", "small")}
    assert shares == {"big": 30, "small": 10}
    assert len({r.id for r in got if r.fam == "big"}) == 30
    more = sampling.balanced(df, "id", "fam", "w", 400, temperature=2.0).collect()
    assert len(more) == 400 and {r.fam for r in more} == {"big", "small"} and all(r.draw >= 1 for r in more)


def test_budget(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(10)], "id int, d double").repartition(4)
    assert rows(sampling.within_budget(df, ["id"], "d", 5.0), "id") == [(0,), (1,), (2,)]


def test_speaker_splits(spark):
    df = spark.createDataFrame([("a b c d", [2.9, 2.1, 9.0, 0.0], 4.0), ("a b", None, 1.0), ("", [1.0], 1.0), ("a b c d", [1.0], 0.4)], "text string, changes array<double>, d double")
    got = rows(segments.split_at_changes(df, "text", "changes", "d"), "piece_text", "piece_offset", "piece_duration")
    assert got == sorted([("a b", 0.0, 2.0), ("c d", 2.0, 2.0), ("a b", 0.0, 1.0), ("", 0.0, 1.0), ("b c d", 0.1, 0.3)], key=str)


def test_marked_segments_keep_the_last(spark):
    words = [("f", 1, "D:", 0.0, 0.1), ("f", 2, "hi", 0.1, 0.5), ("f", 3, "P:", 1.0, 0.1), ("f", 4, "oh", 1.1, 0.4), ("f", 5, "no", 1.5, 0.5)]
    df = spark.createDataFrame(words, "file string, n int, token string, start double, duration double")
    got = segments.marked_segments(df, "file", "n", "token", "start", "duration", {"D:": "Doctor", "P:": "Patient"})
    assert rows(got, "role", "start", "end", "text") == [("Doctor", 0.0, 0.6, "hi"), ("Patient", 1.0, 2.0, "oh no")]


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij", 50.5), ("", 0.5), (None, None)], "t string, d double")
    assert rows(segments.text_chunks(df, "t", 4), "chunk_text") == [("abcd",), ("efgh",), ("ij",)]
    assert rows(segments.text_chunks(df, "t", 4, 2), "chunk_text") == [("abcd",), ("cdef",), ("efgh",), ("ghij",)]
    assert rows(segments.time_chunks(df, "d", 20.0), "chunk_start", "chunk_end") == [(0.0, 20.0), (20.0, 40.0), (40.0, 50.5)]
    assert segments.time_chunks(df, "d", 25.0).count() == 2


def test_voice_activity(spark):
    frames = [("f", i, 10 <= i < 40) for i in range(80)]
    got = segments.voiced_segments(spark.createDataFrame(frames, "f string, n long, v boolean"), "f", "n", "v")
    (found,) = rows(got)
    assert found[1] == 0 and 5 <= found[2] <= 12 and 45 <= found[3] <= 55


def test_timed_spans(spark):
    tokens = "x NER_CITY new york END y NER_DATE now".split()
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(tokens)], "k string, i int, t string")
    assert rows(segments.timed_spans(df, "k", "i", "t", 0.5)) == [("k", "NER_CITY", 0.5, 2.0, "new york")]


def test_parity_pairs(spark):
    lines = ["a", "B-X", "b", "O", "", "c", "O"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "f string, i int, x string")
    assert rows(segments.parity_pairs(df, "f", "i", "x"), "sentence", "token", "tag") == [(0, "a", "B-X"), (0, "b", "O"), (1, "c", "O")]


# retrieval, plug-ins, streams


def test_vector_table(spark, tmp_path):
    store = retrieval.VectorTable(spark, str(tmp_path / "vectors"))
    assert store.rows().count() == 0
    store.add(spark.createDataFrame([("a", "x", "s", [1.0, 0.0]), ("b", "y", "s", [0.0, 2.0]), ("z", "0", "s", [0.0, 0.0])], store.schema))
    assert [r.id for r in store.search([0.0, 1.0], 2).collect()] == ["b", "a"]
    assert [r.id for r in store.search([0.9, 0.0], 1, "l2").collect()] == ["a"]
    store.delete(spark.createDataFrame([("b",)], "id string"))
    assert retrieval.VectorTable(spark, str(tmp_path / "vectors")).rows().count() == 2


def test_annotators(spark):
    df = spark.range(45).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t")).coalesce(1)
    good = plugins.annotated(df, "id", "t", lambda texts: [{"x": t[-1]} for t in texts], {"x": "d"}, batch=20)
    assert sorted((r.id, r.x, r.ok) for r in good.collect()) == [(i, str(i)[-1], True) for i in range(45)]
    short = plugins.annotated(df, "id", "t", lambda texts: [{}], {"x": "d"})
    assert {(r.x, r.ok) for r in short.collect()} == {("d", False)}


def test_translation_keeps_tags(value):
    assert value(plugins.translated, "hello you ENTITY_CITY paris END ok", translate=lambda texts: [t.upper() for t in texts]) == "HELLO YOU ENTITY_CITY PARIS END OK"


def test_tokenizer_with_tags(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([("hello there END fine",), (None,)], "t string")
    got = [r.x for r in df.select(plugins.tokenized(F.col("t"), P.path("piece_bpe_32k.model"), {"END": 40000}).alias("x")).collect()]
    assert got == [[*model.encode("hello there"), 40000, *model.encode("fine")], []]


def test_event_stream(spark, tmp_path):
    spark.range(100).selectExpr("id as event_id", "timestamp_seconds(id * 60) as ts", "id % 3 as user_id", "'view' as event_type", "cast(id as double) as value").coalesce(1).write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    for name, made in (("win", lambda df: streams.windowed(df, "30 minutes")), ("dedup", lambda df: streams.deduplicated(df, ["user_id"], late="1 day").select("user_id"))):
        query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("dedup").count() == 3
    expected = {tuple(r) for r in streams.windowed(static, "30 minutes").collect()}
    got = {tuple(r) for r in spark.table("win").collect()}
    assert got <= expected and len(got) >= 2


def test_resumed_jobs_do_not_repeat(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    spark.range(5).write.json(source)
    for extra in (0, 3):
        if extra:
            spark.range(5, 5 + extra).write.mode("append").json(source)
        streams.resumable(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), sink, check).awaitTermination(120)
    assert sorted(r.twice for r in spark.read.parquet(sink).collect()) == [2 * i for i in range(8)]


def test_quick_check_and_fan_out(spark):
    df = spark.createDataFrame([(1, 1.0, "AGE_1 a", "AGE_2 a"), (2, 9.0, "x", "y"), (3, 2.0, "b", "c"), (4, 2.0, "b", "b")], "id int, d double, hyp string, ref string")
    got = metrics.quick_check(df, F.col("hyp"), F.col("ref"), "d", 0.5, 5.0, 2, "id").first()
    assert (got.clean_wer, got.tagged_wer, got.rows) == (0.5, pytest.approx(2 / 3), 2)
    many = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, files array<string>")
    assert rows(relations.fan_out(many, "files", "file")) == [(1, "a"), (1, "b")]
    assert len(rows(relations.fan_out(many, "files", "file", keep_empty=True))) == 3

import json

import pytest
from pyspark.sql import functions as F

from tagloom.sources import readers, writers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture
def folder(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    write.root = str(tmp_path)
    return write


LINES = "\n".join([json.dumps({"audio_filepath": "a.wav", "text": "नमस्ते", "duration": 1.5, "lang": "hi", "more": 1}), "", "{broken", json.dumps({"text": "no path"}), json.dumps({"audio_filepath": None, "text": "null path", "lang": "en"})]) + "\n"


def test_manifest_and_quarantine(spark, folder):
    good, bad = readers.manifest(spark, folder("m.jsonl", LINES))
    assert rows(good, "line_no", "audio_filepath", "text", "duration") == [(1, "a.wav", "नमस्ते", "1.5"), (5, None, "null path", None)]
    assert json.loads(good.filter("line_no = 1").first().extra)["more"] == 1
    assert rows(bad, "line_no", "reason") == [(3, "malformed"), (4, "missing:audio_filepath")]
    assert readers.lenient_manifest(spark, folder("m2.jsonl", LINES)).count() == 3


def test_line_numbers_over_splits(spark, folder):
    path = folder("long.txt", "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 5001)))
    other = folder("other.txt", "line 1\nline 2")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = readers.lines(spark, [path, other])
        assert got.rdd.getNumPartitions() > 10
        assert all(r.value.split()[1] == str(r.line_no) for r in got.collect()) and got.count() == 5002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_strict_manifest(spark, folder):
    path = folder("ok.jsonl", json.dumps({"audio_filepath": "a", "language": "xx", "lang": "en"}) + "\n")
    assert rows(readers.strict_manifest(spark, path), "audio_filepath", "lang") == [("a", "EN")]
    assert rows(readers.strict_manifest(spark, path, lang_field="language"), "lang") == [("XX",)]
    with pytest.raises(Exception, match="malformed"):
        readers.strict_manifest(spark, folder("bad.jsonl", "{x\n")).collect()
    with pytest.raises(Exception, match="missing language"):
        readers.strict_manifest(spark, folder("nolang.jsonl", '{"audio_filepath": "a"}\n')).collect()


def test_discovery(spark, folder):
    for name in ("one/train.json", "one/audio/x.json", "two/valid.jsonl", "two/train.json.bak", "two/dataset_info.json", "two/val.json"):
        folder(name, "{}")
    found = [p.split(folder.root)[1] for p in readers.discovered(spark, folder.root)]
    assert found == ["/one/train.json", "/two/val.json", "/two/valid.jsonl"]
    assert len(readers.discovered(spark, folder.root, names=("train.json",))) == 1
    assert readers.split_file(spark, f"{folder.root}/two", "valid").endswith("two/val.json")
    assert readers.first_existing(spark, [f"{folder.root}/no", f"{folder.root}/one"]).endswith("one")
    df = spark.createDataFrame([(f"file:{folder.root}/two/sub/x.json",)], "p string")
    assert df.select(readers.dataset_of(F.col("p"), folder.root)).first()[0] == "two"


def test_json_shapes(spark, folder):
    assert rows(readers.json_array(spark, folder("a.json", '[{"x": 1}, {"x": 2}]'), "x int")) == [(1,), (2,)]
    assert rows(readers.json_records(spark, folder("d.json", '{"k": {"x": 1}, "l": {"x": 2}}'), "x: int")) == [("k", 1), ("l", 2)]
    assert rows(readers.json_records(spark, folder("l.json", '[{"x": 5}]'), "x: int")) == [("0", 5)]
    assert rows(readers.by_extension(spark, folder("e.csv", "x\n3\n"), "x int")) == [(3,)]
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.xml", "x int")


def test_separated_values(spark, folder):
    assert rows(readers.tsv(spark, folder("a.tsv", 'path\tsentence\np\tsay "x\n'), "path string, sentence string")) == [("p", 'say "x')]
    assert rows(readers.tsv(spark, folder("b.tsv", "q\ta\n"), "Question string, Answers string", header=False)) == [("q", "a")]
    assert rows(readers.piped(spark, folder("p.txt", "path|text\na|\nb|NA\n"), ["path", "text"])) == [("a", ""), ("b", "NA")]
    table = '# c\n# c\n# YTID, start, end, labels\nid1, 0.000, 10.000, "/m/1,/m/2"\nshort, 1\n'
    assert rows(readers.label_table(spark, folder("l.csv", table))) == [("id1", 0.0, 10.0, ["/m/1", "/m/2"])]
    assert rows(readers.ontology(spark, folder("o.json", '[{"id": "/m/1", "name": "Rain", "x": 1}]'))) == [("/m/1", "Rain")]


def test_speech_formats(spark, folder):
    assert rows(readers.transcripts(spark, folder("t.txt", "u1 hello  there\nu2\n\n")), "utterance", "text") == [("u1", "hello there"), ("u2", "")]
    assert rows(readers.word_timings(spark, folder("w.ctm", "f 1 0.5 0.25 hi\nbad\n")), "file", "start", "duration", "token") == [("f", 0.5, 0.25, "hi")]
    assert rows(readers.three_fields(spark, folder("3.txt", "a\tb\tc d\ne f g h\n"))) == [("a", "b", "c d"), ("e", "f", "g h")]
    with pytest.raises(Exception, match="fewer than three"):
        readers.three_fields(spark, folder("2.txt", "a b\n")).collect()
    chunks = {"state": "s", "gender": "g", "age_group": "a", "task_name": "t", "verbatim": [{"start": 0, "end": 1.5, "text": "x"}, {"start": 2, "end": 3, "text": "y"}]}
    assert rows(readers.chunked_annotations(spark, folder("c.json", json.dumps(chunks, indent=1))), "chunk", "start", "text") == [(0, 0.0, "x"), (1, 2.0, "y")]


def test_files(spark, folder):
    folder("a/one.wav", b"12345")
    folder("a/two.txt", "no audio")
    assert rows(readers.audio_files(spark, f"{folder.root}/a"), "name", "stem", "length") == [("one.wav", "one", 5)]
    assert rows(readers.decoded_text(spark, folder("u.txt", "é")), "text") == [("é",)]
    assert rows(readers.decoded_text(spark, folder("i.txt", b"\xe9")), "text") == [("é",)]
    folder("d/p.html", "<html><style>x{}</style><p>Hi&nbsp;&amp; <b>you</b><!-- no --></p></html>")
    folder("d/q.md", "# plain")
    assert rows(readers.documents(spark, f"{folder.root}/d"), "kind", "text") == [("html", "Hi & you"), ("md", "# plain")]
    spark.range(3).coalesce(1).write.parquet(f"{folder.root}/pq")
    assert rows(readers.audio_parquet(spark, f"{folder.root}/pq"), "id", "row_index") == [(0, 0), (1, 1), (2, 2)]


def test_columns_and_predictions(spark, folder):
    df = spark.createDataFrame([(1, 2)], "Text int, x int")
    assert readers.resolved(df, ["sentence", "text"]) == "Text"
    with pytest.raises(ValueError):
        readers.resolved(df, ["none"])
    path = folder("p.jsonl", "\n".join(json.dumps({"audio_filepath": str(i)}) for i in range(20)) + "\n")
    assert [r.audio_filepath for r in readers.predictions(spark, path, 3).collect()] == ["0", "1", "2"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "été", None, "x"), ("b", "b", 2.0, None)], "audio_filepath string, text string, duration double, reason string")
    path = lambda name: str(tmp_path / name)
    writers.projected_jsonl(df, path("p"))
    assert "été" in "".join(r.value for r in spark.read.text(path("p")).collect())
    assert rows(spark.read.json(path("p")), "audio_filepath", "duration") == [("a", 0.0), ("b", 2.0)]
    writers.valid_and_invalid(df, path("r"))
    assert spark.read.json(path("r/route=valid")).count() == 1 and spark.read.json(path("r/route=invalid")).count() == 1
    writers.jsonl(spark.range(10).coalesce(1), path("n"), rows_a_file=4)
    assert len(spark.read.json(path("n")).inputFiles()) == 3
    changed = df.withColumn("changed", F.col("text") == "b")
    assert writers.rewritten_if_changed(changed, "changed", path("v"), "v2") and not writers.rewritten_if_changed(changed.filter("not changed"), "changed", path("v"), "v3")
    writers.vocabulary_file(spark.createDataFrame([(1, "b"), (0, "z"), (2, "a")], "id int, token string"), path("vocab"))
    assert rows(readers.lines(spark, path("vocab")).filter("value <> ''"), "line_no", "value") == [(1, "z"), (2, "b"), (3, "a")]
    writers.families(spark, {"EN": "ENGLISH"}, path("f"))
    assert readers.load_families(spark, path("f")) == {"EN": "ENGLISH"}
    writers.csv_and_jsonl(df.withColumn("list", F.array("text")), path("two"))
    assert spark.read.option("header", True).csv(path("two/csv")).count() == spark.read.json(path("two/jsonl")).count() == 2
    writers.tables({"one": df, "two": df.limit(1)}, path("report"))
    assert spark.read.parquet(path("report/two")).count() == 1
    writers.by_family(df.withColumn("lang_family", F.lit("ENGLISH")), path("fam"))
    assert spark.read.parquet(path("fam/lang_family=ENGLISH")).count() == 2

"""Queries over manifests made of the driver's tables: sources and sinks by round trip, filters, joins, labels, samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import metadata, spoken, tags
from tagloom.functions.text import lookup
from tagloom.operators import audits, filters, metrics, relations, sampling, segments, vocabularies
from tagloom.plans.audit_queries import _ERRORS
from tagloom.plans.views import NORM, TAGGED, edits, predicted_turns, query, table, tagged
from tagloom.sources import readers, writers


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the driver ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tagloom_shared"
    folder = f"{root.rstrip('/')}/manifests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _written(spark: SparkSession, lines: DataFrame) -> str:
    folder = scratch(spark)
    lines.write.text(folder)
    return folder


# sources and sinks

_LINE = """CASE WHEN doc_id % 10 = 3 THEN concat('{"audio_filepath": "a', doc_id) WHEN doc_id % 10 = 7 THEN concat('{"text": "t', doc_id, '"}') WHEN doc_id % 10 = 9 THEN '  '
  ELSE concat('{"audio_filepath": "/a/', doc_id, '.wav", "text": "', coalesce(source, ''), ' é", "duration": ', doc_id % 40, '.5, "lang": "', coalesce(lang, 'xx'), '"}') END"""


def _manifest(spark: SparkSession, sf: str) -> str:
    return _written(spark, _docs(spark, sf).select(F.expr(_LINE).alias("value")))


@query("src02_quarantined", """SELECT CASE WHEN doc_id % 10 = 3 THEN 'malformed' ELSE 'missing:audio_filepath' END AS reason, count(*) AS n FROM documents WHERE doc_id % 10 IN (3, 7) GROUP BY 1""")
def src02(spark, sf):
    return audits.reason_counts(readers.manifest(spark, _manifest(spark, sf))[1])


@query("src02_manifest", """SELECT concat('/a/', doc_id, '.wav') AS audio_filepath, concat(coalesce(source, ''), ' é') AS text, doc_id % 40 + 0.5::DOUBLE AS duration, coalesce(lang, 'xx') AS lang FROM documents WHERE doc_id % 10 NOT IN (3, 7, 9)""")
def src02b(spark, sf):
    return readers.manifest(spark, _manifest(spark, sf))[0].select("audio_filepath", "text", F.col("duration").cast("double").alias("duration"), "lang")


@query("src01_strict_manifest", """SELECT concat('/a/', doc_id, '.wav') AS audio_filepath, upper(coalesce(lang, 'xx')) AS lang FROM documents WHERE doc_id % 10 NOT IN (3, 7, 9)""")
def src01(spark, sf):
    whole = _docs(spark, sf).filter("doc_id % 10 not in (3, 7, 9)").select(F.expr(_LINE).alias("value"))
    return readers.strict_manifest(spark, _written(spark, whole)).select("audio_filepath", "lang")


@query("src03_lenient_manifest", "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 10 <> 7) AS with_audio FROM documents WHERE doc_id % 10 NOT IN (3, 9)")
def src03(spark, sf):
    return readers.lenient_manifest(spark, _manifest(spark, sf)).agg(F.count("*").alias("n"), F.count("audio_filepath").alias("with_audio"))


@query("src11_records", "SELECT source AS key, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def src11(spark, sf):
    counts = _docs(spark, sf).filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    whole = counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", F.struct("n"))))).alias("value"))
    return readers.json_records(spark, _written(spark, whole), "n bigint")


@query("src13_tsv", "SELECT doc_id, coalesce(source, 'none') AS source, n_chars FROM documents")
def src13(spark, sf):
    rows = _docs(spark, sf).select(F.format_string("%d\t%s\t%d", "doc_id", F.coalesce("source", F.lit("none")), "n_chars").alias("value"))
    return readers.tsv(spark, _written(spark, rows), "doc_id bigint, source string, n_chars bigint", header=False)


@query("src14_piped", "SELECT doc_id::VARCHAR AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def src14(spark, sf):
    rows = _docs(spark, sf).select(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("value"))
    head = spark.createDataFrame([("id|lang|source",)], "value string")
    return readers.piped(spark, _written(spark, rows.unionByName(head)), ["id", "lang", "source"])


@query("src18_transcripts", r"SELECT concat('utt', doc_id) AS utterance, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM documents WHERE text IS NOT NULL")
def src18(spark, sf):
    text = F.regexp_replace("text", "[\\r\\n]+", "  ")
    rows = _docs(spark, sf).filter("text is not null").select(F.concat(F.lit("utt"), "doc_id", F.lit("  "), text).alias("value"))
    return readers.transcripts(spark, _written(spark, rows)).select("utterance", F.md5(F.btrim("text")).alias("text"))


@query("src20_word_timings", "SELECT concat('f', doc_id) AS file, '1' AS channel, doc_id / 4.0 AS start, n_chars / 8.0 AS duration, coalesce(source, 'none') AS token FROM documents")
def src20(spark, sf):
    rows = _docs(spark, sf).select(F.format_string("f%d 1  %s %s\t%s", "doc_id", (F.col("doc_id") / 4).cast("string"), (F.col("n_chars") / 8).cast("string"), F.coalesce("source", F.lit("none"))).alias("value"))
    return readers.word_timings(spark, _written(spark, rows)).select("file", "channel", "start", "duration", "token")


@query("src21_three_fields", "SELECT doc_id::VARCHAR AS utterance, coalesce(lang, 'xx') AS label, CASE WHEN doc_id % 2 = 0 THEN 'a b  c' ELSE 'd e f' END AS text FROM documents")
def src21(spark, sf):
    lang = F.coalesce("lang", F.lit("xx"))
    line = F.when(F.col("doc_id") % 2 == 0, F.format_string("%d\t%s\ta b  c", "doc_id", lang)).otherwise(F.format_string("%d  %s d e f", "doc_id", lang))
    return readers.three_fields(spark, _written(spark, _docs(spark, sf).select(line.alias("value"))))


@query("src23_point_lookup", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 17 = 0")
def src23(spark, sf):
    keyed = _docs(spark, sf).select("doc_id", "n_chars", (F.col("doc_id") % 4).alias("shard"), F.floor(F.col("doc_id") / 4).alias("row"))
    return relations.point_lookup(keyed, keyed.filter("doc_id % 17 = 0"), ["shard", "row"]).select("doc_id", "n_chars")


@query("src27_documents_read_back", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def snk01(spark, sf):
    """JSON lines written and read; letters beyond ASCII stay."""
    folder = scratch(spark)
    writers.jsonl(_docs(spark, sf).filter("text is not null and source is not null").select("source", "text"), folder, rows_a_file=500)
    return spark.read.schema("source string, text string").json(folder).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("snk02_projected", "SELECT doc_id::VARCHAR AS audio_filepath, source AS text, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE doc_id / 2.0 END AS duration FROM documents")
def snk02(spark, sf):
    folder = scratch(spark)
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("audio_filepath"), F.col("source").alias("text"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") / 2).alias("duration"), "lang")
    writers.projected_jsonl(rows, folder)
    return spark.read.schema("audio_filepath string, text string, duration double").json(folder)


@query("snk03_valid_and_invalid", "SELECT CASE WHEN n_chars < 500 THEN 'invalid' ELSE 'valid' END AS route, count(*) AS n FROM documents GROUP BY 1")
def snk03(spark, sf):
    folder = scratch(spark)
    writers.valid_and_invalid(_docs(spark, sf).select("doc_id", F.when(F.col("n_chars") < 500, "short").alias("reason")), folder)
    return spark.read.schema("doc_id bigint, route string").json(folder).groupBy("route").agg(F.count("*").alias("n"))


@query("snk06_by_family", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def snk06(spark, sf):
    """Folders of two families of all that were written."""
    folder = scratch(spark)
    writers.by_family(_docs(spark, sf).filter("lang is not null").select("doc_id", "lang"), folder, "lang")
    return spark.read.schema("doc_id bigint, lang string").parquet(folder).filter(F.col("lang").isin("en", "de"))


@query("snk12_vocabulary_file", "SELECT row_number() OVER (ORDER BY source) AS line_no, source AS value FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def snk12(spark, sf):
    folder = scratch(spark)
    tokens = relations.numbered(_docs(spark, sf).filter("source is not null").select(F.col("source").alias("token")).distinct(), ["token"])
    writers.vocabulary_file(tokens, folder)
    return readers.lines(spark, folder).select("line_no", "value")


# texts and labels


@query("prj08_parsed", rf"WITH {NORM} SELECT doc_id, md5(array_to_string(list_filter(words, lambda w: NOT list_contains(tags, w)), ' ')) AS clean, md5(norm) AS normalized FROM norm")
def prj08(spark, sf):
    both = tags.parse(F.col("text"))
    return tagged(spark, sf).select("doc_id", both.alias("p")).select("doc_id", F.md5("p.clean").alias("clean"), F.md5("p.normalized").alias("normalized"))


@query("prj28_rooted", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('/new/', source, '.wav') ELSE concat('/root/', source, '.wav') END AS path FROM documents WHERE source IS NOT NULL")
def prj28(spark, sf):
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/old/").otherwise(""), "source", F.lit(".wav"))
    return _docs(spark, sf).filter("source is not null").select("doc_id", metadata.rooted(path, "/root", ("/old/", "/new/")).alias("path"))


@query("prj29_mapped", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('/root/cv/', source) WHEN 1 THEN concat('/root/slurp/', source) ELSE concat('/root/', source) END AS path FROM documents WHERE source IS NOT NULL")
def prj29(spark, sf):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "common/").when(F.col("doc_id") % 3 == 1, "/external/").otherwise("/"), "source")
    return _docs(spark, sf).filter("source is not null").select("doc_id", metadata.mapped(path, [("common/", "cv"), ("/external/", "slurp/")], "/root/").alias("path"))


@query("prj32_language_from_path", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN lang END AS found FROM documents WHERE lang IS NOT NULL")
def prj32(spark, sf):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "/data/").when(F.col("doc_id") % 3 == 1, "/x/lang=").otherwise("/other/"), "lang", F.lit("/a.wav"))
    return _docs(spark, sf).filter("lang is not null").select("doc_id", metadata.language_from_path(path, ["/data/([a-z]+)/", "lang=([a-z]+)"]).alias("found"))


@query("prj35_family_or_single", "SELECT doc_id, CASE WHEN lang IS NULL THEN 'UNKNOWN' WHEN lang = 'en' THEN 'GERMANIC' ELSE concat('Singleton_', upper(lang)) END AS family FROM documents")
def prj35(spark, sf):
    return _docs(spark, sf).select("doc_id", metadata.family_or_single(F.col("lang"), {"EN": "GERMANIC"}).alias("family"))


@query("prj37_age_decades", """SELECT doc_id, CASE WHEN a < 18 THEN '0_17' WHEN a < 25 THEN '18_24' WHEN a < 35 THEN '25_34' WHEN a < 45 THEN '35_44' WHEN a < 55 THEN '45_54' WHEN a < 65 THEN '55_64' ELSE '65PLUS' END AS age FROM (SELECT doc_id, doc_id % 90 AS a FROM documents)""")
def prj37(spark, sf):
    return _docs(spark, sf).select("doc_id", metadata.age_bracket(F.col("doc_id") % 90, "decades").alias("age"))


@query("prj38_age_inclusive", """SELECT doc_id, CASE WHEN a IS NULL OR a < 0 THEN 'UNKNOWN' WHEN a < 18 THEN '0_17' WHEN a < 30 THEN '18_29' WHEN a < 45 THEN '30_44' WHEN a < 60 THEN '45_59' ELSE '60PLUS' END AS age
  FROM (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN doc_id % 90 - 5 END AS a FROM documents)""")
def prj38(spark, sf):
    age = F.when(F.col("doc_id") % 11 > 0, F.col("doc_id") % 90 - 5)
    return _docs(spark, sf).select("doc_id", metadata.age_bracket(age, "inclusive", "UNKNOWN").alias("age"))


@query("prj39_age_words", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '18_30' WHEN 1 THEN '45_60' WHEN 2 THEN '60PLUS' ELSE '18_30' END AS age FROM documents")
def prj39(spark, sf):
    word = F.element_at(F.array(*map(F.lit, ["Twenties", "fifties", "nineties", "teens"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", metadata.age_of_word(word).alias("age"))


@query("prj40_codes", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'GENDER_MALE' WHEN 1 THEN 'GENDER_FEMALE' ELSE 'GENDER_OTHER' END AS gender, CASE doc_id % 4 WHEN 0 THEN 'EMOTION_HAPPY' WHEN 1 THEN 'EMOTION_ANGRY' WHEN 2 THEN 'EMOTION_CONTEMPT' ELSE 'EMOTION_NEUTRAL' END AS emotion FROM documents""")
def prj40(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ["hap", "ANG", "contempt", "xyz"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", metadata.gender_of_code(F.col("doc_id") % 3).alias("gender"), metadata.emotion_of_code(code).alias("emotion"))


@query("prj46_emotion_mark", "SELECT doc_id, trim(concat(CASE doc_id % 3 WHEN 0 THEN '<laugh> ' WHEN 1 THEN '<sigh> ' ELSE '' END, source)) AS line FROM documents WHERE source IS NOT NULL")
def prj46(spark, sf):
    emotion = F.element_at(F.array(*map(F.lit, ["HAP", "sad", "neutral"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, sf).filter("source is not null").select("doc_id", F.btrim(spoken.with_emotion_mark(F.col("source"), emotion)).alias("line"))


@query("prj47_noise_label", r"SELECT doc_id, concat('hello ', source) AS clean, CASE WHEN doc_id % 3 = 0 THEN '<N12>' WHEN doc_id % 3 = 1 THEN '<N3>' END AS label FROM documents WHERE source IS NOT NULL")
def prj47(spark, sf):
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, "<N12> ").otherwise(""), F.lit("hello  "), "source", F.when(F.col("doc_id") % 3 == 1, " <N3> <N4>").otherwise(""))
    return _docs(spark, sf).filter("source is not null").select("doc_id", tags.noise_label(line).alias("n")).select("doc_id", "n.clean", "n.label")


_FIRST = r"""SELECT doc_id, nullif(regexp_extract(text, 'EMOTION_(\w+)', 1), '') AS emotion, nullif(regexp_extract(text, 'AGE_(\d+_\d+)', 1), '') AS age, nullif(regexp_extract(text, 'INTENT_(\w+)', 1), '') AS intent, nullif(regexp_extract(text, 'GENDER_(\w+)', 1), '') AS gender FROM tagged"""


@query("prj57_first_tags", f"WITH {TAGGED} {_FIRST}")
def prj57(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.first_tags(F.col("text")).alias("t")).select("doc_id", "t.emotion", "t.age", "t.intent", "t.gender")


@query("prj50_without_tag_letters", rf"""WITH {TAGGED} SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '' AND NOT regexp_matches(w, 'END|ENTITY_|INTENT_|EMOTION_|GENDER_|AGE_|DIALECT_|KEYWORD_|LANG_|OTHER_|ROLE_|SPEAKER_|TURN_|FAMILY_')), ' ')) AS clean FROM tagged""")
def prj50(spark, sf):
    return tagged(spark, sf).select("doc_id", F.md5(tags.strip_tags_containing(F.col("text"))).alias("clean"))


@query("prj51_last_tags", "SELECT doc_id, concat('EMOTION_', lang) AS emotion, 'AGE_2' AS age FROM documents WHERE lang IS NOT NULL")
def prj51(spark, sf):
    line = F.concat(F.lit("AGE_1 EMOTION_X hello AGE_2 EMOTION_"), "lang")
    rows = _docs(spark, sf).filter("lang is not null").select("doc_id", tags.last_tag_by_prefix(line).alias("m"))
    return rows.select("doc_id", F.try_element_at("m", F.lit("EMOTION")).alias("emotion"), F.try_element_at("m", F.lit("AGE")).alias("age"))


@query("prj54_codes_of_parts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('T1_', upper(source)) ELSE concat('T2-', upper(source)) END AS code FROM documents WHERE source IS NOT NULL")
def prj54(spark, sf):
    word = F.concat(F.when(F.col("doc_id") % 2 == 0, "ENTITY_").otherwise("DOMAIN-"), F.upper("source"))
    return _docs(spark, sf).filter("source is not null").select("doc_id", tags.to_codes(word, {"ENTITY": "T1", "DOMAIN": "T2"}).alias("code"))


@query("prj56_names", "SELECT doc_id, concat('VERY_', upper(source)) AS emotion, concat('INTENT_', upper(source)) AS intent FROM documents WHERE source IS NOT NULL")
def prj56(spark, sf):
    docs = _docs(spark, sf).filter("source is not null")
    return docs.select("doc_id", tags.emotion_name(F.concat(F.lit(" emotion_very-"), "source", F.lit("! "))).alias("emotion"), tags.intent_name(F.concat(F.lit(" "), "source")).alias("intent"))


@query("prj58_prediction_texts", "SELECT doc_id, source AS text FROM documents WHERE source IS NOT NULL")
def prj58(spark, sf):
    quoted = F.concat(F.lit('"'), "source", F.lit('"'))
    kinds = [F.col("source"), quoted, F.concat(F.lit('{"text": '), quoted, F.lit("}")), F.concat(F.lit('[{"pred_text": '), quoted, F.lit("}, 1]")), F.concat(F.lit("["), quoted, F.lit("]"))]
    raw = F.element_at(F.array(*kinds), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, sf).filter("source is not null").select("doc_id", metadata.prediction_text(raw).alias("text"))


@query("prj61_recordings", "SELECT doc_id, unnest(range(0, doc_id % 4)) AS recording FROM documents")
def prj61(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.filter(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4), lambda i: i < F.col("doc_id") % 4).alias("recordings"))
    return relations.fan_out(docs, "recordings", "recording")


@query("prj63_boost_words", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('a|', source) ELSE source END AS words FROM documents WHERE source IS NOT NULL")
def prj63(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("['a', '"), "source", F.lit("']"))).otherwise(F.col("source"))
    return _docs(spark, sf).filter("source is not null").select("doc_id", F.array_join(metadata.boost_words(raw), "|").alias("words"))


@query("prj67_entities_and_intent", rf"""WITH {TAGGED} SELECT doc_id, concat(array_to_string(regexp_extract_all(text, 'ENTITY_[A-Z_]+ .*? END'), ' '), CASE WHEN regexp_matches(text, 'INTENT_[A-Z_]+') THEN concat(' ', regexp_extract(text, 'INTENT_[A-Z_]+')) ELSE '' END) AS line FROM tagged""")
def prj67(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.entities_and_intent(F.col("text")).alias("line"))


@query("prj68_components", "SELECT doc_id, concat('say ', source, ' now') AS text, 'ENTITY|CITY|END|INTENT|ASK|DOMAIN|a' AS parts FROM documents WHERE source IS NOT NULL")
def prj68(spark, sf):
    line = F.concat(F.lit("say ENTITY_CITY "), "source", F.lit(" END now INTENT_ASK DOMAIN-a"))
    return _docs(spark, sf).filter("source is not null").select("doc_id", tags.components(line).alias("c")).select("doc_id", "c.text", F.array_join("c.parts", "|").alias("parts"))


@query("prj70_upper_intents", "SELECT doc_id, concat('go INTENT_', upper(source), ' on') AS line FROM documents WHERE source IS NOT NULL")
def prj70(spark, sf):
    return _docs(spark, sf).filter("source is not null").select("doc_id", tags.upper_intents(F.concat(F.lit("go INTENT_"), "source", F.lit(" on"))).alias("line"))


# filters


@query("flt04_at_least", "SELECT doc_id FROM documents WHERE n_chars / 15.0 >= 60")
def flt04(spark, sf):
    return _docs(spark, sf).filter(filters.in_band(F.col("n_chars") / 15.0, 60, None)).select("doc_id")


@query("flt08_listed_audio", "SELECT doc_id, doc_id % 3 <> 0 AS there FROM documents")
def flt08(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.concat(F.lit("/a/"), "doc_id").alias("path"))
    there, gone = relations.matched(docs, docs.filter("doc_id % 3 <> 0").select("path"), "path")
    return there.select("doc_id", F.lit(True).alias("there")).unionByName(gone.select("doc_id", F.lit(False).alias("there")))


@query("flt09_audio_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN n_chars / 15.0 > 30 OR n_chars / 15.0 < 0.3 THEN 'duration' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def flt09(spark, sf):
    docs = _docs(spark, sf)
    listing = docs.filter("doc_id % 3 <> 0").select("doc_id", F.lit(True).alias("there"))
    checked = docs.join(listing, "doc_id", "left").withColumn("reason", filters.first_reason([("missing", F.col("there").isNull()), ("duration", ~filters.in_band(F.col("n_chars") / 15.0, 0.3, 30))]))
    return audits.reason_counts(checked.filter("reason is not null").select("reason"))


@query("flt11_alignable", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text[1:400]) > 0 AND length(text[1:400]) <= 399 AND length(text[1:400]) * 2.0 >= length(text)")
def flt11(spark, sf):
    return _docs(spark, sf).filter(filters.alignable(F.left("text", F.lit(400)), F.col("text"), 2.0, 399)).select("doc_id")


@query("flt12_says_something", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL")
def flt12(spark, sf):
    line = F.when(F.col("doc_id") % 3 == 0, " EMOTION_SAD  END ").otherwise(F.concat(F.lit("AGE_30_45 "), "source"))
    return _docs(spark, sf).filter(filters.says_something(line)).select("doc_id")


@query("flt13_single_label", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 0 AND lang <> 'de'")
def flt13(spark, sf):
    labels = F.split(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "").otherwise(",x")), ",")
    return _docs(spark, sf).filter(filters.single_label(labels, ["de"])).select("doc_id")


@query("flt14_source_languages", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'known' ELSE lang END AS found FROM documents WHERE lang IS NOT NULL")
def flt14(spark, sf):
    source = F.when(F.col("doc_id") % 2 == 0, "special").otherwise(F.concat(F.lit("some_corpus_"), "lang"))
    return _docs(spark, sf).filter("lang is not null").select("doc_id", filters.language_of_source(source, {"special": "known"}).alias("found"))


@query("flt15_one_of", f"WITH {TAGGED} SELECT doc_id FROM tagged WHERE regexp_extract(text, 'EMOTION_([A-Z]+)', 1) IN ('HAP', 'SAD')")
def flt15(spark, sf):
    return tagged(spark, sf).filter(filters.one_of(F.regexp_extract("text", "EMOTION_([A-Z]+)", 1), ["HAP", "SAD"])).select("doc_id")


@query("flt16_frequent_tags", rf"WITH {NORM}, f AS (SELECT t FROM (SELECT unnest(tags) AS t FROM norm) GROUP BY t HAVING count(*) >= 20) SELECT doc_id FROM norm WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, unnest(tags) AS t FROM norm) WHERE t NOT IN (SELECT t FROM f))")
def flt16(spark, sf):
    docs = tagged(spark, sf).select("doc_id", tags.normalize(F.col("text")).alias("text"))
    frequent = audits.tag_counts(docs, normalized=False).filter("n >= 20").agg(F.collect_list("tag").alias("frequent"))  # a row a tag
    return docs.crossJoin(F.broadcast(frequent)).filter(filters.all_tags_in(F.col("text"), F.col("frequent"))).select("doc_id")


@query("flt18_short_lines", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) < 100")
def flt18(spark, sf):
    return _docs(spark, sf).filter(filters.shorter_than(F.col("text"))).select("doc_id")


@query("flt19_needs_intent", rf"WITH {TAGGED} SELECT doc_id FROM tagged WHERE regexp_matches(text, '\b(?:AGE|GENDER|EMOTION)_\S+') AND NOT regexp_matches(text, '\bINTENT_\S+')")
def flt19(spark, sf):
    return tagged(spark, sf).filter(filters.needs_intent(F.col("text"))).select("doc_id")


@query("flt20_already_tagged", rf"WITH {TAGGED} SELECT doc_id FROM tagged WHERE regexp_matches(text, '\bAGE_\S+') AND regexp_matches(text, '\bGENDER_\S+') AND regexp_matches(text, '\bEMOTION_\S+')")
def flt20(spark, sf):
    return tagged(spark, sf).filter(filters.already_tagged(F.col("text"))).select("doc_id")


@query("flt21_required_keys", "SELECT CASE doc_id % 4 WHEN 0 THEN 'missing:text' WHEN 1 THEN 'missing:duration' WHEN 2 THEN 'malformed' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def flt21(spark, sf):
    lines = ['{"audio_filepath": "a", "duration": 1}', '{"audio_filepath": "a", "text": null}', '{"audio_filepath": ', '{"audio_filepath": "a", "text": "", "duration": 2}']
    raw = F.element_at(F.array(*map(F.lit, lines)), (F.col("doc_id") % 4 + 1).cast("int"))
    return audits.reason_counts(_docs(spark, sf).select(F.coalesce(filters.missing_keys(raw, ["audio_filepath", "text", "duration"]), F.lit("kept")).alias("reason")))


@query("flt22_rare_words", r"""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word FROM conversations), c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
  r AS (SELECT DISTINCT lower(word) AS l FROM c WHERE n < 5) SELECT min(word) AS word FROM w JOIN r ON lower(word) = l WHERE length(lower(word)) >= 3 GROUP BY l""")
def flt22(spark, sf):
    spoken_words = table(spark, sf, "conversations").select(F.explode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("word"))
    return filters.with_rare_words(spoken_words, spoken_words.groupBy("word").agg(F.count("*").alias("n")))


@query("flt23_budget", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 100000")
def flt23(spark, sf):
    return sampling.within_budget(_docs(spark, sf).select("doc_id", "n_chars"), ["doc_id"], "n_chars", 100_000).select("doc_id")


@query("flt24_capped", "SELECT doc_id, md5(CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '...' ELSE text[1:500] END) AS text FROM documents")
def flt24(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(filters.capped(F.col("text"))).alias("text"))


@query("flt27_supplied_or_predicted", """SELECT doc_id, CASE WHEN doc_id % 6 IN (1, 5) THEN 'given' ELSE 'predicted' END AS age FROM documents""")
def flt27(spark, sf):
    pair = metadata.supplied_or_predicted(F.when(F.col("doc_id") % 2 == 1, "given"), F.when(F.col("doc_id") % 3 > 0, "given"), F.lit("predicted"), F.lit("predicted"))
    return _docs(spark, sf).select("doc_id", pair["age"].alias("age"))


# joins and sets


@query("jon01_stems", "SELECT doc_id, doc_id % 5 <> 0 AS paired FROM documents")
def jon01(spark, sf):
    """Audio and transcript files of one stem, and the audio without a transcript."""
    audio = _docs(spark, sf).select("doc_id", metadata.file_stem(F.concat(F.lit("/audio/u."), "doc_id", F.lit(".wav"))).alias("stem"))
    texts = _docs(spark, sf).filter("doc_id % 5 <> 0").select(metadata.file_stem(F.concat(F.lit("/txt/u."), "doc_id", F.lit(".txt"))).alias("stem"))
    paired, alone = relations.matched(audio, texts, "stem")
    return paired.select("doc_id", F.lit(True).alias("paired")).unionByName(alone.select("doc_id", F.lit(False).alias("paired")))


@query("jon04_first_stem", "SELECT source, min(doc_id) AS doc_id, count(*) AS utterances FROM documents WHERE source IS NOT NULL GROUP BY source")
def jon04(spark, sf):
    docs = _docs(spark, sf).filter("source is not null")
    index = relations.distinct_on(docs.select("source", "doc_id"), ["source"], ["doc_id"])
    return relations.strict_lookup(docs.select("source"), index, "source").groupBy("source", "doc_id").agg(F.count("*").alias("utterances"))


@query("jon09_class_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS name FROM documents")
def jon09(spark, sf):
    return _docs(spark, sf).select("doc_id", lookup(F.col("lang"), {"en": "English", "de": "German"}, F.col("lang")).alias("name"))


@query("jon13_zipped_lines", "SELECT doc_id, source AS tagged, lang AS clean FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def jon13(spark, sf):
    docs = relations.numbered(_docs(spark, sf).filter("source is not null and lang is not null").select("doc_id", "source", "lang"), ["doc_id"], "line_no")
    return relations.zipped(docs.select("doc_id", "line_no", F.col("source").alias("tagged")), docs.select("line_no", F.col("lang").alias("clean")), ["line_no"]).drop("line_no")


@query("jon16_stacked", "SELECT doc_id AS id, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def jon16(spark, sf):
    return relations.stacked(_docs(spark, sf).select(F.col("doc_id").alias("id"), "lang"), table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role"))


@query("jon18_first_segment", "SELECT source AS ytid, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IS NOT NULL) WHERE r = 1")
def jon18(spark, sf):
    rows = _docs(spark, sf).filter("source is not null").select(F.col("source").alias("ytid"), "doc_id", "n_chars")
    return relations.distinct_on(rows, ["ytid"], [-F.col("n_chars"), F.col("doc_id")]).select("ytid", "doc_id")


_LOCAL = "local AS (SELECT lang, source AS token, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS local_id FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL))"
_GLOBAL = f"WITH {_LOCAL}, f AS (SELECT token, min(lang) AS default_lang, array_to_string(list_sort(list(lang)), ',') AS langs, min((lang, local_id)) AS p FROM local GROUP BY token), g AS (SELECT row_number() OVER (ORDER BY p, token) - 1 AS id, token, default_lang, langs FROM f)"


def _local(spark, sf):
    from pyspark.sql.window import Window as W

    pairs = _docs(spark, sf).filter("lang is not null and source is not null").select("lang", F.col("source").alias("token")).distinct()
    return pairs.withColumn("local_id", F.row_number().over(W.partitionBy("lang").orderBy("token")) - 1)


@query("agg24_candidate_languages", f"{_GLOBAL} SELECT id, token, default_lang, langs FROM g")
def agg24(spark, sf):
    return vocabularies.aggregated(_local(spark, sf)).withColumn("langs", F.array_join("langs", ","))


@query("jon17_local_to_global", f"{_GLOBAL} SELECT lang, local_id::INT AS local_id, id FROM local JOIN g USING (token)")
def jon17(spark, sf):
    local = _local(spark, sf)
    return vocabularies.local_to_global(local, vocabularies.aggregated(local))


@query("set08_restricted", f"{_GLOBAL}, k AS (SELECT token, min(id) AS o FROM g WHERE default_lang IN ('de', 'fr') GROUP BY token) SELECT row_number() OVER (ORDER BY o) - 1 AS id, token FROM k")
def set08(spark, sf):
    return vocabularies.restricted(vocabularies.aggregated(_local(spark, sf)), ["de", "fr"], "default_lang")


@query("set03_label_union", "SELECT DISTINCT label FROM (SELECT lang AS label FROM documents UNION ALL SELECT role FROM conversations) WHERE label IS NOT NULL")
def set03(spark, sf):
    return relations.stacked(_docs(spark, sf).select(F.col("lang").alias("label")), table(spark, sf, "conversations").select(F.col("role").alias("label"))).filter("label is not null").distinct()


@query("set06_new_tags", rf"""WITH {NORM}, t AS (SELECT unnest(words) AS token FROM norm) SELECT token, count(*) AS n FROM t WHERE regexp_matches(token, '^(?:ENTITY_|INTENT_|EMOTION_|GENDER_|AGE_|DIALECT_|KEYWORD_|LANG_|OTHER_)')
  AND regexp_matches(token, '^[A-Z][A-Z0-9_]*_[A-Z0-9_<>+.]*$') AND token NOT IN ('EMOTION_SAD', 'GENDER_FEMALE') GROUP BY token HAVING count(*) >= 10""")
def set06(spark, sf):
    docs = tagged(spark, sf).select(tags.normalize(F.col("text")).alias("text"))
    return audits.new_tokens(docs, spark.createDataFrame([("EMOTION_SAD",), ("▁GENDER_FEMALE",)], "token string")).select("token", "n")


# counts


@query("agg05_manifest_stats", "SELECT count(*) AS samples, round(sum(n_chars / 15.0) / 3600, 2) AS hours, round(avg(n_chars / 15.0), 4) AS mean FROM documents")
def agg05(spark, sf):
    made = audits.totals(tagged(spark, sf))
    return made.select("samples", F.round("hours", 2).alias("hours"), F.round(made[[c for c in made.columns if "mean" in c][0]], 4).alias("mean"))


@query("agg14_inverse_weights", "WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT lang, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS inverse FROM c")
def agg14(spark, sf):
    return audits.family_weights(_docs(spark, sf).filter("lang is not null"), "lang").select("lang", "n", F.round("inverse", 6).alias("inverse"))


@query("agg18_offenders", rf"""WITH {NORM}, o AS (SELECT unnest(list_distinct(list_filter(tags, lambda t: t NOT IN ('EMOTION_HAPPY', 'END', 'GENDER_MALE')))) AS tag FROM norm) SELECT tag, count(*) AS n FROM o GROUP BY tag ORDER BY n DESC, tag LIMIT 50""")
def agg18(spark, sf):
    known = F.array(*map(F.lit, ["EMOTION_HAPPY", "END", "GENDER_MALE"]))
    offenders = tagged(spark, sf).select(F.explode(filters.unknown_tags(tags.normalize(F.col("text")), known)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return audits.top(offenders, 50, "tag")


@query("agg20_roles", "SELECT role AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM conversations), 2) AS percent FROM conversations GROUP BY role")
def agg20(spark, sf):
    return audits.shares(table(spark, sf, "conversations"), "role")


@query("agg30_error_kinds", f"""{_ERRORS}, s AS (SELECT sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, sum(insertions)::BIGINT AS i, sum(deletions)::BIGINT AS d, sum(substitutions)::BIGINT AS u FROM edits)
  SELECT errors, words, round(errors / words, 6) AS wer, round(i / words, 6) AS ins_rate, round(d / words, 6) AS del_rate, round(u / words, 6) AS sub_rate FROM s""")
def agg30(spark, sf):
    made = metrics.error_rate(predicted_turns(spark, sf), F.col("hyp"), F.col("ref"))
    return made.select("errors", "words", *[F.round(c, 6).alias(c) for c in ("wer", "ins_rate", "del_rate", "sub_rate")])


@query("agg39_frequent_tags", rf"WITH {NORM} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM norm) GROUP BY tag HAVING count(*) > 20")
def agg39(spark, sf):
    return audits.tag_counts(tagged(spark, sf)).filter("n > 20").select("tag", "n")


@query("agg40_grown", "WITH f AS (SELECT source AS token, min(doc_id // 10) AS b FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT *, (SELECT count(*) FROM f g WHERE g.b < f.b) AS before FROM f) SELECT token, b AS first_batch FROM c WHERE before < 8")
def agg40(spark, sf):
    batches = _docs(spark, sf).filter("source is not null").select(F.col("source").alias("token"), F.floor(F.col("doc_id") / 10).alias("batch"))
    return vocabularies.grown(batches.limit(0).select("token"), batches, 8)


@query("agg42_sources", "SELECT source AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY source")
def agg42(spark, sf):
    return audits.shares(_docs(spark, sf), "source")


@query("srt01_most_common", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 20")
def srt01(spark, sf):
    return audits.top(_docs(spark, sf).filter("source is not null").groupBy("source").agg(F.count("*").alias("n")), 20, "source")


@query("win14_ids_by_position", "SELECT row_number() OVER (ORDER BY source) - 1 AS id, source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def win14(spark, sf):
    return relations.numbered(_docs(spark, sf).filter("source is not null").select("source").distinct(), ["source"])


@query("srt08_shuffled", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat('9|', doc_id)), doc_id) AS rank FROM documents")
def srt08(spark, sf):
    return sampling.ranked(_docs(spark, sf).select("doc_id"), "doc_id", 9).select("doc_id", F.col("rank").cast("long").alias("rank"))


# samples and segments


@query("win13_budget_by_group", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE lang IS NOT NULL) WHERE b < 20000")
def win13(spark, sf):
    return sampling.within_budget(_docs(spark, sf).filter("lang is not null").select("doc_id", "lang", "n_chars"), ["doc_id"], "n_chars", 20_000, by=["lang"]).select("doc_id")


@query("smp03_split_by_language", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42|', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)
  SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.9) THEN 'train' WHEN r <= floor(n * 0.9) + floor(n * 0.05) THEN 'valid' ELSE 'test' END AS split FROM r""")
def smp03(spark, sf):
    return sampling.split(_docs(spark, sf).filter("lang is not null").select("doc_id", "lang"), "doc_id", [("train", 0.9), ("valid", 0.05)], "test", by=["lang"]).select("doc_id", "lang", "split")


@query("smp08_batches", "SELECT lang, (count(*) // 16)::BIGINT AS batches, ceil((count(*) // 16) / 4)::BIGINT AS per_rank FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def smp08(spark, sf):
    counts = _docs(spark, sf).filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", sampling.batch_counts(F.col("n"), 16, 4).alias("b")).select("lang", F.col("b.batches").cast("long").alias("batches"), F.col("b.per_rank").cast("long").alias("per_rank"))


@query("smp12_twenty_seconds", """WITH c AS (SELECT doc_id, n_chars / 15.0 AS d, unnest(range(0, ceil(n_chars / 15.0 / 20)::BIGINT)) AS chunk FROM documents)
  SELECT doc_id, chunk, round(chunk * 20.0::DOUBLE, 4) AS chunk_start, round(least((chunk + 1) * 20.0, d), 4)::DOUBLE AS chunk_end FROM c WHERE least((chunk + 1) * 20.0, d) - chunk * 20.0 >= 1""")
def smp12(spark, sf):
    made = segments.time_chunks(_docs(spark, sf).select("doc_id", (F.col("n_chars") / 15.0).cast("double").alias("d")), "d", 20.0)
    return made.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.round("chunk_start", 4).alias("chunk_start"), F.round("chunk_end", 4).alias("chunk_end"))


@query("smp14_named_segments", "SELECT concat('d', doc_id, '_segment_0000_1_3') AS name FROM documents UNION ALL SELECT concat('d', doc_id, '_segment_0001_5_', 5 + doc_id % 7) FROM documents")
def smp14(spark, sf):
    times = F.array(F.struct(F.lit(1).cast("long").alias("start"), F.lit(3).cast("long").alias("end")), F.struct(F.lit(5).cast("long").alias("start"), (F.col("doc_id") % 7 + 5).alias("end")))
    return segments.named_segments(_docs(spark, sf).select("doc_id", times.alias("times")), F.concat(F.lit("d"), "doc_id"), "times").select("name")


@query("smp16_overlapping_chunks", """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0), CASE WHEN length(text) > 0 THEN 1 ELSE 0 END)::BIGINT)) AS chunk FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, chunk, md5(substring(text, chunk * 800 + 1, 1000)) AS piece FROM c WHERE trim(substring(text, chunk * 800 + 1, 1000), ' ') <> ''""")
def smp16(spark, sf):
    return segments.text_chunks(_docs(spark, sf).select("doc_id", "text"), "text", 1000, 200).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("chunk_text").alias("piece"))


@query("str04_unprocessed", "SELECT doc_id FROM documents WHERE doc_id % 7 <> 2")
def str04(spark, sf):
    docs = _docs(spark, sf).select("doc_id")
    return filters.unprocessed(docs, docs.filter("doc_id % 7 = 2"), "doc_id")


# files of other shapes


@query("src06_discovered", "SELECT lang AS dataset, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def src06(spark, sf):
    """Manifests below folders of data sets; folders of audio and backups are passed over."""
    root, docs = scratch(spark), _docs(spark, sf).select("doc_id", "lang")
    for folder, lang in (("en", "en"), ("de/deeper", "de"), ("de/audio", "en")):
        docs.filter(F.col("lang") == lang).write.json(f"{root}/{folder}")
    found = [p for p in readers.discovered(spark, root) if "/audio/" not in p]
    rows = spark.read.schema("doc_id bigint").json(found).select(readers.dataset_of(F.col("_metadata.file_path"), root).alias("dataset"))
    return rows.groupBy("dataset").agg(F.count("*").alias("n"))


@query("src09_split_alias", "SELECT count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id % 10 = 0")
def src09(spark, sf):
    root, docs = scratch(spark), _docs(spark, sf).select("doc_id")
    docs.filter("doc_id % 10 = 0").write.json(f"{root}/validation.json")
    docs.filter("doc_id % 10 <> 0").write.json(f"{root}/train.json")
    return spark.read.schema("doc_id bigint").json(readers.split_file(spark, root, "valid")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("src10_json_array", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def src10(spark, sf):
    counts = _docs(spark, sf).filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    whole = counts.agg(F.to_json(F.collect_list(F.struct("source", "n"))).alias("value"))  # a row a source
    return readers.json_array(spark, _written(spark, whole), "source string, n bigint")


@query("src12_by_extension", "SELECT kind, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents, (VALUES ('csv'), ('jsonl')) k(kind) GROUP BY kind")
def src12(spark, sf):
    root, docs = scratch(spark), _docs(spark, sf).select("doc_id", "n_chars")
    docs.write.option("header", True).csv(f"{root}/rows.csv")
    docs.write.json(f"{root}/rows.jsonl")
    both = [readers.by_extension(spark, f"{root}/rows.{k}", "doc_id bigint, n_chars bigint").withColumn("kind", F.lit(k)) for k in ("csv", "jsonl")]
    return relations.stacked(*both).groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("src16_label_table", "SELECT concat('y', doc_id) AS ytid, doc_id / 2.0 AS start, doc_id / 2.0 + 10 AS \"end\", concat('/m/', coalesce(lang, 'xx'), '|/m/b') AS labels FROM documents")
def src16(spark, sf):
    rows = _docs(spark, sf).select((F.col("doc_id") + 10).alias("at"), F.format_string('y%d, %s, %s, "/m/%s,/m/b"', "doc_id", (F.col("doc_id") / 2).cast("string"), (F.col("doc_id") / 2 + 10).cast("string"), F.coalesce("lang", F.lit("xx"))).alias("value"))
    head = spark.createDataFrame([(i, x) for i, x in enumerate(["# made", "# num_ytids", "# YTID, start", "# a comment", ""])], "at long, value string")
    one = head.unionByName(rows).repartition(1).sortWithinPartitions("at").select("value")  # one file, as the format has it
    return readers.label_table(spark, _written(spark, one)).withColumn("labels", F.array_join("labels", "|"))


@query("src17_ontology", "SELECT DISTINCT source AS id, upper(source) AS name FROM documents WHERE source IS NOT NULL")
def src17(spark, sf):
    names = _docs(spark, sf).filter("source is not null").select("source").distinct()
    whole = names.agg(F.to_json(F.collect_list(F.struct(F.col("source").alias("id"), F.upper("source").alias("name"), F.lit("x").alias("description")))).alias("value"))
    return readers.ontology(spark, _written(spark, whole))


@query("src30_chunked_annotations", "SELECT lang AS state, source AS text, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS chunk FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)")
def src30(spark, sf):
    """A file a language, with its sources as chunks."""
    named = _docs(spark, sf).filter("lang is not null and source is not null").groupBy(F.col("lang").alias("state")).agg(F.array_sort(F.collect_set("source")).alias("s"))
    chunk = lambda s, i: F.struct((i + 0.5).alias("start"), (i + 1.0).alias("end"), s.alias("text"))
    folder = scratch(spark)
    writers.jsonl(named.select("state", F.lit("f").alias("gender"), F.transform("s", chunk).alias("verbatim")), folder, rows_a_file=1)
    return readers.chunked_annotations(spark, folder).select("state", "text", F.col("chunk").cast("long").alias("chunk"))


@query("src31_first_predictions", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def src31(spark, sf):
    folder = scratch(spark)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("audio_filepath"), F.lit("t").alias("text")))
    _docs(spark, sf).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(folder)
    return readers.predictions(spark, folder, limit=25).select(F.col("audio_filepath").cast("long").alias("doc_id"))


@query("snk04_routed", "SELECT coalesce(lang, 'none') AS route, count(*) AS n FROM documents GROUP BY 1")
def snk04(spark, sf):
    folder = scratch(spark)
    writers.routed(_docs(spark, sf).select("doc_id", F.coalesce("lang", F.lit("none")).alias("route")), folder)
    return spark.read.schema("doc_id bigint, route string").json(folder).groupBy("route").agg(F.count("*").alias("n"))


@query("snk05_rewritten_if_changed", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'changed' ELSE 'same' END AS text FROM documents")
def snk05(spark, sf):
    folder, same = scratch(spark), F.lit("same")
    docs = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 == 0, "changed").otherwise(same).alias("text"), (F.col("doc_id") % 9 == 0).alias("changed"))
    assert not writers.rewritten_if_changed(docs.filter("not changed"), "changed", folder, "v1")
    assert writers.rewritten_if_changed(docs, "changed", folder, "v2")
    return spark.read.schema("doc_id bigint, text string").json(f"{folder}/v2")


@query("snk07_parquet_parts", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, ceil(count(*) / 50.0)::BIGINT AS least_files FROM documents")
def snk07(spark, sf):
    folder = scratch(spark)
    writers.parquet(_docs(spark, sf).repartition(1), folder, rows_a_file=50)
    parts = readers.audio_parquet(spark, folder)
    return parts.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("source_file").alias("least_files"))


@query("snk09_csv_and_jsonl", "SELECT doc_id, concat('[\"', coalesce(lang, 'xx'), '\",\"b\"]') AS labels FROM documents")
def snk09(spark, sf):
    folder = scratch(spark)
    writers.csv_and_jsonl(_docs(spark, sf).select("doc_id", F.array(F.coalesce("lang", F.lit("xx")), F.lit("b")).alias("labels")), folder)
    flat = spark.read.option("header", True).schema("doc_id bigint, labels string").csv(f"{folder}/csv")
    nested = spark.read.schema("doc_id bigint, labels array<string>").json(f"{folder}/jsonl").select("doc_id", F.to_json("labels").alias("labels"))
    return flat.intersect(nested)


@query("snk14_summary", "SELECT count(*) AS samples, sum(n_chars)::BIGINT AS chars FROM documents")
def snk14(spark, sf):
    folder = scratch(spark)
    writers.summary(_docs(spark, sf).agg(F.count("*").alias("samples"), F.sum("n_chars").alias("chars")), folder)
    return spark.read.schema("samples bigint, chars bigint").json(folder)


# more texts and rates


@query("prj15_first_word_closed", "SELECT doc_id, concat('ENTITY_CITY ', source, ' END hello') AS line FROM documents WHERE source IS NOT NULL")
def prj15(spark, sf):
    return _docs(spark, sf).filter("source is not null").select("doc_id", tags.close_first_word(F.concat(F.lit("ENTITY_CITY "), "source", F.lit(" hello"))).alias("line"))


@query("prj18_split_types", "SELECT doc_id, concat('say ENTITY_CITY ', source, ' END') AS line FROM documents WHERE source IS NOT NULL")
def prj18(spark, sf):
    return _docs(spark, sf).filter("source is not null").select("doc_id", tags.join_split_types(F.concat(F.lit("say ENTITY_CIT Y "), "source", F.lit(" END"))).alias("line"))


@query("prj20_without_ner", "SELECT doc_id, concat('say ', source, ' AGE_30_45 now') AS line FROM documents WHERE source IS NOT NULL")
def prj20(spark, sf):
    return _docs(spark, sf).filter("source is not null").select("doc_id", F.btrim(tags.remove_ner(F.concat(F.lit("say NER_CITY "), "source", F.lit(" AGE_30_45 now")))).alias("line"))


_PLAIN = f"{_ERRORS}, plain AS (SELECT k, regexp_replace(hyp, '<N\\d+>', ' ', 'g') AS hyp, regexp_replace(ref, '<N\\d+>', ' ', 'g') AS ref, nullif(regexp_extract(hyp, '<N\\d+>'), '') AS hl, nullif(regexp_extract(ref, '<N\\d+>'), '') AS rl FROM numbered), {edits('plain', 'k', 'u_')}"


@query("agg33_labelled_error_rate", f"""{_PLAIN}, l AS (SELECT sum(errors) AS le, sum(words) AS lw FROM edits), u AS (SELECT sum(errors) AS ue, sum(words) AS uw FROM u_edits), a AS (SELECT count(*) FILTER (WHERE hl = rl) AS hit, count(rl) AS labels FROM plain)
  SELECT round(le / greatest(lw, 1), 6) AS labelled_wer, round(ue / greatest(uw, 1), 6) AS unlabelled_wer, round(CASE WHEN labels = 0 THEN 0.0 ELSE hit / labels END, 6) AS label_accuracy FROM l, u, a""")
def agg33(spark, sf):
    made = metrics.labelled_error_rate(predicted_turns(spark, sf), F.col("hyp"), F.col("ref"))
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])

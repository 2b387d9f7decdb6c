"""Queries of projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import edit, metadata, tags
from tagloom.functions import lexicon as lx

from tagloom.operators import filters, plugins
from tagloom.plans.views import IS_TAG, NORM, TAGGED, query, squeezed, table, tagged


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(value: str, pairs: dict[str, str], otherwise: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {otherwise} END"


@query("prj01_normalize", f"WITH {NORM} SELECT doc_id, norm FROM norm")
def prj01(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.normalize(F.col("text")).alias("norm"))


_LEGACY = r"""replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, 'EMOTION_HAPPYPY', 'EMOTION_HAPPY'), 'EMOTION_HAP\b', 'EMOTION_HAPPY', 'g'),
  'EMOTION_NEU\b', 'EMOTION_NEUTRAL', 'g'), 'EMOTION_ANG\b', 'EMOTION_ANGRY', 'g'), 'GER_', 'GENDER_'), 'AGE_60PLUS', 'AGE_60+')"""
_LEGACY = squeezed(rf"""regexp_replace({_LEGACY}, '(\w)",', '\1', 'g')""")


@query("prj02_normalize_legacy", f"WITH {TAGGED} SELECT doc_id, {_LEGACY} AS norm FROM tagged")
def prj02(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.normalize(F.col("text"), "legacy").alias("norm"))


_FOLD = _case("w[8:]", lx.INTENT_FOLD | {i: i for i in lx.INTENTS}, "'STATEMENT'")


@query("prj03_canonicalize", rf"""WITH {TAGGED} SELECT doc_id, array_to_string(list_transform(string_split(
  regexp_replace(regexp_replace(regexp_replace(text, 'EMOTION_HAP\b', 'EMOTION_HAPPY', 'g'), 'EMOTION_NEU\b', 'EMOTION_NEUTRAL', 'g'), '\bGER_MALE\b', 'GENDER_MALE', 'g'), ' '),
  lambda w: CASE WHEN starts_with(w, 'INTENT_') THEN concat('INTENT_', {_FOLD}) ELSE w END), ' ') AS canonical FROM tagged""")
def prj03(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.canonicalize(F.col("text")).alias("canonical"))


@query("prj04_canonicalize_inline", rf"""WITH {TAGGED} SELECT doc_id, x AS repaired, {squeezed(r"regexp_replace(concat(x, ' DOMAIN_A'), '\bDOMAIN_\S+\b', '', 'g')")} AS without_domains FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\bEMOTION_HAP\b', 'EMOTION_HAPPY', 'g'), '\bEMOTION_NEU\b', 'EMOTION_NEUTRAL', 'g'), '\bGER_MALE\b', 'GENDER_MALE', 'g') AS x FROM tagged)""")
def prj04(spark, sf):
    text = F.col("text")
    return tagged(spark, sf).select("doc_id", tags.canonicalize_inline(text).alias("repaired"), tags.canonicalize_inline(F.concat(text, F.lit(" DOMAIN_A")), drop_domains=True).alias("without_domains"))


_META = r"'^(?:AGE_\S+|GENDER_\S+|GER_\S+|EMOTION_\S+|INTENT_\S+|ENTITY_\S+|END)\b'"


@query("prj06_tags_last", rf"""WITH {TAGGED}, w AS (SELECT doc_id, string_split({squeezed('text')}, ' ') AS words FROM tagged)
  SELECT doc_id, concat_ws(' ', array_to_string(list_filter(words, lambda w: NOT regexp_matches(w, {_META})), ' '),
    array_to_string(list_transform(list_filter(words, lambda w: regexp_matches(w, {_META})), lambda w: {_case('w', lx.MERGE_RENAMES, 'w')}), ' ')) AS moved FROM w""")
def prj06(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.move_tags_last(F.col("text"), spell=False).alias("moved"))


@query("prj07_parse", f"WITH {NORM} SELECT doc_id, array_to_string(list_filter(words, lambda w: NOT regexp_matches(w, {IS_TAG})), ' ') AS clean, len(tags) AS n_tags FROM norm")
def prj07(spark, sf):
    norm = tags.normalize(F.col("text"))
    return tagged(spark, sf).select("doc_id", norm.alias("n")).select("doc_id", tags.strip_tags(F.col("n")).alias("clean"), F.size(tags.tags(F.col("n"))).alias("n_tags"))


@query("prj09_decompose", rf"""WITH {NORM}, t AS (SELECT DISTINCT unnest(tags) AS tag FROM norm)
  SELECT tag, CASE WHEN tag IN ('END', 'TURN_CHANGE') THEN tag ELSE regexp_replace(regexp_replace(tag, '^([A-Z]+_)(.*)$', '\1|\2'), '([A-Z0-9])_([A-Z0-9])', '\1|_\2', 'g') END AS pieces FROM t""")
def prj09(spark, sf):
    found = tagged(spark, sf).select(F.explode(tags.tags(tags.normalize(F.col("text")))).alias("tag")).distinct()
    return found.select("tag", F.array_join(tags.decompose(F.col("tag")), "|").alias("pieces"))


@query("prj10_drop_unknown", r"""WITH %s SELECT doc_id, array_to_string(list_filter(words, lambda w: NOT regexp_matches(w, '^[A-Z][A-Z0-9_]*_[A-Z0-9_+.]+\b|^END$') OR w = 'ENTITY_CITY'
  OR regexp_matches(w, '^(?:AGE_|GENDER_|EMOTION_|INTENT_|DIALECT_)')), ' ') AS kept FROM norm""" % NORM)
def prj10(spark, sf):
    norm = tagged(spark, sf).select("doc_id", tags.normalize(F.col("text")).alias("n"))
    return norm.select("doc_id", tags.drop_unknown(F.col("n"), F.array(F.lit("ENTITY_CITY"))).alias("kept"))


@query("prj11_emotions_and_ages", rf"""WITH {NORM} SELECT doc_id, array_to_string(regexp_extract_all(norm, 'EMOTION_[^\s]+'), ',') AS emotions, array_to_string(regexp_extract_all(norm, 'AGE_[^\s]+'), ',') AS ages FROM norm""")
def prj11(spark, sf):
    found = tagged(spark, sf).select("doc_id", tags.emotions_and_ages(F.col("text")).alias("f"))
    return found.select("doc_id", F.array_join("f.emotions", ",").alias("emotions"), F.array_join("f.ages", ",").alias("ages"))


@query("prj12_append_lang", f"WITH {TAGGED} SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN n ELSE concat(n, ' LANG_', upper(lang)) END AS line FROM (SELECT doc_id, lang, {_LEGACY} AS n FROM tagged)")
def prj12(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.append_lang(F.col("text"), F.col("lang")).alias("line"))


@query("prj13_surroundings", f"WITH {TAGGED} SELECT doc_id, substr(text, 1, 30) AS around FROM tagged")
def prj13(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.surroundings(F.col("text")).alias("around"))


@query("prj14_fix_glued", r"""WITH %s SELECT doc_id, md5(x) AS digest, x <> t AS changed FROM (SELECT doc_id, t, regexp_replace(t, '\bENTITY_(CITY|DATE)END\b', 'ENTITY_\1 END', 'g') AS x
  FROM (SELECT doc_id, concat(CASE WHEN doc_id %% 2 = 0 THEN 'ENTITY_CITYEND ' ELSE '' END, text) AS t FROM tagged))""" % TAGGED)
def prj14(spark, sf):
    glued = tagged(spark, sf).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "ENTITY_CITYEND ").otherwise(""), F.col("text")).alias("t"))
    return glued.select("doc_id", tags.fix_glued_entities(F.col("t")).alias("f")).select("doc_id", F.md5("f.text").alias("digest"), "f.changed")


@query("prj17_repair_spans")
def prj17(spark, sf):
    """Parity and strict repairs side by side, as digests."""
    text = F.col("text")
    return tagged(spark, sf).select("doc_id", *[F.md5(tags.repair_spans(text, p)).alias(p) for p in ("strict", "add", "trim", "domain")])


@query("prj19_remove_entities", rf"""WITH {TAGGED} SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?:NER|ENTITY)_\w+\s?', '', 'g'), '\s?\bEND\b', '', 'g')) AS digest FROM tagged""")
def prj19(spark, sf):
    return tagged(spark, sf).select("doc_id", F.md5(tags.remove_entities(F.col("text"))).alias("digest"))


@query("prj21_remove_capitals", rf"""WITH {TAGGED} SELECT doc_id, {squeezed(r"regexp_replace(head, '\b[A-Z0-9_]+\b', '', 'g')")} AS plain FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS head FROM tagged)""")
def prj21(spark, sf):
    ascii_only = F.regexp_replace("text", "[^\\x00-\\x7F]", "x")
    return tagged(spark, sf).select("doc_id", tags.remove_capitals(ascii_only).alias("plain"))


@query("prj22_insert_intent", rf"""WITH {TAGGED} SELECT doc_id, regexp_replace(text, '(\bEMOTION_\S+)', '\1 INTENT_ASK') AS line FROM tagged""")
def prj22(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.insert_intent(F.col("text"), F.lit("ASK")).alias("line"))


@query("prj23_default_emotion", rf"""WITH {TAGGED}, t AS (SELECT doc_id, regexp_replace(text, '^EMOTION_\w+ (?:GER_MALE|GENDER_FEMALE) ', '') AS t FROM tagged)
  SELECT doc_id, CASE WHEN regexp_matches(t, '\bEMOTION_\S+') THEN t WHEN regexp_matches(t, '\bAGE_\S+') THEN regexp_replace(t, '(\bAGE_\S+)', '\1 EMOTION_NEUTRAL') ELSE concat(rtrim(t), ' EMOTION_NEUTRAL') END AS line FROM t""")
def prj23(spark, sf):
    bare = tagged(spark, sf).select("doc_id", F.regexp_replace("text", "^EMOTION_\\w+ (?:GER_MALE|GENDER_FEMALE) ", "").alias("t"))
    return bare.select("doc_id", tags.default_emotion(F.col("t")).alias("line"))


@query("prj24_combine", rf"""WITH t AS (SELECT conv_id, turn, concat(text, CASE WHEN turn % 2 = 0 THEN ' INTENT_ASK' ELSE '' END) AS t FROM conversations)
  SELECT conv_id, turn, trim(CASE WHEN regexp_matches(t, '\sINTENT_ASK$') THEN regexp_replace(t, '\s(INTENT_ASK)$', ' AGE_1 GENDER_MALE \1') ELSE concat(t, ' AGE_1 GENDER_MALE') END, ' ') AS line FROM t""")
def prj24(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, " INTENT_ASK").otherwise("")).alias("t"))
    return turns.select("conv_id", "turn", tags.combine(F.col("t"), F.lit("AGE_1 GENDER_MALE")).alias("line"))


@query("prj25_assemble", """SELECT doc_id, concat_ws(' ', 'AGE_30_45', CASE WHEN doc_id % 2 = 0 THEN 'GENDER_MALE' END, CASE WHEN doc_id % 3 = 0 THEN 'EMOTION_SAD' END, CASE WHEN doc_id % 5 = 0 THEN 'INTENT_INFORM' END) AS line FROM documents""")
def prj25(spark, sf):
    pick = lambda n, a: F.when(F.col("doc_id") % n == 0, a).otherwise("none")
    return table(spark, sf, "documents").select("doc_id", tags.assemble(F.lit("30_45"), pick(2, "male"), pick(3, "sad"), pick(5, "inform")).alias("line"))


@query("prj26_tagged_transcript", """SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '' ELSE concat_ws(' ', trim(text, ' '), CASE WHEN doc_id % 3 = 0 THEN 'AGE_30_45' WHEN doc_id % 3 = 1 THEN 'AGE_60' END, concat('DOMAIN_', source)) END AS line FROM documents""")
def prj26(spark, sf):
    docs = table(spark, sf, "documents")
    age = F.when(F.col("doc_id") % 3 == 0, "30_45").when(F.col("doc_id") % 3 == 1, "AGE_60").otherwise("NA")
    return docs.select("doc_id", tags.tagged_transcript({"text": F.col("text"), "audio_age": age, "nlp_domain": F.col("source")}).alias("line"))


@query("prj27_paths", r"""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN concat('/mnt/', url[9:]) WHEN starts_with(url, '/') THEN url ELSE concat('/data/', url) END AS rooted,
  regexp_replace(url, '^.*/', '') AS name, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem FROM pages""")
def prj27(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", metadata.rooted(url, "/data", ("https://", "/mnt/")).alias("rooted"), metadata.file_name(url).alias("name"), metadata.file_stem(url).alias("stem"))


@query("prj30_speaker_id", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('SPK_cv_en_', doc_id) WHEN doc_id % 3 = 1 THEN concat('SPK_ls_', source) ELSE concat('SPK_unk_', left(concat('f_', doc_id), 8)) END AS speaker FROM documents""")
def prj30(spark, sf):
    docs = table(spark, sf, "documents")
    corpus = F.when(F.col("doc_id") % 3 == 0, "commonvoice_en").when(F.col("doc_id") % 3 == 1, "librispeech").otherwise("other")
    path = F.concat(F.lit("/a/train-clean-100/"), F.col("source"), F.lit("/f_"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return docs.select("doc_id", metadata.speaker_id(path, corpus).alias("speaker"))


@query("prj31_trailing_run", r"""SELECT conv_id, turn, trim(text, ' ') AS clean, concat_ws(' ', concat('SPK_', conv_id), 'AGE_1 GENDER_X', trim(text, ' ')) AS line FROM conversations""")
def prj31(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("t", F.concat("text", F.lit(" AGE_1 GENDER_X ")))
    return turns.select("conv_id", "turn", tags.trailing_run(F.col("t"))["clean"].alias("clean"), tags.for_synthesis(F.col("t"), F.concat(F.lit("SPK_"), F.col("conv_id").cast("string"))).alias("line"))


_COUNT = "len(regexp_extract_all(t, '{}'))"


@query("prj33_script_family", rf"""WITH c AS (SELECT doc_id, lang, trim(coalesce(text, ''), ' ') AS t, {_COUNT.format('[Ѐ-ӿ]')} AS cy, {_COUNT.format('[ऀ-ॿ]')} AS de, {_COUNT.format('[a-zA-Z]')} AS la, {_COUNT.format('[؀-ۿ]')} AS ar,
    {_COUNT.format('[ঀ-৿]')} AS be FROM (SELECT doc_id, lang, text, regexp_replace(coalesce(text, ''), '\b(?:AGE_|GENDER_|EMOTION_|INTENT_|ENTITY_|END)\S*', '', 'g') AS t FROM documents)),
  s AS (SELECT *, cy + de + la + ar + be + 1 AS n FROM c)
  SELECT doc_id, CASE WHEN t = '' THEN 'MULTI' WHEN cy / n > 0.3 THEN 'SLAVIC' WHEN de / n > 0.3 THEN 'INDO_ARYAN' WHEN la / n > 0.3 THEN 'ENGLISH' WHEN ar / n > 0.3 OR be / n > 0.3 THEN 'INDO_ARYAN' ELSE 'MULTI' END AS script,
    CASE WHEN lang = 'en' THEN 'ENGLISH' WHEN lang IN ('de', 'fr', 'es') THEN 'EUROPEAN' ELSE 'none' END AS family, CASE WHEN lang = 'en' THEN 'ENGLISH' WHEN lang IS NULL THEN 'UNKNOWN' ELSE concat('Singleton_', upper(lang)) END AS single FROM s""")
def prj33(spark, sf):
    docs = table(spark, sf, "documents")
    families = metadata.configured_families({"english": ["en"]})
    return docs.select(
        "doc_id", metadata.script_family(F.coalesce("text", F.lit(""))).alias("script"), metadata.language_family(F.col("lang"), F.lit("none"), F.col("text")).alias("family"),
        metadata.family_or_single(F.col("lang"), families).alias("single"),
    )


@query("prj36_age_brackets", """WITH a AS (SELECT doc_id, (doc_id % 100) AS y, (doc_id % 100) / 100.0 AS ratio FROM documents)
  SELECT doc_id, CASE WHEN y < 18 THEN '0_18' WHEN y < 30 THEN '18_30' WHEN y < 45 THEN '30_45' WHEN y < 60 THEN '45_60' ELSE '60PLUS' END AS of_schema,
    CASE WHEN y < 18 THEN '0_17' WHEN y < 25 THEN '18_24' WHEN y < 35 THEN '25_34' WHEN y < 45 THEN '35_44' WHEN y < 55 THEN '45_54' WHEN y < 65 THEN '55_64' ELSE '65PLUS' END AS of_decades,
    CASE WHEN y < 18 THEN '0_17' WHEN y < 30 THEN '18_29' WHEN y < 45 THEN '30_44' WHEN y < 60 THEN '45_59' ELSE '60PLUS' END AS inclusive,
    CASE WHEN y % 2 = 0 THEN '18_30' ELSE '45_60' END AS of_word, CASE y % 3 WHEN 0 THEN 'GENDER_MALE' WHEN 1 THEN 'GENDER_FEMALE' ELSE 'GENDER_OTHER' END AS gender,
    CASE WHEN y % 2 = 0 THEN 'EMOTION_SAD' ELSE 'EMOTION_NEUTRAL' END AS emotion FROM a""")
def prj36(spark, sf):
    y = (F.col("doc_id") % 100).cast("double")
    even = F.col("doc_id") % 100 % 2 == 0
    return table(spark, sf, "documents").select(
        "doc_id", metadata.age_bracket(y).alias("of_schema"), metadata.age_bracket(y, "decades", digits=1).alias("of_decades"), metadata.age_bracket(y, "inclusive", "UNKNOWN", 0).alias("inclusive"),
        metadata.age_of_word(F.when(even, "Twenties").otherwise("fifties")).alias("of_word"), metadata.gender_of_code((F.col("doc_id") % 100 % 3).cast("int")).alias("gender"),
        metadata.emotion_of_code(F.when(even, "sad").otherwise("other")).alias("emotion"),
    )


@query("prj41_brackets", """SELECT doc_id, concat('go [city : ', source, '] now') AS before, concat('go ENTITY-CITY ', source, ' END now') AS after FROM documents""")
def prj41(spark, sf):
    before = F.concat(F.lit("go [city : "), F.col("source"), F.lit("] now"))
    return table(spark, sf, "documents").select("doc_id", before.alias("before"), tags.without_brackets(before).alias("after"))


@query("prj43_bio_to_spans", """SELECT doc_id, concat('NER_SRC ', source, ' ', coalesce(lang, '-'), ' END of ', doc_id) AS line FROM documents""")
def prj43(spark, sf):
    tokens = F.array("source", F.coalesce("lang", F.lit("-")), F.lit("of"), F.col("doc_id").cast("string"))
    labels = F.array(*map(F.lit, ["B-SRC", "I-SRC", "O", "O"]))
    return table(spark, sf, "documents").select("doc_id", tokens.alias("w"), labels.alias("l")).select("doc_id", tags.bio_to_spans(F.col("w"), F.col("l")).alias("line"))


@query("prj44_offsets_to_spans", "SELECT doc_id, trim(text[1:4] || 'NER_X ' || text[5:8] || ' END' || text[9:], ' ') AS line FROM documents")
def prj44(spark, sf):
    """The same span in all documents, those that are short, or blank at an end or before the span, among them."""
    spans = F.array(F.struct(F.lit(4).alias("start"), F.lit(8).alias("end"), F.lit("X").alias("tag")))
    return table(spark, sf, "documents").select("doc_id", tags.offsets_to_spans(F.col("text"), spans).alias("line"))


@query("prj48_first_tags", rf"""WITH {NORM} SELECT doc_id, nullif(regexp_extract(norm, 'EMOTION_([A-Z]+)', 1), '') AS emotion, nullif(regexp_extract(norm, 'AGE_(\d+_\d+)', 1), '') AS age, nullif(regexp_extract(norm, 'INTENT_([A-Z]+)', 1), '') AS intent,
  nullif(regexp_extract(norm, 'GENDER_([A-Z]+)', 1), '') AS gender, nullif(regexp_extract(norm, 'DIALECT_([A-Z]+)', 1), '') AS dialect FROM norm""")
def prj48(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.first_tags(tags.normalize(F.col("text"))).alias("f")).select("doc_id", "f.*")


@query("prj52_markers", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)
  SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 IN (2, 5) THEN concat('SPEAKER_CHANGE ', x) ELSE x END), ' ') AS line FROM w""")
def prj52(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tags.insert_markers(F.col("text"), F.array(F.lit(2), F.lit(5), F.lit(0))).alias("line"))


@query("prj53_half_width", """SELECT doc_id, md5(nfc_normalize(concat('（', text, '）'))) AS raw, md5(replace(replace(nfc_normalize(concat('（', text, '）')), '（', '('), '）', ')')) AS half FROM documents""")
def prj53(spark, sf):
    wide = F.concat(F.lit("（"), F.col("text"), F.lit("）"))
    return table(spark, sf, "documents").select("doc_id", F.md5(wide).alias("raw"), F.md5(edit.half_width(wide)).alias("half"))


@query("prj55_keywords", r"""SELECT doc_id, array_to_string(list_filter(list_concat(string_split(regexp_replace(concat('AGE_60 INTENT_', upper(source)), '[ _]+', '|', 'g'), '|')), lambda x: true), '|') AS x,
  concat('AGE|60+|INTENT|', upper(source)) AS keywords FROM documents""")
def prj55(spark, sf):
    line = F.concat(F.lit("AGE_60 INTENT_"), F.upper("source"))
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(line, "[ _]+", "|").alias("x"), F.array_join(tags.keywords(line), "|").alias("keywords"))


@query("prj59_task_views", """SELECT doc_id, task, CASE task WHEN 'transcription' THEN 'plain' WHEN 'ner' THEN concat('ner ', source) ELSE concat('both ', source, ' ', coalesce(lang, '')) END AS line
  FROM documents, (VALUES ('transcription'), ('ner'), ('ner+emotion')) t(task)""")
def prj59(spark, sf):
    views = F.array(
        F.struct(F.lit("transcription").alias("task"), F.lit("plain").alias("line")),
        F.struct(F.lit("ner").alias("task"), F.concat(F.lit("ner "), F.col("source")).alias("line")),
        F.struct(F.lit("ner+emotion").alias("task"), F.concat(F.lit("both "), F.col("source"), F.lit(" "), F.coalesce("lang", F.lit(""))).alias("line")),
    )
    return table(spark, sf, "documents").select("doc_id", F.explode(views).alias("v")).select("doc_id", "v.*")


@query("prj64_replies", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ok' WHEN event_id % 3 = 1 THEN 'unknown' ELSE 'unknown' END AS label, event_id % 3 = 2 AS broken FROM events""")
def prj64(spark, sf):
    n = F.col("event_id") % 3
    raw = F.when(n == 0, '```json\n{"label": "ok"}\n```').when(n == 1, '{"other": 1}').otherwise("sorry, no")
    return table(spark, sf, "events").select("event_id", metadata.reply(raw, "label string", {"label": "unknown"}).alias("r")).select("event_id", "r.label", "r.broken")


@query("prj65_validated", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'INTERVIEWER' ELSE 'INTERVIEWEE' END AS role, CAST(least(greatest(floor(value), 1), 5) AS INTEGER) AS score FROM events""")
def prj65(spark, sf):
    role = F.when(F.col("event_type") == "purchase", "role_interviewer").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", metadata.validated(role, "role").alias("role"), metadata.clamped(F.col("value")).alias("score"))


# filters


@query("flt01_keep_line", rf"""WITH {NORM} SELECT doc_id, list_has_any(regexp_extract_all(norm, 'EMOTION_[^\s]+'), [{_list(lx.EMOTIONS)}]) AND NOT list_has_any(regexp_extract_all(norm, 'AGE_[^\s]+'), [{_list(lx.FORBIDDEN_AGES)}]) AS keep FROM norm""")
def flt01(spark, sf):
    return tagged(spark, sf).select("doc_id", tags.keep_line(F.col("text")).alias("keep"))


@query("flt02_merge_reasons", f"""WITH {TAGGED} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN duration < 0.3 OR duration > 20 THEN 'duration' WHEN trim(raw, ' ') = '' THEN 'empty_text' WHEN coalesce(source, '') = '' THEN 'bad_audio' ELSE 'kept' END AS reason FROM tagged) GROUP BY reason""")
def flt02(spark, sf):
    reasons = tagged(spark, sf).withColumn("reason", filters.merge_reason(F.col("duration"), F.col("raw"), F.col("source")))
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("flt03_annotator_reasons", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bad_duration' WHEN value < 0.5 OR value > 30 THEN 'duration' WHEN event_type = 'view' THEN 'no_audio' WHEN event_type = 'click' THEN 'no_text' END AS reason FROM events""")
def flt03(spark, sf):
    duration = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    path = F.when(F.col("event_type") == "view", "NA").otherwise(F.col("event_type"))
    text = F.when(F.col("event_type") == "click", "").otherwise("text")
    return table(spark, sf, "events").select("event_id", filters.annotator_reason(duration, path, text).alias("reason"))


@query("flt05_unknown_tags", rf"""WITH {NORM} SELECT t AS tag, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(tags, lambda t: t NOT IN ('END', 'ENTITY_CITY', 'EMOTION_HAPPY', 'GENDER_MALE')))) AS t FROM norm) GROUP BY t""")
def flt05(spark, sf):
    known = F.array(*map(F.lit, ["END", "ENTITY_CITY", "EMOTION_HAPPY", "GENDER_MALE"]))
    found = tagged(spark, sf).select(F.explode(filters.unknown_tags(tags.normalize(F.col("text")), known)).alias("tag"))
    return found.groupBy("tag").agg(F.count("*").alias("n"))


@query("flt06_language_route", """SELECT doc_id, CASE WHEN lang IN ('en', 'de') OR lang IS NULL THEN 'kept' ELSE 'removed' END AS route, CASE WHEN lang = 'en' THEN 'ENGLISH' WHEN lang = 'de' THEN 'EUROPEAN' WHEN lang IS NULL THEN 'INDIAN_LOW_RESOURCE' END AS lang_family FROM documents""")
def flt06(spark, sf):
    route = filters.language_route(F.col("lang"), {"en": "ENGLISH", "de": "EUROPEAN"})
    return table(spark, sf, "documents").select("doc_id", route.alias("r")).select("doc_id", "r.*")


@query("flt10_alignable", """SELECT conv_id, turn, length(text) > 0 AND length(role) > 0 AND length(text) * 2.0 >= length(role) AND length(text) <= 300 AS ok FROM conversations""")
def flt10(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", filters.alignable(F.col("text"), F.col("role"), 2.0, 300).alias("ok"))


@query("flt17_line_checks", rf"""WITH {TAGGED} SELECT doc_id,
    CASE WHEN regexp_matches(text, 'ENTITY_[A-Z_]+ [^ ]+ END') AND regexp_matches(text, 'INTENT_[A-Z_]+') THEN 'CLEAN_LINE' WHEN regexp_matches(text, 'ENTITY_[A-Z_]+ [^ ]+') THEN 'NOISY_LINE' WHEN regexp_matches(text, 'INTENT_[A-Z_]+') THEN 'CLEAN_LINE' ELSE 'NOISY_LINE' END AS noise,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 100 AS short, regexp_matches(text, '\b(?:AGE|GENDER|EMOTION)_\S+') AND NOT regexp_matches(text, '\bINTENT_\S+') AS needs_intent,
    regexp_matches(text, '\bAGE_\S+') AND regexp_matches(text, '\bGENDER_\S+') AND regexp_matches(text, '\bEMOTION_\S+') AS tagged, left(text, 500) AS head FROM tagged""")
def flt17(spark, sf):
    text = F.col("text")
    return tagged(spark, sf).select("doc_id", tags.noisy_line(text).alias("noise"), filters.shorter_than(text).alias("short"), filters.needs_intent(text).alias("needs_intent"), filters.already_tagged(text).alias("tagged"), filters.capped(text).alias("head"))


@query("flt26_unprocessed", "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def flt26(spark, sf):
    return filters.unprocessed(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("src28_page_text")
def src28(spark, sf):
    """Visible text of raw pages, as a length and a digest."""
    from tagloom.sources.readers import html_text

    text = html_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("udf01_annotator", r"""SELECT conv_id * 1000 + turn AS id, CASE WHEN regexp_matches(text, '\?\s*$') THEN 'QUESTION' WHEN regexp_matches(text, '!\s*$') THEN 'EXCLAIM' ELSE 'STATEMENT' END AS intent, true AS ok FROM conversations""")
def udf01(spark, sf):
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return plugins.annotated(turns, "id", "text", plugins.intents, {"intent": "STATEMENT"})




@query("prj62_written_numbers", """SELECT doc_id, concat('about ₹', doc_id % 1000 + 100, ' or ', doc_id % 90 + 10, '%') AS line FROM documents""")
def prj62(spark, sf):
    """Numbers spelled out and read back."""
    from tagloom.functions import spoken

    n, share = (F.col("doc_id") % 1000 + 100).cast("string"), (F.col("doc_id") % 90 + 10).cast("string")
    words_ = edit.spell_all_numbers(F.concat(F.lit("about "), n, F.lit(" rupees or "), share, F.lit(" percent")))
    return table(spark, sf, "documents").select("doc_id", spoken.inverse_normalized(F.replace(words_, F.lit("-"), F.lit(" "))).alias("line"))


_PLACES = rf"""WITH {TAGGED}, s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(ENTITY_\w+) (.*?) END', 1)) AS label, unnest(regexp_extract_all(text, '(ENTITY_\w+) (.*?) END', 2)) AS phrase FROM tagged),
  p AS (SELECT *, list_transform(string_split(text, phrase), lambda x: length(x)) AS between FROM s),
  o AS (SELECT doc_id, label, phrase, unnest(list_transform(range(1, len(between)), lambda k: list_sum(between[1:k]) + (k - 1) * length(phrase)))::BIGINT AS start FROM p)"""


@query("prj72_located_entities", f"{_PLACES} SELECT doc_id, label, phrase, start FROM o")
def prj72(spark, sf):
    from tagloom.functions import spoken

    found = tagged(spark, sf).select("doc_id", F.explode(spoken.located_entities(F.col("text"), "ENTITY_")).alias("e")).select("doc_id", "e.*")
    return found.select("doc_id", "label", "phrase", F.col("start").cast("long").alias("start"))


@query("prj72_every_entity_place", f'{_PLACES} SELECT doc_id, label, phrase, start, start + length(phrase) AS "end" FROM o')
def prj72_every(spark, sf):
    """Every place of every span's phrase, as ``spoken.located_entities`` finds them."""
    spans = r"(?Ud)(ENTITY_\w+) (.*?) END"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(spans), F.lit(1)).alias("label"), F.regexp_extract_all("text", F.lit(spans), F.lit(2)).alias("phrase"))
    rows = tagged(spark, sf).select("doc_id", "text", F.explode(found).alias("e")).select("doc_id", "text", "e.*")
    quoted = F.concat(F.lit(r"\Q"), F.replace("phrase", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = rows.withColumn("between", F.split("text", quoted, -1)).drop("text")
    starts = F.expr("transform(sequence(1, size(between) - 1), k -> aggregate(slice(between, 1, k), 0, (n, x) -> n + length(x)) + (k - 1) * length(phrase))")
    placed = pieces.select("doc_id", "label", "phrase", F.explode(starts).alias("start"))
    return placed.select("doc_id", "label", "phrase", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("phrase")).cast("long").alias("end"))

"""Queries of audits, vocabularies and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import metadata, tags
from tagloom.operators import audits, metrics
from tagloom.plans.views import NORM, TAGGED, TURNS, edits, predicted_turns, query, table, tagged


@query("agg01_totals", r"""WITH %s, w AS (SELECT duration, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM tagged)
  SELECT count(*) AS samples, round(sum(duration) / 3600, 4) AS hours, round(avg(duration), 4) AS mean_duration, """ % TAGGED + ", ".join(
    f"count(*) FILTER (WHERE len(list_filter(w, lambda x: starts_with(x, '{f}_'))) > 0) AS samples_with_{f.lower()}, sum(len(list_filter(w, lambda x: starts_with(x, '{f}_'))))::BIGINT AS {f.lower()}_tags" for f in ("AGE", "GENDER", "EMOTION", "INTENT", "ENTITY")
) + " FROM w")
def agg01(spark, sf):
    return audits.totals(tagged(spark, sf))


@query("agg02_shares", "SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang")
def agg02(spark, sf):
    return audits.shares(table(spark, sf, "documents"), "lang")


@query("agg03_by_dataset", "SELECT source, count(*) AS samples, round(sum(n_chars / 15.0) / 3600, 4) AS hours, arg_max(lang, doc_id) AS last_family, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def agg03(spark, sf):
    docs = table(spark, sf, "documents").withColumn("d", (F.col("n_chars") / 15.0).cast("double"))
    return audits.by_dataset(docs, "source", "d", "lang", "lang", "doc_id")


@query("agg04_top_tags", f"WITH {NORM} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM norm) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def agg04(spark, sf):
    return audits.top(audits.tag_counts(tagged(spark, sf)), 20, "tag")


@query("agg04_tag_histogram", r"""WITH %s, t AS (SELECT unnest(regexp_extract_all(text, '\b(?:AGE|GENDER|EMOTION|INTENT|ENTITY|DIALECT)_\S+')) AS t FROM tagged)
  SELECT split_part(t, '_', 1) AS family, regexp_replace(t, '^[A-Z]+_', '') AS value, count(*) AS n FROM t GROUP BY ALL""" % TAGGED)
def agg04b(spark, sf):
    return audits.tag_histogram(tagged(spark, sf))


@query("agg06_special_tokens", r"""WITH %s, w AS (SELECT upper(trim(unnest(regexp_split_to_array(text, '\s+')), '.,;:!?"''()[]{}')) AS token FROM tagged),
  c AS (SELECT token, count(*) AS n FROM w WHERE regexp_matches(token, '^(?:AGE_|EMOTION_|END)') GROUP BY token UNION ALL SELECT 'END', 0), s AS (SELECT token, sum(n)::BIGINT AS n FROM c GROUP BY token)
  SELECT row_number() OVER (ORDER BY token = 'END', n DESC, token) - 1 AS rank, token, n FROM s""" % TAGGED)
def agg06(spark, sf):
    return audits.special_tokens(tagged(spark, sf), prefixes=["age_", "emotion_", "end"])


@query("agg07_languages", "SELECT DISTINCT upper(lang) AS lang FROM documents WHERE lang <> ''")
def agg07(spark, sf):
    return audits.languages(table(spark, sf, "documents"), "lang")


@query("agg08_pieces", rf"""WITH {NORM}, t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM norm) GROUP BY tag HAVING count(*) >= 5),
  p AS (SELECT unnest(CASE WHEN tag IN ('END', 'TURN_CHANGE') THEN [tag] ELSE string_split(regexp_replace(regexp_replace(tag, '^([A-Z]+_)(.*)$', '\1|\2'), '([A-Z0-9])_([A-Z0-9])', '\1|_\2', 'g'), '|') END) AS piece, n FROM t)
  SELECT piece, sum(n)::BIGINT AS n FROM p WHERE piece <> '' GROUP BY piece""")
def agg08(spark, sf):
    return audits.piece_vocabulary(tagged(spark, sf))


@query("agg09_letters", f"""WITH {NORM}, c AS (SELECT unnest(string_split(array_to_string(list_filter(words, lambda w: NOT list_contains(tags, w)), ' '), '')) AS letter FROM norm) SELECT letter, count(*) AS n FROM c WHERE letter <> '' GROUP BY letter HAVING count(*) >= 10""")
def agg09(spark, sf):
    return audits.character_vocabulary(tagged(spark, sf))


@query("agg10_new_tokens", r"""WITH %s, w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM tagged)
  SELECT token, count(*) AS n FROM w WHERE regexp_matches(token, '^[A-Z][A-Z0-9_]*_[A-Z0-9_<>+.]*$|^END$') AND regexp_matches(token, '^(?:ENTITY_|INTENT_|EMOTION_|GENDER_|AGE_|DIALECT_|KEYWORD_|LANG_|OTHER_)') AND token NOT IN ('EMOTION_SAD', 'AGE_30_45') GROUP BY token HAVING count(*) >= 10""" % TAGGED)
def agg10(spark, sf):
    vocabulary = spark.createDataFrame([("EMOTION_SAD",), ("▁AGE_30_45",)], "token string")
    return audits.new_tokens(tagged(spark, sf), vocabulary)


@query("agg11_prefix_rollup", f"WITH {NORM} SELECT split_part(tag, '_', 1) AS prefix, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM norm) GROUP BY prefix")
def agg11(spark, sf):
    return audits.prefix_rollup(audits.tag_counts(tagged(spark, sf)))


@query("agg12_frequent_classes", "SELECT lang, count(*) AS n FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 150) GROUP BY lang")
def agg12(spark, sf):
    return audits.frequent_classes(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 150).groupBy("lang").agg(F.count("*").alias("n"))


@query("agg13_family_weights", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS a, count(*) AS k FROM c), p AS (SELECT source, n, pow(n / a, 5.0) AS p, a / (k * n) AS inverse FROM c, t)
  SELECT source, n, round(p / sum(p) OVER (), 8) AS probability, round(inverse, 8) AS inverse FROM p""")
def agg13(spark, sf):
    made = audits.family_weights(table(spark, sf, "documents"), "source")
    return made.select("source", "n", F.round("probability", 8).alias("probability"), F.round("inverse", 8).alias("inverse"))


@query("agg15_keyphrase_weights", f"WITH {NORM} SELECT doc_id, 1 + 0.5 * len(list_filter(words, lambda w: starts_with(w, 'ENTITY_') OR w = 'END')) AS weight FROM norm")
def agg15(spark, sf):
    return tagged(spark, sf).select("doc_id", audits.keyphrase_weight(tags.normalize(F.col("text")), 0.5).alias("weight"))


@query("agg16_change_counts", f"WITH {NORM} SELECT 'rewritten' AS change, count(*) FILTER (WHERE norm <> text) AS n FROM norm UNION ALL SELECT 'has_span', count(*) FILTER (WHERE list_contains(words, 'END')) FROM norm")
def agg16(spark, sf):
    norm = tagged(spark, sf).withColumn("norm", tags.normalize(F.col("text")))
    return audits.change_counts(norm, {"rewritten": F.col("norm") != F.col("text"), "has_span": F.array_contains(F.split("norm", " "), "END")})


@query("agg23_deduplicated_vocabulary", """WITH t AS (SELECT lang, source AS token, min(doc_id) AS position FROM documents WHERE lang IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY lang, position) AS r FROM t)
  SELECT token, lang, position, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM t x WHERE x.token = r.token) AS langs FROM r WHERE r = 1""")
def agg23(spark, sf):
    tokens = table(spark, sf, "documents").filter("lang is not null").select("lang", F.col("source").alias("token"), F.col("doc_id").alias("position"))
    return audits.deduplicated_vocabulary(tokens)


@query("agg25_majority", """SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def agg25(spark, sf):
    return audits.majority(table(spark, sf, "documents"), "source", "lang", "doc_id")


_GUESS = "CASE WHEN doc_id % 10 = 0 THEN 'xx' WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END"


def _guesses(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", F.expr(_GUESS).alias("guess"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END").alias("other"))


@query("agg26_confusion", f"""WITH g AS (SELECT lang AS r, {_GUESS} AS p FROM documents), k AS (SELECT * FROM g WHERE r IS NOT NULL AND p IS NOT NULL), l AS (SELECT r AS x FROM k UNION SELECT p FROM k)
  SELECT a.x AS reference, b.x AS predicted, (SELECT count(*) FROM k WHERE r = a.x AND p = b.x) AS n FROM l a, l b""")
def agg26(spark, sf):
    return metrics.confusion(_guesses(spark, sf), "lang", "guess")


@query("agg27_class_report", f"""WITH g AS (SELECT lang AS r, {_GUESS} AS p FROM documents), k AS (SELECT * FROM g WHERE r IS NOT NULL AND p IS NOT NULL), l AS (SELECT r AS x FROM k UNION SELECT p FROM k),
  c AS (SELECT x AS label, (SELECT count(*) FROM k WHERE r = x) AS support, (SELECT count(*) FROM k WHERE p = x) AS q, (SELECT count(*) FROM k WHERE p = x AND r = x) AS t FROM l),
  s AS (SELECT *, CASE WHEN q = 0 THEN 0.0 ELSE t / q END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE t / support END AS re FROM c), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f FROM s),
  n AS (SELECT sum(support)::BIGINT AS n FROM f)
  SELECT label, support, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1 FROM f UNION ALL SELECT 'accuracy', n, NULL, round(n / (SELECT count(*) FROM documents), 6), round((SELECT sum(t) FROM f) / n, 6) FROM n
  UNION ALL SELECT 'macro', n, NULL, NULL, round((SELECT avg(f) FROM f), 6) FROM n UNION ALL SELECT 'weighted', n, NULL, NULL, round((SELECT sum(f * support) FROM f) / n, 6) FROM n""")
def agg27(spark, sf):
    made = metrics.class_report(_guesses(spark, sf), "lang", "guess")
    return made.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg28_agreement", f"""WITH g AS (SELECT lang, {_GUESS} AS guess, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS other FROM documents), x AS (SELECT 'lang' AS one, 'guess' AS two, lang AS a, guess AS b FROM g UNION ALL SELECT 'lang', 'other', lang, other FROM g UNION ALL SELECT 'guess', 'other', guess, other FROM g)
  SELECT one, two, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS share FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY one, two""")
def agg28(spark, sf):
    made = metrics.agreement(_guesses(spark, sf), ["lang", "guess", "other"])
    return made.withColumn("share", F.round("share", 6))


_ERRORS = f"WITH RECURSIVE {TURNS}, numbered AS (SELECT *, conv_id * 1000000 + turn AS k FROM turns), {edits('numbered', 'k')}"


@query("agg29_word_error_rate", f"""{_ERRORS}, s AS (SELECT role, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, sum(insertions)::BIGINT AS i, sum(deletions)::BIGINT AS d, sum(substitutions)::BIGINT AS u FROM edits JOIN numbered USING (k) GROUP BY role)
  SELECT role, errors, words, round(errors / words, 6) AS wer, round(i / words, 6) AS ins_rate, round(d / words, 6) AS del_rate, round(u / words, 6) AS sub_rate FROM s""")
def agg29(spark, sf):
    """By role, with the rates of insertions, deletions and substitutions."""
    made = metrics.error_rate(predicted_turns(spark, sf), F.col("hyp"), F.col("ref"), by=["role"])
    return made.select("role", "errors", "words", *[F.round(c, 6).alias(c) for c in ("wer", "ins_rate", "del_rate", "sub_rate")])


@query("agg31_dropped_words", rf"""WITH {TURNS}, k AS (SELECT role, coalesce(text, '') AS text, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda x, i: (i - 1 + turn) % 5 <> 0), ' ') AS kept FROM turns),
  w AS (SELECT role, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, len(list_filter(regexp_split_to_array(kept, '\s+'), lambda x: x <> '')) AS k FROM k)
  SELECT role, sum(n - k)::BIGINT AS errors, sum(n)::BIGINT AS words FROM w GROUP BY role""")
def agg31(spark, sf):
    """Where the hypothesis only lacks words, the distance is the number of words left out."""
    kept = F.expr("array_join(filter(split(text, ' '), (x, i) -> (i + turn) % 5 <> 0), ' ')")
    return metrics.error_rate(predicted_turns(spark, sf), kept, F.col("text"), by=["role"]).select("role", "errors", "words")


@query("agg31_mean_error_rate", f"{_ERRORS} SELECT count(*) AS n, round(avg(CASE WHEN words > 0 THEN errors / words ELSE errors END), 6) AS mean_wer FROM edits")
def agg31b(spark, sf):
    return metrics.mean_error_rate(predicted_turns(spark, sf), F.col("hyp"), F.col("ref")).withColumn("mean_wer", F.round("mean_wer", 6))


@query("agg29_character_error_rate")
def agg29b(spark, sf):
    """Letter by letter over turns."""
    return metrics.error_rate(predicted_turns(spark, sf), F.col("hyp"), F.col("ref"), characters=True)


@query("agg32_span_scores", rf"""WITH {TAGGED}, s AS (SELECT doc_id, unnest(regexp_extract_all(text, 'ENTITY_CITY (?:new )?src\d+ END')) AS s FROM tagged), g AS (SELECT doc_id, s FROM s), p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN s ELSE replace(s, 'src', 'town') END AS s FROM s WHERE doc_id % 3 <> 0),
  c AS (SELECT (SELECT count(*) FROM g JOIN p USING (doc_id, s)) AS tp, (SELECT count(*) FROM g) AS gt, (SELECT count(*) FROM p) AS pred), r AS (SELECT *, tp / pred AS pr, tp / gt AS re FROM c)
  SELECT label, CASE WHEN label <> 'overall_macro' THEN tp END AS tp, CASE WHEN label <> 'overall_macro' THEN gt END AS gt, CASE WHEN label <> 'overall_macro' THEN pred END AS pred, round(pr, 6) AS "precision", round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS fscore
  FROM r, (VALUES ('ENTITY_CITY'), ('overall_micro'), ('overall_macro')) t(label)""")
def agg32(spark, sf):
    docs = tagged(spark, sf).withColumn("hyp", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 2 = 0 THEN text ELSE replace(text, concat(source, ' END'), concat(replace(source, 'src', 'town'), ' END')) END"))
    made = metrics.span_scores(docs, "doc_id", F.col("hyp"), F.col("text"))
    return made.select("label", "tp", "gt", "pred", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fscore")])


@query("agg34_tag_set_scores", rf"""WITH {TURNS}, t AS (SELECT (turn % 3) AS h, (turn % 2) AS r FROM turns), s AS (SELECT count(*) FILTER (WHERE (h = 0 AND r = 0) OR (h = 1 AND r = 1)) AS tp, count(*) FILTER (WHERE (h = 0 AND r = 1) OR (h = 1 AND r = 0)) AS fp, count(*) FILTER (WHERE NOT ((h = 0 AND r = 0) OR (h = 1 AND r = 1))) AS fn FROM t),
  p AS (SELECT tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM s) SELECT round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p""")
def agg34(spark, sf):
    made = metrics.tag_set_scores(predicted_turns(spark, sf), F.col("hyp"), F.col("ref"))
    return made.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg35_family_error_rate", f"""{_ERRORS} SELECT role, grouping(role)::INT AS everything, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, round(sum(errors) / sum(words), 6) AS wer
  FROM edits JOIN numbered USING (k) GROUP BY ROLLUP (role)""")
def agg35(spark, sf):
    return metrics.family_error_rate(predicted_turns(spark, sf), F.col("hyp"), F.col("ref"), "role").withColumn("wer", F.round("wer", 6))


@query("agg38_first_seen", rf"""WITH k AS (SELECT doc_id, unnest(string_split(concat('INTENT|', upper(source)), '|')) AS token, generate_subscripts(['a', 'b'], 1) - 1 AS place FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, place) AS r FROM k) SELECT token, doc_id, place FROM r WHERE r = 1""")
def agg38(spark, sf):
    return audits.first_seen(table(spark, sf, "documents").select("doc_id", F.concat(F.lit("INTENT_"), F.upper("source")).alias("line")), "line", "doc_id")


@query("agg41_speech_metrics", r"""WITH w AS (SELECT doc_id, n_chars / 15.0 AS d, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), m AS (SELECT doc_id, d, len(w) AS n, len(list_filter(w, lambda x: lower(x) IN ('the', 'de', 'und'))) AS f FROM w)
  SELECT doc_id, CASE WHEN d > 0 THEN round(n / (d / 60), 4) ELSE 0.0 END AS wpm, f AS fillers FROM m""")
def agg41(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(metadata.speech_rate(F.col("text"), (F.col("n_chars") / 15.0).cast("double")), 4).alias("wpm"), metadata.disfluency(F.col("text"), ["the", "de", "und"], F.lit(0.5))["fillers"].alias("fillers"))


@query("agg44_label_ids", "SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def agg44(spark, sf):
    return audits.label_ids(table(spark, sf, "documents"), "lang")


@query("agg45_tag_parts", rf"WITH {NORM} SELECT DISTINCT part FROM (SELECT unnest(string_split(t, '_')) AS part FROM (SELECT unnest(tags) AS t FROM norm)) WHERE regexp_matches(part, '^[A-Za-z0-9]{{2,}}$')")
def agg45(spark, sf):
    return audits.tag_parts(tagged(spark, sf).select(tags.normalize(F.col("text")).alias("text")))


@query("agg46_encoded", "SELECT doc_id, CASE WHEN source IS NULL THEN '0,0,0,0,0,0' WHEN length(source) = 4 THEN concat('1,', '1,', '3,', CASE WHEN source[4] = '1' THEN '4' ELSE '1' END, ',0,0') ELSE concat('1,1,3,', CASE WHEN source[4] = '1' THEN '4' ELSE '1' END, ',', CASE WHEN source[5] = '1' THEN '4' ELSE '1' END, ',0') END AS ids FROM documents")
def agg46(spark, sf):
    ids = F.create_map(F.lit("c"), F.lit(3), F.lit("1"), F.lit(4))
    return table(spark, sf, "documents").select("doc_id", F.array_join(audits.encoded(F.upper("source"), ids, 6), ",").alias("ids"))


@query("agg47_examples", "SELECT source, doc_id, row FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row FROM documents) WHERE row <= 3")
def agg47(spark, sf):
    return audits.examples(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("prj71_ids_to_text", """SELECT conv_id, trim(replace(string_agg(concat('▁', role), '' ORDER BY turn), '▁', ' '), ' ') AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def prj71(spark, sf):
    vocabulary = spark.createDataFrame([(0, "▁user"), (1, "▁assistant")], "id int, token string")
    ids = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("place"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(9).alias("id"))
    return audits.ids_to_text(ids, vocabulary, "conv_id")

"""The driver's tables, and tagged views of them in both engines. The tables carry no tags: the views derive some from keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the DuckDB SQL of its rows."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TEXT = """concat(
  CASE doc_id % 4 WHEN 0 THEN 'EMOTION_HAP' WHEN 1 THEN 'EMOTION_NEU' WHEN 2 THEN 'EMOTION_SAD' ELSE 'EMOTION_UNKNOWN' END, ' ',
  CASE doc_id % 2 WHEN 0 THEN 'GER_MALE' ELSE 'GENDER_FEMALE' END, ' ',
  CASE doc_id % 3 WHEN 0 THEN 'AGE_60+' WHEN 1 THEN 'AGE_30_45' ELSE 'AGE_NUMBER' END, ' ',
  CASE doc_id % 5 WHEN 0 THEN 'ENTITY_STATEAGE_18_30' WHEN 1 THEN concat('ENTITY_CITY ', source, ' END') WHEN 2 THEN concat('ENTITY_CITY new ', source, ' END') ELSE 'hello' END, ' ',
  CASE doc_id % 7 WHEN 0 THEN 'INTENT_SUGGEST' WHEN 1 THEN 'INTENT_INFORM' WHEN 2 THEN 'INTENT_THANK' WHEN 3 THEN 'INTENT_XYZ' ELSE 'okay' END, ' ', text)"""

#: Documents with tags: doc_id, lang, source, n_chars, raw (text without tags), duration, text.
TAGGED = f"tagged AS (SELECT doc_id, lang, source, n_chars, text AS raw, n_chars / 15.0 AS duration, {_TEXT} AS text FROM documents)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.col("text").alias("raw"), (F.col("n_chars") / 15.0).cast("double").alias("duration"), F.expr(_TEXT).alias("text")
    )


#: Turns with a hypothesis: every fifth word of the text left out, a tag in front of each.
_HYPOTHESIS = """concat(CASE turn % 3 WHEN 0 THEN 'EMOTION_SAD ' WHEN 1 THEN 'EMOTION_HAPPY ' ELSE '' END, CASE conv_id % 4 WHEN 0 THEN '<N1> ' ELSE '<N2> ' END, {dropped})"""
_REFERENCE = """concat(CASE turn % 2 WHEN 0 THEN 'EMOTION_SAD ' ELSE 'EMOTION_HAPPY ' END, CASE conv_id % 3 WHEN 0 THEN '<N1> ' WHEN 1 THEN '<N2> ' ELSE '' END, text)"""


def predicted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text, ref, hyp."""
    dropped = "array_join(filter(split(text, ' '), (x, i) -> (i + turn) % 5 <> 0), ' ')"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.expr(_REFERENCE).alias("ref"), F.expr(_HYPOTHESIS.format(dropped=dropped)).alias("hyp"))


TURNS = f"""turns AS (SELECT conv_id, turn, role, text, {_REFERENCE} AS ref,
  {_HYPOTHESIS.format(dropped="array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1 + turn) % 5 <> 0), ' ')")} AS hyp FROM conversations)"""


def squeezed(c: str) -> str:
    """SQL of a text with single spaces."""
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def normalized(c: str) -> str:
    """SQL of the library's rewrite chain."""
    steps = [
        (r"replace({}, 'EMOTION_HAPPYPY', 'EMOTION_HAPPY')"), (r"regexp_replace({}, 'EMOTION_HAP\b', 'EMOTION_HAPPY', 'g')"), (r"regexp_replace({}, 'EMOTION_NEU\b', 'EMOTION_NEUTRAL', 'g')"),
        (r"regexp_replace({}, 'EMOTION_ANG\b', 'EMOTION_ANGRY', 'g')"), (r"regexp_replace({}, 'EMOTION_INFORM\b', 'EMOTION_NEUTRAL', 'g')"), (r"regexp_replace({}, 'EMOTION_JOY\b', 'EMOTION_HAPPY', 'g')"),
        (r"regexp_replace({}, 'EMOTION_ANGRYER\b', 'EMOTION_ANGRY', 'g')"), (r"replace({}, 'GGENDER_', 'GENDER_')"), (r"replace({}, 'GENSION_', 'GENDER_')"), (r"replace({}, 'GER_', 'GENDER_')"),
        (r"replace({}, 'AGE_60+', 'AGE_60PLUS')"), (r"""regexp_replace({}, '(\w)",', '\1', 'g')"""), (r"regexp_replace({}, '(ENTITY_[A-Z_]+)(AGE_)', '\1 \2', 'g')"),
        (r"regexp_replace({}, '(OTHER_[A-Z_]+)(OTHER_)', '\1 \2', 'g')"), (r"regexp_replace({}, '(OTHER_[A-Z_]+)(INTENT_)', '\1 \2', 'g')"), (r"regexp_replace({}, '(INTENT_[A-Z_]+)(AGE_)', '\1 \2', 'g')"),
    ]
    out = f"coalesce({c}, '')"
    for step in steps:
        out = step.replace("{}", out)
    return squeezed(out)


IS_TAG = r"'^(?:(?:ENTITY_|INTENT_|EMOTION_|GENDER_|AGE_|DIALECT_|KEYWORD_|LANG_|OTHER_|ROLE_|SPEAKER_|TURN_|FAMILY_)[A-Z0-9_+.<>]*|END|TURN_CHANGE)$'"

#: Tagged documents with ``norm``, its ``words`` and the ``tags`` among them.
NORM = f"""{TAGGED}, norm AS (SELECT *, string_split(norm, ' ') AS words, list_filter(string_split(norm, ' '), lambda w: regexp_matches(w, {IS_TAG})) AS tags
  FROM (SELECT *, {normalized('text')} AS norm FROM tagged))"""


def edits(pairs: str, key: str, of: str = "") -> str:
    """SQL of ``edits`` (``of`` goes before its names): errors, words, insertions, deletions and substitutions of rows (``key``, hyp, ref) of ``pairs``.

    A row of the table a step: an error counts a million, an insertion or deletion one more; white space divides words.
    """
    return rf"""{of}lists AS (SELECT {key}, list_filter(regexp_split_to_array(coalesce(hyp, ''), '\s+'), lambda x: x <> '') AS h, list_filter(regexp_split_to_array(coalesce(ref, ''), '\s+'), lambda x: x <> '') AS r FROM {pairs}),
  {of}dp AS (SELECT {key}, 0 AS i, list_transform(range(0, len(h) + 1), lambda j: j * 1000001) AS row FROM {of}lists
    UNION ALL SELECT {key}, i + 1, list_transform(range(1, len(h) + 2), lambda j: (j - 1) * 1000001 + list_min(best[1:j]))
    FROM (SELECT {key}, h, i, list_transform(range(0, len(h) + 1), lambda j: CASE WHEN j = 0 THEN row[1] + 1000001 ELSE least(row[j + 1] + 1000001, row[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1000000 END) END - j * 1000001) AS best
      FROM {of}dp JOIN {of}lists USING ({key}) WHERE i < len(r))),
  {of}cost AS (SELECT {key}, len(h) AS hn, len(r) AS words, row[len(h) + 1] AS c FROM {of}dp JOIN {of}lists USING ({key}) WHERE i = len(r)),
  {of}edits AS (SELECT {key}, words, c // 1000000 AS errors, (c % 1000000 + hn - words) // 2 AS insertions, (c % 1000000 - hn + words) // 2 AS deletions, c // 1000000 - c % 1000000 AS substitutions FROM {of}cost)"""

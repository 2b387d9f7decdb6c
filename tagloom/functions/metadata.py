"""Speaker, language, path and time fields of a manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions import lexicon as lx
from tagloom.functions.text import first_match, let, lookup, words


def age_bracket(years: Column, scheme: str = "schema", unknown: str | None = None, digits: int | None = None) -> Column:
    """The bracket of an age; ``digits``: rounded half-even before. Null (and, with ``unknown``, negative) ages give ``unknown``."""
    brackets, above = lx.AGE_BRACKETS[scheme]
    age = F.bround(years, digits) if digits is not None else years
    out = F.when(age.isNull(), F.lit(unknown))
    if unknown is not None:
        out = out.when(years < 0, unknown)
    for below, label in brackets:
        out = out.when(age < below, label)
    return out.otherwise(above)


def age_of_word(word: Column) -> Column:
    """The bracket of an age in words ("twenties"); anything else counts as twenty."""
    table = F.create_map(*[F.lit(x) for pair in lx.AGE_WORDS.items() for x in pair])
    return age_bracket(F.coalesce(F.try_element_at(table, F.lower(word)), F.lit(lx.AGE_WORD_DEFAULT)))


def gender_of_code(code: Column, male: int = 0, female: int = 1) -> Column:
    return F.when(code == male, "GENDER_MALE").when(code == female, "GENDER_FEMALE").otherwise("GENDER_OTHER")


def gender_of_word(word: Column) -> Column:
    w = F.upper(word)
    return F.when(w.isin("MALE", "FEMALE"), w).otherwise("OTHER")


def emotion_of_code(code: Column) -> Column:
    return F.concat(F.lit("EMOTION_"), lookup(F.upper(code), lx.EMOTION_CODES, F.lit("NEUTRAL")))


def supplied_or_predicted(age: Column, gender: Column, predicted_age: Column, predicted_gender: Column) -> Column:
    """STRUCT<age, gender>: the supplied pair only where both are there."""
    both = age.isNotNull() & gender.isNotNull()
    return F.struct(F.when(both, age).otherwise(predicted_age).alias("age"), F.when(both, gender).otherwise(predicted_gender).alias("gender"))


def is_given(value: Column) -> Column:
    """Whether a manifest value says something: not null, blank or NA."""
    return F.coalesce(~F.btrim(value).isin("", "NA"), F.lit(False))


# languages


def script_family(text: Column) -> Column:
    """The first script with more than 0.3 of the letters told apart (and one); MULTI if there is none."""
    clean = F.btrim(F.regexp_replace(text, "\\b(?:AGE_|GENDER_|EMOTION_|INTENT_|ENTITY_|END)\\S*", ""))
    counts = [F.regexp_count(clean, F.lit(pattern)) for _, pattern in lx.SCRIPTS]
    total = sum(counts[1:], counts[0]) + 1
    out = F.when(F.coalesce(clean, F.lit("")) == "", "MULTI")
    for (family, _), n in zip(lx.SCRIPTS, counts):
        out = out.when(n / total > 0.3, family)
    return out.otherwise("MULTI")


def language_family(lang: Column, given: Column, text: Column, scheme: str = "annotations") -> Column:
    """Family of a language code; family names stand for themselves; MULTI is told from the script; else what is given, or the script."""
    code = F.upper(lang)
    known = lookup(code, lx.FAMILY_OF[scheme])
    named = lang.isin([f for f in lx.FAMILY_NAMES if f != "MULTI"])
    return F.when(lang == "MULTI", script_family(text)).when(named, lang).when(lang == "MANDARIN", lookup(F.lit("ZH"), lx.FAMILY_OF[scheme])).when(known.isNotNull(), known).otherwise(F.coalesce(given, script_family(text)))


def family_or_single(lang: Column, families: dict[str, str], unknown: str = "UNKNOWN") -> Column:
    """Family by a configured map, or Singleton_XX; a null language is ``unknown``."""
    return F.when(lang.isNull(), unknown).otherwise(lookup(F.upper(lang), families, F.concat(F.lit("Singleton_"), F.upper(lang))))


def configured_families(config: dict | list) -> dict[str, str]:
    """Code -> family of a configuration: {family: [codes]}, a list of names, or a list of one-entry maps. Upper-cased."""
    entries = config.items() if isinstance(config, dict) else [(next(iter(x.items())) if isinstance(x, dict) else (x, [x])) for x in config]
    out = {str(code).upper(): str(family).upper() for family, codes in entries for code in ([codes] if isinstance(codes, str) else codes or [family])}
    if not out:
        raise ValueError("no language families configured")
    return out


def language_from_path(path: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches."""
    return F.coalesce(*[first_match(path, p, 1) for p in patterns])


# paths


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def file_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def rooted(path: Column, root: str | None = None, remap: tuple[str, str] | None = None) -> Column:
    """A prefix exchanged, then relative paths put under a root."""
    out = path
    if remap:
        out = F.when(F.startswith(path, F.lit(remap[0])), F.concat(F.lit(remap[1]), F.substring(path, len(remap[0]) + 1, 1 << 20))).otherwise(path)
    if root:
        out = F.when(F.startswith(out, F.lit("/")), out).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), out))
    return out


def mapped(path: Column, table: list[tuple[str, str]], root: str) -> Column:
    """The first prefix of the table that fits is exchanged; else the path goes under the root."""
    base = root.rstrip("/")
    out = None
    for prefix, new in table:
        case = F.concat(F.lit(f"{base}/{new.rstrip('/')}/"), F.substring(path, len(prefix) + 1, 1 << 20))
        out = F.when(F.startswith(path, F.lit(prefix)), case) if out is None else out.when(F.startswith(path, F.lit(prefix)), case)
    rest = F.concat(F.lit(f"{base}/"), F.ltrim(path, F.lit("/")))
    return rest if out is None else out.otherwise(rest)


def with_extension(path: Column, extension: str) -> Column:
    return F.regexp_replace(path, "\\.[^./]*$", f".{extension}")


def speaker_id(path: Column, source: Column) -> Column:
    """Speaker by the path rules of the source corpus."""
    stem, parts = file_stem(path), file_parts(path)
    last = F.when(F.contains(source, F.lit("_")), F.substring_index(source, "_", -1)).otherwise("unk")
    has = lambda *names: F.array_max(F.array(*[F.contains(source, F.lit(n)).cast("int") for n in names])) == 1
    # The split folders of one corpus
    splits = ["train-other-500", "train-clean-360", "train-clean-100", "dev-clean", "dev-other", "test-clean", "test-other"]

    def behind(names: list[str]) -> Column:
        """The part behind the first of these that has one."""
        found = F.filter(F.transform(parts, lambda p, i: F.when(p.isin(names), F.try_element_at(parts, i + 2))), lambda p: p.isNotNull())
        return F.try_element_at(found, F.lit(1))

    voice = F.concat(F.lit("SPK_cv_"), last, F.lit("_"), F.when(F.contains(stem, F.lit("_")), F.substring_index(stem, "_", -1)).otherwise(F.left(stem, F.lit(8))))
    read = F.concat(F.lit("SPK_ls_"), F.coalesce(behind(splits), F.left(stem, F.lit(4))))
    books = F.concat(F.lit("SPK_mls_"), F.coalesce(F.concat(last, F.lit("_"), behind(["audio"])), F.left(stem, F.lit(6))))
    other = lambda name: F.concat(F.lit(f"SPK_{name}_"), F.left(stem, F.lit(8)))
    return F.when(has("commonvoice"), voice).when(has("librispeech", "librespeech"), read).when(has("mls"), books).when(has("peoples"), other("ps")).otherwise(other("unk"))


# numbers, times and replies


def seconds(value: Column) -> Column:
    """Seconds as DOUBLE from a number or a string of one; null if it is neither."""
    return value.try_cast("double")


def clock(value: Column) -> Column:
    """MM:SS, or H:MM:SS, as seconds."""
    parts = F.split(value, ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 60 + p.try_cast("long"))


def clamped(score: Column, default: int = 3) -> Column:
    """1 to 5; what is no number is ``default``."""
    whole = F.floor(score.try_cast("double")).cast("int")
    return F.when(whole.isNull(), default).otherwise(F.least(F.greatest(whole, F.lit(1)), F.lit(5)))


def validated(value: Column, field: str) -> Column:
    """An interview field against its whitelist, prefix and case aside; anything else is the default."""
    allowed, default = lx.INTERVIEW[field]
    plain = F.replace(F.upper(value), F.lit(f"{field.upper()}_"), F.lit(""))
    return F.when(plain.isin(allowed), plain).otherwise(default)


def reply(text: Column, schema: str, defaults: dict[str, str]) -> Column:
    """A JSON reply with its fences off, parsed; fields that are missing (or all of a broken reply) take defaults."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(text, "^\\s*```(?:json)?", ""), "```\\s*$", ""))
    parsed = F.from_json(bare, schema)
    return F.struct(*[F.coalesce(parsed[f], F.lit(d).cast("string")).alias(f) for f, d in defaults.items()], F.expr("false").alias("_") if not defaults else F.try_parse_json(bare).isNull().alias("broken"))


def prediction_text(raw: Column) -> Column:
    """Text of a prediction: a JSON string, an object with text or pred_text, the first of an array of those, or the raw text."""
    v = F.try_parse_json(raw)
    paths = ["$", "$.text", "$.pred_text", "$[0]", "$[0].text", "$[0].pred_text"]
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths[1:3]], *[F.try_variant_get(v, p, "string") for p in paths[4:]], F.when(raw.rlike("^\\s*\\["), F.try_variant_get(v, "$[0]", "string")), F.when(raw.rlike('^\\s*"'), F.try_variant_get(v, "$", "string")), raw)


def boost_words(raw: Column) -> Column:
    """A list literal as ARRAY; anything else as its only entry. Never evaluated."""
    return F.coalesce(F.from_json(F.replace(raw, F.lit("'"), F.lit('"')), "array<string>"), F.array(raw))


def speech_rate(text: Column, duration: Column) -> Column:
    """Words a minute; 0 without a duration."""
    return F.when(duration > 0, F.size(words(text)) / (duration / 60)).otherwise(F.lit(0.0))


def disfluency(text: Column, fillers: list[str], mean_pause: Column) -> Column:
    """STRUCT<fillers, repeats, score>: fillers (up to 20) weigh 5, the mean pause (up to 30 s) 3, repeated words (up to 10) 2."""
    tokens = F.transform(words(text), F.lower)
    n = F.size(F.filter(tokens, lambda w: w.isin(fillers)))
    # bound once: a lambda computes whatever else it mentions again for every word
    again = let(tokens, lambda t: F.size(F.filter(t, lambda w, i: (i > 0) & (w == F.try_element_at(t, F.when(i > 0, i).otherwise(1))))))
    score = 10 * (F.least(n, F.lit(20)) / 20 * 0.5 + F.least(mean_pause, F.lit(30.0)) / 30 * 0.3 + F.least(again, F.lit(10)) / 10 * 0.2)
    return F.struct(n.alias("fillers"), again.alias("repeats"), score.alias("score"))

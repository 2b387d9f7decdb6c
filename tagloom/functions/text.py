"""Text as words. White space is Unicode's and the four separators U+001C to U+001F, as in most scripting languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1C- \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """ARRAY of the words of a text; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """One space between words and none around; null becomes empty."""
    return F.array_join(words(text), " ")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, and the ends are trimmed; null stays null."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small constant table: a map literal probed once a row."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default if default is not None else F.lit(None).cast("string"))


def any_of(values: list[str]) -> str:
    """A regular expression for one of the values."""
    escaped = ["".join("\\" + c if c in r"\.+*?()[]{}|^$" else c for c in v) for v in values]
    return "(?:" + "|".join(escaped) + ")"


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def insert_after_first(text: Column, patterns: list[str], addition: Column, otherwise: Column) -> Column:
    """``addition`` put in behind the first match of the first pattern that has one."""
    out = otherwise
    for pattern in reversed(patterns):
        found = F.regexp_extract(text, pattern, 0)
        # a match can begin with a word boundary, which its text alone does not show: cut at the first match itself
        before = F.regexp_extract(text, f"(?s)^(.*?){pattern}", 1)
        size = F.length(before) + F.length(found)
        put = F.concat(F.substring(text, F.lit(1), size), addition, F.substring(text, size + 1, F.length(text)))
        out = F.when(text.rlike(pattern), put).otherwise(out)
    return out

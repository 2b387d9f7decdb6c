"""Spoken numbers to written ones, token streams merged, and entities located."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of numbers in English, and in Hindi from 0 to 99 in order.
_ENGLISH = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_HINDI = """शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस
तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ
साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी
नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे""".split()
_SMALL = {w: i for i, w in enumerate(_ENGLISH)} | _TENS | {w: i for i, w in enumerate(_HINDI)} | {"पांच": 5, "ज़ीरो": 0, "जीरो": 0, "छबीस": 26}
_HUNDRED = {"hundred", "सौ", "हंड्रेड"}
_SCALES = {
    "thousand": 10**3, "हजार": 10**3, "हज़ार": 10**3, "थाउज़ेंड": 10**3, "lakh": 10**5, "lakhs": 10**5, "लाख": 10**5, "लाखों": 10**5,
    "million": 10**6, "crore": 10**7, "crores": 10**7, "करोड़": 10**7, "billion": 10**9,
}
_PERCENT = {"percent", "परसेंट", "पर्सेंट", "प्रतिशत"}
_CENTS = {"cent", "cents", "पैसे", "पैसा", "पैसों"}
CURRENCIES = {"dollar": "$", "dollars": "$", "rupee": "₹", "rupees": "₹", "रुपये": "₹", "रूपये": "₹", "रुपए": "₹", "रूपए": "₹", "euro": "€", "euros": "€", "pound": "£", "pounds": "£"}
_KEPT = 13  # single words below stay words


def read_number(words: list[str], at: int) -> tuple[int, int]:
    """(value, words read) of the longest spoken number from a place; nothing read where there is none."""
    total = part = value = 0
    i, good, last_scale, open_tens = at, at, 1 << 62, False
    while i < len(words):
        w = words[i].lower()
        if w == "and" and i > at and i + 1 < len(words) and words[i + 1].lower() in _SMALL and (part >= 100 or total) and part % 100 == 0:
            i += 1
            continue
        if w in _SMALL:
            n, tail = _SMALL[w], part % 100
            if tail == 0 and (n or i == at):
                part += n
                open_tens = w in _TENS
            elif open_tens and 0 < n < 10:
                part += n
                open_tens = False
            else:
                break
        elif w in _HUNDRED and 0 < part < 10:
            part, open_tens = part * 100, False
        elif w in _SCALES and part and _SCALES[w] < last_scale:
            last_scale = _SCALES[w]
            total, part, open_tens = total + part * last_scale, 0, False
        else:
            break
        i += 1
        good, value = i, total + part
    return value, good - at


def written(text: str, currencies: dict[str, str] = CURRENCIES) -> str:
    """Numbers, sums of money and percentages of a spoken text as digits."""
    words, out, i = text.split(), [], 0
    while i < len(words):
        value, n = read_number(words, i)
        after = words[i + n].lower() if n and i + n < len(words) else ""
        if n and after in _PERCENT:
            out.append(f"{value}%")
            i += n + 1
        elif n and after in currencies:
            i += n + 1
            cents = ""
            if i < len(words) and words[i].lower() == "and":
                small, m = read_number(words, i + 1)
                if m and small < 100 and i + 1 + m < len(words) and words[i + 1 + m].lower() in _CENTS:
                    cents, i = f".{small:02d}", i + m + 2
            out.append(f"{currencies[after]}{value}{cents}")
        elif n and not (n == 1 and value < _KEPT):
            out.append(str(value))
            i += n
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def _mapped(column: Column, function) -> Column:
    def change(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(change, T.StringType())(column)


def inverse_normalized(text: Column, currencies: dict[str, str] = CURRENCIES) -> Column:
    return _mapped(text, lambda t: written(t, currencies))


# Entity types whose words are capitalized.
NAMES = ["PERSON", "ORG", "GPE", "LOC", "EVENT", "PRODUCT", "WORK_OF_ART", "FAC", "LANGUAGE", "LAW", "NORP"]


def formatted_entities(text: Column) -> Column:
    """NER_CARDINAL spans written as digits, names capitalized, other spans trimmed."""

    def change(t: str) -> str:
        def span(m: re.Match) -> str:
            kind, content = m[1], m[2].strip()
            if kind == "CARDINAL":
                content = written(content)
            elif kind in NAMES:
                content = " ".join(w.capitalize() for w in content.split())
            return f"NER_{kind} {content} END"

        return re.sub(r"NER_([A-Z_]+)\s+(.*?)\s+END\b", span, t)

    return _mapped(text, change)


def with_punctuation(clean: Column, tagged: Column) -> Column:
    """Words and punctuation of a clean text, in order, with the entity tags of its tagged form at the same words.

    Tagged words are matched with the next words of the clean text, whose punctuation follows them; what the clean text
    has left over comes last.
    """

    def merge(cleans: pa.Array, taggeds: pa.Array) -> pa.Array:
        return pa.array([None if c is None or t is None else _punctuated(c, t) for c, t in zip(cleans.to_pylist(), taggeds.to_pylist())], pa.string())

    return F.arrow_udf(merge, T.StringType())(clean, tagged)


def _punctuated(clean: str, tagged: str) -> str:
    parts = re.findall(r"\w+(?:'\w+)*|[.,!?;]", clean)
    out, i = [], 0

    def marks() -> Iterator[str]:
        nonlocal i
        while i < len(parts) and parts[i] in ".,!?;":
            yield parts[i]
            i += 1

    for word in tagged.split():
        if re.match(r"ENTITY[-_]\w+$", word):
            out += [*marks(), word]
        elif word == "END":
            out.append(word)
        elif re.match(r"\w", word):
            out += marks()
            if i < len(parts):
                out.append(parts[i])
                i += 1
    out += parts[i:]
    return re.sub(r" ([.,!?;])", r"\1", " ".join(out))


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def located_entities(text: Column, prefix: str = "NER_") -> Column:
    """ARRAY<STRUCT<label, phrase, start, end>>: every place of every phrase that a span of the text has."""

    def find(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = re.findall(rf"({re.escape(prefix)}\w+) (.*?) END", t or "")
            out.append([{"label": label, "phrase": phrase, "start": m.start(), "end": m.end()} for label, phrase in spans for m in re.finditer(re.escape(phrase), t)])
        return pa.array(out, _FOUND)

    kind = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return F.arrow_udf(find, kind)(text)


# Emotions and the marks that a synthesizer reads them from.
EMOTION_MARKS = {"hap": "<laugh>", "happy": "<laugh>", "sad": "<sigh>", "ang": "<angry>", "angry": "<angry>", "sur": "<gasp>", "neu": "", "neutral": ""}


def with_emotion_mark(text: Column, emotion: Column, marks: dict[str, str] = EMOTION_MARKS) -> Column:
    """The mark of an emotion before the text; none for a neutral or unknown one."""
    from tagloom.functions.text import lookup

    mark = lookup(F.lower(emotion), {k: v for k, v in marks.items() if v})
    return F.concat_ws(" ", mark, F.btrim(F.coalesce(text, F.lit(""))))


def mixed_at_snr(clean: Column, noise: Column, snr_db: Column) -> Column:
    """Samples with noise, repeated or cut to their length, at a signal-to-noise ratio in decibels; peaks are held below 1."""

    def mix(cleans: pa.Array, noises: pa.Array, ratios: pa.Array) -> pa.Array:
        out = []
        for c, n, r in zip(cleans.to_pylist(), noises.to_pylist(), ratios.to_pylist()):
            if not c or not n or r is None:
                out.append(c)
                continue
            x, y = np.array(c, np.float64), np.resize(np.array(n, np.float64), len(c))
            power = float((y * y).mean())
            if power < 1e-10:
                out.append(c)
                continue
            z = x + y * np.sqrt(float((x * x).mean()) / 10 ** (r / 10) / power)
            peak = float(np.abs(z).max())
            out.append((z * (0.99 / peak if peak > 0.99 else 1)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(mix, T.ArrayType(T.DoubleType()))(clean, noise, snr_db)

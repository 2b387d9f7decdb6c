"""Plug points for models: batches in, records out, keys carried, failures answered with defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Annotator = Callable[[list[str]], list[dict]]


def annotated(df: DataFrame, key: str, text: str, annotate: Annotator, fields: dict[str, str], batch: int = 20, tries: int = 3) -> DataFrame:
    """(key, fields..., ok): ``annotate`` over batches of texts. ``fields`` maps names to defaults.

    An answer of another length, or an exception in every try, gives the defaults with ok false; missing or null fields
    take theirs. The last batch may be short; none is lost.
    """
    schema = T.StructType([df.schema[key], *[T.StructField(f, T.StringType()) for f in fields], T.StructField("ok", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                answers, ok = None, False
                for _ in range(tries):
                    try:
                        answers = annotate([t or "" for t in part[text].tolist()])
                    except Exception:  # a model's failure is an answer here
                        continue
                    if len(answers) == len(part):
                        ok = True
                        break
                for k, answer in zip(part[key].tolist(), answers if ok else [{}] * len(part)):
                    rows.append([k, *[str(answer[f]) if answer.get(f) is not None else d for f, d in fields.items()], ok])
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return df.select(key, text).mapInPandas(run, schema)


def intents(texts: list[str]) -> list[dict]:
    """A rule of thumb in place of a classifier: questions and exclamations by their end, else STATEMENT."""
    return [{"intent": "QUESTION" if t.rstrip().endswith("?") else "EXCLAIM" if t.rstrip().endswith("!") else "STATEMENT"} for t in texts]


def translated(text: Column, translate: Callable[[list[str]], list[str]]) -> Column:
    """Texts through ``translate`` with their tags untouched in place; a failed batch stays as it was."""
    from tagloom.functions.lexicon import EXACT_TAGS, TAG_PREFIXES

    def run(texts: pd.Series) -> pd.Series:
        runs, shape = [], []
        for t in texts:
            parts: list = []
            for w in (t or "").split():
                if w.startswith(tuple(TAG_PREFIXES)) or w in EXACT_TAGS:
                    parts.append(w)
                elif parts and isinstance(parts[-1], list):
                    parts[-1].append(w)
                else:
                    parts.append([w])
            shape.append(parts)
            runs += [" ".join(p) for p in parts if isinstance(p, list)]
        try:
            new = list(translate(runs))
        except Exception:
            return texts
        if len(new) != len(runs):
            return texts
        it = iter(new)
        return pd.Series([" ".join(next(it) if isinstance(p, list) else p for p in parts) for parts in shape], dtype=object)

    return F.pandas_udf(run, T.StringType())(text)


def tokenized(text: Column, model_path: str, tag_ids: dict[str, int] | None = None) -> Column:
    """Ids of a SentencePiece model; words that are keys of ``tag_ids`` become that id, the words between them are encoded together."""

    def run(texts: pd.Series) -> pd.Series:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        special = tag_ids or {}

        def encode(t: str | None) -> list[int]:
            out, held = [], []
            for w in (t or "").split():
                if w in special:
                    out += model.encode(" ".join(held)) if held else []
                    held = []
                    out.append(special[w])
                else:
                    held.append(w)
            return out + (model.encode(" ".join(held)) if held else [])

        return texts.map(encode)

    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)

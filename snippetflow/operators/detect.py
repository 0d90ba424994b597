"""Stage 1: language detection (M1-M3, M10 for the stage switch).

Backends:

* a ``CueTable`` (default): pure Column expressions, no Python on executors;
* any ``Column`` builder ``fn(code_col) -> Column``;
* a ``BatchModel``: an external model called on Arrow batches through a
  pandas UDF; the model is built once per Python worker and a failing batch
  is retried row by row, so only the failing rows become ``Unknown`` (M2).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snippetflow.functions.cues import TEXT_CUE_TABLE, UNKNOWN, CueTable
from snippetflow.functions.text import PROMPT_MAX_CHARS, chat_prompt, clean_response

_MODEL_CACHE: dict = {}
CACHED_MODELS = 4


def cached_model(cache: dict, token: str, make: Callable):
    """The model of ``token`` in this Python worker; of more than CACHED_MODELS the oldest goes."""
    if token not in cache:
        while len(cache) >= CACHED_MODELS:
            cache.pop(next(iter(cache)))
        cache[token] = make()
    return cache[token]


ANSWER = T.StructType([T.StructField("label", T.StringType()), T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class BatchModel:
    """External detector.  ``make_predict_fn()`` returns ``predict(list[str]) -> list[str]``.

    With ``labels`` the model is given the chat prompt (X6, as JSON), whose user turn
    holds the first ``PROMPT_MAX_CHARS`` characters; without, the whole text, or its
    first ``max_chars`` characters where that is set.  A failing batch is retried row by
    row; a failing row gets ``unknown`` and the error's text (``answer``).
    """
    make_predict_fn: Callable
    batch_size: int = 32
    max_chars: int | None = None
    unknown: str = UNKNOWN
    labels: tuple | None = None
    # names this model in a Python worker's cache; made with the object, never reused
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def answer(self, code: Column) -> Column:
        """Struct of the cleaned label and the error (null where none)."""
        make, bs, unknown, token = self.make_predict_fn, self.batch_size, self.unknown, self.token

        @F.pandas_udf(ANSWER)
        def _detect(texts: pd.Series) -> pd.DataFrame:
            fn = cached_model(_MODEL_CACHE, token, make)
            out, err = [unknown] * len(texts), [None] * len(texts)
            vals = texts.tolist()
            for start in range(0, len(vals), bs):
                idx = [i for i in range(start, min(start + bs, len(vals))) if vals[i] is not None]
                if not idx:
                    continue
                try:
                    res = list(fn([vals[i] for i in idx]))
                    if len(res) != len(idx):
                        raise ValueError("model returned a wrong number of answers")
                    for i, r in zip(idx, res):
                        out[i] = unknown if r is None else str(r)
                except Exception:
                    for i in idx:           # isolate the failing rows
                        try:
                            r = list(fn([vals[i]]))[0]
                            out[i] = unknown if r is None else str(r)
                        except Exception as e:
                            out[i], err[i] = unknown, f"{type(e).__name__}: {e}"
            return pd.DataFrame({"label": pd.Series(out, dtype=object), "error": pd.Series(err, dtype=object)})

        if self.labels is not None:
            text = F.when(code.isNotNull(), F.to_json(chat_prompt(self.labels, code, self.max_chars or PROMPT_MAX_CHARS)))
        else:
            text = code if self.max_chars is None else F.substring(code, 1, self.max_chars)
        return _detect(text)

    def column(self, code: Column) -> Column:
        return clean_response(self.answer(code)["label"])


@dataclass(frozen=True)
class CountedCues:
    """Cue substrings counted with their repeats: every occurrence of every cue counts,
    overlapping ones too.  All cues are in one Aho-Corasick automaton, built once per batch of texts,
    so a text is read once however many cues there are."""
    table: CueTable

    def counts(self, code: Column) -> Column:
        """Occurrences per label, in label order; null for a null text."""
        cues = [(w, i) for i, ws in enumerate(self.table.cues.values()) for w in ws]
        width = len(self.table.cues)

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def _count(texts: pd.Series) -> pd.Series:
            import ahocorasick
            found: dict = {}
            for w, i in cues:
                found.setdefault(w, []).append(i)
            automaton = ahocorasick.Automaton()
            for w, at in found.items():
                automaton.add_word(w, at)
            automaton.make_automaton()
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                n = [0] * width
                for _, at in automaton.iter(t):
                    for i in at:
                        n[i] += 1
                out.append(n)
            return pd.Series(out, dtype=object)
        return _count(code)

    def apply(self, df: DataFrame, code: str, out: str, counts: str | None = None) -> DataFrame:
        """The label with the most occurrences (first label on ties, unknown without any); ``counts`` names a column for the numbers."""
        t = df.withColumn("_cc", self.counts(F.col(code)))
        t = t.withColumn("_cm", F.array_max("_cc"))
        names = F.array(*[F.lit(x) for x in self.table.labels])
        best = F.when(F.col("_cm") > 0, F.get(names, F.array_position("_cc", F.col("_cm")).cast("int") - 1))
        t = t.withColumn(out, F.coalesce(best, F.lit(self.table.unknown)))
        return (t.withColumnRenamed("_cc", counts) if counts else t.drop("_cc")).drop("_cm")


def detection_column(code: Column, backend=TEXT_CUE_TABLE) -> Column:
    if isinstance(backend, CueTable):
        return backend.label(code)
    if isinstance(backend, BatchModel):
        return backend.column(code)
    if callable(backend):
        return backend(code)
    raise TypeError(f"unsupported detection backend {backend!r}")


def detect_language(df: DataFrame, backend=TEXT_CUE_TABLE, code: str = "code",
                    out: str = "detected_language", error: str | None = None) -> DataFrame:
    """M1: add the detected language; narrow (no shuffle).  ``error`` names a column
    for a ``BatchModel``'s error texts, so failures can be counted and seen."""
    if isinstance(backend, CueTable):
        return backend.apply(df, code, out, "label")
    if isinstance(backend, CountedCues):
        return backend.apply(df, code, out)
    if error and isinstance(backend, BatchModel):
        res = df.withColumn("_answer", backend.answer(F.col(code)))
        return res.withColumn(out, clean_response(F.col("_answer.label"))).withColumn(error, F.col("_answer.error")).drop("_answer")
    return df.withColumn(out, detection_column(F.col(code), backend))


def language_distribution(df: DataFrame, col: str = "detected_language") -> DataFrame:
    """Rows per detected language (partial + final hash aggregate)."""
    return df.groupBy(F.col(col).alias("language")).agg(F.count(F.lit(1)).alias("n"))

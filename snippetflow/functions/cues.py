"""Cue scorers: label a text by counting cue hits, all in Column expressions.

A cue table maps each label to a list of cues.  The score of a label is the
number of cue hits in the row; the label with the highest score wins, ties
go to the label listed first, and a row without any hit (or a null text)
gets the unknown label.  Two hit rules:

* ``tokens``:     cues are words; each token of ``lower(text)`` split on
                  non-letters that equals a cue is one hit (multiplicity counts);
* ``substrings``: cues are literal substrings; each cue contained in the text
                  is one hit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
LETTER_SPLIT = r"[^\p{L}]+"

# Word cues per natural-language label (the four languages of
# the documents table), tie order = this order.
TEXT_CUES = {
    "de": ["der", "die", "das", "und", "ist", "nicht"],
    "en": ["the", "of", "and", "that", "with"],
    "es": ["el", "los", "las", "que", "del", "una"],
    "fr": ["le", "la", "les", "des", "une", "du"],
}

# The label list of the code-language detector, in order.
CODE_LANGUAGES = ["JavaScript", "PHP", "Java", "Python", "C#", "C++", "Go", "C"]

# Substring cues per code language.  C, C++, Java and C# cues
# are the ones named in the detector's instructions; the other four are ours.
CODE_CUES = {
    "JavaScript": ["console.log", "function(", "=>", "const ", "let ", "document."],
    "PHP": ["<?php", "echo ", "$this->", "->"],
    "Java": ["System.out.println", "public static void main", "import java."],
    "Python": ["def ", "import ", "print(", "self.", "elif "],
    "C#": ["Console.WriteLine", "using System", "namespace "],
    "C++": ["<iostream>", "class", "namespace", "template"],
    "Go": ["package main", "func ", ":=", "fmt."],
    "C": ["<stdio.h>", "malloc", "struct"],
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count_in(values: list[str]):
    """Closure factory: predicate 'token is one of values' for F.filter."""
    lits = [F.lit(v) for v in values]
    return lambda t: t.isin(*lits)


@dataclass(frozen=True)
class CueTable:
    cues: dict = field(default_factory=lambda: dict(TEXT_CUES))
    mode: str = "tokens"            # or "substrings"
    unknown: str = UNKNOWN
    split_pattern: str = LETTER_SPLIT

    @property
    def labels(self) -> list[str]:
        return list(self.cues)

    def scores(self, text="code") -> list[Column]:
        """One integer hit-count Column per label, in label order."""
        t = _c(text)
        if self.mode == "tokens":
            toks = F.split(F.lower(t), self.split_pattern)
            return [F.size(F.filter(toks, _count_in(ws))) for ws in self.cues.values()]
        if self.mode == "substrings":
            out = []
            for ws in self.cues.values():
                hits = [F.when(t.contains(w), F.lit(1)).otherwise(F.lit(0)) for w in ws]
                expr = hits[0]
                for h in hits[1:]:
                    expr = expr + h
                out.append(expr)
            return out
        raise ValueError(f"unknown cue mode {self.mode!r}")

    def pick(self, score_cols: list[Column]) -> Column:
        """Winner among score columns: max score, first label on ties."""
        best = F.greatest(*score_cols) if len(score_cols) > 1 else score_cols[0]
        expr = F.when(best <= F.lit(0), F.lit(self.unknown))
        for label, s in zip(self.labels, score_cols):
            expr = expr.when(s == best, F.lit(label))
        return expr.otherwise(F.lit(self.unknown))

    def argmax_index(self, score_cols: list[Column]) -> Column:
        """Classifier form: 0-based index of the best label, ties and all-zero
        rows go to the lowest index (numpy argmax)."""
        best = F.greatest(*score_cols) if len(score_cols) > 1 else score_cols[0]
        expr = None
        for i, s in enumerate(score_cols):
            expr = F.when(s == best, F.lit(i)) if expr is None else expr.when(s == best, F.lit(i))
        return expr.otherwise(F.lit(0))

    def apply(self, df: DataFrame, text: str = "code", out: str = "detected_language",
              kind: str = "label") -> DataFrame:
        """Add the label (``kind='label'``) or the 0-based class index
        (``kind='index'``) as three projections - tokens, per-label scores,
        winner - so the text is tokenized once per row however many labels
        and comparisons follow (Catalyst does not re-inline such columns)."""
        return self._apply(df, text, **{kind: out})

    def apply_both(self, df: DataFrame, text: str, label: str, index: str) -> DataFrame:
        """Add the label and the class index from one scoring."""
        return self._apply(df, text, label=label, index=index)

    def _apply(self, df: DataFrame, text: str, label: str | None = None, index: str | None = None) -> DataFrame:
        t = F.col(text)
        names = [f"_cue_s{i}" for i in range(len(self.cues))]
        if self.mode == "tokens":
            tokd = df.withColumn("_cue_tok", F.split(F.lower(F.coalesce(t, F.lit(""))), self.split_pattern))
            scored = tokd.select("*", *[F.size(F.filter("_cue_tok", _count_in(ws))).alias(n)
                                        for ws, n in zip(self.cues.values(), names)]).drop("_cue_tok")
        else:
            scored = df.select("*", *[c.alias(n) for c, n in
                                      zip(self.scores(F.coalesce(t, F.lit(""))), names)])
        cols = [F.col(n) for n in names]
        if label:
            scored = scored.withColumn(label, F.when(t.isNull(), F.lit(self.unknown)).otherwise(self.pick(cols)))
        if index:
            scored = scored.withColumn(index, self.argmax_index(cols))
        return scored.drop(*names)

    def label(self, text="code") -> Column:
        """Detected label for the text column; null text -> unknown."""
        t = _c(text)
        return F.when(t.isNull(), F.lit(self.unknown)).otherwise(self.pick(self.scores(t)))

    # -- oracle text -------------------------------------------------------
    def sql_scores(self, text_sql: str) -> list[str]:
        """DuckDB expressions of the per-label hit counts."""
        sc = []
        if self.mode == "tokens":
            tok = f"regexp_split_to_array(lower({text_sql}), '{self.split_pattern}')"
            for ws in self.cues.values():
                inl = ", ".join(_sql_str(w) for w in ws)
                sc.append(f"len(list_filter({tok}, lambda x: x IN ({inl})))")
        else:
            for ws in self.cues.values():
                parts = [f"(CASE WHEN contains({text_sql}, {_sql_str(w)}) THEN 1 ELSE 0 END)" for w in ws]
                sc.append("(" + " + ".join(parts) + ")")
        return sc

    def sql_pick(self, score_names: list[str], text_sql: str | None = None) -> str:
        """DuckDB CASE choosing the label from named score columns."""
        best = f"greatest({', '.join(score_names)})" if len(score_names) > 1 else score_names[0]
        whens = " ".join(f"WHEN {s} = {best} THEN {_sql_str(lab)}"
                         for lab, s in zip(self.labels, score_names))
        null_case = f"WHEN {text_sql} IS NULL THEN {_sql_str(self.unknown)} " if text_sql else ""
        return (f"(CASE {null_case}WHEN {best} <= 0 THEN {_sql_str(self.unknown)} {whens} "
                f"ELSE {_sql_str(self.unknown)} END)")

    def sql_argmax(self, score_names: list[str]) -> str:
        best = f"greatest({', '.join(score_names)})" if len(score_names) > 1 else score_names[0]
        whens = " ".join(f"WHEN {s} = {best} THEN {i}" for i, s in enumerate(score_names))
        return f"(CASE {whens} ELSE 0 END)"

    def sql_classify(self, table: str, id_col: str, text_col: str, out: str = "predicted_label",
                     extra: str = "") -> str:
        """Subquery text: (id_col[, extra], out) with the integer prediction."""
        names = [f"_s{i}" for i in range(len(self.cues))]
        scs = ", ".join(f"{e} AS {n}" for e, n in zip(self.sql_scores(f"coalesce({text_col}, '')"), names))
        extra_sel = f", {extra}" if extra else ""
        return (f"(SELECT {id_col}{extra_sel}, {self.sql_argmax(names)} AS {out} "
                f"FROM (SELECT *, {scs} FROM {table}))")

    def sql_detect(self, table: str, id_col: str, text_col: str, out: str = "detected_language",
                   extra: str = "") -> str:
        """Subquery text: (id_col[, extra], out) for every row of table."""
        names = [f"_s{i}" for i in range(len(self.cues))]
        scs = ", ".join(f"{e} AS {n}" for e, n in zip(self.sql_scores(text_col), names))
        extra_sel = f", {extra}" if extra else ""
        return (f"(SELECT {id_col}{extra_sel}, {self.sql_pick(names, text_col)} AS {out} "
                f"FROM (SELECT *, {scs} FROM {table}))")


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


TEXT_CUE_TABLE = CueTable(TEXT_CUES, "tokens")
CODE_CUE_TABLE = CueTable(CODE_CUES, "substrings")

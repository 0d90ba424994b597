"""Personal data spans (operator 6, DataFrame functions only).

Regular expressions propose spans, validators confirm them (parts of an address
up to 255, Luhn for cards, digit counts for phones, mod-97 for account numbers),
and words near a span raise its score.  Each kind is found on its own, leftmost
first and without overlaps.

Positions come from the pieces between matches: a match starts where the lengths
of the pieces and matches before it end.  The expressions start a run of
characters once only (a look-behind, or the end of the match before) and use
possessive loops, so a very long run costs linear time and constant stack.

Defined cases: null text counts as empty and has no spans; positions are code
points, end exclusive; spans of one start go by kind as listed; repeated rows
give a row each; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snippetflow.llm.common import pick

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
# fixed values: what proposes a span of each kind
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[ -]?[0-9])[0-9]*+(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# a cheap test that must hold before a text is searched for a kind
MAYBE = {
    "email": "@", "phone": "+",
    "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]",
}
# fixed values: words before a span that speak for its kind
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|login|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte", "phone": "phone|call|tel|fax|mobile|anruf",
    "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social security",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
ADD_AT = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _mod97(s: Column) -> Column:
    plain = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(
        c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
        "card": lambda: n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", _digits(s))).otherwise(F.lit(False)),
        "phone": lambda: n.between(10, 15),
        "iban": lambda: _mod97(s) == 1,
        "ssn": lambda: ~s.rlike("^(?:000|666|9)|-00-|-0000$"),
    }[kind]()


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)")


def _spans(kind: str, pieces: Column) -> Column:
    k = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("pos"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["p"])
        end = at + F.length(x["h"])
        keep = x["h"].isNotNull() & _valid(kind, x["h"])
        return F.struct(F.coalesce(end, at).alias("pos"), F.when(keep, F.array_append(
            acc["out"], F.struct(at.alias("start"), F.lit(k).alias("k"), end.alias("end")))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """doc_id, spans: array of (start, k, end, kind, score), sorted by start and kind."""
    d = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    found = {}
    for kind in KINDS:
        maybe = F.contains("text", F.lit(MAYBE[kind])) if len(MAYBE[kind]) == 1 else F.col("text").rlike(MAYBE[kind])
        zipped = F.zip_with(F.split("text", PATTERNS[kind], -1), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)),
                            lambda p, h: F.struct(p.alias("p"), h.alias("h")))
        found[kind] = F.when(maybe, _spans(kind, zipped)).otherwise(_none())
    d = d.withColumns({f"s_{k}": c for k, c in found.items()})
    d = d.withColumn("all", F.array_sort(F.concat(*(F.col(f"s_{k}") for k in KINDS))))

    def scored(x: Column) -> Column:
        lead = F.lower(F.substr("text", F.greatest(F.lit(1), x["start"] + 1 - CONTEXT_CHARS), F.least(F.lit(CONTEXT_CHARS), x["start"])))
        prior, near = F.lit(0.0), F.lit(False)
        for i, kind in enumerate(KINDS):
            prior = F.when(x["k"] == i, PRIOR[kind]).otherwise(prior)
            near = F.when(x["k"] == i, lead.rlike(CONTEXT[kind])).otherwise(near)
        score = F.least(F.lit(1.0), prior + F.when(near, CONTEXT_GAIN).otherwise(0.0))
        return F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"),
                        F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), score.alias("score"))

    d = d.withColumn("spans", F.filter(F.transform("all", scored), lambda x: (x["k"] < BASE) | (x["score"] >= ADD_AT)))
    return d.select("doc_id", *(["text"] if keep_text else []), "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select("doc_id", *counts[:BASE], F.sha2(joined(F.filter("spans", lambda x: x["k"] < BASE)).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), *counts[BASE:])

"""Licence scan by Dice coefficient over word bigrams (operator 2, DataFrame functions only).

Units are the lines of a document, the document as a whole, and passages: windows of the document's
words, across line breaks and inside sentences, as long as a template and aligned with it by a shared
bigram (``passages`` below).  Words are runs
of letters and digits, lower-cased.  A unit and a template are bags of word
bigrams; their Dice coefficient is twice the bag intersection over the sum of
their sizes.  A bag's size is its word count less one, so the bounds
``t / (2 - t) <= |unit| / |template| <= (2 - t) / t`` need no bigrams: units
outside the bounds of all templates are dropped first, and a unit meets only the
templates whose bounds it keeps.  Within the bounds a unit must hold at least the share
``t / (2 - t)`` of a template's bigrams, so it holds one of any set of more
than the rest: each template is entered under that many of its longest bigrams.
For passages, every place of a probe in the document's words is aligned with each of
its places in the template, and the template's length of words there is compared: a notice wrapped over
comment lines, or between other sentences, is met whole.  Only documents that hold a probe look for its places, and
a place takes no more of the document with it than the longest template on either side.
Units without any of these probes end there (the templates are a parameter, so
their probes are a literal of the plan); the others' probes are joined with the
templates, and what meets is scored in place; only marks of documents and scored
matches are shuffled.

Defined cases: null text counts as empty; lines and templates of one word have
no bigrams and match nothing; each document gives one row, repeated rows
included, also without a match; ties of templates are all listed, sorted; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snippetflow.llm.common import pick

THRESHOLD = 0.8
# fixed values: short notices of common licences
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This file is licensed to you under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _plain(c):
    return F.regexp_replace(F.lower(c), NOT_WORD, " ")


def _bigrams(words):
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))


def template_table(spark, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """template, licence, size, low, high (bounds of a unit's size), bag (bigram, n)
    and probe, one row for each probe."""
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, licence string, text string")
    t = t.withColumn("words", F.split(F.trim(F.regexp_replace(_plain(F.col("text")), r"\s+", " ")), " "))
    t = t.withColumn("size", F.size("words") - 1).where("size > 0").withColumn("all", _bigrams(F.col("words")))
    r = threshold / (2 - threshold)
    t = t.withColumns({
        "low": F.ceil(F.col("size") * r - 1e-9).cast("int"), "high": F.floor(F.col("size") / r + 1e-9).cast("int"),
        "bag": F.transform(F.array_distinct("all"), lambda b: F.struct(b.alias("bigram"), F.size(F.filter("all", lambda x: x == b)).alias("n")))})
    # in places of the bag: a match lacks at most size - low of them, so of one more it holds one
    by_length = F.array_sort(F.transform("all", lambda b: F.struct((-F.length(b)).alias("l"), b.alias("bigram"))))
    probes = F.array_distinct(F.transform(F.slice(by_length, 1, F.col("size") - F.col("low") + 1), lambda x: x["bigram"]))
    t = t.select("template", "licence", "size", "low", "high", "bag", "all", F.explode(probes).alias("probe"))
    places = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i) == F.col("probe"))
    return t.withColumn("places", places).drop("all")


def _cover(probes: list[str]) -> list[str]:
    """A few words such that every probe has one of them: each time the word that most of the rest share."""
    left, out = set(probes), []
    while left:
        shared = Counter(w for p in left for w in set(p.split()))
        out.append(max(shared, key=lambda w: (shared[w], len(w), w)))
        left = {p for p in left if out[-1] not in p.split()}
    return out


def scan_licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: Sequence[tuple[str, str]] = TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches (lines and whole texts that match), licences (of all matches, sorted, comma-joined),
    best_dice, units (line numbers of the matches, -1 for the whole text), n_passages, passages (the
    first words, counted from 0, of the windows that match)."""
    spark = docs.sparkSession
    tb = template_table(spark, templates, threshold)
    rows = tb.collect()         # the templates are a parameter: a row for each probe
    tb = spark.createDataFrame(rows, tb.schema)
    marks = spark.range(1).select(*(F.lit("" if f.name == "probe" else None).cast(f.dataType).alias(f.name) for f in tb.schema))
    low, high = max(1, min((r.low for r in rows), default=1)), max((r.high for r in rows), default=0)
    names = sorted({r.probe for r in rows})
    d = pick(docs, doc_id=doc_id, text=text).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", _plain(F.coalesce("text", F.lit(""))).alias("t"))
    # empty lines leave runs of blanks, which are no words
    whole = F.trim(F.regexp_replace("t", r"[ \n]+", " "))
    probes = F.array(*map(F.lit, names), F.lit(""))
    # unit 0 is a mark that keeps every document, unit 1 the whole text, then the lines
    several = F.contains("t", F.lit("\n"))
    units = F.concat(F.array(F.lit(""), F.when(several, whole).otherwise(F.lit(""))), F.split("t", "\n"))
    none = F.expr("cast(array() as array<string>)")

    def words(line):
        # a line may begin and end with a blank, so the upper bound is loose here
        blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.when(blanks.between(low, 2 * high + 2), F.split(F.trim(line), " +")).otherwise(none)

    # one array step after the other within the row: each value is computed once, and most units,
    # which hold no probe, end here
    bags = F.transform(F.transform(units, words), lambda w: F.when((F.size(w) - 1).between(low, high), _bigrams(w)).otherwise(none))
    kept = F.filter(F.transform(bags, lambda b, i: F.struct(i.alias("unit"), F.when(i == 0, F.array(F.lit(""))).otherwise(b).alias("all"))),
                    lambda x: F.arrays_overlap(x["all"], probes))
    kept = F.transform(kept, lambda x: F.struct(x["unit"].cast("long").alias("unit"), x["all"].alias("all"), F.array_intersect(x["all"], probes).alias("probes")))
    # places of probes in the words of the whole text: unit -1 - place, and the words around it
    around = max((r["size"] + 1 for r in rows), default=1)
    named = F.array(*map(F.lit, names or ["\n"]))
    words_in = F.array(*map(F.lit, _cover(names) or ["\n"]))
    split = F.transform(F.array(whole), lambda t: F.when(F.exists(words_in, lambda x: F.contains(t, x)) & F.exists(named, lambda x: F.contains(t, x)), F.split(t, " ")))
    pair = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))
    # word by word: slice() would go over the whole text for every place
    words_near = lambda i: F.transform(F.sequence(F.greatest(i - around, F.lit(0)), F.least(i + around + 1, F.size("w") - 1)), lambda k: F.get("w", k))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.array_contains(probes, pair(i)))
    near = F.transform(at, lambda i: F.struct((-1 - i).cast("long").alias("unit"), words_near(i).alias("all"),
                                              F.array(pair(i)).alias("probes")))
    empty = F.expr("cast(array() as array<struct<unit: bigint, all: array<string>, probes: array<string>>>)")
    # the generator keeps the words a value of the row: they would be split anew for every place
    u = d.select("row", "doc_id", kept.alias("kept"), split.alias("w"))
    u = u.select("row", "doc_id", "kept", F.explode("w").alias("w"))
    u = u.select("row", "doc_id", F.concat("kept", F.when(F.size("w") > 1, near).otherwise(empty)).alias("u"))
    u = u.select("row", "doc_id", F.explode("u").alias("u")).select("row", "doc_id", "u.unit", "u.all", F.size("u.all").alias("n_bigrams"), F.explode("u.probes").alias("probe"))
    met = u.join(F.broadcast(tb.union(marks)), "probe").where("unit <= 0 or n_bigrams between low and high")
    # a passage begins where the template does if the probe's places fall together; it ends with the text
    first = F.explode(F.when(F.col("unit") < 0, F.transform("places", lambda j: -1 - F.col("unit") - j)).otherwise(F.array(F.lit(None).cast("long"))))
    met = met.withColumn("first", first).withColumn("start", F.greatest(F.col("first"), F.when(F.col("first").isNotNull(), F.lit(0))))
    lead = F.greatest(-1 - F.col("unit") - around, F.lit(0))
    window = F.slice("all", (F.col("start") - lead + 1).cast("int"), (F.col("first") + F.col("size") + 1 - F.col("start")).cast("int"))
    # words and bigrams are values of the row before the next step goes through them
    held = lambda t, c: t.withColumn("_v", c).drop("all").withColumn("all", F.explode(F.array("_v"))).drop("_v")
    met = held(met, F.when(F.col("unit") < 0, window).otherwise(F.col("all"))).where("unit >= 0 or size(all) > 1")
    met = held(met, F.when(F.col("unit") < 0, _bigrams(F.col("all"))).otherwise(F.col("all"))).withColumn("n_bigrams", F.size("all"))
    met = met.withColumn("unit", F.when(F.col("unit") < 0, -1 - F.col("start")).otherwise(F.col("unit")))
    both = F.aggregate("bag", F.lit(0), lambda acc, x: acc + F.least(x["n"], F.size(F.filter("all", lambda y: y == x["bigram"]))))
    met = met.withColumn("dice", F.when(F.col("unit") != 0, F.round(2 * both / (F.col("n_bigrams") + F.col("size")), 9)))
    met = met.where((F.col("unit") == 0) | (F.col("dice") >= threshold)).select("row", "doc_id", "unit", "licence", "dice")
    unit = met.repartition("row").groupBy("row", "doc_id", "unit").agg(F.max("dice").alias("dice"), F.collect_set(F.struct("dice", "licence")).alias("met"))
    unit = unit.withColumn("ok", F.col("unit") != 0).withColumn(
        "best", F.transform(F.filter("met", lambda m: m["dice"] == F.col("dice")), lambda m: m["licence"]))
    return unit.groupBy("row", "doc_id").agg(
        F.count(F.when(F.col("unit") > 0, 1)).alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ok"), F.col("best")))))), ",").alias("licences"),
        F.max("dice").alias("best_dice"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("unit") > 0, F.col("unit") - 2))), ",").alias("units"),
        F.count(F.when(F.col("unit") < 0, 1)).alias("n_passages"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("unit") < 0, -1 - F.col("unit")))), ",").alias("passages")).drop("row")

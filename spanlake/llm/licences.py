"""Licence scan: Dice coefficient of word bigrams between units of a text and licence templates, in DataFrame operations only.

Units are the lines and the paragraphs of a text and the sentences of both; a line of comment marks parts
paragraphs like a blank one. Dice(A, B) = 2 |A & B| / (|A| + |B|) is at least t only if |A| lies between
t / (2 - t) and (2 - t) / t times |B|: templates are indexed by the set sizes that they can match, and a unit
meets those listed under its own size only. It is at least t only if A has t / (2 - t) of the bigrams of B, too:
of each template as many long words are picked as stand in more than the remaining bigrams, and a unit with none
of these words needs no bigrams.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Between paragraphs, and between sentences: an end mark, white space, marks of a comment, a capital letter.
BREAK = r"\n[ \t\r*#/;%-]*\n"
SENTENCE = r"[.!?][\"')\]]*[ \t\r\n][ \t\r\n*#/;%-]*(\p{Lu})"
CUT = "\x01"
# Notices and opening passages of public licences, as their publishers word them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def _normal(c):
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words):
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def _with_words(df: DataFrame, unit: str) -> DataFrame:
    return df.withColumn("_w", F.split(_normal(F.col(unit)), " ")).where("size(_w) > 1")


def _with_bigrams(df: DataFrame) -> DataFrame:
    return df.withColumn("bigrams", _bigrams(F.col("_w"))).drop("_w").withColumn("n_bigrams", F.size("bigrams"))


def anchors(words: list[str], least: float) -> list[str]:
    """Words of a template, the longest first, until a text without any of them has too few of its bigrams."""
    pairs = {tuple(words[i:i + 2]) for i in range(len(words) - 1)}
    spare, out = (1 - least / (2 - least)) * len(pairs) + 1e-9, []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(1 for p in pairs if p[0] in out or p[1] in out) > spare:
            break
        out.append(w)
    return out


def bounds(n: int, least: float) -> tuple[int, int]:
    return math.ceil(least / (2 - least) * n - 1e-9), math.floor((2 - least) / least * n + 1e-9)


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, dice, n_units): the licences found in each document, with the best coefficient and the
    number of distinct units that match.

    Null, empty and one-word texts match nothing; rows that share an id are one document; a null id is an id.
    Other columns play no part. The templates are a fixed list, a few kilobytes, and small enough to broadcast.
    """
    spark = docs.sparkSession
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, licence string, body string")
    t = _with_words(t, "body")
    picked = sorted({w for r in t.select("_w").collect() for w in anchors(r[0], least)})
    t = _with_bigrams(t).select("licence", F.col("bigrams").alias("wanted"), F.col("n_bigrams").alias("n_wanted"))
    low = F.ceil(F.lit(least / (2 - least)) * F.col("n_wanted") - 1e-9)
    high = F.floor(F.lit((2 - least) / least) * F.col("n_wanted") + 1e-9)
    t = t.select("*", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("n_bigrams"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).where("_t IS NOT NULL")
    paragraphs = F.filter(F.split("_t", BREAK), lambda p: F.contains(p, F.lit("\n")))
    d = d.select("doc_id", F.array_distinct(F.concat(F.split("_t", "\n"), paragraphs)).alias("_u"))
    sentences = F.flatten(F.transform("_u", lambda u: F.split(F.regexp_replace(u, SENTENCE, CUT + "$1"), CUT)))
    units = _with_words(d.select("doc_id", F.explode(F.array_distinct(F.concat("_u", sentences))).alias("unit")), "unit")
    met = _with_bigrams(units.where(F.arrays_overlap("_w", F.lit(picked)))).join(F.broadcast(t), "n_bigrams")
    dice = 2.0 * F.size(F.array_intersect("bigrams", "wanted")) / (F.col("n_bigrams") + F.col("n_wanted"))
    return (met.select("doc_id", "licence", "unit", dice.alias("dice")).where(F.col("dice") >= least)
            .groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_units")))


def licence_sql(least: float = LEAST) -> str:
    """DuckDB SQL for ``scan_licences`` over documents."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, body.replace("'", "''")) for i, (name, body) in enumerate(TEMPLATES))
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    words = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""WITH t AS (SELECT licence, {words.format('body')} AS w, {grams} AS g, len(g) AS n FROM (VALUES {rows}) v(i, licence, body)),
      l AS (SELECT doc_id, list_concat(string_split(text, chr(10)), [p for p in regexp_split_to_array(text, '{BREAK}') if contains(p, chr(10))]) AS us FROM documents WHERE text IS NOT NULL),
      u0 AS (SELECT doc_id, unnest(list_distinct(list_concat(us, flatten([string_split(regexp_replace(x, '{SENTENCE.replace("'", "''")}', chr(1) || '\\1', 'g'), chr(1)) for x in us])))) AS unit FROM l),
      u1 AS (SELECT doc_id, unit, {words.format('unit')} AS w FROM u0),
      u AS (SELECT doc_id, unit, {grams} AS g, len(g) AS n FROM u1 WHERE len(w) > 1),
      m AS (SELECT doc_id, licence, unit, 2.0 * len(list_intersect(u.g, t.g)) / (u.n + t.n) AS dice FROM u JOIN t ON u.n >= {least / (2 - least)!r} * t.n - 1e-9 AND u.n <= {(2 - least) / least!r} * t.n + 1e-9)
      SELECT doc_id, licence, max(dice) AS dice, count(DISTINCT unit) AS n_units FROM m WHERE dice >= {least} GROUP BY 1, 2"""

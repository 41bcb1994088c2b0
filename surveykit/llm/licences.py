"""Licence notices in texts: normalised lines and paragraphs beside templates by the Dice coefficient of word bigrams.

A unit with a bigrams can reach a coefficient of t with a template of b bigrams only if t / (2 - t) <= a / b <= (2 - t)
/ t. So a unit meets only the templates of about its size, and most lines of prose meet none. All of it is column
expressions over the templates, which are constants of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveykit.llm.registry import query, table
from surveykit.llm.words import full_text, let

LEAST_DICE = 0.8

# Notices as licences ask for them, or as they are commonly given.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text: letters and digits in lower case, anything else a blank."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)})


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(F.lower(unit), "[^a-z0-9]+"), "")


def _bigrams(split: Column) -> Column:
    pairs = let(split, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))
    return F.array_distinct(F.when(F.size(split) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def size_bounds(n: int, least: float) -> tuple[int, int]:
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def best_template(bigrams: Column, templates: Mapping[str, str], least: float) -> Column:
    """``dice, licence`` of the closest template of the unit's size, the first by name on ties; null below ``least``."""

    def against(own: Column) -> Column:
        found = []
        for name in sorted(templates):
            theirs = bigrams_of(templates[name])
            low, high = size_bounds(len(theirs), least)
            dice = 2 * F.size(F.array_intersect(own, F.array(*map(F.lit, theirs)))) / (F.size(own) + len(theirs))
            found.append(F.when(F.size(own).between(low, high), F.struct(dice.alias("dice"), F.lit(name).alias("licence"))))
        best = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["dice"] >= least))
        return F.reduce(best, F.lit(None).cast("struct<dice:double,licence:string>"), lambda a, b: F.when(a.isNull() | (b["dice"] > a["dice"]), b).otherwise(a))

    return let(bigrams, against)


def scan_licences(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, licence, dice, n_units`` (lines and paragraphs that match a template).

    ``licence`` is the template with the highest coefficient in the text, the first by name on ties; null where none
    reaches ``least``. A null or empty text has none; repeated rows are scanned one by one; other columns aren't read.
    """
    body = full_text()
    paragraphs = F.filter(F.split(body, r"\n[ \t]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.concat(F.split(body, "\n"), paragraphs)
    sizes = [size_bounds(len(bigrams_of(t)), least) for t in templates.values()]
    # a unit of w words has at most w - 1 bigrams, and far more words only if it repeats itself; both ends are sure
    fewest = min(low for low, _ in sizes) + 1

    def judged(unit: Column) -> Column:
        return let(_words(unit), lambda w: F.when(F.size(w) >= fewest, best_template(_bigrams(w), templates, least)))

    found = F.filter(F.transform(units, judged), lambda x: x.isNotNull())
    best = F.reduce(F.col("_found"), F.lit(None).cast("struct<dice:double,licence:string>"), lambda a, b: F.when(a.isNull() | (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["licence"] < a["licence"])), b).otherwise(a))
    held = docs.select("doc_id", found.alias("_found"))
    return held.select("doc_id", best.alias("best"), F.size("_found").cast("long").alias("n_units")).select("doc_id", F.col("best.licence").alias("licence"), F.col("best.dice").alias("dice"), "n_units")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, bigrams_of(t)))}])" for n, t in TEMPLATES.items())
    return f"""
WITH templates(licence, b) AS (VALUES {rows}),
units AS (
  SELECT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)),
         list_filter(string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n'), lambda p: contains(p, chr(10))))) AS unit FROM documents),
worded AS (SELECT doc_id, row_number() OVER () AS u, list_filter(string_split_regex(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM units),
paired AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM worded WHERE len(w) BETWEEN 2 AND 500),
met AS (
  SELECT doc_id, u, licence, 2 * len(list_intersect(a, b))::DOUBLE / (len(a) + len(b)) AS dice FROM paired, templates
  WHERE len(a) <= 3 * len(b) AND len(b) <= 3 * len(a)),
best AS (SELECT doc_id, u, max(dice) AS dice, min(licence) FILTER (dice = top) AS licence FROM (SELECT *, max(dice) OVER (PARTITION BY u) AS top FROM met) WHERE dice >= {LEAST_DICE} GROUP BY doc_id, u),
by_doc AS (
  SELECT doc_id, count(*) AS n_units, max(dice) AS dice, min(licence) FILTER (dice = top) AS licence
  FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id) AS top FROM best) GROUP BY doc_id)
SELECT d.doc_id, licence, dice, coalesce(n_units, 0)::BIGINT AS n_units FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""


@query("op4_licence_scan", _sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))

"""Licence notices in texts, by the Dice coefficient of word pairs with templates.

A text's lines, paragraphs (runs of lines without an empty one), sentences and the text itself
are units; a sentence ends with ``.``, ``!`` or ``?`` before white space or with its paragraph. A unit is normalised (lower case, everything but letters and digits a space) and
its different pairs of neighbouring words are compared with each template's: 2 * common /
(unit + template). The coefficient can't reach the threshold unless the sizes are near
each other, so a unit is compared only with templates whose sizes allow it, and its
pairs are built only if there are any. Units of one word have no pairs and match nothing.

The bounds on sizes also say how many of a template's m pairs a unit must have, so of any
m - that + 1 of them it has one. Texts and units that hold no such pair are passed over
before they are normalised; no match is lost by that.

Everything is DataFrame functions. Nulls and empty texts have no units. Equal lines are
reported each, and so are equal rows; a paragraph or text of one line is reported as the line, and a sentence that is a line or paragraph as that. Other columns
are ignored. An empty table gives no rows. Of templates that tie, all are reported.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.licence_texts import IDENTIFIERS, wordings

#: Short notices as licences' own texts and the customary source headers give them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-long": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
    " except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-long": "This program is free software: you can redistribute it and/or modify it under the terms of the"
    " GNU General Public License as published by the Free Software Foundation, either version 3 of the License,"
    " or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def _pairs_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


_known = {tuple(_pairs_of(text)) for text in TEMPLATES.values()}
TEMPLATES |= {name: text for name, text in wordings().items() if tuple(_pairs_of(text)) not in _known}


def identifier(name: str) -> str:
    """The licence that a wording is of: the longest identifier that its name begins with, or else the name."""
    return max((one for one in IDENTIFIERS if name == one or name.startswith(f"{one}-")), key=len, default=name)


def _words(unit: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _once(value: Column) -> Column:
    """The value by a generator, so that filters on it don't compute it again."""
    return F.explode(F.array(value))


def _may_match(text: Column, known: dict[str, list[str]], threshold: float) -> Column:
    """Whether ``text`` holds a pair of those that some template can't do without.

    Pairs are chosen by a word of theirs, long ones that are in many pairs first, as long words are
    rarer and few of them are searched for.
    """
    asked: dict[str, set[str]] = {}
    for pairs in sorted(known.values(), key=len):
        least = ceil(threshold * len(pairs) / (2 - threshold) - 1e-9)
        if least < 1:
            return F.lit(True)
        left = set(pairs)
        while len(pairs) - len(left) <= len(pairs) - least:
            words = {word: [pair for pair in left if word in pair.split()] for word in {word for pair in left for word in pair.split()}}
            best = max(words, key=lambda word: (len(word) > 5, word in asked, len(word) * len(words[word]), word))
            asked.setdefault(best, set()).update(words[best])
            left -= set(words[best])

    def holds(low: Column, word: str, pairs: set[str]) -> Column:
        ways = "|".join(pair.replace(" ", r"[^\p{L}\p{N}]+") for pair in sorted(pairs))
        return low.contains(word) & low.rlike(rf"(?:{ways})(?![\p{{L}}\p{{N}}])")

    # The lower-cased text is an array's one element, so that it is made once and not for each word.
    held = lambda low: reduce(lambda x, y: x | y, (holds(low, *one) for one in sorted(asked.items())), F.lit(False))
    return F.exists(F.array(F.lower(text)), held)


def _sentences() -> Column:
    """The sentences of ``text``, by place, but those that are lines or paragraphs."""
    plain = F.translate("text", "\u0001\u0002", "  ")
    inside = F.regexp_replace(plain, r"([.!?][)\"'\]]*)[ \t]+(?=[^ \t\n])", "$1\u0001")
    marked = F.regexp_replace(inside, r"([.!?][)\"'\]]*)[ \t]*\n(?![ \t]*\n)", "$1\u0002")

    def of(paragraph: Column) -> Column:
        several = F.locate("\u0001", paragraph) + F.locate("\u0002", paragraph) > 0
        return F.flatten(F.transform(F.split(paragraph, "\u0002"), lambda part: parts(part, several)))

    def parts(part: Column, several: Column) -> Column:
        # A part with no break inside is a line, unless the sentence goes over several.
        own = several & ((F.locate("\u0001", part) > 0) | (F.locate("\n", F.trim(part)) > 0))
        return F.transform(F.split(part, "\u0001"), lambda one: F.struct(one.alias("unit"), own.alias("own")))

    trimmed = lambda paragraph: F.regexp_replace(paragraph, "^[ \t\n\u0002]+|[ \t\n\u0002]+$", "")
    every = F.flatten(F.transform(F.transform(F.split(marked, "\n[ \t]*\n"), trimmed), of))
    placed = F.transform(
        every,
        lambda one, at: F.struct(F.lit("sentence").alias("kind"), at.alias("place"), one["unit"].alias("unit"), F.when(one["own"], 2).otherwise(0).alias("lines")),
    )
    return F.filter(placed, lambda one: one["lines"] > 1)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, kind (line, paragraph, sentence, text), place, licence, dice, identifier, best of every match.

    ``licence`` names the wording and ``identifier`` the licence that it is of. Wordings of related licences
    resemble each other, so a unit may match several; ``best`` marks one row of each unit: that
    with the highest dice, of these that with the most pairs, of these the first by name.

    ``place`` counts lines, paragraphs or sentences from 0. Templates are part of the plan, meant for up to
    some hundred. Bounds on the sizes: a unit of n pairs can reach t with a template
    of m only if t * (n + m) <= 2 * min(n, m).
    """
    known = {name: _pairs_of(text) for name, text in (templates or TEMPLATES).items()}
    known = {name: pairs for name, pairs in known.items() if pairs}
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held.where(F.col("text").isNotNull() & _may_match(F.col("text"), known, threshold))
    rows = held.select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    most = max((len(pairs) for pairs in known.values()), default=0)
    # A unit repeats pairs at most as often as it is long: many words with few different pairs still count.
    lines = F.transform(F.split("text", "\n"), lambda one, at: F.struct(F.lit("line").alias("kind"), at.alias("place"), one.alias("unit"), F.lit(1).alias("lines")))
    blocks = F.transform(
        F.split("text", "\n[ \t]*\n"),
        lambda one, at: F.struct(F.lit("paragraph").alias("kind"), at.alias("place"), one.alias("unit"), F.size(F.split(F.trim(one), "\n")).alias("lines")),
    )
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("place"), F.col("text").alias("unit"), F.size(F.split(F.trim("text"), "\n[ \t]*\n")).alias("lines")))
    units = rows.select("doc_id", F.explode(F.concat(lines, blocks, _sentences(), whole)).alias("one")).select("doc_id", "one.*")
    units = units.where("kind = 'line' OR lines > 1")
    least = min((len(pairs) for pairs in known.values()), default=1)
    fewest = max(1, -int(-threshold * least // (2 - threshold)))
    worded = units.where(_may_match(F.col("unit"), known, threshold)).select("doc_id", "kind", "place", _once(_words(F.col("unit"))).alias("words"))
    largest = int(most * (2 - threshold) / threshold + 1e-9)
    # Words of a unit may repeat, so its length is no bound; each different word but the first ends a pair of its own.
    different = F.size(F.array_distinct("words"))
    worded = worded.where((F.size("words") > max(fewest, 1)) & (different - 1 <= largest))
    after = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.array_distinct(
        F.zip_with(
            F.slice("words", F.lit(1), after),
            F.slice("words", F.lit(2), after),
            lambda a, b: F.concat_ws(" ", a, b),
        )
    )
    sized = worded.select("doc_id", "kind", "place", _once(pairs).alias("pairs")).withColumn("n", F.size("pairs"))
    sized = sized.where(F.col("n").between(fewest, largest))
    rows_of = [{"licence": name, "wanted": wanted, "m": len(wanted), "identifier": identifier(name)} for name, wanted in sorted(known.items())]
    every = F.from_json(F.lit(json.dumps(rows_of)), "array<struct<licence:string,wanted:array<string>,m:int,identifier:string>>")

    def near(one: Column) -> Column:
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        return F.col("n").between(low * one["m"] - 1e-9, high * one["m"] + 1e-9)

    def dice(one: Column) -> Column:
        common = F.size(F.array_intersect("pairs", one["wanted"]))
        return F.struct(one["licence"].alias("licence"), (2.0 * common / (F.col("n") + one["m"])).alias("dice"), one["m"].alias("m"), one["identifier"].alias("identifier"))

    matches = F.filter(F.transform(F.filter(every, near), dice), lambda one: one["dice"] >= threshold)
    units = sized.select("doc_id", "kind", F.col("place").cast("long").alias("place"), _once(matches).alias("matches")).where(F.size("matches") > 0)
    first = F.array_min(F.transform("matches", lambda one: F.struct((-one["dice"]).alias("dice"), (-one["m"]).alias("m"), one["licence"].alias("licence"))))
    found = units.select("doc_id", "kind", "place", F.explode("matches").alias("one"), first.alias("first"))
    return found.select("doc_id", "kind", "place", "one.licence", "one.dice", "one.identifier", (F.col("one.licence") == F.col("first.licence")).alias("best"))

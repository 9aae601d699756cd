"""License scans: lines, blocks and passages of texts against license templates.

Texts are normalised to lower-case ASCII words. The similarity of a unit (a line, or a
block of lines between blank ones) to a template is the Dice coefficient of their sets of
word bigrams. A coefficient of at least t needs sizes within a factor of (2 - t) / t, so
most units have few candidate templates or none.

A notice that stands among other words, or runs over several blocks, is found as a passage:
windows as long as the template slide over the words of the whole text. The same bound says
how many of a template's bigrams a text must hold, and how many must lie within a window's
reach, before any window is compared. All of it is projections of the scan: nothing is
shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

THRESHOLD = 0.8

# Wording of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK_LINE = r"\n[\x20\x09\x0B-\x0D]*\n"


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _normalised(text: Column) -> Column:
    lower = F.translate(text, _UPPER, _UPPER.lower())
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    """Bigrams in order as 64-bit hashes, which sets of numbers hold without objects."""
    n = F.size(words) - 1
    first, second = F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n)
    return F.zip_with(first, second, lambda a, b: F.xxhash64(a, b))


def _once(value: Column) -> Column:
    """The value by way of a generator, so that it is not computed for every use of it."""
    return F.explode(F.array(value))


def _known(templates: Mapping[str, str]) -> list[tuple[str, int, list[str]]]:
    """(name, words, distinct bigrams) of the templates that have bigrams, by name."""
    found = ((n, len(template_words(t)), template_bigrams(t)) for n, t in templates.items())
    return sorted(t for t in found if t[2])


def _hashed(bigrams: list[str]) -> Column:
    return F.array(*[F.xxhash64(*map(F.lit, b.split())) for b in bigrams])


def license_hits(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, unit, unit_no, license, dice, n_bigrams) of all that is like a template.

    ``unit`` is ``line`` or ``block`` (two or more lines between blank lines), numbered from
    0 in the text, or ``passage``. Of a line or block the most similar template counts, of
    equals the first by name. Passages are found for each template by itself, wherever they
    begin: windows of its length that overlap make one passage, for which the most similar
    of them, of equals the first, is given; ``unit_no`` is the number of its first word. A
    notice that fills a line is a passage too.

    Units of fewer than two words, NULL and empty texts have no hit; a NULL id stays NULL;
    repeated rows hit alike; no rows give none. Texts of any length are compared whole, in
    time that grows with their length. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    known = _known(templates)
    texts = docs.select(col(id_column).alias("_id"), col(text_column).alias("text"))
    hits = _unit_hits(texts, known, threshold).unionByName(_passage_hits(texts, known, threshold))
    return hits.withColumnRenamed("_id", id_column)


def _unit_hits(texts: DataFrame, known: list[tuple], threshold: float) -> DataFrame:
    slack = (2 - threshold) / threshold
    candidates = F.array(
        *[
            F.struct(
                F.lit(-k).alias("turn"),
                F.lit(name).alias("license"),
                _hashed(held).alias("bigrams"),
                F.lit(len(held)).alias("size"),
            )
            for k, (name, _, held) in enumerate(known)
        ]
    )
    text = F.col("text")
    blocks = F.transform(
        F.split(text, BLANK_LINE, -1), lambda b, k: F.struct(F.lit("block"), k, b)
    )
    lines = F.transform(F.split(text, "\n", -1), lambda x, k: F.struct(F.lit("line"), k, x))
    kind = "array<struct<unit:string,unit_no:int,held:string>>"
    units = F.concat(
        lines.cast(kind), F.filter(blocks.cast(kind), lambda b: F.contains(b["held"], F.lit("\n")))
    )
    # A unit of so few words has too few bigrams for any template.
    fewest = min((len(held) for *_, held in known), default=0) / slack
    keys = ["_id", "unit", "unit_no"]
    rows = (
        texts.select("_id", F.explode(units).alias("u"))
        .select("_id", "u.unit", "u.unit_no", _once(_normalised(F.col("u.held"))).alias("plain"))
        .select(*keys, _once(F.split("plain", " ")).alias("words"))
        .where((F.size("words") > 1) & (F.size("words") - 1 >= fewest - 1e-9))
        .select(*keys, _once(F.array_distinct(_bigrams(F.col("words")))).alias("bigrams"))
        .select(*keys, "bigrams", F.size("bigrams").alias("n_bigrams"))
    )

    def in_bounds(t: Column) -> Column:
        large, small = F.greatest(t["size"], F.col("n_bigrams")), F.least(t["size"], F.col("n_bigrams"))
        return large <= small * slack + 1e-9

    def compared(t: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("bigrams"), t["bigrams"]))
        dice = F.lit(2.0) * shared / (t["size"] + F.col("n_bigrams"))
        return F.struct(dice.alias("dice"), t["turn"].alias("turn"), t["license"].alias("license"))

    best = F.array_max(F.transform(F.filter(candidates, in_bounds), compared))
    hits = F.filter(F.array(best), lambda b: b["dice"] >= threshold)
    return (
        rows.select(*keys, "n_bigrams", F.explode(hits).alias("best"))
        .select(
            "_id",
            "unit",
            F.col("unit_no").cast("bigint").alias("unit_no"),
            F.col("best.license").alias("license"),
            F.col("best.dice").alias("dice"),
            F.col("n_bigrams").cast("bigint").alias("n_bigrams"),
        )
    )


def fewest_shared(size: int, threshold: float) -> int:
    """Bigrams that anything as similar as ``threshold`` shares with a template of ``size``:
    what is shared is not more than what the other side has."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def _passage_hits(texts: DataFrame, known: list[tuple], threshold: float) -> DataFrame:
    candidates = F.array(
        *[
            F.struct(
                F.lit(name).alias("license"),
                _hashed(held).alias("bigrams"),
                F.lit(len(held)).alias("size"),
                F.lit(words - 1).alias("reach"),
                F.lit(fewest_shared(len(held), threshold)).alias("fewest"),
            )
            for name, words, held in known
        ]
    )
    every = _hashed(sorted({b for *_, held in known for b in held}))
    least = min((fewest_shared(len(held), threshold) for *_, held in known), default=1)
    t = F.col("t")

    def in_text(template: Column) -> Column:
        both = F.array_intersect(template["bigrams"], F.col("shared"))
        return F.size(both) >= template["fewest"]

    # Places (of bigrams, from 0) where a bigram of the template stands.
    places = F.filter(
        F.sequence(F.lit(0), F.size("grams") - 1),
        lambda i: F.array_contains(t["bigrams"], F.get("grams", i)),
    )

    def reached(i: Column, j: Column) -> Column:
        return F.get("places", j + t["fewest"] - 1) < i + t["reach"]

    def window(i: Column) -> Column:
        held = F.slice("grams", i + 1, t["reach"])
        shared, n = F.size(F.array_intersect(held, t["bigrams"])), F.size(F.array_distinct(held))
        dice = F.lit(2.0) * shared / (n + t["size"])
        return F.struct(dice.alias("dice"), (-i).alias("turn"), n.alias("n"))

    similar = F.filter(
        F.transform(F.filter("places", reached), window), lambda w: w["dice"] >= threshold
    )

    # Windows that share no word with the one before them begin a passage.
    def begins(k: Column) -> Column:
        before = F.get("windows", k - 1)["turn"]
        return (k == 0) | (before - F.get("windows", k)["turn"] > F.col("reach"))

    begin = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), begins)

    def best(k: Column, q: Column) -> Column:
        after = F.coalesce(F.get("begin", q + 1), F.size("windows"))
        return F.array_max(F.slice("windows", k + 1, after - k))

    return (
        texts.select("_id", _once(_normalised(F.col("text"))).alias("plain"))
        .select("_id", _once(F.split("plain", " ")).alias("words"))
        .where(F.size("words") > 1)
        .select("_id", _once(_bigrams(F.col("words"))).alias("grams"))
        .select("_id", "grams", _once(F.array_intersect("grams", every)).alias("shared"))
        .where(F.size("shared") >= least)
        .select("_id", "grams", F.explode(F.filter(candidates, in_text)).alias("t"))
        .select("_id", "grams", "t", _once(places).alias("places"))
        .select("_id", "t.license", "t.reach", _once(similar).alias("windows"))
        .where(F.size("windows") > 0)
        .select("_id", "license", "windows", _once(begin).alias("begin"))
        .select("_id", "license", F.explode(F.transform("begin", best)).alias("best"))
        .select(
            "_id",
            F.lit("passage").alias("unit"),
            (-F.col("best.turn")).cast("bigint").alias("unit_no"),
            "license",
            F.col("best.dice").alias("dice"),
            F.col("best.n").cast("bigint").alias("n_bigrams"),
        )
    )

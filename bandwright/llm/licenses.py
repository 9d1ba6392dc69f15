"""License scan: Dice coefficient of word bigrams between texts and license templates.

A text is normalised (lower case, everything but letters and digits counts as one space)
and compared whole and line by line, as notices stand in lines of their own. For sets of
different bigrams A of a unit and B of a template, dice = 2 |A n B| / (|A| + |B|). A value
of T or more needs |A| between |B| T / (2 - T) and |B| (2 - T) / T, so most units meet no
template: words bound the bigrams from above before any are built (n words have at most
n - 1), different words bound them from below (k words have at least k - 1 bigrams), and
only templates within both bounds are intersected. Everything is built-in functions; there
is no shuffle.

`find` also compares word windows over the whole text, across lines, with the notices and
with full license texts. The best window of a start ends in a bigram of the template, so
starts and ends are the template's bigrams, and a window has at most (2 - T) / T times as
many bigrams as the template, repeats included. In a full text's case only the first
bigram of each run of the template's is a start, so that a verbatim text costs its length. A template is compared only where the text
holds |B| T / (2 - T) of its bigrams. Of overlapping windows the one of the largest dice
stays, then the longer, then the first license by name. A window within a matching line,
or one that overlaps a matching line of the same license, is that line's notice.

Null and empty texts, and units of fewer than two words, match nothing. Of equal values
the first template by name counts. Repeated rows are read one by one. Input columns that
carry a result's name are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import without

THRESHOLD = 0.8
RESULTS = ["matches", "n_matches", "license", "dice"]
# Longer windows are full texts, which are more than a line's notice.
NOTICE_WORDS = 100
# Templates whose windows may be longer than this are full texts.
LONG = 400
PASSAGE = "array<struct<start:int,end:int,license:string,dice:double>>"
# Short notices by which licenses are usually named.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at"
    ),
}


@cache
def full_texts() -> dict[str, str]:
    """Full license texts by name, from the files beside this module."""
    folder = files("bandwright.llm").joinpath("license_texts")
    return {
        f.name.removesuffix(".txt"): f.read_text(encoding="utf-8")
        for f in folder.iterdir() if f.name.endswith(".txt")
    }


def bigrams(text: str) -> list[str]:
    """Different word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({" ".join(pair) for pair in zip(words, words[1:])})


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(
        F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))
    )
    return F.array_distinct(pairs)


def scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text",
) -> DataFrame:
    """`docs` with matches, an array<struct<line, license, dice>> of the units that match
    (line 0: the whole text, others from 1), n_matches, and license and dice of the best."""
    known = {name: found for name, t in sorted(templates.items()) if (found := bigrams(t))}
    sizes = sorted(map(len, known.values()))
    low, high = sizes[0] * threshold / (2 - threshold), sizes[-1] * (2 - threshold) / threshold

    docs = without(docs, [*RESULTS, "_lines", "_units"])
    lines = F.transform(F.split(_normal(F.coalesce(F.col(text), F.lit(""))), "\n", -1), F.trim)
    # The whole text is a unit of its own where it has more than one line.
    texts = F.concat(F.array(F.array_join("_lines", " ")), F.col("_lines"))
    units = F.transform(texts, lambda unit, i: F.struct(
        i.cast("int").alias("line"), F.when(F.length(unit) > 2 * low, F.split(F.trim(unit), " +")).alias("words")
    ))
    # By words alone: at most n - 1 bigrams, at least one fewer than different words.
    units = F.filter(units, lambda u: (F.size("_lines") > 1) | (u["line"] > 0))
    units = F.filter(units, lambda u: F.coalesce(F.size(u["words"]) - 1 >= low, F.lit(False)))
    units = F.filter(units, lambda u: F.size(F.array_distinct(u["words"])) - 1 <= high)
    units = F.transform(units, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["words"]).alias("pairs")))

    def best(u: Column) -> Column:
        n = F.size(u["pairs"])
        values = []
        for name, own in known.items():
            near = n.between(len(own) * threshold / (2 - threshold) - 1e-9, len(own) * (2 - threshold) / threshold + 1e-9)
            both = F.size(F.array_intersect(u["pairs"], F.array(*map(F.lit, own))))
            dice = F.when(near, 2 * both / (n + len(own)))
            values.append(F.struct(dice.alias("dice"), F.lit(name).alias("license")))
        top = F.aggregate(
            F.array(*values), values[0], lambda a, b: F.when(
                F.coalesce(b["dice"], F.lit(-1.0)) > F.coalesce(a["dice"], F.lit(-1.0)), b
            ).otherwise(a),
        )
        return F.struct(u["line"].alias("line"), top["license"].alias("license"), top["dice"].alias("dice"))

    matches = F.filter(F.transform("_units", best), lambda m: F.coalesce(m["dice"] >= threshold, F.lit(False)))
    top = F.element_at(F.array_sort(F.transform("matches", lambda m: F.struct(
        (-m["dice"]).alias("less"), m["license"].alias("license"), m["dice"].alias("dice"),
    ))), 1)
    some = F.size("matches") > 0
    return docs.withColumn("_lines", lines).withColumn("_units", units).withColumn("matches", matches).drop(
        "_lines", "_units"
    ).withColumns({
        "n_matches": F.size("matches").cast("bigint"), "license": F.when(some, top["license"]),
        "dice": F.when(some, top["dice"]),
    })


def _windows(marks: Column, places: Column, size: int, longest: int, least: int, name: str) -> Column:
    """The best window from each place: `marks` are (previous place of the same bigram, whether
    the template has it) for each bigram of the text, `places` those that the template has.

    For a long template only from where a run of its bigrams begins: a bigram of the template
    before a window makes it longer and its dice no less.
    """
    long = longest > LONG
    starts = F.filter(F.transform(places, lambda at, i: F.struct(
        at.alias("at"), F.get(places, i + (least - 1)).alias("reach"),
        F.coalesce(F.get(places, i - 1) < at - 1, F.lit(True)).alias("first"),
    )), lambda p: (p["reach"] - p["at"] < longest) & (p["first"] | F.lit(not long)))
    # What comes before a place in its run may have been left out of the bound.
    longest = longest * 2 if long else longest

    def best(p: Column) -> Column:
        start = p["at"]
        none = F.struct(
            F.lit(0).alias("n"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"), start.alias("end"), start.alias("at"),
        )

        def add(state: Column, mark: Column) -> Column:
            new = mark["before"] < start
            n = state["n"] + new.cast("int")
            both = state["both"] + (new & mark["own"]).cast("int")
            dice = F.lit(2.0) * both / (n + F.lit(size))
            more = mark["own"] & (dice > state["dice"])
            return F.struct(
                n.alias("n"), both.alias("both"), F.when(more, dice).otherwise(state["dice"]).alias("dice"),
                F.when(more, state["at"]).otherwise(state["end"]).alias("end"), (state["at"] + 1).alias("at"),
            )

        return F.aggregate(F.slice(marks, start + 1, longest), none, add, lambda w: F.struct(
            start.alias("start"), (w["end"] + 1).alias("end"), F.lit(name).alias("license"), w["dice"].alias("dice"),
        ))

    return F.transform(starts, best).cast(PASSAGE)


def find(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, texts: Mapping[str, str] | None = None,
    threshold: float = THRESHOLD, text: str = "text",
) -> DataFrame:
    """`scan`, and passages: an array<struct<start, end, license, dice>> of the word windows
    (first and last word, from 0) that match a notice or a full text and are no matching
    line's; n_matches, license and dice are of both."""
    full = full_texts() if texts is None else texts
    known = []
    for name, body in [*sorted(templates.items()), *sorted(full.items())]:
        if own := bigrams(body):
            words = len(re.sub(r"[\W_]+", " ", body.lower()).split())
            known.append((
                name, own, math.ceil(len(own) * threshold / (2 - threshold) - 1e-9),
                math.floor((words - 1) * (2 - threshold) / threshold + 1e-9),
            ))
    helpers = ["_counts", "_pairs", "_hits", "_enough", "_sorted", "_before", "_marks", "_places", "_best", "_apart", "_held"]
    out = scan(without(docs, [*RESULTS, "passages", *helpers]), templates, threshold, text)
    clean = _normal(F.coalesce(F.col(text), F.lit("")))
    words = F.split(F.trim(F.translate(clean, "\n", " ")), " +")
    out = out.withColumn("_pairs", words).withColumn("_pairs", F.when(F.size("_pairs") > 1, F.transform(
        F.slice("_pairs", 1, F.size("_pairs") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("_pairs", i + 1))
    )))
    every = sorted({pair for _, own, _, _ in known for pair in own})
    least = min(n for _, _, n, _ in known)
    out = out.withColumn("_hits", F.array_distinct(F.filter("_pairs", lambda p: p.isin(every))))

    def shared(own: list[str], n: int) -> Column:
        # One literal for a long list of bigrams.
        both = F.size(F.array_intersect("_hits", F.split(F.lit("\n".join(own)), "\n")))
        return F.when(F.size("_hits") >= n, both >= n).otherwise(False)

    enough = F.when(F.size("_hits") >= least, F.array(*[shared(own, n) for _, own, n, _ in known]))
    out = out.withColumn("_enough", enough)
    out = out.withColumn("_sorted", F.when(F.array_contains("_enough", True), F.array_sort(F.transform(
        "_pairs", lambda p, i: F.struct(p.alias("pair"), i.alias("at"))
    ))))
    out = out.withColumn("_before", F.array_sort(F.transform("_sorted", lambda x, i: F.struct(
        x["at"].alias("at"), F.when(
            F.coalesce(F.get("_sorted", i - 1)["pair"] == x["pair"], F.lit(False)), F.get("_sorted", i - 1)["at"]
        ).otherwise(-1).alias("before"), x["pair"].alias("pair"),
    ))))

    def marked(own: list[str]) -> Column:
        return F.transform("_before", lambda x: F.struct(
            x["before"].alias("before"), x["pair"].isin(own).alias("own"), x["at"].alias("at"),
        ))

    out = out.withColumn("_marks", F.array(*[
        F.when(F.get("_enough", F.lit(i)), marked(own)) for i, (_, own, _, _) in enumerate(known)
    ]))
    out = out.withColumn("_places", F.transform("_marks", lambda marks: F.transform(
        F.filter(marks, lambda m: m["own"]), lambda m: m["at"]
    )))
    found = [
        F.when(F.get("_enough", F.lit(i)), _windows(
            F.get("_marks", F.lit(i)), F.get("_places", F.lit(i)), len(own), longest, n, name
        )).otherwise(F.array().cast(PASSAGE)) for i, (name, own, n, longest) in enumerate(known)
    ]
    ranked = F.array_sort(F.transform(
        F.filter(F.concat(*found), lambda w: w["dice"] >= threshold), lambda w: F.struct(
            (-w["dice"]).alias("less"), (w["start"] - w["end"]).alias("size"), w["license"].alias("license"),
            w["start"].alias("start"), w["end"].alias("end"),
        )
    ))
    out = out.withColumn("_best", F.when(F.array_contains("_enough", True), ranked))

    def add(kept: Column, w: Column) -> Column:
        free = ~F.exists(kept, lambda k: (k["start"] <= w["end"]) & (w["start"] <= k["end"]))
        return F.when(free, F.concat(kept, F.array(w))).otherwise(kept)

    out = out.withColumn("_apart", F.aggregate("_best", F.slice("_best", 1, 0), add))
    # Words of each line, to place the matching lines among the words of the text.
    counts = F.transform(F.split(clean, "\n", -1), lambda line: F.when(F.trim(line) == "", 0).otherwise(
        F.size(F.split(F.trim(line), " +"))
    ))
    some = F.size(F.coalesce("_apart", F.array())) > 0
    out = out.withColumn("_counts", F.when(some, counts))
    total = lambda to: F.aggregate(F.slice("_counts", 1, to), F.lit(0), lambda a, b: a + b)
    out = out.withColumn("_held", F.transform("matches", lambda m: F.struct(
        F.when(m["line"] == 0, 0).otherwise(total(F.greatest(m["line"] - 1, F.lit(0)))).alias("start"),
        (F.when(m["line"] == 0, total(F.size("_counts"))).otherwise(total(m["line"])) - 1).alias("end"),
        m["license"].alias("license"),
    )))
    passages = F.transform(F.filter("_apart", lambda w: ~F.exists("_held", lambda h: (
        ((h["start"] <= w["start"]) & (w["end"] <= h["end"]))
        | ((h["license"] == w["license"]) & (h["start"] <= w["end"]) & (w["start"] <= h["end"]) & (w["end"] - w["start"] < NOTICE_WORDS))
    ))), lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), w["license"].alias("license"), (-w["less"]).alias("dice"),
    ))
    out = out.withColumn("passages", F.when(some, passages).otherwise(F.array().cast(PASSAGE)))
    value = lambda m: F.struct((-m["dice"]).alias("less"), m["license"].alias("license"), m["dice"].alias("dice"))
    top = F.element_at(F.array_sort(F.concat(F.transform("matches", value), F.transform("passages", value))), 1)
    any_found = F.size("matches") + F.size("passages") > 0
    return out.withColumns({
        "n_matches": (F.size("matches") + F.size("passages")).cast("bigint"),
        "license": F.when(any_found, top["license"]), "dice": F.when(any_found, top["dice"]),
    }).drop(*helpers)

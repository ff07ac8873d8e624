"""License scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

A text's units are its lines and its paragraphs (between empty lines), the whole text being one where it has a single
paragraph. A unit is normalised (letters A-Z lower-cased, everything but letters, digits and dots between words dropped)
and becomes a set of word bigrams. With a bigrams against a template's b the Dice coefficient is 2 * shared / (a + b), so it can
reach t only where t / (2 - t) <= a / b <= (2 - t) / t: templates outside that range are never compared, and a unit
whose count is outside all ranges is dropped before its bigrams are made. The same bounds say that a match shares t / (2 - t) of
the template's bigrams at least, so that it has one of any few words that cover the rest and one more: texts and units with none of
these are dropped by one search. What is left meets the templates by an equi-join on the bigram; templates are a
fixed list, a few hundred bigrams that are broadcast.

What no unit matches as a whole is searched for embedded notices: for each template paragraphs are cut at lines that match
one of its size or larger, and of the rest every run of words that starts and ends with a bigram of the template, and stands on at most
(2 - t) / t times as many places as it has bigrams, is compared by the same coefficient. There a run counts as no shorter than
the template, and bigrams that aren't the template's as often as they stand. A part with such a run is one unit more.

Defined results: rows that share a doc_id, or have none, are one document; null, empty or wordless texts match nothing; a unit of one word has no bigram and matches nothing; of templates
with equal Dice the first by name is the document's best; repeated rows get the same results; an empty table gives no
rows. Other columns pass through `scan`, whatever their names, but for those that it returns.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, by_place, cut, documents

#: Short notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}


def normal_words(text: Column) -> Column:
    """Words of the normalised text: runs of letters and digits, dots kept inside."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words, as text."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license and its distinct bigrams."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return rows.select("license", bigrams(normal_words(F.col("text"))).alias("bigrams")).filter(F.size("bigrams") > 0)


def anchors(known: dict[str, list[str]], low: float) -> list[str]:
    """Words of which every match has one: for each template words that cover all but ceil(low * b) - 1 of its bigrams."""
    chosen: set[str] = set()
    for _, pairs in sorted(known.items()):
        open_pairs, spare = [set(p.split(" ")) for p in pairs], math.ceil(low * len(pairs) - 1e-9) - 1
        open_pairs = [p for p in open_pairs if not p & chosen]
        while len(open_pairs) > spare:
            words = Counter(w for p in open_pairs for w in p if w.isalpha())
            if not words:
                return []
            # Long words first: short ones are those that all texts have.
            best = max(words, key=lambda w: (len(w) > 4, words[w], len(w), w))
            chosen.add(best)
            open_pairs = [p for p in open_pairs if best not in p]
    return sorted(chosen)


def embedded(docs: DataFrame, whole: DataFrame, known: DataFrame, hint: str, low: float, high: float, least: float) -> DataFrame:
    """doc_id, license, dice: each licence that a run of words reaches in what is left of docs without the units of `whole` (doc_id, mark, b) that a template of its size or larger matches."""
    sizes = [r["b"] for r in known.select(F.size("bigrams").alias("b")).distinct().collect()]  # as many as templates at most
    taken = whole.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("mark", "b")).alias("taken"))
    docs = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    # Without such units a text is the same for templates of all sizes.
    docs = docs.select("doc_id", "text", "taken", F.explode(F.when(F.col("taken").isNull(), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, sorted(sizes))))).alias("of"))
    blank = r"\n[\x20\x09-\x0D]*\n"
    is_taken = lambda x: F.coalesce(F.exists("taken", lambda u: (u["mark"] == F.xxhash64(x)) & (u["b"] >= F.col("of"))), F.lit(False))
    paragraphs = F.filter(F.split("text", blank, -1), lambda p: ~is_taken(p))
    lines = F.transform(F.split(F.array_join(paragraphs, "\n\n"), "\n", -1), lambda x: F.when(is_taken(x), F.lit("")).otherwise(x))
    parts = docs.select("doc_id", "of", F.explode(F.split(F.array_join(lines, "\n"), blank, -1)).alias("part"))
    parts = parts.filter(F.col("part").rlike(hint)).select("doc_id", "of", F.monotonically_increasing_id().alias("part"), normal_words(F.col("part")).alias("words"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = parts.select("doc_id", "of", "part", F.posexplode(F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b))).alias("pos", "bigram"))
    index = known.select("license", F.size("bigrams").alias("b"), F.explode("bigrams").alias("bigram"))
    met = pairs.join(F.broadcast(index), "bigram").filter("of IN (0, b)").groupBy("doc_id", "part", "license", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "bigram"))).alias("hits"))
    met = met.filter(F.size(F.array_distinct("hits.bigram")) >= F.col("b") * low)

    def best_from(first: Column) -> Column:
        """The best Dice coefficient of the runs that start with a hit."""
        near = F.filter("hits", lambda h: (h["pos"] >= first["pos"]) & (h["pos"] - first["pos"] + 1 <= F.col("b") * high))

        def run(last: Column, k: Column) -> Column:
            shared = F.size(F.array_distinct(F.transform(F.slice(near, F.lit(1), k + 1), lambda h: h["bigram"])))
            a = F.greatest(last["pos"] - first["pos"] - k + shared, F.col("b"))
            return 2.0 * shared / (a + F.col("b"))

        return F.when(F.size(near) >= F.col("b") * low, F.array_max(F.transform(near, run))).otherwise(0.0)

    return met.select("doc_id", "license", F.array_max(F.transform("hits", best_from)).alias("dice")).filter(F.col("dice") >= least)


def matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, __row, license, dice: each licence that some unit of the row or a run of words inside one reaches, with its Dice coefficient."""
    spark = docs.sparkSession
    known = template_rows(spark, templates or TEMPLATES)
    listed = {r["license"]: r["bigrams"] for r in known.collect()}  # as many as the list of templates
    sizes = [len(pairs) for pairs in listed.values()]
    low, high = least / (2 - least), (2 - least) / least
    words = anchors(listed, low)
    hint = rf"(?<![A-Za-z0-9])(?i:{'|'.join(words)})(?![A-Za-z0-9])" if words else ""
    docs = docs.filter(F.col("text").rlike(hint))
    lines = F.split("text", "\n", -1)
    paragraphs = F.split("text", r"\n[\x20\x09-\x0D]*\n", -1)
    units = docs.filter(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.concat(lines, paragraphs))).alias("unit"))
    # Before any word is made out: a template of b bigrams has a counterpart of b * low + 1 words at least.
    shortest = int(min(sizes) * low) + 1
    units = units.filter((F.length("unit") >= 2 * shortest - 1) & F.col("unit").rlike(hint)).select("doc_id", F.xxhash64("unit").alias("mark"), normal_words(F.col("unit")).alias("words"))
    in_words = F.lit(False)
    for b in sorted(set(sizes)):  # a words make a - 1 bigrams at most; repeats make it fewer
        in_words = in_words | (F.size("words") - 1 >= b * low)
    units = units.filter(in_words).select("doc_id", "mark", bigrams(F.col("words")).alias("own"))
    in_range = F.lit(False)
    for b in sorted(set(sizes)):
        in_range = in_range | F.size("own").between(b * low, b * high)
    units = units.filter(in_range).withColumn("unit", F.monotonically_increasing_id()).withColumn("a", F.size("own"))
    pairs = units.select("doc_id", "unit", "mark", "a", F.explode("own").alias("bigram"))
    index = known.select("license", F.size("bigrams").alias("b"), F.explode("bigrams").alias("bigram"))
    met = pairs.join(F.broadcast(index), "bigram").filter(F.col("a").between(F.col("b") * low, F.col("b") * high))
    shared = met.groupBy("doc_id", "unit", "mark", "license", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("dice", 2.0 * F.col("shared") / (F.col("a") + F.col("b"))).filter(F.col("dice") >= least)
    whole = cut(scored.select("doc_id", "mark", "b", "license", "dice"), "licenses")
    inside = embedded(docs, whole, known, hint, low, high, least)
    scored = whole.drop("mark", "b").unionByName(inside)
    return scored.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))


def scan(docs: DataFrame, **how) -> DataFrame:
    """docs without text, with license (the best, null if none), dice (0 if none), n_units that match and licenses (all, sorted, joined by commas)."""
    plain, rest, back = by_place(docs, ("doc_id", "text"), ("text", "license", "dice", "n_units", "licenses"))
    rest = [c for c in rest if c != "text"]
    found = matches(plain.select("doc_id", "text"), **how)
    per_doc = found.groupBy(F.col("doc_id").alias("__id")).agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license"))["license"].alias("license"),
        F.max("dice").alias("dice"),
        F.sum("n_units").alias("n_units"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    joined = plain.select(*rest).join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return back(joined.select(*rest, "license", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))


_NORMAL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:\.[a-z0-9]+)*')"
_BIGRAMS = "list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
OP1_SQL = f"""
WITH t(license, text) AS (VALUES {", ".join(f"($q${k}$q$, $q${v}$q$)" for k, v in sorted(TEMPLATES.items()))}),
tw AS (SELECT license, {_NORMAL.format("text")} AS w FROM t),
tb AS (SELECT license, {_BIGRAMS.format("w")} AS b FROM tw),
u AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '\n[\x20\x09-\x0D]*\n')) AS unit FROM documents WHERE text IS NOT NULL),
uw AS (SELECT doc_id, unit, {_NORMAL.format("unit")} AS w FROM u),
ub AS (SELECT doc_id, unit, {_BIGRAMS.format("w")} AS a FROM uw WHERE len(w) > 1),
s AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM ub, tb WHERE len(a) <= 200),
f AS (SELECT * FROM s WHERE dice >= 0.8),
l AS (SELECT doc_id, license, max(dice) AS dice, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT doc_id, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, sum(n)::BIGINT AS n_units, string_agg(license, ',' ORDER BY license) AS licenses FROM l GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

"""Licence scan: whole texts, lines and passages against templates by Dice over word bigrams.

Passages are runs of as many words as a template has, a quarter of that apart, wherever one holds a
word of which every match must hold one: so a licence that is wrapped over lines, precedes code or
stands inside a longer line is met by a passage that differs from it by an eighth at most. Most units
are left out by the same words. Two texts with a and b different bigrams can reach a coefficient t only if
2 * min(a, b) >= t * (a + b); units of a size that no template allows are left out before their
bigrams are spread, and single templates by their own bounds in the join. Templates are a fixed
list, so the table of their bigrams is bounded and broadcast. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

MIN_DICE = 0.8

# Names of public licences as notices state them.
NAMES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
}
# How a notice begins.
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under the {}",
           "This work is licensed under the {}", "This software is licensed under the {}")
# Public licence texts, without names and years.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General
        Public License along with this program. If not, see http://www.gnu.org/licenses/.""",
}
# Words that are too common to tell anything.
_COMMON = {"and", "by", "in", "is", "of", "or", "the", "this", "to", "under", "with"}


def templates() -> list[tuple[str, str]]:
    """(license_id, text) of all templates."""
    return [(i, n.format(name)) for i, name in NAMES.items() for n in NOTICES] + list(TEXTS.items())


def normalised(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 is one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(text: Column) -> Column:
    """The different word bigrams of normalised text."""
    pairs = lambda words: F.array_distinct(F.zip_with(
        F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)),
        lambda a, b: F.concat_ws(" ", a, b)))
    # as a variable of the outer function the words are split once
    return F.transform(F.array(F.split(text, " ")), pairs)[0]


def _keywords(found: list[list[str]], min_dice: float) -> list[str]:
    """Words of which every match has one.

    A match shares at least b * t / (2 - t) of a template's b bigrams. Words are added, those in
    most bigrams first and long ones before short ones, until the bigrams without any of them are
    fewer than that for every template.
    """
    chosen: set[str] = set()
    for words in found:
        bigrams = set(zip(words, words[1:]))
        shared = len(bigrams) * min_dice / (2 - min_dice) - 1e-9
        while len(bare := [pair for pair in bigrams if not chosen & set(pair)]) >= shared:
            chosen.add(max({w for pair in bare for w in pair}, key=lambda w: (
                w not in _COMMON, min(len(w), 6), sum(w in pair for pair in bare), len(w), w)))
    return sorted(chosen)


def _possible(a: Column, b: Column, min_dice: float) -> Column:
    return 2 * F.least(a, b) >= min_dice * (a + b)


def _passages(words: Column, keywords: list[str], sizes: list[int]) -> Column:
    """(first word, number of words) of the passages of ``sizes`` words that hold a keyword.

    Passages begin at multiples of a quarter of their size. What reaches past the end of the text is
    the end of the text.
    """
    n = F.size(words)
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull())

    def of(size: int) -> Column:
        step = _step(size)
        first = lambda p: F.greatest(F.ceil((p - size + 1) / step), F.lit(0)).cast("int")
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(
            first(p), F.greatest(F.floor(p / step).cast("int"), first(p))))))
        return F.transform(F.filter(starts, lambda s: (s * step < n) & (n > size)), lambda s: F.struct(
            (s * step).alias("first"), F.lit(size).alias("size")))

    return F.concat(*map(of, sizes))


def _step(size: int) -> int:
    return max(1, size // 4)


def license_scan(docs: DataFrame, min_dice: float = MIN_DICE,
                 found: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license_id, dice, n_units): licences of a document and the best coefficient.

    Units are the whole text, each line if it has several, and passages of as many words as some
    template has; ``n_units`` counts the whole text and the lines that reach ``min_dice`` for some
    template of the licence, so it is 0 where only a passage does. Ties between templates do not
    matter. Rows with the same id and text are one document. Units with fewer than two words, null
    and empty texts have no licence. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(k, i, t) for k, (i, t) in enumerate(found or templates())],
        "template int, license_id string, text string").withColumn(
            "bigrams", _bigrams(normalised(F.col("text")))).where(F.size("bigrams") > 0)
    sizes = [r[0] for r in known.select(F.size("bigrams")).distinct().collect()]
    known = known.select("template", "license_id", F.size("bigrams").alias("b"),
                         F.explode("bigrams").alias("bigram"))
    words = [r[0].split(" ") for r in spark.createDataFrame(
        [(t,) for _, t in found or templates()], "text string").select(normalised(F.col("text"))).collect()]
    words = [w for w in words if len(w) > 1]
    keywords = _keywords(words, min_dice)
    possible = lambda line: F.lower(line).rlike("(?<![a-z0-9])(?:" + "|".join(keywords) + ")(?![a-z0-9])")
    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text")).where(possible("text"))
    lines = F.split("text", "\n")
    whole = held.select("doc_id", "text_hash", F.posexplode(F.when(
        F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))).alias("unit", "line"))
    # explode() keeps what it makes: a filter on it does not compute it again
    whole = whole.where(possible("line")).select(
        "doc_id", "text_hash", "unit", F.explode(F.array(normalised(F.col("line")))).alias("line"))
    spoken = held.select("doc_id", "text_hash", F.explode(F.array(F.split(
        normalised(F.col("text")), " "))).alias("words"))
    parts = spoken.select("doc_id", "text_hash", "words", F.explode(_passages(
        F.col("words"), keywords, sorted({len(w) for w in words}))).alias("at")).select(
            "doc_id", "text_hash", (-1 - F.col("at.first").cast("long") * 100_000 - F.col("at.size")).alias("unit"),
            F.array_join(F.slice("words", F.col("at.first") + 1, F.col("at.size")), " ").alias("line"))
    spread = whole.withColumn("unit", F.col("unit").cast("long")).unionByName(parts).where(
        F.contains("line", F.lit(" "))).select(
            "doc_id", "text_hash", "unit", F.explode(F.array(_bigrams(F.col("line")))).alias("bigrams"))
    a = F.size("bigrams")
    allowed = F.lit(False)
    for low, high in _ranges(sizes, min_dice):
        allowed = allowed | a.between(low, high)
    joined = spread.where(allowed).select(
        "doc_id", "text_hash", "unit", a.alias("a"), F.explode("bigrams").alias("bigram")).join(
            F.broadcast(known), "bigram").where(_possible(F.col("a"), F.col("b"), min_dice))
    scored = joined.groupBy("doc_id", "text_hash", "unit", "template", "license_id", "a", "b").agg(
        F.size(F.collect_set("bigram")).alias("common")).withColumn(
            "dice", 2 * F.col("common") / (F.col("a") + F.col("b"))).where(F.col("dice") >= min_dice)
    by_unit = scored.groupBy("doc_id", "text_hash", "unit", "license_id").agg(F.max("dice").alias("dice"))
    return by_unit.groupBy("doc_id", "text_hash", "license_id").agg(
        F.max("dice").alias("dice"), F.count_if(F.col("unit") >= 0).alias("n_units")).drop("text_hash")


def _ranges(sizes: list[int], min_dice: float) -> list[tuple[int, int]]:
    """Sizes of units that some template allows, as disjoint ranges."""
    fits = sorted({a for b in sizes for a in range(1, int(b * (2 - min_dice) / min_dice) + 2)
                   if 2 * min(a, b) >= min_dice * (a + b)})
    out: list[tuple[int, int]] = []
    for a in fits:
        if out and out[-1][1] == a - 1:
            out[-1] = out[-1][0], a
        else:
            out.append((a, a))
    return out


def scan_sql(min_dice: float = MIN_DICE) -> str:
    """The same in DuckDB's SQL, over table ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(i)}, {quote(t)})" for k, (i, t) in enumerate(templates()))
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = [re.sub("[^a-z0-9]+", " ", t.lower()).strip().split(" ") for _, t in templates()]
    words = [w for w in words if len(w) > 1]
    keys = ", ".join(map(quote, _keywords(words, min_dice)))
    sizes = ", ".join(f"({n}, {_step(n)})" for n in sorted({len(w) for w in words}))
    return f"""
        WITH tw AS (SELECT k, license_id, string_split({normal("text")}, ' ') AS w
                    FROM (VALUES {rows}) v(k, license_id, text)),
        t AS (SELECT k, license_id, {pairs} AS g FROM tw),
        d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM d),
        u AS (SELECT doc_id, text, 0 AS unit, text AS line FROM d
              UNION ALL SELECT doc_id, text, unnest(range(1, len(lines) + 1)) AS unit,
                               unnest(lines) AS line FROM l WHERE len(lines) > 1),
        n AS (SELECT doc_id, text, unit, string_split({normal("line")}, ' ') AS w FROM u),
        spoken AS (SELECT doc_id, text, string_split({normal("text")}, ' ') AS ws FROM d),
        keyed AS (SELECT *, list_filter(range(0, len(ws)), lambda i: list_contains([{keys}], ws[i + 1])) AS hits
                  FROM spoken),
        starts AS (SELECT DISTINCT doc_id, text, ws, size, step, unnest(range(
                       CAST(greatest(ceil((p - size + 1) / step::DOUBLE), 0) AS BIGINT), p // step + 1)) AS s
                   FROM (SELECT doc_id, text, ws, unnest(hits) AS p FROM keyed) q,
                        (VALUES {sizes}) v(size, step) WHERE len(ws) > size),
        passages AS (SELECT doc_id, text, -1 - s * step * 100000 - size AS unit,
                            ws[s * step + 1:s * step + size] AS w FROM starts WHERE s * step < len(ws)),
        b AS (SELECT doc_id, text, unit, {pairs} AS g
              FROM (SELECT * FROM n UNION ALL SELECT * FROM passages) q WHERE len(w) > 1),
        c AS (SELECT doc_id, text, unit, len(g) AS a, unnest(g) AS w FROM b),
        tb AS (SELECT k, license_id, len(g) AS b, unnest(g) AS w FROM t),
        s AS (SELECT doc_id, text, unit, k, license_id,
                     2 * count(*) / (any_value(a) + any_value(b)) AS dice
              FROM c JOIN tb USING (w) GROUP BY doc_id, text, unit, k, license_id),
        best AS (SELECT doc_id, text, unit, license_id, max(dice) AS dice FROM s
                 WHERE dice >= {min_dice} GROUP BY doc_id, text, unit, license_id)
        SELECT doc_id, license_id, max(dice) AS dice, count(*) FILTER (unit >= 0) AS n_units
        FROM best GROUP BY doc_id, text, license_id"""

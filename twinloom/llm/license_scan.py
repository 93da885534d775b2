"""Licence scan: texts and their lines against licence templates.

Each document is normalised (lower case, everything but a-z, 0-9 and line ends becomes a
space) and compared as a whole, by blank-line separated block and by line with every
template by the Dice coefficient of their sets of word bigrams. Dice >= t is only possible
if the smaller of two bigram counts is at least t / (2 - t) of the larger, and a set is no
larger than its number of words less one; a segment whose size fits no template is dropped
before its bigrams are built, and a template whose size does not fit is never compared. The
least overlap that follows from the bounds also gives words of which a matching segment
must have one; texts and segments without any are passed over.

A notice may also span lines and blocks or sit inside a longer line, so runs of words of any
place and length are compared too (``_window``), unless a segment scores 1 already. A run that
scores best begins with a bigram of the template, and its set is a prefix of the distinct
bigrams from there on, no longer than the bounds allow; a run that goes on to the next
occurrence of its first bigram has the same set as one that begins later. So one pass from each
occurrence of a template's bigrams compares every run.

Runs on DataFrame functions only. Documents are scanned in place; nothing is shuffled.

Defined results: one row per row of ``docs``; null, empty and one-word texts have no bigrams and
no licence; of templates with equal score the first by name wins, of a segment and a run with
equal score the segment; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table

THRESHOLD = 0.8
SHORT = 4

#: Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "bsd": "Licensed under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(count: int, threshold: float) -> tuple[int, int]:
    """Least and largest bigram counts that can reach ``threshold`` against ``count``.

    In fractions: in doubles 0.8 / (2 - 0.8) lies above 2/3, which cuts off counts just at the threshold.
    """
    share = Fraction(str(threshold)) / (2 - Fraction(str(threshold)))
    return math.ceil(count * share), math.floor(count / share)


def _let(value, body):
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def marks(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every segment within ``threshold`` of a template has at least one.

    A template of n bigrams shares at least as many as ``size_bounds`` asks for. Words
    taken for another template, then long words are taken until fewer bigrams than that
    are without one of them.
    """
    found: set[str] = set()
    for _, grams in known:
        need, rest = max(1, size_bounds(len(grams), threshold)[0]), [set(g.split()) for g in grams]
        # among short words the later ones by name: they are rarer than "by"
        for word in sorted(sorted(set().union(*rest), reverse=True), key=lambda w: (w not in found, -len(w))):
            if len(rest) < need:
                break
            found.add(word)
            rest = [g for g in rest if word not in g]
    return sorted(found)


def _any_of(tests):
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _plain(text, words: list[str]):
    """A text that has one of ``words``, normalised; null for others."""

    def inside(s):
        """Cheap for long words; short ones are looked for as whole words once their letters are there."""
        short = [F.contains(s, F.lit(w)) & F.rlike(s, F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])")) for w in words if len(w) < SHORT]
        return _any_of([F.contains(s, F.lit(w)) for w in words if len(w) >= SHORT] + short)

    return _let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.when(inside(t), F.regexp_replace(t, "[^a-z0-9\\n]+", " ")))


def _segments(plain, words: list[str]):
    """Distinct lines, blocks and the whole of a normalised text, those that have one of ``words``."""

    def whole_word(s):
        return _any_of([F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(f" {w} ")) for w in words])

    def split(plain):
        parts = F.array_union(F.array_union(F.split(plain, "\n"), F.split(plain, "\n ?(?:\n ?)+")), F.array(plain))
        return F.array_distinct(F.transform(parts, lambda p: F.trim(F.translate(p, "\n", " "))))

    found = F.filter(split(plain), lambda s: _let(s, whole_word))
    return F.when(plain.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def _sequence(segment):
    """The bigrams of a segment in their order."""

    def pairs(words):
        rest = F.size(words) - 1
        return F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b))

    return _let(F.split(segment, " +"), pairs)


def _bigrams(segment):
    return F.array_distinct(_sequence(segment))


def _best_from(b, at, own: list[str], threshold: float):
    """The best Dice with ``own`` of a run of the bigrams ``b`` that begins at ``at``."""
    least, most = size_bounds(len(own), threshold)
    reach = 4 * most

    def open_end(near):
        """Distinct bigrams up to the end, looked for beyond ``reach`` only if there are too few."""
        more = F.array_distinct(F.slice(b, at + 1, F.size(b)))
        return _let(F.array_distinct(near), lambda d: F.when((F.size(d) < most) & (at + reach < F.size(b)), more).otherwise(d))

    def distinct(near):
        # beyond the next occurrence of the first bigram sets are those of runs from there
        again = F.array_position(F.slice(near, 2, reach), F.get(near, F.lit(0))).cast("int")
        return _let(again, lambda n: F.when(n > 0, F.array_distinct(F.slice(near, 1, n))).otherwise(open_end(near)))

    def step(a, gram):
        shared = a["shared"] + F.when(gram.isin(own), 1).otherwise(0)
        dice = F.lit(2.0) * shared / (a["size"] + 1 + len(own))
        return F.struct(shared.alias("shared"), (a["size"] + 1).alias("size"), F.greatest(a["dice"], dice).alias("dice"))

    def score(grams):
        start = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("size"), F.lit(0.0).alias("dice"))
        enough = F.size(F.filter(grams, lambda g: g.isin(own))) >= least
        return F.when(enough, F.reduce(grams, start, step, lambda a: a["dice"])).otherwise(0.0)

    return _let(F.slice(b, at + 1, reach), lambda near: _let(F.slice(distinct(near), 1, most), score))


def _window(plain, known: list[tuple[str, list[str]]], threshold: float):
    """dice and license of the best run of words of a normalised text, of any place and length."""
    every = sorted(set().union(*(own for _, own in known)))

    def best(b):
        # places of bigrams of any template
        return _let(F.array_compact(F.transform(b, lambda x, i: F.when(x.isin(every), i))), lambda places: of_templates(b, places))

    def of_template(b, places, own):
        least = size_bounds(len(own), threshold)[0]

        def runs(starts):
            # fewer than ``least`` shared bigrams are left behind the last places
            first = F.slice(starts, 1, F.greatest(F.size(starts) - least + 1, F.lit(0)))
            return F.reduce(first, F.lit(0.0), lambda a, i: F.when(a >= 1.0, a).otherwise(F.greatest(a, _best_from(b, i, own, threshold))))

        return _let(F.filter(places, lambda i: F.get(b, i).isin(own)), runs)

    def of_templates(b, places):
        each = [F.struct(of_template(b, places, own).alias("dice"), F.lit(name).alias("license")) for name, own in known]
        found = F.reduce(F.array(*each), F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), _better)
        return F.when(F.size(places) >= min(size_bounds(len(own), threshold)[0] for _, own in known), found)

    return _let(_sequence(F.trim(F.translate(plain, "\n", " "))), best)


def _better(a, b):
    """The higher score; of equal ones the first licence by name."""
    ahead = (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["license"] < a["license"]))
    return F.when(ahead, b).otherwise(a)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, license (null if none), dice, n_segments that match.

    ``dice`` is the best score over segments, runs of words and templates that reach
    ``threshold``, else 0. A run that scores better than every segment counts as one.
    """
    known = [(name, grams) for name, text in sorted(templates.items()) if (grams := bigrams_of(text))]
    if not known:
        nothing = F.lit(None).cast("string").alias("license")
        return docs.select(ref(id_col).alias(id_col), nothing, F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_segments"))
    bounds = [size_bounds(len(grams), threshold) for _, grams in known]
    least = min(lo for lo, _ in bounds)
    words = marks(known, threshold)

    def spaces(segment):
        return F.length(segment) - F.length(F.translate(segment, " ", ""))

    # a set holds at most as many bigrams as there are gaps; repeats only shrink it
    sized = F.filter(_segments(F.col("__plain"), words), lambda s: spaces(s) >= least)
    grams = F.transform(sized, _bigrams)
    fitting = F.filter(
        grams,
        lambda g: F.exists(
            F.array(*[F.struct(F.lit(lo), F.lit(hi)) for lo, hi in bounds]),
            lambda b: F.size(g).between(b["col1"], b["col2"]),
        ),
    )

    def scores(g):
        each = []
        for (name, own), (lo, hi) in zip(known, bounds):
            shared = F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in own])))
            dice = F.when(F.size(g).between(lo, hi), 2.0 * shared / (F.size(g) + len(own))).otherwise(0.0)
            each.append(F.struct(dice.alias("dice"), F.lit(name).alias("license")))
        return F.reduce(F.array(*each), F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), _better)

    scored = F.filter(F.transform(fitting, scores), lambda s: s["dice"] >= threshold)
    found = docs.select(ref(id_col).alias(id_col), _plain(ref(text_col), words).alias("__plain"))
    found = found.select(id_col, "__plain", scored.alias("__scored"))
    best = F.reduce("__scored", F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("license")), _better)
    found = found.select(id_col, "__plain", best.alias("__best"), F.size("__scored").cast("long").alias("__n"))
    # nothing is better than 1
    run = F.when(F.col("__plain").isNotNull() & (F.col("__best.dice") < 1.0), _window(F.col("__plain"), known, threshold))
    found = found.select(id_col, "__best", "__n", run.alias("__run"))
    better = F.coalesce((F.col("__run.dice") >= threshold) & (F.col("__run.dice") > F.col("__best.dice")), F.lit(False))
    return found.select(
        id_col,
        F.when(better, F.col("__run.license")).otherwise(F.col("__best.license")).alias("license"),
        F.when(better, F.col("__run.dice")).otherwise(F.col("__best.dice")).alias("dice"),
        (F.col("__n") + better.cast("long")).alias("n_segments"),
    )


def _sql_bounds(count: int) -> tuple[int, int]:
    """The bounds the SQL was given with, in doubles: up to one narrower than ``size_bounds``."""
    share = THRESHOLD / (2 - THRESHOLD)
    return int(-(-count * share // 1)), int(count / share)


def _sql() -> str:
    known = [(name, bigrams_of(text)) for name, text in sorted(TEMPLATES.items())]
    rows = ", ".join(
        f"('{name}', {len(g)}, {_sql_bounds(len(g))[0]}, {_sql_bounds(len(g))[1]}, "
        f"[{', '.join(repr(x) for x in g)}])"
        for name, g in known
    )
    return f"""
with plain as (
  select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') as t from documents),
segments as (
  select doc_id, unnest(list_distinct(list_transform(
    string_split(t, chr(10)) || regexp_split_to_array(t, '\n ?(?:\n ?)+') || [t],
    lambda s: trim(replace(s, chr(10), ' '))))) as s from plain),
words as (
  select doc_id, s, regexp_split_to_array(s, ' +') as w from segments
  where length(s) - length(replace(s, ' ', '')) >= {min(_sql_bounds(len(g))[0] for _, g in known)}),
grams as (
  select doc_id, s, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from words),
templates(license, n, lo, hi, own) as (values {rows}),
best as (
  select doc_id, s, license, 2.0::double * len(list_intersect(g, own)) / (len(g) + n) as dice,
         row_number() over (partition by doc_id, s order by 2.0::double * len(list_intersect(g, own)) / (len(g) + n) desc, license) as place
  from grams join templates on len(g) between lo and hi),
hits as (select * from best where place = 1 and dice >= {THRESHOLD})
select d.doc_id, first(h.license order by h.dice desc, h.license) as license,
       coalesce(max(h.dice), 0.0)::double as dice, count(h.license) as n_segments
from documents d left join hits h on h.doc_id = d.doc_id group by d.doc_id"""


@query("op1_license_scan", _sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

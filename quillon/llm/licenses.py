"""Licence scans: normalised lines and whole texts against licence templates by the Dice coefficient over word bigrams.

A text's segments are its lines, the text as a whole, and, as a notice may be wrapped over lines or stand in a line of
prose, all runs of as many words as a template has, of every start. Segments and templates
are normalised alike: lower case, everything but ASCII letters and digits a space. With |A| and |B| bigrams a
Dice coefficient of t or more needs t / (2 - t) <= |A| / |B| <= (2 - t) / t, so a segment meets only the templates
within these bounds. For lines and whole texts shared bigrams are found by a join with the templates' bigrams, a
table of fixed size. Such a segment also shares t / (2 - t) of the template's bigrams at least. `telling_words`
picks words that occur in more than the rest of every template's bigrams: a text, line or run without any of
them can't match. Runs are counted as they slide, in time that grows with the text's length.

Defined results: a null or empty text, and one that matches nothing, has null license and dice and no
matching segments; equal scores go to the licence first by name; repeated rows each give a row, also with a null
doc_id; texts of any length are scanned whole, in a task each; an empty table gives an empty result; other
columns are ignored. A segment of one word has no bigrams and matches nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import written

THRESHOLD = 0.8

# Public licence notices and short licence texts.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Function words that texts of any kind hold; they tell nothing of licences.
COMMON_WORDS = frozenset("a all an and any as at be but by for from if in is it no not of on one or that the this to under was with without you".split())


def normalised(c: Column) -> Column:
    """Lower case; line ends stay, any other run of characters but ASCII letters and digits becomes one space."""
    return F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9\n]+", " ")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.translate(c, "\n", " "), " "), lambda w: w != "")


def _bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    n = F.size(w)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))


def templates(spark: SparkSession, texts=TEMPLATES) -> DataFrame:
    """license, template number, its distinct bigrams and their count."""
    rows = [(name, i, text) for i, (name, text) in enumerate(texts)]
    schema = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("_t", T.StringType())])
    grams = _bigrams(_words(normalised(F.col("_t"))))
    return spark.createDataFrame(rows, schema).select("license", "template", grams.alias("grams"), F.size(grams).alias("n_template"))


@cache
def telling_words(texts=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every segment that matches a template holds one: greedily, those in many bigrams and long, common words last."""
    grams, need = [], []
    for _, text in texts:
        w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        grams.append(set(zip(w, w[1:])))
        need.append(int(len(grams[-1]) * (1 - threshold / (2 - threshold)) + 1e-9) + 1)
    chosen: list[str] = []
    while any(n > 0 for n in need):
        gain: Counter = Counter()
        for part, n in zip(grams, need):
            for word, in_grams in Counter(w for g in part for w in set(g)).items():
                gain[word] += min(max(n, 0), in_grams) * (0.01 if word in COMMON_WORDS else len(word))
        word = max(sorted(gain), key=gain.__getitem__)
        chosen.append(word)
        need = [n - sum(word in g for g in part) for part, n in zip(grams, need)]
        grams = [{g for g in part if word not in g} for part in grams]
    return chosen


def _holds_any(c: Column, words: list[str]) -> Column:
    """Whether a word of the text, as normalised() would leave it, is one of these."""
    return F.arrays_overlap(F.transform(F.split(c, "[^A-Za-z0-9]+"), F.lower), F.array(*map(F.lit, words)))


def _places(rows: DataFrame) -> DataFrame:
    """Of rows(_row, template, words, i, gram), all occurrences of bigrams: first and last, the run starts at which a run of `words` words holds this occurrence as the first of its bigram."""
    seen = Window.partitionBy("_row", "template", "gram").orderBy("i")
    return rows.withColumn("first", F.greatest(F.lit(0), F.col("i") - F.col("words") + 2, F.coalesce(F.lag("i").over(seen) + 1, F.lit(0)))).withColumn("last", F.col("i")).where("first <= last")


def _by_start(places: DataFrame, *weights: Column) -> DataFrame:
    """Sums of weights over the occurrences that runs hold, for all starts: rows (start, starts, s0, s1, ..) that stand for `starts` starts from `start` on."""
    names = [f"s{n}" for n in range(len(weights))]
    ends = lambda at, sign: F.struct(at.alias("start"), *[(sign * w).alias(n) for n, w in zip(names, weights)])
    changes = places.select("_row", "template", F.inline(F.array(ends(F.col("first"), 1), ends(F.col("last") + 1, -1))))
    along = Window.partitionBy("_row", "template").orderBy("start")
    summed = changes.withColumns({n: F.sum(n).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in names})
    return summed.withColumn("starts", F.lead("start").over(along) - F.col("start")).where("starts > 0")


def run_matches(docs: DataFrame, texts: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The matching runs of words of docs(_row, text), of every start: _row, start (word number from 0), starts (that many from there on match alike), license, template, dice.

    A run's bigrams are counted as it slides. An occurrence of a bigram is the first in its run for the starts between the occurrence before
    it and itself, so each count over all starts is a running sum of ends of such stretches. Shared bigrams alone are counted first, at
    the templates' bigrams; only texts and templates with a run that shares enough of them have all of their bigrams counted.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    split = docs.where(_holds_any(F.col("text"), telling_words(texts, threshold))).dropDuplicates(["_row"]).select("_row", _words(normalised(F.col("text"))).alias("_w"))
    n = F.size("_w")
    pairs = F.when(n > 1, F.zip_with(F.slice("_w", 1, F.greatest(n - 1, F.lit(0))), F.slice("_w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    grams = split.select("_row", F.posexplode(pairs).alias("i", "gram"))
    known = templates(docs.sparkSession, texts).withColumn("words", F.element_at(F.array(*[F.lit(len(re.sub("[^a-z0-9]+", " ", t.lower()).split())) for _, t in texts]), F.col("template") + 1))
    wanted = F.broadcast(known.select("license", "template", "n_template", "words", F.explode("grams").alias("gram")))
    hits = grams.join(wanted, "gram").repartition("_row", "template")  # one shuffle for both windows
    enough = _by_start(_places(hits).withColumn("one", F.lit(1)), F.col("one")).groupBy("_row", "template").agg(F.max("s0").alias("most"))
    some = enough.join(F.broadcast(known.select("license", "template", "n_template", "words")), "template").where(F.col("most") >= F.col("n_template") * F.lit(low)).select("_row", "template", "license", "n_template", "words")
    some = written(some, "templates")
    every = grams.join(some, "_row").join(wanted.select("template", "gram", F.lit(1).alias("shared")), ["template", "gram"], "left").repartition("_row", "template")
    counts = _by_start(_places(every).withColumns({"one": F.lit(1), "shared": F.coalesce("shared", F.lit(0))}), F.col("one"), F.col("shared"))
    rated = counts.join(some, ["_row", "template"]).where(F.col("s0").between(F.col("n_template") * F.lit(low), F.col("n_template") * F.lit(high)))
    return rated.withColumn("dice", 2.0 * F.col("s1") / (F.col("s0") + F.col("n_template"))).where(F.col("dice") >= threshold).select("_row", "start", "starts", "license", "template", "dice")


def matches(docs: DataFrame, texts: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The matching segments of docs(_row, text): _row, segment (line number from 0; the number of lines for the whole text), license, template, dice."""
    known = templates(docs.sparkSession, texts)
    sizes = [r[0] for r in known.select("n_template").collect()]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    # Bounds on the segment before its words are cut: bigrams <= words - 1, and a distinct bigram repeats only in longer texts.
    text = normalised(F.col("text"))
    lines = F.split(text, "\n")
    whole = F.when(F.contains(F.col("text"), F.lit("\n")), F.array(text)).otherwise(F.array().cast("array<string>"))
    telling = telling_words(texts, threshold)
    segments = docs.where(_holds_any(F.col("text"), telling)).select("_row", F.posexplode(F.concat(lines, whole)).alias("segment", "line"))
    counted = segments.where((F.length("line") >= 2 * least) & _holds_any(F.col("line"), telling)).withColumn("_g", _bigrams(_words(F.col("line")))).withColumn("n", F.size("_g")).where(F.col("n").between(least, most))
    bigrams = counted.select("_row", "segment", "n", F.explode("_g").alias("gram"))
    wanted = known.select("license", "template", "n_template", F.explode("grams").alias("gram"))
    near = bigrams.join(F.broadcast(wanted), "gram").where(F.col("n").between(F.col("n_template") * F.lit(threshold / (2 - threshold)), F.col("n_template") * F.lit((2 - threshold) / threshold)))
    shared = near.groupBy("_row", "segment", "license", "template", "n", "n_template").agg(F.count(F.lit(1)).alias("both"))
    return shared.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("n_template"))).where(F.col("dice") >= threshold).select("_row", "segment", "license", "template", "dice")


def scan(docs: DataFrame, texts=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, license and dice (the best match), n_segments (those that match a template), licenses (all, sorted), n_runs (runs of words that match one)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("h")))
    few = written(rows.select("_row", "text").where(_holds_any(F.col("text"), telling_words(texts, threshold))), "telling")
    found = matches(few, texts, threshold).select("_row", "segment", "license", "dice", F.lit(0).alias("starts"))
    runs = run_matches(few, texts, threshold).select("_row", F.lit(None).cast("int").alias("segment"), "license", "dice", "starts")
    found = found.unionByName(runs)
    # Repeated rows share a key, so their segments are counted once; each still gets its row in the join below.
    per_doc = found.groupBy("_row").agg(F.min(F.struct((-F.col("dice")).alias("worst"), "license")).alias("_b"), F.count_distinct("segment").alias("n_segments"), F.sum("starts").alias("n_runs"), F.array_sort(F.collect_set("license")).alias("_a"))
    out = rows.select("_row").join(per_doc, "_row", "left")
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("_b.license").alias("license"), F.round(-F.col("_b.worst"), 6).alias("dice"), F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), F.coalesce(F.array_join("_a", ","), F.lit("")).alias("licenses"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"))


def sql(texts=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB over the view documents, with all pairs of segments and templates."""
    values = ", ".join("('{}', {}, '{}')".format(n, i, t.replace("'", "''")) for i, (n, t) in enumerate(texts))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    norm = lambda c: f"regexp_replace({lower.format(c)}, '[^a-z0-9\\n]+', ' ', 'g')"
    words = lambda c: f"list_filter(string_split(replace({c}, chr(10), ' '), ' '), lambda w: w <> '')"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
with t as (select license, template, {words(norm('txt'))} w from (values {values}) v(license, template, txt)),
tg as (select license, template, {grams('w')} g from t),
d as (select row_number() over () r, doc_id, {norm('text')} x from documents),
seg as (select r, unnest(generate_series(0, len(string_split(x, chr(10))) - 1)) segment, unnest(string_split(x, chr(10))) line from d where x is not null
        union all select r, -1, x from d where contains(x, chr(10))),
sw as (select r, segment, {words('line')} w from seg),
sg as (select r, segment, {grams('w')} g from sw where len(w) > 1),
m as (select r, segment, license, template, 2.0::double * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) dice from sg, tg
      where len(sg.g) between len(tg.g) * {threshold / (2 - threshold)!r}::double and len(tg.g) * {(2 - threshold) / threshold!r}::double),
dw as materialized (select r, {words('x')} w from d where x is not null),
tw as (select license, template, len(w) nw, {grams('w')} g from t),
dg as (select r, len(w) n, {grams('w')} g from dw),
near as (select r, template, n from dg, tw where len(list_intersect(dg.g, tw.g)) >= len(tw.g) * {threshold / (2 - threshold)!r}::double),
start as (select r, template, unnest(range(0, n)) s from near),
run as (select r, template, s, list_slice(dw.w, s + 1, s + nw) rw from start join tw using (template) join dw using (r)),
rm as (select r, tw.license, template, s, 2.0::double * len(list_intersect(rg, tw.g)) / (len(rg) + len(tw.g)) dice from (select r, template, s, {grams('rw')} rg from run where len(rw) > 1) join tw using (template)
       where len(rg) between len(tw.g) * {threshold / (2 - threshold)!r}::double and len(tw.g) * {(2 - threshold) / threshold!r}::double),
k as (select r, segment, license, dice, null s, null template from m where dice >= {threshold} union all select r, null, license, dice, s, template from rm where dice >= {threshold}),
b as (select *, row_number() over (partition by r order by dice desc, license) n from k),
a as (select r, count(distinct segment) n_segments, count(distinct (s, template)) filter (s is not null) n_runs, string_agg(distinct license, ',' order by license) licenses from k group by r)
select doc_id, b.license, round(b.dice, 6) dice, coalesce(n_segments, 0) n_segments, coalesce(licenses, '') licenses, coalesce(n_runs, 0) n_runs
from d left join b on b.r = d.r and b.n = 1 left join a on a.r = d.r"""

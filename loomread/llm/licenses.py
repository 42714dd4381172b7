"""License scan: Dice coefficient over word bigrams against templates (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.llm.decontamination import LOWER, UPPER

#: Public notices and short public licence texts, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Words that are in most English texts, which tell little.
COMMON = set("about all also and any are but can copy following for free from has have into its may must not notice one other shall source such terms that the their these they this those under use was were which will with without work you your".split())


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of the normalised words, sorted."""
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def markers(templates: list[list[str]], least: float) -> list[str]:
    """Words of which a text has one at least if a unit of it matches one of the templates (lists of bigrams) with Dice >= least.

    Such a unit has least / (2 - least) of the template's bigrams or more. So words that occur in more than the rest of
    its bigrams can't all be missing. They are chosen one by one: the one that is in the most bigrams still needed, over all
    templates, that is not one of COMMON while there is one.
    """
    need = [int(len(g) * (1 - least / (2 - least)) + 1e-9) + 1 for g in templates]  # bigrams to be told by the chosen words
    left, chosen = [set(g) for g in templates], []
    while any(n > 0 for n in need):
        gain = {}
        for n, grams in zip(need, left):
            own = {}
            for g in grams if n > 0 else ():
                for w in set(g.split(" ")):
                    own[w] = own.get(w, 0) + 1
            for w, k in own.items():
                gain[w] = gain.get(w, 0) + min(k, n)
        best = max(gain, key=lambda w: (w not in COMMON and len(w) > 2, gain[w], w))
        chosen.append(best)
        for i, grams in enumerate(left):
            told = {g for g in grams if best in g.split(" ")}
            need[i] -= len(told)
            grams -= told
    return sorted(chosen)


def normalised_words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lowering A-Z; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; empty for fewer than two."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


BREAK = "\x01"


def line_runs(lines: Column, near: Column) -> Column:
    """Runs of two or more lines with words of the array ``lines`` for which the array ``near`` is true, as texts."""
    marked = F.zip_with(lines, near, lambda x, ok: F.when(ok, F.replace(x, F.lit(BREAK), F.lit(" "))).otherwise(F.lit(BREAK)))
    return F.filter(F.split(F.array_join(marked, "\n"), BREAK), lambda x: F.size(F.filter(F.split(x, "\n"), lambda y: y.rlike("[A-Za-z0-9]"))) > 1)


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, n_units, dice): licences whose template matches a unit of the text best, with Dice >= least.

    Units are the whole text and, where it has several lines, each of its lines and each of its line_runs(), such as a
    licence wrapped over lines of a comment. Dice = 2 |A and B| / (|A| + |B|) on sets of word
    bigrams; so |A| must lie within |B| * least / (2 - least) and |B| * (2 - least) / least. Texts without any of the
    templates' markers() match nothing and go first. A unit has at least as many
    distinct bigrams as distinct words less one and at most as many as words less one, which prunes most units before
    bigrams are built; a second bound, on the true size, prunes templates. A unit counts for its best template (of equal ones the
    one whose name comes last). One row per document and licence, with the
    number of matching units and the best Dice; documents without a match have no row. Null and empty texts match
    nothing; a long text is a unit like any other; rows that share a doc_id are counted together; an empty table or list gives an empty result; columns other than the two
    named are not read, so clashing names do no harm.
    """
    # the templates are a short list fixed in code or given by the caller; they travel in the plan, not in a join
    known = [(name, grams) for name, body in (TEMPLATES if templates is None else templates) if (grams := template_bigrams(body))]
    if not known:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("license"), F.lit(0).cast("long").alias("n_units"), F.lit(0.0).alias("dice")).limit(0)
    low, high = min(len(g) for _, g in known) * least / (2 - least), max(len(g) for _, g in known) * (2 - least) / least
    lit = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(len(g)).alias("size"), F.array(*map(F.lit, g)).alias("grams")) for n, g in known])
    every = F.array(*[F.lit(g) for g in sorted({g for _, own in known for g in own})])

    marked = F.col(text).rlike(r"(?i)\b(?:" + "|".join(markers([g for _, g in known], least)) + ")")
    whole, lines, near = F.col("whole"), F.col("lines"), F.transform("own", lambda g: 2 * F.size(F.array_intersect(g, every)) >= F.size(g))
    texts = docs.where(marked).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("whole"), F.split(text, "\n").alias("lines"))
    # columns, so that a lambda doesn't split a line anew for each use
    texts = texts.withColumn("words", F.transform("lines", normalised_words)).withColumn("own", F.transform("words", bigrams)).withColumn("near", near)
    runs = F.filter(line_runs(lines, F.col("near")), lambda x: x != whole)
    units = texts.select("doc_id", F.explode_outer(F.when(F.size("lines") > 1, F.concat(F.array("whole"), "lines", runs)).otherwise(F.col("lines"))).alias("unit"))
    # a word has a character and a separator, so short units fall out by length before they are split
    words = units.where(F.length("unit") >= int(low) + 1).select("doc_id", normalised_words(F.col("unit")).alias("w"))
    words = words.where((F.size("w") - 1 >= low) & (F.size(F.array_distinct("w")) - 1 <= high))
    # the number of a unit tells its templates apart again; it also keeps bigrams from being computed anew for each template
    grams = words.select("doc_id", bigrams(F.col("w")).alias("a"), F.monotonically_increasing_id().alias("number"))
    fit = lambda t: (F.size("a") >= t["size"] * least / (2 - least)) & (F.size("a") <= t["size"] * (2 - least) / least)
    pairs = grams.select("doc_id", "number", "a", F.explode_outer(F.filter(lit, fit)).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("a", "t.grams")) / (F.size("a") + F.col("t.size"))
    scored = pairs.select("doc_id", "number", F.struct(dice.alias("dice"), F.col("t.license").alias("license")).alias("t")).where(F.col("t.dice") >= least)
    best = scored.groupBy("doc_id", "number").agg(F.max("t").alias("t"))
    return best.groupBy("doc_id", F.col("t.license").alias("license")).agg(F.count("*").alias("n_units"), F.round(F.max("t.dice"), 6).alias("dice"))


def op5_license_scan(spark, sf_dir):
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_templates() -> str:
    rows = ", ".join("('{}', ['{}'])".format(n, "', '".join(template_bigrams(t))) for n, t in TEMPLATES)
    return f"(VALUES {rows}) t(license, b)"


_SQL_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_SQL_WORDS = f"list_filter(string_split_regex({_SQL_LOW}, '[^a-z0-9]+'), lambda w: w <> '')"
SQL_LICENSES = f"""
WITH t AS (SELECT * FROM {_sql_templates()}), v AS (SELECT list(DISTINCT g) AS every FROM (SELECT unnest(b) AS g FROM t)),
line AS (SELECT r, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS u FROM (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, chr(10)))),
split AS (SELECT *, {_SQL_WORDS.format('u')} AS w FROM line),
flagged AS (SELECT r, doc_id, i, u, len(w) AS n, len(g) AS k, len(list_intersect(g, every)) AS m FROM (SELECT *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM split), v),
cut AS (SELECT *, 2 * m >= k AS ok, sum((2 * m < k)::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM flagged),
runs AS (SELECT r, doc_id, string_agg(u, chr(10) ORDER BY i) AS u, count(*) FILTER (n > 0) AS lines, min(i) AS lo, max(i) AS hi FROM cut WHERE ok GROUP BY r, doc_id, run),
units AS (SELECT doc_id, text AS u FROM documents UNION ALL SELECT doc_id, u FROM line
  UNION ALL SELECT runs.doc_id, u FROM runs JOIN (SELECT r, max(i) AS n FROM line GROUP BY r) z USING (r) WHERE lines > 1 AND (lo > 1 OR hi < n)),
words AS (SELECT row_number() OVER () AS x, doc_id, {_SQL_WORDS.format('u')} AS w FROM units),
grams AS (SELECT x, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM words WHERE len(w) > 1),
scored AS (SELECT x, doc_id, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM grams, t WHERE len(a) <= 4 * len(b)),
best AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY dice DESC, license DESC) AS k FROM scored WHERE dice >= 0.8)
SELECT doc_id, license, count(*) AS n_units, round(max(dice), 6) AS dice FROM best WHERE k = 1 GROUP BY doc_id, license
"""

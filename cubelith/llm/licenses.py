"""Licence scans: passages compared with licence templates.

A passage is a whole text, a paragraph of it (between blank lines), a line of it, or a *window*:
as many words as a template has, over lines and paragraphs and inside lines, beginning where
one of the template's first three bigrams would put its beginning; of a text's windows for a template the best counts (the first, if
as good).  Equal passages of a text count once.  Passages and templates are normalised: lower case, runs
of anything but a-z and 0-9 become one space.  Their similarity is the Dice coefficient of
their sets of word bigrams, ``2 * shared / (a + b)``.  For a coefficient of at least ``t`` a
template of ``m`` bigrams can only match passages of ``m * t / (2 - t)`` to
``m * (2 - t) / t`` bigrams; a passage is compared with the templates of such a size only,
and is dropped before any bigram is made if its number of words rules all of them out.  The same bound says how many
of a template's bigrams a match shares at least; texts that hold none of a set of words without which
too few are left are ruled out first, then those that for each template lack all words of such a set of its own.

All is done inside the row: no shuffle, no join, no Python.

Rules for odd input: a null text and one without words match nothing; a passage of one word
has no bigram and matches nothing; ties give one row for each template; repeated rows are each
reported; null ids stay; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of common licence notices and licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-line": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str) -> list[str]:
    """Words of a normalised text."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order."""
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def needed_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words one of which every match holds: without them, fewer of any template's bigrams are left than a match shares.

    Long words are taken first, as they are rarer.
    """
    out: set[str] = set()
    for text in templates.values():
        left = bigrams(text)
        least = size_bounds(len(left), threshold)[0]
        left = [b for b in left if not out & set(b.split())]
        for w in sorted({w for b in left for w in b.split()}, key=lambda w: (-len(w), w)):
            if len(left) < least:
                break
            out.add(w)
            left = [b for b in left if w not in b.split()]
    return sorted(out)


def needed_groups(text: str, threshold: float) -> list[list[str]]:
    """Groups of a template's words, none twice; every match holds a word of each group, for the reason given at ``needed_words``."""
    every = bigrams(text)
    least = size_bounds(len(every), threshold)[0]
    words = sorted({w for b in every for w in b.split()}, key=lambda w: (-len(w), w))
    out: list[list[str]] = []
    group: set[str] = set()
    for w in words:
        group.add(w)
        if sum(not group & set(b.split()) for b in every) < least:
            out.append(sorted(group, key=words.index))
            group = set()
    return out


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can match a template of ``m``."""
    t = Fraction(str(threshold))
    return -int(-m * t // (2 - t)), int(m * (2 - t) // t)


def normalised(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))


def scan(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """``doc_id, license, dice, bigrams, passage`` of each passage and template with ``dice >= threshold``."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    texts = {k: v for k, v in sorted((TEMPLATES if templates is None else templates).items()) if bigrams(v)}
    known = {k: bigrams(v) for k, v in texts.items()}
    bounds = {k: size_bounds(len(v), threshold) for k, v in known.items()}
    rows = docs.select(c(doc_id).alias("doc_id"), c(text).alias("t")).where(F.col("t").isNotNull())
    some = lambda low, words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words], F.lit(False))
    every = lambda low, groups: reduce(lambda a, b: a & b, [some(low, g) for g in groups], F.lit(True))

    def may_match(low: Column) -> Column:
        one = [every(low, needed_groups(v, threshold)) for v in texts.values()]
        return some(low, needed_words(texts, threshold)) & reduce(lambda a, b: a | b, one, F.lit(False))

    # exploded, as in a plain filter Spark puts lower(t) in the place of every mention of it
    rows = rows.select("doc_id", "t", F.explode_outer(F.filter(F.array(F.lower("t")), may_match)).alias("low")).where(F.col("low").isNotNull())
    passages = F.concat(F.array("t"), F.split("t", r"\n[ \t\r]*\n"), F.split("t", "\n"))
    rows = rows.select("doc_id", F.array_distinct(F.transform(F.array_distinct(passages), normalised)).alias("passages"), F.split(normalised(F.col("low")), " ").alias("words"), normalised(F.col("low")).alias("all"))
    if texts:
        found = rows.withColumn("found", F.filter(F.array(*[_window(k, words_of(v), known[k]) for k, v in texts.items()]), lambda x: x["best"]["dice"] >= threshold))
        named = found.withColumn("windows", F.transform("found", lambda x: F.struct(x["license"].alias("license"), x["best"]["dice"].alias("dice"), F.concat_ws(" ", F.slice("words", -x["best"]["at"], x["n"])).alias("passage"))))
        rows = named.withColumn("windows", F.filter("windows", lambda x: ~F.array_contains("passages", x["passage"])))
    # passages and windows go on together, so that the texts are read and ruled out once
    parts = F.transform("passages", lambda x: F.struct(x.alias("passage"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice")))
    if texts:
        parts = F.concat(parts, F.transform("windows", lambda x: F.struct(x["passage"].alias("passage"), x["license"].alias("license"), x["dice"].alias("dice"))))
    whole = rows.select("doc_id", F.explode_outer(parts).alias("part")).select("doc_id", "part.*")  # outer: else Spark filters by the size of what is exploded, which works it out twice
    n_bigrams = F.length("passage") - F.length(F.replace("passage", F.lit(" "), F.lit("")))  # before repeats go: an upper bound
    window = F.col("license").isNotNull()
    fits = whole.where(window | ((n_bigrams >= min(lo for lo, _ in bounds.values())) & (n_bigrams > 0))) if bounds else whole.limit(0)
    words = F.split("passage", " ")
    most = max((hi for _, hi in bounds.values()), default=0)
    # repeats can only make a passage's set smaller than its word count says, so long passages are compared too
    # unless even their distinct words are too many: a set of n bigrams starts with at most n distinct words
    few = (n_bigrams <= most) | (F.size(F.array_distinct(words)) <= most + 1)
    made = fits.where(window | few).select("doc_id", "passage", "license", "dice", _pairs(words).alias("p")).select("*", F.size("p").alias("bigrams"))
    found = [F.when(F.col("bigrams").between(*bounds[k]), F.struct(F.lit(k).alias("license"), _dice(F.col("p"), v).alias("dice"))) for k, v in known.items()]
    none = F.expr("cast(array() as array<struct<license: string, dice: double>>)")
    hits = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["dice"] >= threshold)) if found else none
    hits = F.when(window, F.array(F.struct("license", "dice"))).otherwise(hits)
    return made.select("doc_id", F.explode_outer(hits).alias("hit"), "bigrams", "passage").where("hit is not null").select("doc_id", "hit.license", "hit.dice", F.col("bigrams").cast("long").alias("bigrams"), "passage")


def _pairs(words: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def _dice(pairs: Column, template: list[str]) -> Column:
    return (2.0 * F.size(F.array_intersect(pairs, F.split(F.lit(",".join(template)), ",")))) / (F.size(pairs) + len(template))


def _window(name: str, template: list[str], own: list[str]) -> Column:
    """``license, n, best`` of a template's best window in ``words``: its similarity and its place, negative; null if none of the first bigrams occurs."""
    first = [f"{a} {b}" for a, b in zip(template, template[1:3] + template[3:4], strict=False)][:3]
    w, n = F.col("words"), len(template)

    def starts_at(b: str, j: int) -> Column:
        here = lambda i: F.concat_ws(" ", F.try_element_at(w, i), F.try_element_at(w, i + 1)) == b
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), here), lambda i: i - j)

    starts = [starts_at(b, j) for j, b in enumerate(first)]
    every = F.filter(F.array_distinct(F.concat(*starts)), lambda i: i >= 1)
    rated = F.transform(every, lambda i: F.struct(_dice(_pairs(F.slice(w, i, n)), own).alias("dice"), (-i).alias("at")))
    there = reduce(lambda a, b: a | b, [F.contains(F.col("all"), F.lit(b)) for b in first])
    return F.when(there, F.struct(F.lit(name).alias("license"), F.lit(n).alias("n"), F.array_max(rated).alias("best")))


def sql(templates: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    texts = {k: v for k, v in sorted((TEMPLATES if templates is None else templates).items()) if bigrams(v)}
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"('{k}', {listed(bigrams(v))}, {listed(words_of(v))})" for k, v in texts.items())
    return rf"""
WITH t(license, b, q) AS (VALUES {values}), doc AS (
  SELECT row_number() OVER () AS r, doc_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS whole FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT r, doc_id, list_distinct(list_transform(
    list_concat([text], regexp_split_to_array(text, '\n[ \t\r]*\n'), string_split(text, chr(10))),
    lambda u: trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')))) AS passages, string_split(whole, ' ') AS w FROM doc
), u AS (
  SELECT r, doc_id, unnest(passages) AS passage FROM l
), p AS (
  SELECT doc_id, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p
  FROM (SELECT doc_id, passage, string_split(passage, ' ') AS w FROM u WHERE passage LIKE '% %')
), d AS (
  SELECT doc_id, passage, license, len(p) AS bigrams, 2.0::DOUBLE * len(list_intersect(p, b)) / (len(p) + len(b)) AS dice
  FROM p, t WHERE len(p) <= 2 * len(b) AND len(b) <= 2 * len(p)
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM l)
), s AS (
  SELECT DISTINCT r, license, b, len(q) AS n, i - j AS s
  FROM g JOIN (SELECT license, b, q, j, q[j + 1] || ' ' || q[j + 2] AS first FROM t, (VALUES (0), (1), (2)) x(j)) f ON g.g = f.first WHERE i - j >= 1
), w AS (
  SELECT s.r, license, s, b, w[s : s + n - 1] AS v FROM s JOIN l USING (r)
), v AS (
  SELECT r, license, s, b, array_to_string(v, ' ') AS passage, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS p FROM w
), k AS (
  SELECT *, 2.0::DOUBLE * len(list_intersect(p, b)) / (len(p) + len(b)) AS dice FROM v
), m AS (
  SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, s) AS place FROM k
)
SELECT doc_id, license, dice, bigrams, passage FROM d WHERE dice >= {threshold}
UNION ALL
SELECT l.doc_id, license, dice, len(p) AS bigrams, passage FROM m JOIN l USING (r) WHERE place = 1 AND dice >= {threshold} AND NOT list_contains(passages, passage)
"""

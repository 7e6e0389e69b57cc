"""Licence scan in DataFrame functions only: normalised text against licence templates.

Units of a document are its lines, its paragraphs (cut at blank lines), runs of 2 to RUN adjacent
paragraphs that have words, and the whole text. A unit is lower-cased (A-Z) and every run of other
characters than a-z and 0-9 becomes a space; units that are equal then count once. A unit's set
of word bigrams is held against each template's by Dice coefficient, 2 |A and B| / (|A| + |B|).
Only templates whose size allows the threshold are compared: Dice >= t needs |A| between
|B| t / (2 - t) and |B| (2 - t) / t. Units that share no bigram with any template leave before
that. All is done within a row: nothing is shuffled, so no document or line can be hot.

Defined cases: a null or empty text has no unit with a bigram and no licence. Among templates
of equal Dice the name that sorts first wins. Repeated rows are scanned each; only doc_id and
text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 80  # per cent
RUN = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public licence texts and the notices by which works refer to them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold against n."""
    return math.ceil(n * threshold / (200 - threshold)), n * (200 - threshold) // threshold


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " "))


def runs(parts: Column, least: int = 2, most: int = RUN) -> Column:
    """Texts of ``least`` to ``most`` adjacent parts."""
    size = F.size(parts)
    lengths = F.sequence(F.lit(least), F.lit(most))
    starts = lambda k: F.when(size >= k, F.sequence(F.lit(1), size - k + 1))
    of = lambda k: F.transform(starts(k), lambda i: F.array_join(F.slice(parts, i, k), " "))
    return F.when(size < least, F.array().cast("array<string>")).otherwise(F.flatten(F.array_compact(F.transform(lengths, of))))


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    # zip_with pads the shorter side with null, and concat_ws leaves the last word alone.
    return F.array_distinct(F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, license (best match or null), dice (its coefficient, 0 without one), n_matches (units
    that match a template), licenses (all names found, sorted)."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    known = [(name, grams, *size_bounds(len(grams), threshold)) for name, grams in known if grams]
    least, most = min(k[2] for k in known), max(k[3] for k in known)
    every = F.array(*[F.lit(g) for g in sorted({g for k in known for g in k[1]})])
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"), F.lit(a).alias("least"), F.lit(b).alias("most")) for name, grams, a, b in known])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.split(text, "\n[ \\t\\r]*\n").alias("paragraphs"))
    parts = F.filter(F.transform("paragraphs", normalised), lambda p: p != "")
    rows = rows.select("doc_id", "text", F.when(F.size("paragraphs") > 1, parts).otherwise(F.array().cast("array<string>")).alias("parts"))
    units = F.array_distinct(F.concat(F.transform(F.split("text", "\n"), normalised), "parts", runs(F.col("parts")), F.array(normalised(F.col("text")))))
    # More distinct words than a template allows bigrams: the bigrams need not be made.
    fits = lambda w: (F.size(w) <= most + 1) | (F.size(F.array_distinct(w)) <= most + 1)
    rows = rows.select("doc_id", F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: F.size(w) > least).alias("units"))
    rows = rows.select("doc_id", F.transform(F.filter("units", fits), bigrams).alias("units"))
    rows = rows.select("doc_id", F.filter("units", lambda b: F.size(b).between(least, most) & F.arrays_overlap(b, every)).alias("units"))

    def matches(b: Column) -> Column:
        fits = F.filter(table, lambda t: F.size(b).between(t["least"], t["most"]))
        shared = F.transform(fits, lambda t: F.struct(F.size(F.array_intersect(b, t["grams"])).alias("i"), (F.size(b) + t["n"]).alias("s"), t["name"].alias("name")))
        return F.filter(shared, lambda x: 200 * x["i"] >= threshold * x["s"])

    rows = rows.select("doc_id", F.filter(F.transform("units", matches), lambda m: F.size(m) > 0).alias("found"))
    best = F.array_min(F.transform(F.flatten("found"), lambda x: F.struct((-2.0 * x["i"] / x["s"]).alias("d"), x["name"].alias("name"))))
    return rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten("found"), lambda x: x["name"]))), ",").alias("licenses"),
        best.alias("best"),
    ).select("doc_id", F.col("best")["name"].alias("license"), F.coalesce(-F.col("best")["d"], F.lit(0.0)).alias("dice"), "n_matches", "licenses")


def oracle_sql(threshold: int = THRESHOLD) -> str:
    """The same by plain SQL: every unit against every template, without bounds."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    words = "regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + "'), '[a-z0-9]+')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH templates AS (SELECT name, {grams.format("w")} AS g FROM (SELECT name, {words.format("t")} AS w FROM (VALUES {values}) v(k, name, t))),
raw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, r, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda p: array_to_string({words.format("p")}, ' ')), lambda p: p <> '') AS p FROM raw),
units AS (SELECT DISTINCT doc_id, r, u FROM (
  SELECT doc_id, r, array_to_string({words.format("unnest(string_split(text, chr(10)))")}, ' ') AS u FROM raw
  UNION ALL SELECT doc_id, r, array_to_string(p[i : i + k - 1], ' ') FROM (SELECT *, unnest(range(1, len(p) - k + 2)) AS i FROM parts, range(1, {RUN + 1}) n(k) WHERE len(p) >= k)
  UNION ALL SELECT doc_id, r, array_to_string({words.format("text")}, ' ') FROM raw)),
grammed AS (SELECT doc_id, r, u, {grams.format("w")} AS g FROM (SELECT doc_id, r, u, string_split(u, ' ') AS w FROM units)),
pairs AS (SELECT doc_id, r, u, name, len(list_intersect(m.g, t.g)) AS i, len(m.g) + len(t.g) AS s FROM grammed m, templates t
  WHERE len(m.g) > 0 AND list_has_any(m.g, t.g)),
hits AS (SELECT doc_id, r, u, name, 2.0::DOUBLE * i / s AS dice FROM pairs WHERE 200 * i >= {threshold} * s),
sums AS (SELECT doc_id, r, max(dice) AS dice, count(DISTINCT u) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hits GROUP BY doc_id, r),
names AS (SELECT h.doc_id, h.r, min(h.name) AS license FROM hits h JOIN sums s ON h.r = s.r AND h.dice = s.dice GROUP BY h.doc_id, h.r)
SELECT raw.doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses
FROM raw LEFT JOIN sums USING (r) LEFT JOIN names USING (r)
"""

r"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters, digits and whatever else is neither ASCII punctuation nor white space, A-Z in lower case; a shingle is five
words. A text's shingles are cut into windows of `WINDOW`, a new one every `STEP`. Of each window and each template the
least value under `BANDS` hash functions is taken, a band being one function; a template is a candidate where any of its bands equals that of any
window.

How sure that is: a template of at least `WINDOW` shingles, four fifths of which occur in one stretch, has for each function its own
least shingle in the text with probability 0.8, and the window around it that lies within the stretch has the same least value: all
`BANDS` miss with probability 0.2 ** 32. The worst case is a template of one shingle, that is one of `WINDOW` in a window: a window
misses it with probability (1 - 1 / 4) ** 32 = 1e-4, and two windows hold it.

A band can only agree in a window that holds the shingle a template has its band value from. Texts with none of
these few shingles have no candidates, and are left out before windows are made, which changes no result (`prefilter` turns that off). All happens within a
text's own row: there is no shuffle. Templates are a parameter; a table of one row has their marks and band values, and is broadcast, for at most `MOST`
templates at a time: more are scanned for in several passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACES, bound, staged, table

SHINGLE, SIMILARITY = 5, 0.8
WINDOW, STEP, BANDS, MOST = 4, 2, 32, 1000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public license notices, the grants of public licenses and their warranty clauses (a text with the whole of a license has both).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
}


def scan_words(text: Column) -> Column:
    """The words of a text as license scans take them; a text without any: one empty string."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, LOWER + " " * len(PUNCTUATION))
    return F.split(F.btrim(plain, F.lit(SPACES)), SPACE)


def _each(words: Column, of) -> Column:
    """of(word, ..., word) for each run of SHINGLE words; fewer words: none."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
    found = F.transform(at, lambda i: of(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, found).otherwise(F.slice(found, 1, 0))


def shingle_hashes(words: Column) -> Column:
    return _each(words, F.xxhash64)


def shingle_texts(words: Column) -> Column:
    return _each(words, lambda *w: F.concat_ws(" ", *w))


def known_templates(spark: SparkSession, texts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The templates (license, shingles, n_shingles), and one row: marks, the shingles their bands come from; bands, the values of these; names, the
    templates of each value, in the same order."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, body string").withColumn("w", scan_words(F.col("body")))
    rows = staged(rows.select("license", "w", shingle_hashes(F.col("w")).alias("h")).filter(F.size("h") > 0))

    def least(b: int) -> Column:
        return F.array_min(F.transform("h", lambda x: F.struct(F.xxhash64(F.lit(b), x).alias("value"), x.alias("h"))))

    each = rows.select("license", F.inline(F.array(*map(least, range(BANDS)))))
    by = each.groupBy("value").agg(F.sort_array(F.collect_set("license")).alias("names"), F.min("h").alias("h")).withColumn("at", F.struct("value", "names"))
    # at most MOST * BANDS values
    one = by.agg(F.collect_set("h").alias("marks"), F.map_from_entries(F.sort_array(F.collect_list("at"))).alias("names")).withColumn("known", F.map_keys("names"))
    known = rows.select("license", F.array_distinct(shingle_texts(F.col("w"))).alias("shingles"))
    return known.withColumn("n_shingles", F.size("shingles").cast("long")), staged(one)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY, prefilter: bool = True) -> DataFrame:
    """docs: doc_id, text. A row for each row of docs and license found in it: doc_id, license, n_shared, n_shingles long, containment double,
    first_word, last_word long.

    containment: the share of the license's distinct shingles that occur in the text, `similarity` at least. first_word and last_word (from 0) are
    those of the first and of the last of the shingles shared. Null, empty and white texts and those of fewer than five words hold no license; repeated
    rows are scanned each; null doc_ids stay; other columns are neither read nor returned; an empty table gives an empty result.
    Templates of fewer than five words are never found.
    """
    given = sorted((TEMPLATES if templates is None else templates).items())
    if not given:
        return docs.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("license", "string"), ("n_shared", "long"), ("n_shingles", "long"), ("containment", "double"), ("first_word", "long"), ("last_word", "long")))).filter("false")
    passes = [_scan(docs, dict(given[k : k + MOST]), similarity, prefilter) for k in range(0, len(given), MOST)]
    return reduce(DataFrame.unionAll, passes)


def _scan(docs: DataFrame, templates: dict[str, str], similarity: float, prefilter: bool) -> DataFrame:
    known, one = known_templates(docs.sparkSession, templates)
    own = bound(bound(docs.select("doc_id", "text"), w=scan_words(F.col("text"))).drop("text"), h=shingle_hashes(F.col("w")))
    own = own.crossJoin(F.broadcast(one))  # one row
    own = own.filter(F.arrays_overlap("h", "marks")) if prefilter else own.filter(F.size("h") > 0)
    windows = F.transform(F.sequence(F.lit(1), F.size("h"), F.lit(STEP)), lambda i: F.slice("h", i, WINDOW))

    def band(b: int) -> Column:
        return F.transform("windows", lambda w: F.array_min(F.transform(w, lambda x: F.xxhash64(F.lit(b), x))))

    own = bound(own.drop("marks"), windows=windows)
    own = bound(own, bands=F.array_intersect(F.flatten(F.array(*map(band, range(BANDS)))), F.col("known"))).drop("windows", "known", "h")
    own = own.select("doc_id", "w", F.explode(F.array_distinct(F.flatten(F.transform("bands", lambda k: F.element_at("names", k))))).alias("license"))
    own = bound(own.join(F.broadcast(known), "license"), own=shingle_texts(F.col("w")))
    own = bound(own, n_shared=F.size(F.array_intersect("own", "shingles")).cast("long"))
    own = own.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= similarity)
    own = bound(own, at=F.transform("own", lambda s: F.array_contains(F.col("shingles"), s)))
    first = F.array_position("at", True) - 1
    last = F.size("at") - F.array_position(F.reverse("at"), True) + SHINGLE - 1
    return own.select("doc_id", "license", "n_shared", "n_shingles", "containment", first.cast("long").alias("first_word"), last.cast("long").alias("last_word"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_words(text: str) -> str:
    plain = f"translate(coalesce({text}, ''), {_quoted(UPPER + PUNCTUATION)}, {_quoted(LOWER + ' ' * len(PUNCTUATION))})"
    return f"list_filter(string_split_regex({plain}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


#: What op3_license_scan returns, in DuckDB's SQL: containment in all documents of all templates, without bands.
OP3_SQL = f"""
WITH t(license, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
tw AS (SELECT license, {_sql_words("body")} AS w FROM t),
ts AS (SELECT DISTINCT license, array_to_string(w[i + 1:i + 5], ' ') AS s FROM tw, unnest(range(len(w) - 4)) AS u(i)),
tn AS (SELECT license, count(*) AS n_shingles FROM ts GROUP BY license),
dw AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
ds AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM dw, unnest(range(greatest(len(w) - 4, 0))) AS u(i)),
m AS (SELECT doc_id, license, count(DISTINCT s) AS n_shared, min(i) AS first_word, max(i) + 4 AS last_word FROM ds JOIN ts USING (s) GROUP BY doc_id, license)
SELECT doc_id, license, n_shared, n_shingles, n_shared::DOUBLE / n_shingles AS containment, first_word, last_word FROM m JOIN tn USING (license) WHERE n_shared::DOUBLE / n_shingles >= {SIMILARITY}
"""

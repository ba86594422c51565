"""Licence scans, in built-in functions only.

A file is read in units: its sentences, its blocks (header comments and the like, between
blank lines) and the whole of it. A unit is a sparse TF-IDF vector, and so is each template, a short
statement or a licence's full text; their cosine is a join on terms. Inverse document
frequencies are those of the templates, so that a file's result depends on nothing but the
file; function words don't count. A bound that needs one look at a unit's words, and no join, tells
which units can reach ``LEAST`` with no template: those are left at once (``_may_match``).

A file's own licence is that of its best unit: one that matches a full text before one that
matches a statement, and any before the generic reservation of all rights. A licence file, by
its name, because the whole of it matches, or because statements make up at least half of it,
also sets the licence of its directory. Files without their own inherit from the nearest
directory above that has one: directories are joined with licence files on each of their
ancestor paths.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table, row_keys, scratch

LEAST = 0.6
#: Parts into which the files of one directory are dealt for the join with its licence.
SALTS = 16

#: Licence and a statement that stands for it; wordings of public licence notices.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
    *((f"CC-{k.upper()}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in (
        ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
        ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
    )),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((k, f"SPDX-License-Identifier: {k}") for k in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "BSL-1.0", "Unlicense", "CC0-1.0", "Zlib")),
)

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""


def _gnu(kind: str, version: str) -> str:
    what = f"GNU {kind}General Public License"
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {what} as published by the Free Software Foundation,
either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {what} for more details. You should have received a copy of the {what}
along with this program. If not, see https://www.gnu.org/licenses/."""


#: Licence and its full text, or the notice that its authors have files begin with.
FULL_TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_THIRD} {_AS_IS}"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-2.0", _gnu("", "2")),
    ("GPL-3.0", _gnu("", "3")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1")),
    ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("AGPL-3.0", _gnu("Affero ", "3")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that
recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software."""),
)

GENERIC = "Proprietary"
FILE_NAMES = r"^(licen[cs]e|copying|copyright|notice)([.-].*)?$"

#: Terms are words and numbers, versions whole; these words are none.
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
FUNCTION_WORDS = tuple("a all an and any are as at be by can do for from has if in into is it its not of on or out see shall so such that the this to under was we which will with you your".split())
def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in FUNCTION_WORDS]


def _weigh() -> tuple[list[tuple[int, str, bool, str, float, float]], float]:
    """(template, licence, full, term, weight, idf) of each term of each template, weights
    of a template being of length one; and the idf of terms that no template has."""
    every = [(name, False, t) for name, t in STATEMENTS] + [(name, True, t) for name, t in FULL_TEXTS]
    counts = [Counter(terms_of(t)) for _, _, t in every]
    seen = Counter(t for c in counts for t in c)
    idf = {t: log((len(every) + 1) / (n + 1)) + 1 for t, n in seen.items()}
    out = []
    for k, ((name, full, _), c) in enumerate(zip(every, counts)):
        weights = {t: n * idf[t] for t, n in c.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        out += [(k, name, full, t, w / norm, idf[t]) for t, w in sorted(weights.items())]
    return out, log(len(every) + 1) + 1


WEIGHTS, RARE = _weigh()


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*FUNCTION_WORDS))


def _known(terms: Column) -> Column:
    return F.filter(terms, lambda t: t.isin(*sorted({w[3] for w in WEIGHTS})))


def _may_match(text: Column) -> Column:
    """Whether a text's cosine to any template can reach LEAST. The product with a
    template is at most the sum, over the words as they occur, of idf times the most
    that any template gives the word; the text's length is at least the root of the
    sum of their idf squared."""
    most: dict[str, tuple[float, float]] = {}
    for _, _, _, term, weight, idf in WEIGHTS:
        most[term] = (max(idf * weight, most.get(term, (0.0, 0.0))[0]), idf * idf)
    table = lambda i: F.create_map(*[F.lit(x) for t, v in sorted(most.items()) for x in (t, v[i])])
    total = lambda known, i: F.aggregate(known, F.lit(0.0), lambda acc, t: acc + F.element_at(table(i), t))

    def test(terms: Column) -> Column:
        def of_known(known: Column) -> Column:
            product, squares = total(known, 0), total(known, 1) + (F.size(terms) - F.size(known)) * RARE**2
            return (F.size(known) > 0) & (product * product >= (LEAST - 0.01) ** 2 * squares)

        return _let(_known(terms), of_known)

    return F.coalesce(_let(_terms(text), test), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value worked out once for a body that uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _units(files: DataFrame) -> DataFrame:
    """(row, kind, pos, unit) of the sentences "s", blocks "b" and wholes "f" of files that
    may match a template."""
    some = files.select("row", "text").where(F.size(_known(_terms(F.col("text")))) > 0)
    sentences = F.split(F.regexp_replace("text", r"([.!?])[ \t\r]+", "$1\n"), "\n")
    blocks = F.split("text", r"\n[ \t\r]*\n")
    kind = lambda k, units: F.transform(units, lambda u, i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), F.btrim(u, F.lit(" \t\r\n")).alias("unit")))
    both = F.concat(kind("s", sentences), F.when(F.size(blocks) > 1, kind("b", blocks)).otherwise(F.array().cast("array<struct<kind:string,pos:int,unit:string>>")), kind("f", F.array("text")))
    return some.select("row", F.explode(both).alias("u")).select("row", "u.*").where(_may_match(F.col("unit")))


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "template int, license string, full boolean, term string, weight double, idf double")


def match_units(units: DataFrame) -> DataFrame:
    """(unit, license, full, score) of each distinct unit whose best cosine to a template
    is at least LEAST: full texts first, then what isn't GENERIC, then by score, then by
    name."""
    templates = _templates(units.sparkSession)  # some thousand rows, fixed
    tf = units.select("unit").distinct().select("unit", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit", "term").agg(F.count("*").cast("double").alias("tf"))
    idf = templates.select("term", "idf").distinct()
    vectors = tf.join(F.broadcast(idf), "term", "left").select("unit", "term", (F.col("tf") * F.coalesce("idf", F.lit(RARE))).alias("w"))
    vectors = materialize(vectors, "license-vectors")
    length = vectors.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.join(F.broadcast(templates.drop("idf")), "term").groupBy("unit", "template", "license", "full").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(length, "unit").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= LEAST)
    best = scored.groupBy("unit").agg(F.min(_rank()).alias("best"))
    return best.select("unit", *_unranked("best"))


def _rank() -> Column:
    return F.struct((F.col("license") == GENERIC).alias("generic"), (~F.col("full")).alias("short"), (-F.col("score")).alias("low"), F.col("license").alias("name"))


def _unranked(rank: str) -> list[Column]:
    return [F.col(f"{rank}.name").alias("license"), (~F.col(f"{rank}.short")).alias("full"), (-F.col(f"{rank}.low")).alias("score")]


def scan(files: DataFrame) -> DataFrame:
    """One row per row of files (row, path, text): row, path, n_statements,
    own_license, own_score, license_file, license, inherited_from.

    row tells files apart and must not be null; rows that share it are one file twice.
    Null and empty texts have no unit, null paths lie at the top. Equal scores go to the
    licence first by name. Other columns are ignored; an empty table gives an empty
    result.
    """
    files = files.select("row", F.coalesce("path", F.lit("")).alias("path"), "text")
    with scratch(files.sparkSession, "license-files"):
        found = materialize(_units(files).dropDuplicates(["row", "kind", "pos"]), "license-units")
        named = materialize(match_units(found), "license-named")
        statement = F.col("kind") == "s"
        own = (
            found.join(named, "unit")
            .groupBy("row")
            .agg(
                F.count_if(statement).alias("n_statements"), F.min(_rank()).alias("best"), F.sum(F.when(statement, F.length("unit")).otherwise(0)).alias("covered"),
                F.max((F.col("kind") == "f") & (F.col("license") != GENERIC)).alias("whole"),
            )
            .select("row", "n_statements", "covered", "whole", *[c.alias(f"own_{n}") for n, c in zip(("license", "full", "score"), _unranked("best"))])
        )
        slash = F.instr(F.reverse("path"), "/")
        folder = F.when(slash == 0, F.lit("")).otherwise(F.substring("path", F.lit(1), F.length("path") - slash))
        base = F.lower(F.substring_index("path", "/", -1))
        listed = files.select("row", "path", folder.alias("folder"), base.alias("base"), F.length("text").alias("n"))
        by_name = F.rlike("base", F.lit(FILE_NAMES))
        marked = materialize(
            listed.join(own, "row", "left").select(
                "row", "path", "folder", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"), "own_license", "own_score", "own_full",
                (F.col("own_license").isNotNull() & (by_name | F.col("whole") | (F.col("covered") * 2 >= F.col("n")))).alias("license_file"),
            ), "license-files",
        )
    # Per directory, the licence of its best licence file.
    rank = F.struct((F.col("own_license") == GENERIC).alias("generic"), (~F.col("own_full")).alias("short"), (-F.col("own_score")).alias("low"), F.col("own_license").alias("name"))
    holders = marked.where("license_file").groupBy(F.col("folder").alias("above")).agg(F.min(rank).alias("best")).select("above", F.col("best.name").alias("folder_license"))
    # Every directory once, with all its ancestors and how deep they lie.
    folders = marked.select("folder").distinct()
    parts = F.split("folder", "/")
    chain = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "above"))
    nearest = chain.distinct().join(holders, "above").groupBy("folder").agg(F.max_by(F.struct("above", "folder_license"), F.col("depth")).alias("from"))
    # A directory may hold a third of all files: both sides are salted, the files by row.
    spread = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return marked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(spread, ["folder", "salt"], "left").select(
        "row", "path", "n_statements", "own_license", "own_score", "license_file",
        F.coalesce("own_license", "from.folder_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from.above")).alias("inherited_from"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id, those without a doc_id too."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    files = docs.select(F.struct(*row_keys(F.col("source"), F.col("lang")), F.col("doc_id").cast("long").alias("doc_id")).alias("row"), path.alias("path"), "text")
    return scan(files).select(F.col("row.doc_id").alias("doc_id"), "path", "n_statements", "own_license", "own_score", "license_file", "license", "inherited_from")


def _sql_rows() -> str:
    return ", ".join(f"({k}, '{name}', {str(full).lower()}, '{term}', {weight!r}, {idf!r})" for k, name, full, term, weight, idf in WEIGHTS)


_SQL_TERMS = "list_filter(regexp_extract_all(lower({0}), '" + TERM + "'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + "))"

ORACLE_SQL = rf"""
WITH templates AS (SELECT * FROM (VALUES {_sql_rows()}) v(template, license, "full", term, weight, idf)),
files AS (
  SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path,
    coalesce(source, '') || '/' || coalesce(lang, '') AS folder
  FROM documents
), parts AS (
  SELECT rid, 's' AS kind, unnest(string_split(regexp_replace(text, '([.!?])[ 	
]+', '' || chr(10), 'g'), chr(10))) AS unit FROM files
  UNION ALL SELECT rid, 'b', unnest(string_split_regex(text, '
[ 	
]*
')) FROM files WHERE regexp_matches(text, '
[ 	
]*
')
  UNION ALL SELECT rid, 'f', text FROM files
), units AS (SELECT rid, kind, trim(unit, ' ' || chr(9) || chr(13) || chr(10)) AS unit FROM parts WHERE unit IS NOT NULL),
tf AS (SELECT unit, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT unit, unnest({_SQL_TERMS.format("unit")}) AS term FROM (SELECT DISTINCT unit FROM units)) GROUP BY 1, 2),
vectors AS (SELECT unit, term, tf * coalesce(idf, {RARE!r}) AS w FROM tf LEFT JOIN (SELECT DISTINCT term, idf FROM templates) USING (term)),
length_ AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY 1),
scored AS (
  SELECT unit, license, "full", round(dot / norm, 6) AS score FROM (SELECT unit, template, license, "full", sum(w * weight) AS dot FROM vectors JOIN templates USING (term) GROUP BY 1, 2, 3, 4)
  JOIN length_ USING (unit)
), named AS (
  SELECT unit, license, "full", score FROM scored WHERE score >= {LEAST!r}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY license = '{GENERIC}', "full" DESC, score DESC, license) = 1
), hits AS (SELECT rid, kind, unit, license, "full", score FROM units JOIN named USING (unit)),
own AS (
  SELECT rid, count(*) FILTER (kind = 's') AS n_statements, coalesce(sum(length(unit)) FILTER (kind = 's'), 0) AS covered, bool_or(kind = 'f' AND license <> '{GENERIC}') AS whole FROM hits GROUP BY 1
), best AS (
  SELECT rid, license AS own_license, "full" AS own_full, score AS own_score FROM hits
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY license = '{GENERIC}', "full" DESC, score DESC, license) = 1
), marked AS (
  SELECT f.rid, doc_id, path, folder, coalesce(n_statements, 0) AS n_statements, own_license, own_full, own_score,
    own_license IS NOT NULL AND (regexp_matches(lower(coalesce(CAST(doc_id AS VARCHAR), '')), '{FILE_NAMES}') OR whole OR covered * 2 >= length(text)) AS license_file
  FROM files f LEFT JOIN own USING (rid) LEFT JOIN best USING (rid)
), holders AS (
  SELECT folder AS above, own_license AS folder_license FROM marked WHERE license_file
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY own_license = '{GENERIC}', own_full DESC, own_score DESC, own_license) = 1
), nearest AS (
  SELECT c.folder, c.above, folder_license FROM (
    SELECT DISTINCT folder, depth, array_to_string(list_slice(string_split(folder, '/'), 1, depth), '/') AS above
    FROM (SELECT folder, unnest(generate_series(0, len(string_split(folder, '/')))) AS depth FROM (SELECT DISTINCT folder FROM marked))
  ) c JOIN holders USING (above) QUALIFY row_number() OVER (PARTITION BY c.folder ORDER BY depth DESC) = 1
)
SELECT doc_id, path, CAST(n_statements AS BIGINT) AS n_statements, own_license, own_score, license_file,
  coalesce(own_license, folder_license) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM marked LEFT JOIN nearest USING (folder)
"""

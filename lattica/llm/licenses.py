"""License scan by canonical digests.

A text and each of its lines are brought into a canonical form: copyright lines go, letters are lower-cased,
everything but letters and digits becomes one space, and equivalent spellings become one. The SHA-256
of that form is joined with those of known licenses and notices, a table of fixed size that is broadcast.
Only DataFrame functions are used; only documents with a hit are shuffled.

Defined cases: a null text is empty; a text without letters or digits has the digest of the empty text and
no license. Rows that repeat an id share the licenses found in any of them. Null ids are their own group.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import fresh, whole_text

#: Lines that say whose copyright it is, and no more.
COPYRIGHT_LINE = r"(?i)copyright\s*(?:\(c\)|©|[0-9])|©\s*[0-9]|^[^a-z0-9]*all rights reserved[^a-z0-9]*$"

#: Equivalent spellings, in canonical form.
SPELLINGS = [
    ("licences", "licenses"), ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"), ("initialise", "initialize"),
    ("programme", "program"), ("whilst", "while"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"), ("https", "http"),
]

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = _PERMISSION + "\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _MIT_AS_IS
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: License texts and usual notices, without copyright lines; each with its public identifier.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_AS_IS),
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_AS_IS])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS])),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("LicenseRef-Proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
]


def _lines(text: Column) -> Column:
    """The text's lines without copyright lines."""
    return F.filter(F.split(text, "\n"), lambda line: ~line.rlike(COPYRIGHT_LINE))


def _canonical(text: Column) -> Column:
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    spelled = plain
    for old, new in SPELLINGS:
        spelled = F.replace(spelled, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.when(plain.rlike(" (?:" + "|".join(old for old, _ in SPELLINGS) + ") "), spelled).otherwise(plain))


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the canonical form of a text."""
    return F.sha2(_canonical(F.array_join(_lines(text), "\n")), 256)


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: one row for each known text or notice, a table of fixed size."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known or KNOWN]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("k")).select("k.license", canonical_digest(F.col("k.text")).alias("digest"))
    return table.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a document: id, digest of the whole text, license_id of the whole text (null: none known), notices (licenses named by a line of their own, sorted, comma-separated; null: none)."""
    spark = docs.sparkSession
    i = fresh(docs, "scan_id")
    text = whole_text(text_col)
    table = known_digests(spark, known)
    lines = docs.select(F.col(id_col).alias(i), F.explode(_lines(text)).alias("line")).where("line <> ''")
    # fixed size: one row for each known text
    hits = lines.select(i, F.sha2(_canonical(F.col("line")), 256).alias("digest")).join(F.broadcast(table), "digest")
    notices = hits.select(i, "license").groupBy(i).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    whole = docs.select(F.col(id_col), canonical_digest(text).alias("digest"))
    named = whole.join(F.broadcast(table.withColumnRenamed("license", "license_id")), "digest", "left")
    return named.join(notices, named[id_col].eqNullSafe(notices[i]), "left").select(id_col, "digest", "license_id", "notices")


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def oracle_sql() -> str:
    """The scan of documents in DuckDB SQL."""
    lines = f"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, {_sql(COPYRIGHT_LINE)}))"
    known = ", ".join(f"({_sql(name)}, {_sql(text)})" for name, text in KNOWN)
    return f"""
        WITH known AS (SELECT min(license) AS license, sha256({_sql_canonical("array_to_string(" + lines + ", chr(10))")}) AS digest FROM (VALUES {known}) AS k(license, text) GROUP BY 2),
        whole AS (SELECT doc_id, sha256({_sql_canonical("array_to_string(" + lines + ", chr(10))")}) AS digest FROM documents),
        line AS (SELECT doc_id, unnest({lines}) AS line FROM documents),
        notice AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM line JOIN known ON sha256({_sql_canonical("line")}) = digest WHERE line <> '' GROUP BY 1)
        SELECT doc_id, whole.digest, license AS license_id, notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN notice USING (doc_id)"""

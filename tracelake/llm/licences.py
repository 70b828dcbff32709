"""Licence scanning by canonical digests, in DataFrame functions only.

A text is normalised (lower case; copyright lines gone; British and other equivalent spellings
made one; punctuation and white space one blank) and hashed.  Whole texts, and each line on its own
(notices stand in a line), are hash-joined to the digests of known licences by the same rules, so
any rendering of a licence that differs only in those respects is found, and nothing else.

Distribution: normalising and hashing are a map; the join is on digests.  The catalogue is
broadcast only below a checked number of rows.  A hot digest joins to the one row the catalogue
has for it.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Catalogues are broadcast up to this many rows, else joined with a shuffle.
BROADCAST_LICENCES = 20_000

#: A line that names a copyright holder, or reserves all rights.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[\x20\t]*(?:\(c\)|©|[0-9]{4}|[<\[]year)|©|\(c\)[\x20\t]*[0-9]{4}|all rights reserved)[^\n]*$"
SIGNS = r"[^\p{L}\p{N}\n]+"
#: Spellings that licence matching takes as equal, after signs have become blanks.
#: They stand for whole words, with or without an s at the end.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Short licences and notices.  Longer ones come in a catalogue of the caller's.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)


#: Texts without any of these words keep their spelling.
_SPELT = r"(?:^|[ \n])(?:" + "|".join(other for other, _ in SPELLINGS) + r")s?(?:$|[ \n])"


def _one(other: str) -> str:
    return rf"(^|[ \n]){other.replace(' ', '  ')}(s?)($|[ \n])"


def normalised(text: Column) -> Column:
    """Normal form of each line; lines stay apart, and may have blanks at their ends."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    x = F.regexp_replace(x, SIGNS, " ")
    # Blanks are doubled, so that each of two words side by side has its own around it
    spelt = F.replace(F.replace(x, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n "))
    for other, one in SPELLINGS:
        spelt = F.regexp_replace(spelt, _one(other), f"$1{one}$2$3")
    return F.when(x.rlike(_SPELT), F.regexp_replace(spelt, " +", " ")).otherwise(x)


def plain_digest(text: str) -> str:
    """:func:`digest` of one text, in Python."""
    x = regex.sub(SIGNS, " ", regex.sub(COPYRIGHT_LINE, "", text.lower()))
    spelt = regex.search(_SPELT, x) is not None
    x = x.replace(" ", "  ").replace("\n", " \n ")
    for other, one in SPELLINGS if spelt else ():
        x = regex.sub(_one(other), rf"\g<1>{one}\g<2>\g<3>", x)
    return hashlib.sha256(regex.sub(r"[ \n]+", " ", x).strip(" ").encode()).hexdigest()


def _whole(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \n]+", " "))


def digest(text: Column) -> Column:
    """Digest of the normal form of a whole text."""
    return F.sha2(_whole(normalised(text)), 256)


def catalogue(spark: SparkSession, licences: DataFrame | None = None) -> DataFrame:
    """One row a digest: digest, license_id (the first by name if several have that text)."""
    licences = spark.createDataFrame([*KNOWN], "license_id string, text string") if licences is None else licences
    known = licences.where("license_id is not null and text is not null").select(digest(F.col("text")).alias("digest"), "license_id")
    empty = F.sha2(F.lit(""), 256)
    return known.where(F.col("digest") != empty).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, licences: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What whole texts and their lines are: doc_id, line_no, digest, license_id.

    Line 0 is the whole text; every row of ``df`` has one, its license_id null unless the whole
    text is a known licence.  Lines (from 1) are listed only where they are known.  Null texts are
    empty; empty texts are no licence.  Each of repeated rows has its own rows; an empty table
    gives an empty result.
    """
    known = catalogue(df.sparkSession, licences)
    if licences is None or licences.limit(BROADCAST_LICENCES + 1).count() <= BROADCAST_LICENCES:
        known = F.broadcast(known)
    normal = df.select(F.col(key).alias("doc_id"), normalised(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    whole = F.array(F.struct(F.lit(0).alias("line_no"), _whole(F.col("x")).alias("own")))
    lines = F.transform(F.split("x", "\n"), lambda s, i: F.struct((i + 1).alias("line_no"), F.trim(s).alias("own")))
    parts = normal.select("doc_id", F.inline(F.concat(whole, F.filter(lines, lambda s: s["own"] != "")))).select("doc_id", "line_no", F.sha2("own", 256).alias("digest"))
    found = parts.join(known, "digest", "left").where("license_id is not null or line_no = 0")
    return found.select("doc_id", "line_no", "digest", "license_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(licences: list[tuple[str, str]] = KNOWN) -> str:
    """:func:`scan` over ``documents`` with the given licences, for DuckDB; their digests are worked
    out here."""
    x = f"regexp_replace(lower(coalesce(text, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    x = f"regexp_replace({x}, {_quoted(SIGNS)}, ' ', 'g')"
    x = f"replace(replace({x}, ' ', '  '), chr(10), ' ' || chr(10) || ' ')"
    for other, one in SPELLINGS:
        x = f"regexp_replace({x}, {_quoted(_one(other))}, '\\1{one}\\2\\3', 'g')"
    known: dict[str, str] = {}
    for k, t in licences:
        d = plain_digest(t)
        known[d] = min(k, known.get(d, k))
    values = ", ".join(f"('{d}', {_quoted(k)})" for d, k in known.items())
    return f"""
with known(digest, license_id) as (values {values}),
normal as (select doc_id, {x} as x from documents),
lines as (select doc_id, string_split(x, chr(10)) as l from normal),
parts as (
  select doc_id, 0 as line_no, trim(regexp_replace(x, '[ \\n]+', ' ', 'g'), ' ') as own from normal
  union all
  select doc_id, i as line_no, trim(regexp_replace(l[i], ' +', ' ', 'g'), ' ') as own from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from lines) where trim(l[i], ' ') != ''
)
select doc_id, cast(line_no as integer) as line_no, sha256(own) as digest, license_id
from parts left join known on sha256(parts.own) = known.digest
where license_id is not null or line_no = 0
"""

"""Licence scan by canonical digests.

A text is brought to a canonical form: letters A-Z in lower case, lines with a copyright
notice or "all rights reserved" taken out, equivalent spellings made one, and every run of
punctuation and white space one space. A line that begins with "copyright" is a notice if
it has a year or a copyright sign, or else if what follows may be a holder: "copyright
notice", "copyright holders" and the like are body text that was wrapped there. In whole
texts spellings are also made one across line breaks. The digest of the whole text, and that of each of
its lines, is hash-joined to the digests of known licence texts and notices in the same
form. The known table is fixed and small, so it is broadcast and no document is shuffled.

Built from DataFrame functions only. Defined results: a null or empty text, or one that is
nothing but copyright lines, matches nothing; a repeated row is found each time; ``doc_id``
may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import texts

# fixed values: equivalent spellings, the form on the right is kept
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("https://", "http://"),
    ("merchantibility", "merchantability"),
    ("&", " and "),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BODY = r"(notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|claims?|and|or)"
LEAD = r"^[ \t#*/;-]*"
DATED = r"copyright[^\n]*(\b[0-9]{4}\b|\(c\)|©)"
MARKED = r"\(c\)|©|all rights reserved"
NOTICE_LINE = rf"(?m){LEAD}({DATED}|copyright(?!\w)(?![ \t]*$)(?![ \t]+{BODY}\b(?!:))|{MARKED})[^\n]*$"
BREAKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’–—…©®]+"

# fixed values: names and the short texts of common licences
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"),
    **{
        f"CC-{kind}-{v}": (f"CC {kind} {v}", f"CC-{kind}-{v}", f"Creative Commons {kind} {v}")
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
        for v in ("3.0", "4.0")
    },
}
PHRASES = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "Distributed under the {}",
    "This project is licensed under the {}", "This software is licensed under the {}",
    "This program is licensed under the {}", "License: {}", "SPDX-License-Identifier: {}",
    "Published under the {}", "Available under the {}",
)
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n{}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n" + WARRANTY
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": BSD.format(""),
    "BSD-3-Clause": BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.\n"
    ),
}


def registry() -> list[tuple[str, str]]:
    """(licence, text) of every known notice and full text; a full text with and without its title."""
    notices = [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    full = [(k, t) for k, text in TEXTS.items() for t in (text, *(f"{n}\n{text}" for n in NAMES[k]))]
    return notices + full


def canonical(text: Column) -> Column:
    """The canonical form, lines kept apart by newlines."""
    form = F.translate(text, UPPER, LOWER)
    form = F.regexp_replace(form, NOTICE_LINE, "")
    for a, b in SPELLINGS:
        form = F.replace(form, F.lit(a), F.lit(b))
    return F.regexp_replace(form, BREAKS, " ")


def whole(form: Column) -> Column:
    form = F.regexp_replace(form, r"[ \n]+", " ")
    for a, b in SPELLINGS:
        if " " in a or "-" in a:
            form = F.replace(form, F.lit(a.replace("-", " ")), F.lit(b))
    return F.trim(form)


def known(spark: SparkSession) -> DataFrame:
    """``(digest, licence, size)`` of the registry; of licences with one form the first by name."""
    rows = spark.createDataFrame(registry(), "licence string, text string")
    form = rows.select("licence", whole(canonical(F.col("text"))).alias("form"))
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(
        F.min("licence").alias("licence"), F.max(F.length("form")).alias("size")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, place, licence)`` of every match: place 0 is the whole text, else the line's number."""
    spark = docs.sparkSession
    table = known(spark)
    size = table.agg(F.min("size"), F.max("size")).first()
    form = texts(docs, id_col, text_col).select("doc_id", canonical(F.col("text")).alias("form"))
    parts = form.select(
        "doc_id", F.posexplode(F.concat(F.array(whole(F.col("form"))), F.split("form", "\n", -1))).alias("place", "line")
    ).withColumn("line", F.trim("line"))
    # only a text as long as some known one can match
    able = parts.filter(F.length("line").between(size[0], size[1]))
    return (
        able.withColumn("digest", F.sha2("line", 256))
        .join(F.broadcast(table.select("digest", "licence")), "digest")  # a few hundred fixed rows
        .select("doc_id", F.col("place").cast("long").alias("place"), "licence")
    )


def oracle() -> str:
    """The scan as DuckDB SQL, whose regular expressions cannot look ahead: the notice rule is
    three tests of a line there. It does not know texts that are wrapped before "copyright" or
    within a spelling."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"translate(text, {lit(UPPER)}, {lit(LOWER)})"
    named = lit(LEAD + r"copyright(\W|$)"), lit(LEAD + r"copyright[ \t]*$"), lit(LEAD + rf"copyright[ \t]+{BODY}($|[^\w:])")
    notice = f"regexp_matches(x, {lit(rf'{LEAD}({DATED}|{MARKED})')}) OR (regexp_matches(x, {named[0]})"
    notice += f" AND NOT regexp_matches(x, {named[1]}) AND NOT regexp_matches(x, {named[2]}))"
    form = f"array_to_string([CASE WHEN {notice} THEN '' ELSE x END FOR x IN string_split({form}, chr(10))], chr(10))"
    for a, b in SPELLINGS:
        form = f"replace({form}, {lit(a)}, {lit(b)})"
    form = f"regexp_replace({form}, {lit(BREAKS)}, ' ', 'g')"
    one = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in registry())
    return f"""
WITH registry(licence, text) AS (VALUES {values}),
known AS (SELECT form, min(licence) AS licence FROM (SELECT licence, {one(form)} AS form FROM registry) GROUP BY form),
docs AS (SELECT doc_id, {form} AS form FROM documents),
parts AS (
  SELECT doc_id, 0 AS place, {one("form")} AS line FROM docs
  UNION ALL
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS place, trim(unnest(lines)) AS line
  FROM (SELECT doc_id, string_split(form, chr(10)) AS lines FROM docs)
)
SELECT doc_id, place, licence FROM parts JOIN known ON line = form
"""

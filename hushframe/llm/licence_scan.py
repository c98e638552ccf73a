"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings do not matter), and the
digest of the whole text and that of each of its lines are hash-joined with the digests of known licence texts and notices.

Only DataFrame functions are used. The broadcast side is the fixed table below.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.licence_texts import TEXTS

# Licence names with their texts or notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
]
# Title lines that stand before a text, and numbers before its points.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"],
}
_POINT = re.compile(r"(?m)^[ \t]*[0-9]\.[ \t]+(?=Redistributions|Neither)")
#: What a text's file has before its first words without the title, and behind its last words as a guide to use.
_HEAD = re.compile(r"(?s)\A.*?(?=TERMS AND CONDITIONS FOR USE|Everyone is permitted|Preamble\n|1\. Definitions|CREATIVE COMMONS CORPORATION)")
_GUIDE = re.compile(r"(?s)(END OF TERMS AND CONDITIONS).*\Z")


def _forms(licence: str, text: str) -> set[str]:
    """A whole text with and without its title, its guide to use and the numbers of its points."""
    bare = {text, _POINT.sub("", text), _HEAD.sub("", text)}
    bare |= {_GUIDE.sub(r"\1", t) for t in bare}
    return bare | {f"{title}\n\n{t}" for title in _TITLES.get(licence, []) for t in bare}


KNOWN += [(licence, form) for licence, text in [*((n, t) for n, t in KNOWN if len(t) > 500), *TEXTS] for form in sorted(_forms(licence, text)) if (licence, form) not in KNOWN]
# Spellings that count as equal, the first as the second.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil ", "fulfill "), ("judgement", "judgment"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("organisation", "organization"), ("share-alike", "sharealike"), ("whilst", "while"), ("&", " and "), ("http:", "https:"), ("neighbouring", "neighboring"),
]
#: A copyright line, in lower case.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"
#: A copyright statement, in lower case: behind comment marks, and up to the licence if its line goes on with one. COPYRIGHT, for SQL without lookahead, cuts the line.
STATEMENT = (
    r"(?m)^[^\p{L}\p{N}\n]*?(?:copyright\b(?![ \t]+(?:holder|owner|notice|law|licen[sc]e|interest|statement|and\b|or\b))|\(c\)|©|all rights reserved)[^\n]*?"
    r"(?=\b(?:permission (?:is hereby granted|to use)|licen[sc]ed under|released under|redistribution and use|this (?:work|source code form) is|to the extent possible)\b|$)"
)


def canonical(text: Column) -> Column:
    """Canonical form of a text; lines stay apart."""
    out = F.regexp_replace(F.lower(text), STATEMENT, "")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def joined(canonical_text: Column) -> Column:
    """A canonical text as one line."""
    return F.trim(F.regexp_replace(canonical_text, r"[ \n]+", " "))


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, licences (names in order, comma-joined, empty if none), n_lines (lines that are a
    known text), whole (the whole text is one).

    Null and empty texts have none. Rows that repeat a doc_id count as one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known, "licence string, known string").select("licence", F.sha2(joined(canonical(F.col("known"))), 256).alias("digest")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("form"))
    lines = F.transform(F.split("form", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(F.trim(x), 256).alias("digest")))
    units = ids.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.sha2(joined(F.col("form")), 256).alias("digest"))), lines)).alias("u")).select("doc_id", "u.whole", "u.digest")
    hits = units.join(F.broadcast(table), "digest").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("found"), F.count_if(~F.col("whole")).alias("n"), F.max("whole").alias("all"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return own.join(hits.withColumnRenamed("doc_id", "__doc"), F.col("doc_id").eqNullSafe(F.col("__doc")), "left").select("doc_id", F.coalesce("found", F.lit("")).alias("licences"), F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("all", F.lit(False)).alias("whole"))

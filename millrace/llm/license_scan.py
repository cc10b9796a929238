"""License scans by canonical digests. DataFrame functions only.

A text is made canonical: lower case, lines that claim copyright left out, equivalent spellings made one, everything
but letters and digits turned into single spaces. The SHA-256 of the canonical text is joined with the digests of known
licence texts, made by the same function. Whole licences lie in licenses/, and are known in several forms: under their
usual titles, with and without what follows their terms, numbered and not, wrapped, a line a paragraph, and in one line.

Notices amid prose are found by the same join: known texts of at most NOTICE_WORDS words give their first two words and
their number of words, and wherever a text has those two words, the words from there on are digested too, however they are
wrapped or marked as comments. Tags of the form "SPDX-License-Identifier: .." are reported as they stand.

Defined results: a null text has a null digest and no licence; a text without letters or digits has the digest of the
empty string and no licence; copies get equal results; known texts that are equal in canonical form are reported under
the smallest name; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import sized_join, written

# Known notices and short licence texts, in the public wording.
KNOWN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: Titles that whole licences may stand under, besides those in their texts.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License"],
}
END = "END OF TERMS AND CONDITIONS"
# Spellings that count as equal, after lower-casing.
EQUIVALENT = [
    ("licence", "license"), ("licencing", "licensing"), ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("recognised", "recognized"), ("utilisation", "utilization"), ("favour", "favor"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
    ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https://", "http://"), ("&", " and "),
]
#: A line with one of these, without words like "notice", "holder" or "owner" near, claims copyright.
CLAIM = r"(^|\n)[ \t]*(?:\(c\)|©|copyright (?:\(c\)|©|[0-9]{4})|all rights reserved)[^\n]*"
#: The same for Java: at starts of lines alone, with a look at one character first.
CLAIM_JAVA = "(?md)^[ \\t]*+(?=[(©ca])" + CLAIM.removeprefix(r"(^|\n)[ \t]*")
#: Known texts of more words are looked up as whole texts only.
NOTICE_WORDS = 400
#: Fixed value: a tag, and what an expression of tags may be joined by.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?: (?:OR|AND|WITH) [A-Za-z0-9.+-]+){0,9})"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), CLAIM_JAVA, "")
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def _forms(text: str, titles: list[str]) -> set[str]:
    """The forms in which a whole licence is known."""
    ends = {text, text.split(END)[0], text[: text.find(END) + len(END)]} if END in text else {text}
    bodies = ends | {re.sub(r"(?m)^[ \t]*Copyright \[yyyy\].*\n", "", x) for x in ends}  # filled in, the line is a claim
    if titles:
        bodies |= {re.sub(r"(?m)^[ \t]*[0-9]\. ", "", x) for x in bodies}  # with bullets
    bodies |= {f"{title}\n\n{x}" for title in titles for x in bodies}
    paragraphs = {"\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", x)) for x in bodies}
    return bodies | paragraphs | {" ".join(x.split()) for x in bodies}


def whole() -> list[tuple[str, str]]:
    """(license_id, text) of the whole licences in all their forms."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("licenses").glob("*.txt"))} | {"MIT": KNOWN["MIT text"]}
    return [(f"{k} text", x) for k, v in texts.items() for x in sorted(_forms(v, TITLES.get(k, [])))]


def known(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(license_id, digest, n, head) of known texts: number of words, and the first two."""
    df = spark.createDataFrame(rows, "license_id string, body string").select("license_id", canonical(F.col("body")).alias("body"))
    words = F.split("body", " ")
    df = df.where("body <> ''").select("license_id", F.sha2("body", 256).alias("digest"), F.size(words).alias("n"), F.array_join(F.slice(words, 1, 2), " ").alias("head"))
    return df.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.first("n").alias("n"), F.first("head").alias("head"))


def let(value: Column, then) -> Column:
    """then(value), the value being made once."""
    return F.transform(F.array(value), then)[0]


def _windows(canon: Column, heads: dict[str, list[int]]) -> Column:
    """Digests of the runs of words that begin like a known notice and have as many words."""
    if not heads:
        return F.array().cast("array<string>")
    first = sorted({h.split(" ")[0] for h in heads})

    def at(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(first))

        def of(i: Column) -> Column:
            two, runs = F.array_join(F.slice(words, i + 1, F.lit(2)), " "), F.array().cast("array<int>")
            for head, sizes in heads.items():
                begins = two == head if " " in head else F.get(words, i) == head
                runs = F.concat(runs, F.when(begins, F.array(*map(F.lit, sizes))).otherwise(F.array().cast("array<int>")))
            return F.transform(F.filter(runs, lambda n: i + n <= F.size(words)), lambda n: F.sha2(F.array_join(F.slice(words, i + 1, n), " "), 256))

        return F.array_distinct(F.flatten(F.transform(places, of)))

    # most texts have none of the heads, and are spared the words
    some = reduce(Column.__or__, [F.contains(canon, F.lit(h)) for h in heads])
    return F.when(some, let(F.split(canon, " "), at)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text), notices (ids of what stands in the text, whole or in part), spdx
    (tags); both distinct, sorted, joined by commas. texts: known texts by id, instead of those known here."""
    spark = docs.sparkSession
    all_known = written(known(spark, list(texts.items()) if texts is not None else [*KNOWN.items(), *whole()]), "known")
    names = all_known.select("digest", "license_id")
    short = {x for x in texts} if texts is not None else set(KNOWN)
    heads: dict[str, list[int]] = {}
    for r in all_known.where(F.col("n") <= NOTICE_WORDS).select("license_id", "head", "n").distinct().orderBy("head", "n").collect():  # of known texts: given by the caller
        if r["license_id"] in short and r["n"] not in heads.setdefault(r["head"], []):
            heads[r["head"]].append(r["n"])
    found = let(canonical(F.col("text")), lambda c: F.struct(F.sha2(c, 256).alias("digest"), _windows(c, heads).alias("runs")))
    tags = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))), ",")
    each = docs.select("doc_id", found.alias("x"), F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), tags).alias("tags"))
    each = written(each.select("doc_id", "x.digest", "x.runs", "tags").withColumn("row", F.monotonically_increasing_id()), "digests")
    hits = each.select("row", F.explode("runs").alias("digest")).join(names, "digest")
    # notices of a document: no more than there are known texts
    hits = written(hits.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("ids")), "notices")
    out = sized_join(sized_join(each.drop("runs"), names, "digest"), hits, "row")
    return out.select("doc_id", "digest", "license_id", F.coalesce("ids", F.lit("")).alias("notices"), F.coalesce("tags", F.lit("")).alias("spdx"))

"""Licence scan by canonical digest.

A text is brought to a canonical form: ASCII letters in lower case, copyright lines gone
(a line that begins with the word and a sign or, within five words, a year, or with a sign
and a year; not one that merely begins with the word, as wrapped licence texts have),
every run of characters other than letters and digits one space, and equivalent spellings
one word. Texts whose whole canonical form has the digest (SHA-256) of a known licence
are that licence; nothing is searched inside a text. The units are whole documents and
each of their lines, so a notice that stands as a line of its own is found as an entire
text. Only units of a known canonical length are digested, which loses none.

The list of known texts is a fixed table of the library (or one passed in) and is
broadcast. Defined cases: null and empty texts match nothing; a document's licences are
distinct and sorted; every row is matched by its own text, whatever rows share its doc_id
or have none, so a namesake's licence is never taken over; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the same meaning in licence texts.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "organisation": "organization", "organisations": "organizations", "authorised": "authorized",
    "acknowledgement": "acknowledgment", "favour": "favor", "honour": "honor", "behaviour": "behavior",
    "whilst": "while", "wilful": "willful", "noninfringement": "non infringement", "https": "http",
    "per cent": "percent",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known licence texts and notices (licence, text).
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)



def _full_texts() -> tuple:
    """(licence, text) of the whole texts beside this file; a BSD text also follows "All rights reserved."."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").iterdir()):
        name, text = path.name.removesuffix(".regents"), path.read_text(encoding="utf-8")
        out.append((name, text))
        if name.startswith("BSD"):
            out.append((name, "All rights reserved.\n\n" + text))
    return tuple(out)


#: The fixed list of this library: ``KNOWN``, and whole texts of common licences.
ALL = KNOWN + _full_texts()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGN, _YEAR = r"(\(c\)|©)", r"(19|20)\d\d(?!\d)"
_COPYRIGHT = (
    rf"(?m)^[^\p{{L}}\p{{N}}\n]*?(copyright[^\p{{L}}\p{{N}}\n]*?({_SIGN}|([\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}\n]+){{0,4}}{_YEAR})"
    rf"|{_SIGN}[^\p{{L}}\p{{N}}\n]*{_YEAR})[^\n]*$"
)
_OTHER = r"[^\p{L}\p{N}]+"


def plain(text: Column) -> Column:
    """Canonical form but for spellings."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, F.lit(_COPYRIGHT), F.lit(" ")), F.lit(_OTHER), F.lit(" ")))


def respelt(text: Column) -> Column:
    """One spelling for equivalent words of a plain text."""
    for word, other in SPELLINGS.items():
        text = F.regexp_replace(text, F.lit(rf"\b{word}\b"), F.lit(other))
    return text


def longest_plain(canonical: int) -> int:
    """Most characters of a plain text that spelling brings to ``canonical`` characters: every
    spelling may have shortened it by as much as the one that shortens most."""
    shorter = max([len(word) - len(other) for word, other in SPELLINGS.items()] + [0])
    return canonical + shorter * (canonical // min(map(len, SPELLINGS.values())) + 1)


def known_digests(spark: SparkSession, known=ALL) -> DataFrame:
    """(license, canonical, digest) of the known texts."""
    table = spark.createDataFrame(list(known), "license string, text string")
    canonical = table.select("license", respelt(plain(F.col("text"))).alias("canonical"))
    return canonical.groupBy("canonical").agg(F.min("license").alias("license")).withColumn("digest", F.sha2("canonical", 256))


def license_scan(docs: DataFrame, known=ALL) -> DataFrame:
    """Per row of ``docs``: doc_id, license (of the whole text), line_licenses, n_lines."""
    spark = docs.sparkSession
    table = known_digests(spark, known)
    listed = table.select(F.length("canonical"), F.substring_index("canonical", " ", 2)).collect()  # the library's own list
    lengths, openings = sorted({r[0] for r in listed}), sorted({r[1] for r in listed})
    longest = longest_plain(max(lengths, default=0))
    table = F.broadcast(table.select("license", "digest"))
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a plain text that spelling makes a known one is no longer than this
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    units = texts.select("_row", "doc_id", F.explode(F.concat(
        F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), plain(x).alias("unit"))),
        F.array(F.struct(F.lit(True).alias("whole"), plain(F.col("text")).alias("unit"))),
    )).alias("u")).select("_row", "doc_id", "u.*")
    # spelling works word by word and joins two at most, so the first two come from the first four
    opening = F.substring_index(respelt(F.substring_index("unit", " ", 4)), " ", 2)
    maybe = F.length("unit").between(1, longest) & opening.isin(openings) if openings else F.lit(False)
    units = units.withColumn("maybe", maybe).where("maybe OR whole")  # the whole text stands for its row
    units = units.withColumn("unit", F.when(F.col("maybe"), respelt(F.col("unit"))))
    digest = F.when(F.length("unit").isin(lengths), F.sha2("unit", 256)) if lengths else F.lit(None).cast("string")
    hits = units.select("_row", "doc_id", "whole", digest.alias("_digest")).join(table, F.col("_digest") == F.col("digest"), "left")
    # a row's units are in one task, so they are summed there
    return hits.groupBy("_row", "doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"),
        F.count_if(~F.col("whole") & F.col("license").isNotNull()).alias("n_lines"),
    ).drop("_row")


def license_report(docs: DataFrame) -> DataFrame:
    return license_scan(docs)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The whole list and the rule for copyright lines, line by line (DuckDB's patterns have no look-ahead)."""
    year = r"(19|20)[0-9][0-9]([^0-9]|$)"
    line = rf"^[^\p{{L}}\p{{N}}]*(copyright[^\p{{L}}\p{{N}}]*({_SIGN}|([\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]+){{0,4}}{year})|{_SIGN}[^\p{{L}}\p{{N}}]*{year})"

    def canon(column: str) -> str:
        lower = f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"
        kept = f"array_to_string(list_filter(string_split({lower}, chr(10)), lambda x: NOT regexp_matches(x, '{line}')), ' ')"
        text = f"trim(regexp_replace({kept}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for word, other in SPELLINGS.items():
            text = f"regexp_replace({text}, '\\b{word}\\b', '{other}', 'g')"
        return text

    values = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in ALL)
    return f"""
WITH known AS (SELECT min(license) AS license, c FROM (SELECT license, {canon('text')} AS c FROM (VALUES {values}) AS k(license, text)) GROUP BY c),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
units AS (
  SELECT r, true AS whole, text AS unit FROM d
  UNION ALL SELECT r, false, unnest(string_split(text, chr(10))) FROM d),
every AS (SELECT r, whole, {canon('unit')} AS c FROM units),
hits AS (SELECT r, whole, license FROM every JOIN known USING (c) WHERE c <> ''),
found AS (
  SELECT r, min(license) FILTER (WHERE whole) AS license,
         coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole), '') AS line_licenses,
         count(*) FILTER (WHERE NOT whole) AS n_lines
  FROM hits GROUP BY r)
SELECT d.doc_id, f.license, coalesce(f.line_licenses, '') AS line_licenses, CAST(coalesce(f.n_lines, 0) AS BIGINT) AS n_lines
FROM d LEFT JOIN found f USING (r)
"""

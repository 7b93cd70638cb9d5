"""Documents rearranged for filling in the middle.

A text is a row of units; where a prefix and a middle end is drawn by a digest of the seed and the
document's id, so any run gives the same output. An Arrow-batched pandas UDF walks the units once,
keeps their ends in a compact array, and slices the text at two of them. Nothing is shuffled.

Defined cases: a null text counts as empty, an empty text stays plain; a row without a doc_id has
the seed that ends at the colon, rows that repeat a doc_id the same seed; a text that holds one of
the markers stays plain, so every output can be taken apart again; empty tables give no rows;
other columns, of whatever names, stay as they are in ``fill_in_middle`` (columns of its own names,
in whatever case, are replaced). A text of any length is cut whole, four bytes of offsets for each unit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[A-Za-z]+|[^A-Za-z]"
_FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Code-point offsets at which units end, 0 first."""
    ends = array("I", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned integers of a digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, h: list[int], unit: regex.Pattern, plain: int, spm: int):
    """(units, form, prefix length, middle length, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ends[first], ends[second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output: markers occur once each, as no cut text holds any."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def infill_column(doc_id, text, seed: int = 1, plain: int = 10, spm: int = 20):
    """A struct column: n, form, prefix_chars, middle_chars, output and two digests.

    plain: percent of texts that stay as they are; spm: percent of the others whose suffix comes first.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(UNIT)
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts):
                t = t or ""
                n, form, before, between, out = rearranged(t, draws(seed, None if pd.isna(i) else int(i)), unit, plain, spm)
                digests = (hashlib.sha256(x.encode()).hexdigest() for x in (out, restored(out, form)))
                rows.append((n, form, before, between, out, *digests))
            frame = pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS.split(", ")])
            yield frame.astype({c: "Int64" for c in ("n", "prefix_chars", "middle_chars")})
        give_back()

    # ids travel as text: pandas would make a column with nulls floating point
    return F.pandas_udf(run, _FIELDS)(doc_id.cast("bigint").cast("string"), text.cast("string"))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """All columns of ``docs``, then n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256."""
    bounded_batches(docs.sparkSession)
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in (*names, "_fim")]
    cut = docs.withColumn("_fim", infill_column(docs["doc_id"], docs["text"], seed, plain, spm))
    return cut.select(*kept, *(F.col(f"_fim.{c}").alias(c) for c in names))


def infill_report(docs: DataFrame) -> DataFrame:
    return fill_in_middle(docs.select("doc_id", "text")).drop("text", "output")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4, len(units) AS n FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(len(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(len(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""

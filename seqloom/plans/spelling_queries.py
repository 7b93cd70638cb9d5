"""Texts read by a spelling file, with the SQL that follows its entries one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transduce
from ..sources import inventory
from .tables import table

SPELLING = """
spelling:
- {write: tion, read: [s, j, o, n]}
- {write: sch, read: ʃ}
- {write: eau, read: o, after: ["#", x]}
- {write: eau, read: [e, o]}
- {write: ch, read: x, before: [a, o, u, "#"]}
- {write: ch, read: ç}
- {write: qu, read: k}
- {write: ph, read: f}
- {write: th, read: θ, after: [a, e, i, o, u, "#"]}
- {write: ng, read: ŋ, after: ["#"]}
- {write: ll, read: [l]}
- {write: c, read: s, after: [e, i, é, è, ê, í]}
- {write: c, read: k}
- {write: g, read: ʒ, before: [a, e, n, "#"], after: [e, i, é]}
- {write: s, read: z, before: [a, e, i, o, u, é, è], after: [a, e, i, o, u, é, è]}
- {write: h, before: ["#"]}
- {write: e, after: ["#"]}
- {write: x, read: [k, s]}
consonant_mappings: {b: b, d: d, f: f, g: g, h: h, j: j, k: k, l: l, m: m, n: n, p: p, r: r, s: s, t: t, v: v, w: v, z: z, ß: s, ñ: ɲ, ç: s}
diacritic_mappings: {a: a, e: e, i: i, o: o, u: u, y: i, ä: ɛ, ö: ø, ü: y, é: e, è: ɛ, ê: ɛ, à: a, á: a, í: i, ó: o, ú: u}
"""


def spelled_sounds(spark, d):
    """How often each sound occurs in the documents of each language."""
    reader = transduce.compiled(transduce.entries_of(inventory.parse(SPELLING)))
    sounds = table(spark, d, "documents").select("lang", F.explode(reader.column(F.lower("text"))).alias("sound"))
    return sounds.groupBy("lang", "sound").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (spelled_sounds,)}


def _sql() -> str:
    entries = sorted(transduce.entries_of(inventory.parse(SPELLING)), key=lambda e: -len(e.write))
    one_of = lambda column, letters: f" AND {column} IN ({', '.join(repr(x) for x in letters)})" if letters else ""
    fits = " ".join(
        f"WHEN starts_with(rest, '{e.write}'){one_of('b', e.before)}{one_of(f'''CASE WHEN length(rest) = {len(e.write)} THEN '#' ELSE substr(rest, {len(e.write) + 1}, 1) END''', e.after)} THEN {k}"
        for k, e in enumerate(entries, 1)
    )
    reads = ", ".join("[" + ", ".join(repr(s) for s in e.read) + "]::VARCHAR[]" for e in entries)
    sizes = ", ".join(str(len(e.write)) for e in entries)
    return f"""WITH RECURSIVE w AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS word FROM documents) GROUP BY lang, word),
        r AS (SELECT word, '#' AS b, word AS rest, []::VARCHAR[] AS said FROM (SELECT DISTINCT word FROM w) UNION ALL
            SELECT word, substr(rest, m, 1), substr(rest, m + 1), said FROM (SELECT word, rest, coalesce([{sizes}][k], 1) AS m, coalesce([{reads}][k], []::VARCHAR[]) AS said
                FROM (SELECT word, rest, CASE {fits} ELSE NULL END AS k FROM r WHERE rest <> ''))),
        s AS (SELECT word, unnest(said) AS sound FROM r)
        SELECT lang, sound, CAST(sum(n) AS BIGINT) AS n FROM s JOIN w USING (word) GROUP BY lang, sound"""


ORACLES = {"spelled_sounds": _sql()}

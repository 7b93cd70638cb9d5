"""Verses that may hold a kind of rule, by tests of their text and of adjacent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters of each test. A silent n is the letter with sukoon.
SILENT_N, SHORT = "نْ", "ًٌٍَُِّْٰ"
THROAT_PAIRS = ("نْع", "نْ ع", "نْه", "نْ ه")
HIDING = "تثجدذزسشصضطظفقك"
LONG = ("َا", "ِي", "ُو")
#: Strings of which one is enough, for the tests of the whole text.
ANYWHERE = {
    "idhhar": THROAT_PAIRS, "qalqalah": ("قْ", "طْ", "بْ", "جْ", "دْ"), "raa_heavy": ("رَ", "رُ", "رْ"), "raa_light": ("رِ",), "emphatic": ("ص", "ض", "ط", "ظ", "ق"),
}


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def _pairs(text: Column, test) -> Column:
    """Whether a word and the one after it pass a test."""
    w = T.words(text)
    both = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: test(a, b))
    return F.exists(both, lambda x: x)


def tests(text: Column) -> dict[str, Column]:
    """Each test as a boolean column."""
    first = lambda w: F.regexp_extract(w, f"[^{SHORT}]", 0)
    one_word = F.exists(T.words(text), lambda w: F.contains(w, F.lit("آء")) | (_any(w, LONG) & F.contains(w, F.lit("ء"))))
    out = {name: _any(text, parts) for name, parts in ANYWHERE.items()}
    return out | {
        "idgham": _pairs(text, lambda a, b: F.contains(a, F.lit(SILENT_N)) & F.substring(b, 1, 1).isin(*"يونم")),
        "iqlab": _pairs(text, lambda a, b: F.contains(a, F.lit(SILENT_N)) & (first(b) == "ب")),
        "ikhfaa": _pairs(text, lambda a, b: F.contains(a, F.lit(SILENT_N)) & first(b).isin(*HIDING)),
        "madd_muttasil": _any(text, ("آء",)) & one_word | (_any(text, ("َا",)) & _any(text, ("ء",)) & one_word),
        "madd_munfasil": _pairs(text, lambda a, b: _any(a, LONG) & _any(b, ("ء", "أ", "إ"))),
    }


def candidates(verses: DataFrame) -> DataFrame:
    """class and the columns of the verse, a row for each test that it passes."""
    found = F.array(*[F.when(test, F.lit(name)) for name, test in tests(F.col("text")).items()])
    return verses.withColumn("class", F.explode(F.filter(found, lambda x: x.isNotNull())))


def sql(verses: str) -> str:
    """The same for SQL, from a query of verses."""
    some = lambda x, parts: "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
    pair = lambda test: f"len(list_filter(range(1, len(w)), lambda i: {test})) > 0"
    first = f"regexp_extract(w[i + 1], '[^{SHORT}]')"
    silent = f"contains(w[i], '{SILENT_N}')"
    word = f"len(list_filter(w, lambda x: contains(x, 'آء') OR ({some('x', LONG)} AND contains(x, 'ء')))) > 0"
    every = {name: some("text", parts) for name, parts in ANYWHERE.items()} | {
        "idgham": pair(f"{silent} AND contains('يونم', substring(w[i + 1], 1, 1))"), "iqlab": pair(f"{silent} AND {first} = 'ب'"),
        "ikhfaa": pair(f"{silent} AND {first} <> '' AND contains('{HIDING}', {first})"),
        "madd_muttasil": f"(contains(text, 'آء') OR (contains(text, 'َا') AND contains(text, 'ء'))) AND {word}",
        "madd_munfasil": pair(f"{some('w[i]', LONG)} AND {some('w[i + 1]', ('ء', 'أ', 'إ'))}"),
    }
    parts = " UNION ALL ".join(f"SELECT '{name}' AS class, chapter, verse FROM t WHERE {test}" for name, test in every.items())
    return f"WITH t AS (SELECT *, string_split(text, ' ') AS w FROM ({verses})) {parts}"

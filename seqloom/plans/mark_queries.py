"""Letters, marks and spans of verses and words made of all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import patterns
from .tables import table
from .scripted import ARTICLE, choice, choice_sql
from .scripted import SQL_DOCUMENT_VERSES as SQL_VERSES
from .scripted import document_verses as _verses

VERSE = ["chapter", "verse"]
_NAMES = ", ".join(f"('{mark}', '{name}', '{T.MARK_SIGNS.get(name, '?')}')" for name, mark in T.MARK_NAMES.items())
#: Every code point of the verses, which are in decomposed form: place, whether it is a letter, and its mark.
SQL_CHARS = f"""SELECT c.*, name, sign FROM (
    SELECT chapter, verse, i - 1 AS place, substring(text, i, 1) AS ch, regexp_matches(substring(text, i, 1), '^[ء-يݐ-ݿ]$') AS is_letter
    FROM ({SQL_VERSES}), unnest(range(1, length(text) + 1)) AS t(i)) c LEFT JOIN (VALUES {_NAMES}) AS n(mark, name, sign) ON n.mark = c.ch"""
SQL_MARKS = f"""SELECT *, row_number() OVER (PARTITION BY chapter, verse ORDER BY place) - 1 AS position FROM (
    SELECT *, last_value(CASE WHEN is_letter THEN ch END IGNORE NULLS) OVER w AS base, sum(CASE WHEN is_letter THEN 1 ELSE 0 END) OVER w - 1 AS letter
    FROM ({SQL_CHARS}) WINDOW w AS (PARTITION BY chapter, verse ORDER BY place ROWS UNBOUNDED PRECEDING)) WHERE name IS NOT NULL"""
#: Letters to find in words, by the rest of the word's length.
TARGETS = ("ل", "بن", "و", "ا")
#: Rules of errors by kind of event, and what the error is called.
ERRORS = {
    "click": ("madd_tabii", "too short or long", "counts"), "view": ("tafkhim", "heavy", "hz"), "purchase": ("ghunnah_mushaddadah_noon", "weak", "ratio"),
    "error": ("qalqalah_major", "none", "ratio"), "signup": ("ikhfaa_light", "clear", "ratio"),
}


def verse_marks(spark, d):
    """Every named mark with the letter before it and its place."""
    m = T.extract_marks(_verses(spark, d), VERSE)
    return m.select(*VERSE, *[F.col(c).cast("bigint").alias(c) for c in ("position", "at", "letter")], "mark", "name", "base")


def verse_mark_counts(spark, d):
    return T.extract_marks(_verses(spark, d), VERSE).groupBy("name").agg(F.count("*").alias("n"))


def verse_mark_sequences(spark, d):
    """Marks as signs, and which letters have sukoon and shaddah."""
    m = T.mark_sequences(_verses(spark, d), VERSE)
    return m.select(*VERSE, "signs", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("sukoon_at", "shaddah_at")])


def verse_mark_statistics(spark, d):
    total = lambda names: sum((F.col(n) for n in names), F.lit(0).cast("bigint"))
    kinds = {"vowels": T.SHORT_MARKS, "sukoon": ["sukoon"], "shaddah": ["shaddah"], "tanween": T.TANWEEN_MARKS}
    return T.mark_counts(_verses(spark, d), VERSE).select(
        *VERSE, total(T.MARK_NAMES).alias("total"), *T.MARK_NAMES, *[(total(names) > 0).alias(f"has_{kind}") for kind, names in kinds.items()],
    )


def word_analyses(spark, d):
    """Letters and vowels of every word of the verses."""
    return T.word_analyses(_verses(spark, d), VERSE)


def text_statistics(spark, d):
    s = _verses(spark, d).select(*VERSE, T.text_statistics(T.normalize("text", "NFC")).alias("s"))
    n = [F.col(f"s.{c}").cast("bigint").alias(c) for c in ("n_chars", "n_letters", "n_words", "n_marks")]
    return s.select(*VERSE, *n, F.round("s.letters_a_word", 4).alias("letters_a_word"), "s.is_valid")


def character_classes(spark, d):
    """How many letters, marks and others the verses have."""
    kind = F.when(T.is_letter("ch"), "letter").when(T.is_mark("ch"), "mark").otherwise("other")
    return T.character_counts(_verses(spark, d), decomposed=True).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


def verse_text_forms(spark, d):
    """Stripped and folded forms of each verse."""
    return _verses(spark, d).select(
        *VERSE, T.strip_tatweel("text").alias("no_tatweel"), T.fold_hamza("text").alias("one_hamza"), T.comparable("text").alias("comparable"),
        T.strip_pauses("text").alias("no_pauses"), T.label_script("text").alias("label"), T.strip_category_mn("text").alias("no_mn"),
        F.array_join(T.arabic_words("text"), "|").alias("words"), T.before_bracket(F.concat("text", F.lit(" [note]"))).alias("bare"),
        F.array_join(T.verses(F.concat_ws(" * ", "text", "text"), "*"), "|").alias("twice"),
    )


def opening_formula(spark, d):
    """The article at a verse's beginning split off, but for every seventh document."""
    v = _verses(spark, d).withColumn("s", T.split_prefix("text", ARTICLE, F.col("chapter") % 7 == 1))
    return v.select(*VERSE, "s.found", "s.prefix", "s.rest")


def letter_units(spark, d):
    """Base letters with their marks, whether they are doubled or silent, and their vowel: how often each is."""
    u = _verses(spark, d).select(F.explode(T.letter_units("text")).alias("u")).groupBy("u.letter", "u.marks").agg(F.count("*").alias("n"))
    return u.select("letter", "marks", T.is_silent("marks").alias("is_silent"), T.doubling_and_vowel("marks")["doubled"].alias("doubled"), T.vowel_of("marks").alias("vowel"), "n")


def highlight_spans(spark, d):
    """Of every distinct word, the span of a letter nearest to a hint, and the word with it marked."""
    w = _verses(spark, d).select(F.explode(T.words("text")).alias("word")).distinct()
    w = w.withColumns({"hint": F.length("word") % 3, "targets": choice(TARGETS, F.length("word") % len(TARGETS))})
    span = F.coalesce(*[F.when(F.col("targets") == t, T.nearest_span("word", t, F.col("hint"))) for t in TARGETS])
    w = w.withColumn("span", span)
    return w.select(
        "word", "hint", F.col("span.start").cast("bigint").alias("start_at"), F.col("span.end").cast("bigint").alias("end_at"),
        F.size(T.letter_spans("word")).cast("bigint").alias("n_spans"), T.highlight("word", F.col("span")).alias("marked"),
    )


def error_advice(spark, d):
    """What to do about each event as an error of its kind, 40 expected: how often which advice is given."""
    of = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, v[i]) for k, v in ERRORS.items()], F.lit("other [x]"))
    e = table(spark, d, "events").withColumns({"rule": of(0), "description": of(1), "unit": of(2)})
    told = T.advice("rule", "description", F.lit(40.0), F.col("value"), "unit")
    return e.groupBy("rule", told.alias("advice"), T.before_bracket("description").alias("mistake")).agg(F.count("*").alias("n"))


def word_of_position(spark, d):
    """Word of each line of an order, words ending after lines 2, 3 and 5."""
    ends = F.array(*[F.lit(x) for x in (2, 3, 5)])
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return li.groupBy("l_linenumber", T.word_of_position(F.col("l_linenumber"), ends).cast("bigint").alias("word_idx")).agg(F.count("*").alias("n"))


def verse_candidates(spark, d):
    """Verses that may hold each kind of rule, by ten tests of their text and adjacent words."""
    return patterns.candidates(_verses(spark, d)).select("class", *VERSE)


QUERIES = {f.__name__: f for f in (
    verse_marks, verse_mark_counts, verse_mark_sequences, verse_mark_statistics, word_analyses, text_statistics, character_classes, verse_text_forms,
    opening_formula, letter_units, highlight_spans, error_advice, word_of_position, verse_candidates,
)}

_ALL = "\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06dc\\u06df-\\u06e8\\u06ea-\\u06ed".encode().decode("unicode_escape")
_P = T.PAUSE_SIGNS
_M = T.MARK_NAMES
_VOWEL = "CASE regexp_extract({0}, '[" + "".join((T.SHORT_MARKS | T.TANWEEN_MARKS).values()) + "]') " + " ".join(f"WHEN '{m}' THEN '{n}'" for n, m in (T.SHORT_MARKS | T.TANWEEN_MARKS).items()) + " END"
#: Letters of the decomposed verses with the marks right behind them.
_UNITS = f"SELECT chapter, verse, unnest(u) AS u, generate_subscripts(u, 1) - 1 AS i FROM (SELECT chapter, verse, regexp_extract_all(text, '[ء-يݐ-ݿ][{_ALL}]*') AS u FROM ({SQL_VERSES}))"
_WORDS = f"SELECT chapter, verse, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS idx FROM (SELECT chapter, verse, string_split(text, ' ') AS w FROM ({SQL_VERSES}))"
_SPAN_WORDS = f"(SELECT DISTINCT word, {choice_sql(TARGETS, f'length(word) % {len(TARGETS)}')} AS targets, length(word) % 3 AS hint FROM ({_WORDS}))"
_ERROR = lambda i: "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in ERRORS.items()) + " ELSE 'other [x]' END"

ORACLES = {
    "verse_marks": f'''SELECT chapter, verse, position, place AS "at", CAST(letter AS BIGINT) AS letter, ch AS mark, name, coalesce(base, '') AS base FROM ({SQL_MARKS})''',
    "verse_mark_counts": f"SELECT name, count(*) AS n FROM ({SQL_CHARS}) WHERE name IS NOT NULL GROUP BY name",
    "verse_mark_sequences": f"""WITH s AS (SELECT chapter, verse, string_agg(sign, '' ORDER BY place) AS signs FROM ({SQL_MARKS}) GROUP BY ALL),
        u AS (SELECT chapter, verse, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE contains(u, '{_M["sukoon"]}')), '') AS sukoon_at,
            coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE contains(u, '{_M["shaddah"]}')), '') AS shaddah_at FROM ({_UNITS}) GROUP BY ALL)
        SELECT chapter, verse, coalesce(signs, '') AS signs, sukoon_at, shaddah_at FROM u LEFT JOIN s USING (chapter, verse)""",
    "verse_mark_statistics": f"""SELECT chapter, verse, count(name) AS total, {", ".join(f"count(*) FILTER (WHERE name = '{n}') AS {n}" for n in _M)},
        count(*) FILTER (WHERE name IN ('fatha', 'damma', 'kasra')) > 0 AS has_vowels, count(*) FILTER (WHERE name = 'sukoon') > 0 AS has_sukoon,
        count(*) FILTER (WHERE name = 'shaddah') > 0 AS has_shaddah, count(*) FILTER (WHERE starts_with(name, 'tanween')) > 0 AS has_tanween FROM ({SQL_CHARS}) GROUP BY chapter, verse""",
    "word_analyses": f"""WITH u AS (SELECT chapter, verse, idx, word, regexp_extract_all(word, '[ء-يݐ-ݿ][{_ALL}]*') AS u FROM ({_WORDS}))
        SELECT chapter, verse, idx, array_to_string(list_transform(u, lambda x: x[1]), '') AS letters, len(u) AS n_letters,
        length(regexp_replace(word, '[^{"".join(_M.values())}]', '', 'g')) AS n_marks, array_to_string(list_transform(u, lambda x: coalesce({_VOWEL.format("x")}, 'none')), ',') AS vowels,
        contains(word, 'ٱ') AS has_wasla, contains(word, 'ة') AS has_marbuta FROM u""",
    "text_statistics": f"""WITH t AS (SELECT chapter, verse, nfc_normalize(text) AS t FROM ({SQL_VERSES})),
        s AS (SELECT *, length(t) AS n_chars, len(regexp_extract_all(t, '[ء-يݐ-ݿ]')) AS n_letters, len(string_split(t, ' ')) AS n_words FROM t)
        SELECT chapter, verse, n_chars, n_letters, n_words, len(regexp_extract_all(t, '[{"".join(_M.values())}]')) AS n_marks, round(n_letters / n_words, 4) AS letters_a_word,
        regexp_matches(t, '[{"".join((T.SHORT_MARKS | T.TANWEEN_MARKS).values())}]') AS is_valid FROM s""",
    "character_classes": f"SELECT CASE WHEN is_letter THEN 'letter' WHEN regexp_matches(ch, '^[{_ALL}]$') THEN 'mark' ELSE 'other' END AS kind, count(*) AS n FROM ({SQL_CHARS}) GROUP BY ALL",
    "verse_text_forms": f"""SELECT chapter, verse, replace(text, 'ـ', '') AS no_tatweel, translate(text, 'أإؤئ', 'ءءءء') AS one_hamza,
        trim(regexp_replace(regexp_replace(translate(regexp_replace(text, '[{T.COMPARED_MARKS}ـ]', '', 'g'), 'أإآٱةى', 'ااااهي'), '[^؀-ۿ\\s]', '', 'g'), '\\s+', ' ', 'g')) AS comparable,
        regexp_replace(regexp_replace(regexp_replace(text, '[{_P}] ', '', 'g'), ' [{_P}]', '', 'g'), '[{_P}]', '', 'g') AS no_pauses,
        regexp_replace(nfc_normalize(text), '[ـ{_P}]', '', 'g') AS label, regexp_replace(text, '\\p{{Mn}}', '', 'g') AS no_mn,
        array_to_string(regexp_extract_all(text, '[{T.WORD_SIGNS}]+'), '|') AS words, text AS bare, text || '|' || text AS twice FROM ({SQL_VERSES})""",
    "opening_formula": f"""SELECT chapter, verse, f AS found, CASE WHEN f THEN '{ARTICLE}' END AS prefix, CASE WHEN f THEN ltrim(substring(text, {len(ARTICLE) + 1})) ELSE text END AS rest
        FROM (SELECT *, starts_with(text, '{ARTICLE}') AND chapter % 7 <> 1 AS f FROM ({SQL_VERSES}))""",
    "letter_units": f"""WITH u AS (SELECT unnest(regexp_extract_all(text, '[ء-يݐ-ݿٱ][^ء-يݐ-ݿٱ\\s]*')) AS u FROM ({SQL_VERSES}))
        SELECT substring(u, 1, 1) AS letter, substring(u, 2) AS marks, contains(u, '{_M["sukoon"]}') OR {_VOWEL.format("u")} IS NULL AS is_silent,
        contains(u, '{_M["shaddah"]}') AS doubled, {_VOWEL.format("u")} AS vowel, count(*) AS n FROM u GROUP BY u""",
    "highlight_spans": f"""WITH u AS (SELECT word, targets, hint, unnest(u) AS part, generate_subscripts(u, 1) - 1 AS i, len(u) AS n_spans FROM (SELECT *, regexp_extract_all(word, '[^{_ALL}][{_ALL}]*') AS u FROM {_SPAN_WORDS})),
        s AS (SELECT *, sum(length(part)) OVER (PARTITION BY word ORDER BY i) AS e FROM u),
        b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN len(list_filter(range(1, length(part) + 1), lambda k: contains(targets, substring(part, k, 1)))) > 0 THEN 0 ELSE 1 END, abs(i - hint), i) AS b,
            len(list_filter(range(1, length(part) + 1), lambda k: contains(targets, substring(part, k, 1)))) > 0 AS hit FROM s)
        SELECT word, hint, CASE WHEN hit THEN CAST(e - length(part) AS BIGINT) END AS start_at, CASE WHEN hit THEN CAST(e AS BIGINT) END AS end_at, n_spans,
        CASE WHEN hit THEN substring(word, 1, CAST(e AS BIGINT) - length(part)) || '<b>' || part || '</b>' || substring(word, CAST(e AS BIGINT) + 1) ELSE '<b>' || word || '</b>' END AS marked FROM b WHERE b = 1""",
    "error_advice": f"""WITH e AS (SELECT {_ERROR(0)} AS rule, {_ERROR(1)} AS description, {_ERROR(2)} AS unit, value < 40 AS short FROM events)
        SELECT rule, CASE WHEN unit = 'counts' THEN CASE WHEN short THEN 'Hold the sound longer — aim for 40.0 counts' ELSE 'Shorten the sound — aim for 40.0 counts' END
        WHEN rule = 'tafkhim' THEN CASE WHEN short THEN 'Pronounce with more emphasis — raise the back of the tongue' ELSE 'Reduce emphasis — lower the back of the tongue slightly' END
        WHEN contains(rule, 'ghunnah') THEN CASE WHEN short THEN 'Sustain the nasal sound longer — aim for 40.0 counts' ELSE 'Shorten the nasal sound — aim for 40.0 counts' END
        WHEN contains(rule, 'qalqalah') THEN 'Add a slight bounce/echo when releasing the letter' WHEN contains(rule, 'ikhfa') THEN 'Blend the noon/meem sound partially into the next letter with nasalization'
        ELSE description END AS advice, replace(description, ' [x]', '') AS mistake, count(*) AS n FROM e GROUP BY ALL""",
    "word_of_position": "SELECT l_linenumber, CAST(CASE WHEN l_linenumber < 2 THEN 0 WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber < 5 THEN 2 ELSE 3 END AS BIGINT) AS word_idx, count(*) AS n FROM lineitem GROUP BY ALL",
    "verse_candidates": patterns.sql(SQL_VERSES),
}

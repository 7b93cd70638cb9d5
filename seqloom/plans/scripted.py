"""Fully marked script and sequences of sounds made of the driver's tables, with the same in SQL.

Each sentence of a text becomes a verse: consonants become letters, a vowel behind a letter its mark,
any other vowel a carrier, everything else goes; the article joins the word behind it, and a
final t is tied. Events become sounds and rule applications of a sequence for each user.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context
from .tables import KEY, ORDER, SQL_POS, positions, table

#: What letters become.
PLAIN, SCRIPT = "bcdfghjklmnpqrstvxzñßç", "بكدفغهجقلمنصطرستضخزعحظ"
#: What becomes a mark behind a letter, and the mark.
MARKS = (("a", "َ"), ("ei", "ِ"), ("ou", "ُ"), ("y", "ّ"), ("w", "ْ"), ("éèêáà", "ً"), ("óòôö", "ٌ"), ("íìîï", "ٍ"), ("úùûüä", "ٰ"))
CARRIED, CARRIERS = "aeiouyw", "اايوويو"
ARTICLE = "ٱلْ"
SENTENCE_END = "[.!?\\n]"


def script(text: Column) -> Column:
    t = F.translate(F.lower(text), PLAIN, SCRIPT)
    for plain, mark in MARKS:
        t = F.regexp_replace(t, f"([ء-ي])[{plain}]", f"$1{mark}")
    t = F.regexp_replace(F.translate(t, CARRIED, CARRIERS), "[^ء-يً-ْٰ ]", "")
    t = F.trim(F.regexp_replace(t, " +", " "))
    return F.regexp_replace(F.regexp_replace(t, "(^| )تهِ ", f"$1{ARTICLE}"), "ت( |$)", "ة$1")


def _script_sql(text: str) -> str:
    t = f"translate(lower({text}), '{PLAIN}', '{SCRIPT}')"
    for plain, mark in MARKS:
        t = f"regexp_replace({t}, '([ء-ي])[{plain}]', '\\1{mark}', 'g')"
    t = f"regexp_replace(translate({t}, '{CARRIED}', '{CARRIERS}'), '[^ء-يً-ْٰ ]', '', 'g')"
    t = f"trim(regexp_replace({t}, ' +', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({t}, '(^| )تهِ ', '\\1{ARTICLE}', 'g'), 'ت( |$)', 'ة\\1', 'g')"


#: The end of a sentence or text among code points of script.
_END, _SPACE = ord("\n"), ord(" ")
#: By code point, the last one standing for all above: the mark that it becomes behind a letter, and what it is or becomes elsewhere (0: nothing).
_MARK, _ELSE = (np.zeros(0x672, np.uint16) for _ in range(2))
_ELSE[[*range(0x621, 0x653), 0x670, _SPACE]] = [*range(0x621, 0x653), 0x670, _SPACE]
_ELSE[[ord(c) for c in PLAIN]] = [ord(c) for c in SCRIPT]
_IS_LETTER = (_ELSE >= 0x621) & (_ELSE < 0x64B)
for _plain, _mark in MARKS:
    _MARK[[ord(c) for c in _plain]] = ord(_mark)
_ELSE[[ord(c) for c in CARRIED]] = [ord(c) for c in CARRIERS]
_ELSE[[ord(c) for c in ".!?\n"]] = _END
_T, _H, _I, _TIED = map(ord, "تهِة")


def _scripts(codes: np.ndarray, starts: np.ndarray):
    """What ``script`` makes of all sentences of lower-case texts: text's number, sentence's number, and the scripts as an Arrow array."""
    import pyarrow as pa

    # an end stands behind each text, so each sentence has its end, and what follows on an end belongs to another one
    codes = np.insert(np.minimum(codes, 0x671).astype(np.uint16), starts[1:], _END)
    c = _ELSE[codes]
    mark = _MARK[codes]
    np.copyto(c[1:], mark[1:], where=_IS_LETTER[codes[:-1]] & (mark[1:] > 0))
    last = np.searchsorted(np.flatnonzero(c == _END), starts[1:] + np.arange(len(starts) - 1)) + 1
    c = c[c > 0]
    c = c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] > _SPACE)])] if len(c) else c
    c = c[1:] if len(c) and c[0] == _SPACE else c
    c = c[np.concatenate([(c[:-1] != _SPACE) | (c[1:] != _END), [True]])] if len(c) else c
    # the article takes the space behind it, so of articles in a row every second one has none before it
    at = np.flatnonzero((c[:-3] == _T) & (c[1:-2] == _H) & (c[2:-1] == _I) & (c[3:] == _SPACE))
    at = at[(at == 0) | (c[at - 1] <= _SPACE)]
    starts_row = np.concatenate([[True], np.diff(at) != 4])[: len(at)]
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(starts_row, np.arange(len(at)), 0)) if len(at) else at
    at = at[rank % 2 == 0]
    for k, a in enumerate(ARTICLE):
        c[at + k] = ord(a)
    c = np.delete(c, at + 3)
    np.copyto(c[:-1], _TIED, where=(c[:-1] == _T) & (c[1:] <= _SPACE))
    ends = np.flatnonzero(c == _END)
    length = np.diff(ends, prepend=-1) - 1
    size = 2 * length - np.diff(np.searchsorted(np.flatnonzero(c == _SPACE), ends), prepend=0)
    filled = np.flatnonzero(length)
    offsets = np.concatenate([[0], np.cumsum(size[filled])]).astype(np.int32)
    data = c[c != _END].tobytes().decode("utf-16-le").encode()
    scripts = pa.StringArray.from_buffers(len(filled), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    of = np.searchsorted(last, filled, "right")
    return of, filled - np.concatenate([[0], last])[of], scripts


def verses(texts: DataFrame, key: str) -> DataFrame:
    """chapter (the text's key), verse (its sentence), text; sentences without letters are left out.

    ``script`` takes a dozen passes of regular expressions over each sentence; here all sentences of
    a batch are made at once by tables of code points.
    """

    def run(batches):
        import pyarrow as pa

        for batch in T.steps(batches, "_t"):
            of, verse, scripts = _scripts(*T.code_points(batch.column("_t")))
            yield pa.RecordBatch.from_arrays([batch.column("chapter").take(pa.array(of)), pa.array(verse, pa.int64()), scripts], names=["chapter", "verse", "text"])

    lower = texts.select(F.col(key).alias("chapter"), F.lower("text").alias("_t"))
    return lower.mapInArrow(run, f"chapter {lower.schema['chapter'].dataType.simpleString()}, verse bigint, text string")


def document_verses(spark, d) -> DataFrame:
    return verses(table(spark, d, "documents"), "doc_id")


def benchmark_verses(spark, d) -> DataFrame:
    return verses(table(spark, d, "benchmark"), "item_id")


def _verses_sql(table_: str, key: str) -> str:
    parts = f"SELECT {key} AS chapter, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS verse FROM (SELECT {key}, string_split_regex(text, '{SENTENCE_END}') AS p FROM {table_})"
    return f"SELECT * FROM (SELECT chapter, CAST(verse AS BIGINT) AS verse, {_script_sql('s')} AS text FROM ({parts})) WHERE text <> ''"


SQL_DOCUMENT_VERSES = _verses_sql("documents", "doc_id")
SQL_BENCHMARK_VERSES = _verses_sql("benchmark", "item_id")

#: Sounds and rules that events stand for, by the rest of their ids.
SOUNDS = ("q", "u", "l", "sˤ", "aː", "n", "ʔ", "a", "m", "iː", "tˤ", "ɑ", "b", "ħ", "i", "x")
APPLIED = (
    "vowel_backing_after_emphatic_long", "madd_tabii", "iqlab", "ghunnah_mushaddadah_noon", "idgham_ghunnah_noon", "vowel_backing_after_emphatic_short",
    "raa_tafkheem_with_fatha", "ikhfaa_shafawi", "ikhfaa_light", "qalqalah_minor",
)


def choice(values, n: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


def choice_sql(values, n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} + 1]"


def event_sounds(spark, d) -> DataFrame:
    """verse (the user), pos, symbol, word_idx (words begin at errors), word_final, verse_final."""
    p = positions(spark, d)
    s = p.select(
        "user_id", "ts", "event_id", F.col("user_id").alias("verse"), "pos", choice(SOUNDS, F.col("event_id") % len(SOUNDS)).alias("symbol"),
        context.running_count(F.col("event_type") == "error", KEY, ORDER).alias("word_idx"),
    ).drop("user_id", "ts", "event_id")
    w = context.ordered(["verse"], ["pos"])
    last = F.lead(F.lit(1)).over(w).isNull()
    return s.withColumns({"verse_final": last, "word_final": last | (F.lead("word_idx").over(w) != F.col("word_idx"))})


def event_ranges(spark, d) -> DataFrame:
    """verse, start_pos, end_pos, rule: one of eleven events applies no rule, the others up to three places."""
    p = positions(spark, d)
    rule = choice(APPLIED, F.col("event_id") % (len(APPLIED) + 1))
    return p.select(F.col("user_id").alias("verse"), F.col("pos").alias("start_pos"), (F.col("pos") + F.col("event_id") % 3).alias("end_pos"), rule.alias("rule")).where("rule IS NOT NULL")


SQL_SOUNDS = f"""SELECT *, lead(1) OVER w IS NULL AS verse_final, lead(1) OVER w IS NULL OR lead(word_idx) OVER w <> word_idx AS word_final, lag(symbol) OVER w AS b, lead(symbol) OVER w AS a FROM (
    SELECT user_id AS verse, pos, {choice_sql(SOUNDS, f'event_id % {len(SOUNDS)}')} AS symbol,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS word_idx FROM ({SQL_POS})) WINDOW w AS (PARTITION BY verse ORDER BY pos)"""
SQL_RANGES = f"""SELECT user_id AS verse, pos AS start_pos, pos + event_id % 3 AS end_pos, {choice_sql(APPLIED, f'event_id % {len(APPLIED) + 1}')} AS rule FROM ({SQL_POS})
    WHERE event_id % {len(APPLIED) + 1} < {len(APPLIED)}"""

"""Text normalisation, segmentation and letter analysis as column functions.

All but Unicode normalisation, the extraction of marks and the similarity ratio are JVM expressions;
these are functions of Arrow arrays, a part of a batch at a time, since Spark has no built-in for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import ratios

#: Unicode characters of Arabic script and its marks.
TATWEEL = "\u0640"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
PAUSE_SIGNS = "\u06d6\u06d7\u06d8\u06d9\u06da\u06db\u06dc\u06dd\u06de\u06df\u06e0\u06e2\u06ed"
SHORT_MARKS = {"fatha": "\u064e", "damma": "\u064f", "kasra": "\u0650"}
TANWEEN_MARKS = {"tanween_fath": "\u064b", "tanween_damm": "\u064c", "tanween_kasr": "\u064d"}
OTHER_MARKS = {"shaddah": "\u0651", "sukoon": "\u0652", "dagger_alif": "\u0670"}
MARK_NAMES = SHORT_MARKS | TANWEEN_MARKS | OTHER_MARKS
#: The sign of each mark in an encoded sequence; any other is a question mark.
MARK_SIGNS = {
    "fatha": "a", "damma": "u", "kasra": "i", "sukoon": "0", "shaddah": "~", "tanween_fath": "an", "tanween_damm": "un", "tanween_kasr": "in",
}
WASLA, MARBUTA = "\u0671", "\u0629"
STRIPPED_MARKS = "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0654\u0655\u0670\u06e5"
LETTERS = "\u0621-\u064a\u0750-\u077f"
WORD_SIGNS = "\u0621-\u064a\u064b-\u0652\u0670\u0671"
ALL_MARKS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed"
SPACES = " \t\n\x0b\f\r"
COMPARED_MARKS = "\u0610-\u061a\u064b-\u065f\u0670"
#: Code points of a step of the functions that work on code points.
CODES = 1 << 19


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slices(texts) -> Iterator[tuple[int, int]]:
    """(first, length) of parts of an Arrow array that have about ``CODES`` code points, or one text."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CODES, "right")))
        yield a, b - a
        a = b


def _changed(text: Column, change) -> Column:
    """``change`` (str -> str) of each text."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        part = lambda p: pa.array([None if v is None else change(v) for v in p.to_pylist()], pa.string())
        return pa.concat_arrays([part(texts.slice(*at)) for at in slices(texts)] or [part(texts)])

    return run(text)


def _normal(text: str, form: str) -> str:
    return text if unicodedata.is_normalized(form, text) else unicodedata.normalize(form, text)


def normalize(text: Column | str, form: str = "NFC") -> Column:
    """Unicode normal form; a form that does not exist raises."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no Unicode normal form: {form}")
    return _changed(as_column(text), lambda v: _normal(v, form))


def strip_invisible(text: Column | str) -> Column:
    """Without tatweel, zero-width characters and pause signs."""
    return F.translate(as_column(text), TATWEEL + ZERO_WIDTH + PAUSE_SIGNS, "")


def clean(text: Column | str, form: str = "NFC") -> Column:
    """Decomposed, stripped, and composed again in the asked form."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no Unicode normal form: {form}")
    gone = re.compile(f"[{TATWEEL}{ZERO_WIDTH}{PAUSE_SIGNS}]+")
    return _changed(as_column(text), lambda v: _normal(gone.sub("", _normal(v, "NFD")), form))


def strip_marks(text: Column | str, marks: str = STRIPPED_MARKS) -> Column:
    return F.translate(as_column(text), marks, "")


def strip_category_mn(text: Column | str) -> Column:
    """Without combining marks of any script."""
    return F.regexp_replace(as_column(text), r"\p{Mn}", "")


def strip_tatweel(text: Column | str) -> Column:
    return F.translate(as_column(text), TATWEEL, "")


def fold(text: Column | str, letters: str, others: str) -> Column:
    """Letters folded to others by a fixed table."""
    return F.translate(as_column(text), letters, others)


def fold_hamza(text: Column | str) -> Column:
    """Hamza on any carrier becomes the letter hamza."""
    return fold(text, "أإؤئ", "ء" * 4)


def comparable(text: Column | str) -> Column:
    """Loose form for comparing words: no marks, one alef, h for t marbuta, y for alef maqsura, Arabic only."""
    bare = F.regexp_replace(as_column(text), f"[{COMPARED_MARKS}{TATWEEL}]", "")
    folded = F.translate(bare, "أإآٱةى", "ااااهي")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^؀-ۿ\s]", ""), r"\s+", " "))


def strip_pauses(text: Column | str, signs: str = PAUSE_SIGNS) -> Column:
    """Pause signs go together with one space beside them: after, before, none, in that order."""
    out = as_column(text)
    for pattern in (f"[{signs}] ", f" [{signs}]", f"[{signs}]"):
        out = F.regexp_replace(out, pattern, "")
    return out


def is_arabic(text: Column | str) -> Column:
    return as_column(text).rlike(f"[{LETTERS}]")


def letter_count(text: Column | str, letters: str = LETTERS) -> Column:
    """How many characters of a class a text has."""
    return F.regexp_count(as_column(text), F.lit(f"[{letters}]"))


def letter_units(text: Column | str, letters: str = LETTERS + "ٱ") -> Column:
    """Array of (letter, marks): base letters with the marks that follow them."""
    units = F.regexp_extract_all(as_column(text), F.lit(f"([{letters}][^{letters}\\s]*)"), F.lit(1))
    return F.transform(units, lambda u: F.struct(F.substring(u, 1, 1).alias("letter"), F.substring(u, F.lit(2), F.length(u)).alias("marks")))


def has_mark(marks: Column | str, name: str) -> Column:
    return F.instr(as_column(marks), MARK_NAMES[name]) > 0


def vowel_of(marks: Column | str) -> Column:
    """Name of the first short vowel or tanween among marks, by place; null if none."""
    names = SHORT_MARKS | TANWEEN_MARKS
    first = F.regexp_extract(as_column(marks), "[" + "".join(names.values()) + "]", 0)
    # nothing is found at place 1, a mark behind it
    place = F.position(first, F.lit(" " + "".join(names.values())))
    return F.get(F.array(F.lit(None).cast("string"), *[F.lit(n) for n in names]), place - 1)


def mark_name(char: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for name, mark in MARK_NAMES.items() for x in (mark, name)])[as_column(char)]


def is_letter(char: Column | str) -> Column:
    return as_column(char).rlike(f"^[{LETTERS}]$")


def is_mark(char: Column | str) -> Column:
    return as_column(char).rlike(f"^[{ALL_MARKS}]$")


def arabic_words(text: Column | str) -> Column:
    """Runs of letters and vowel marks, whatever stands between them."""
    return F.regexp_extract_all(as_column(text), F.lit(f"[{WORD_SIGNS}]+"), F.lit(0))


def is_silent(marks: Column | str) -> Column:
    """Whether a letter with these marks has no vowel: sukoon, or none of the vowel marks."""
    return has_mark(marks, "sukoon") | vowel_of(marks).isNull()


def doubling_and_vowel(marks: Column | str) -> Column:
    return F.struct(has_mark(marks, "shaddah").alias("doubled"), vowel_of(marks).alias("vowel"))


def _marks_of(text: Column) -> Column:
    """The named marks of a decomposed text, nothing else."""
    return F.regexp_replace(text, "[^" + "".join(MARK_NAMES.values()) + "]", "")


def _known_marks(text: Column | str) -> Column:
    """The named marks of a text in canonical order, nothing else."""
    return _marks_of(normalize(text, "NFD"))


def mark_sequence(text: Column | str) -> Column:
    """The text's marks as a string of signs."""
    marks = _known_marks(text)
    for name, mark in MARK_NAMES.items():
        marks = F.replace(marks, F.lit(mark), F.lit(MARK_SIGNS.get(name, "?")))
    return marks


def marked_letters(text: Column | str) -> Column:
    """Array of (letter, marks) of a text in decomposed form: letters with the marks right behind them."""
    return _marked(normalize(text, "NFD"))


def _marked(text: Column) -> Column:
    units = F.regexp_extract_all(text, F.lit(f"[{LETTERS}][{ALL_MARKS}]*"), F.lit(0))
    return F.transform(units, lambda u: F.struct(F.substring(u, 1, 1).alias("letter"), F.substring(u, F.lit(2), F.length(u)).alias("marks")))


def letters_with(units: Column | str, name: str) -> Column:
    """Ordinals (from 0) of the letters of ``marked_letters`` that have a mark."""
    at = F.transform(as_column(units), lambda u, i: F.when(has_mark(u["marks"], name), i))
    return F.filter(at, lambda i: i.isNotNull())


def mark_statistics(text: Column | str) -> Column:
    """Number of marks in total and by name, what kinds occur, and where sukoon and shaddah stand."""
    marks, units = _known_marks(text), marked_letters(text)
    count = lambda name: F.regexp_count(marks, F.lit(MARK_NAMES[name]))
    any_of = lambda names: marks.rlike("[" + "".join(MARK_NAMES[n] for n in names) + "]")
    return F.struct(
        F.length(marks).alias("total"), *[count(n).alias(n) for n in MARK_NAMES],
        any_of(SHORT_MARKS).alias("has_vowels"), any_of(["sukoon"]).alias("has_sukoon"), any_of(["shaddah"]).alias("has_shaddah"),
        any_of(TANWEEN_MARKS).alias("has_tanween"), letters_with(units, "sukoon").alias("sukoon_at"), letters_with(units, "shaddah").alias("shaddah_at"),
    )


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of an Arrow array, one after the other, and where each text begins and the last one ends."""
    texts = pc.fill_null(texts, "")
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)


def steps(batches, text: str) -> Iterator:
    """Parts of Arrow batches, as ``slices`` cuts them by a column of texts."""
    for batch in batches:
        for at in slices(batch.column(text)):
            yield batch.slice(*at)


#: By code point, the last one standing for all above: number of a named mark or -1, and whether it is a letter, or any mark.
_NUMBER = np.full(0x781, -1, np.int8)
_NUMBER[[ord(m) for m in MARK_NAMES.values()]] = range(len(MARK_NAMES))
#: Also by code point: place among the vowels and tanween, from 1, or 0 for none.
_VOWEL = np.zeros(0x781, np.int8)
_VOWEL[[ord(m) for m in (SHORT_MARKS | TANWEEN_MARKS).values()]] = range(1, len(SHORT_MARKS | TANWEEN_MARKS) + 1)
_IS_LETTER, _IS_MARK, _IS_SPACE = (np.array([bool(re.match(f"[{c}]", chr(k))) for k in range(0x781)]) for c in (LETTERS, ALL_MARKS, SPACES))


def _in_normal_form(texts, form: str):
    """An Arrow array of texts, null as empty, in a normal form."""
    values = pc.fill_null(texts, "").to_pylist()
    if unicodedata.is_normalized(form, "".join(values)):  # so are its parts
        return texts
    return pa.array([_normal(v, form) for v in values], pa.string())


def _decomposed(texts) -> tuple[np.ndarray, np.ndarray]:
    """``code_points`` of the decomposed texts, in 16 bits: those above 0x780, which are neither letters nor marks, as 0x780."""
    codes, starts = code_points(_in_normal_form(texts, "NFD"))
    return np.minimum(codes, 0x780).astype(np.uint16), starts


def character_counts(texts: DataFrame, text: str = "text", decomposed: bool = False) -> DataFrame:
    """ch, n: how often each character of the texts, or of their decomposed forms, occurs.

    A partition is counted where it is and gives one row a character that it has, not one for each place.
    """

    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in steps(batches, "_t"):
            values = batch.column("_t")
            n = np.bincount(code_points(_in_normal_form(values, "NFD") if decomposed else values)[0])
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(k) for k in at], pa.string()), pa.array(total[at])], names=["ch", "n"])

    counted = texts.select(F.col(text).alias("_t")).mapInArrow(run, "ch string, n bigint")
    return counted.groupBy("ch").agg(F.sum("n").alias("n"))


def mark_sequences(texts: DataFrame, key: list[str], names: tuple[str, ...] = ("sukoon", "shaddah"), text: str = "text") -> DataFrame:
    """key, signs (those of ``mark_sequence``), and for each of ``names`` the ordinals that ``letters_with`` gives, in ``<name>_at``.

    As columns, these take a string a mark and a pass of regular expressions a name; here a part of a batch is looked at as a whole.
    """
    signs = np.array([MARK_SIGNS.get(n, "?").encode() for n in MARK_NAMES], "S2").view(np.uint8).reshape(-1, 2)
    widths = (signs > 0).sum(1)

    def letters(codes, starts, hits, passed, others):
        """Ordinals of the letters that the marks at ``hits`` stand behind, with nothing but marks between."""
        found = np.searchsorted(others, hits) - 1
        hits, found = hits[found >= 0], others[found[found >= 0]]
        first = starts[np.searchsorted(starts, hits, "right") - 1]
        mine = (found >= first) & _IS_LETTER[codes[found]]
        found, which = np.unique(found[mine], return_index=True)
        ordinals = (passed[found] - passed[first[mine][which]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(found, starts).astype(np.int32)), pa.array(ordinals))

    def run(batches):
        for batch in steps(batches, "_t"):
            given = batch.column("_t").is_valid()
            codes, starts = _decomposed(batch.column("_t"))
            at = np.flatnonzero(_NUMBER[codes] >= 0)
            n = _NUMBER[codes[at]]
            ends = np.concatenate([[0], np.cumsum(widths[n])])[np.searchsorted(at, starts)].astype(np.int32)
            data = signs[n].ravel()
            passed = np.concatenate([[0], np.cumsum(_IS_LETTER[codes])])
            others = np.flatnonzero(~_IS_MARK[codes])
            made = [pa.StringArray.from_buffers(len(given), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[data > 0].tobytes()))]
            made += [letters(codes, starts, at[n == list(MARK_NAMES).index(name)], passed, others) for name in names]
            made = [m if given.true_count == len(m) else pc.if_else(given, m, pa.scalar(None, m.type)) for m in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *made], names=[*key, "signs", *[f"{name}_at" for name in names]])

    chars = texts.select(*key, F.col(text).alias("_t"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chars.schema.fields[:-1])
    return chars.mapInArrow(run, ", ".join([kept, "signs string", *[f"{name}_at array<int>" for name in names]]))


def mark_counts(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, and how often each named mark occurs in the text, in a column of its name; 0 for null."""

    def run(batches):
        for batch in steps(batches, "_t"):
            codes, starts = _decomposed(batch.column("_t"))
            at = np.flatnonzero(_NUMBER[codes] >= 0)
            row = np.searchsorted(starts, at, "right") - 1
            n = np.bincount(row * len(MARK_NAMES) + _NUMBER[codes[at]], minlength=(len(starts) - 1) * len(MARK_NAMES)).reshape(-1, len(MARK_NAMES))
            counts = [pa.array(np.ascontiguousarray(c, np.int64)) for c in n.T]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *counts], names=[*key, *MARK_NAMES])

    chars = texts.select(*key, F.col(text).alias("_t"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chars.schema.fields[:-1]]
    return chars.mapInArrow(run, ", ".join([*kept, *[f"{n} bigint" for n in MARK_NAMES]]))


def extract_marks(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, position, mark, name, base (the letter before, empty if none), at (code point in the decomposed text), letter (ordinal of the base).

    A text is looked at where its row is, so no row a character is made and none is moved.
    """
    names, marks = list(MARK_NAMES), list(MARK_NAMES.values())

    def run(batches):
        for batch in steps(batches, "_t"):
            codes, starts = _decomposed(batch.column("_t"))
            is_letter, place = _IS_LETTER[codes], np.arange(len(codes))
            at = np.flatnonzero(_NUMBER[codes] >= 0)
            row = np.searchsorted(starts, at, "right") - 1
            first = starts[row]
            last = np.maximum.accumulate(np.where(is_letter, place, -1))[at] if len(at) else at
            passed = np.concatenate([[0], np.cumsum(is_letter)])
            base = np.where(last >= first, codes[np.maximum(last, 0)] if len(at) else 0, 0)
            kinds, which = np.unique(base, return_inverse=True)
            n = _NUMBER[codes[at]]
            columns = [
                *(batch.column(k).take(pa.array(row)) for k in key), pa.array((np.arange(len(at)) - np.searchsorted(row, row)).astype(np.int32)),
                pa.array(marks).take(pa.array(n)), pa.array(names).take(pa.array(n)), pa.array([chr(k) if k else "" for k in kinds], pa.string()).take(pa.array(which.ravel())),
                pa.array((at - first).astype(np.int32)), pa.array((passed[at] - passed[first] - 1).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "position", "mark", "name", "base", "at", "letter"])

    chars = texts.select(*key, F.col(text).alias("_t"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chars.schema.fields[:-1])
    return chars.mapInArrow(run, f"{kept}, position int, mark string, name string, base string, at int, letter bigint")


def word_analysis(word: Column | str) -> Column:
    """Letters of a word, its marks and vowels, letter by letter."""
    w = as_column(word)
    t = normalize(w, "NFD")
    units = _marked(t)
    return F.struct(
        F.transform(units, lambda u: u["letter"]).alias("letters"), F.size(units).alias("n_letters"), F.length(_marks_of(t)).alias("n_marks"),
        letters_with(units, "sukoon").alias("sukoon_at"), letters_with(units, "shaddah").alias("shaddah_at"),
        F.transform(units, lambda u: F.coalesce(vowel_of(u["marks"]), F.lit("none"))).alias("vowels"),
        F.contains(w, F.lit(WASLA)).alias("has_wasla"), F.contains(w, F.lit(MARBUTA)).alias("has_marbuta"),
    )


def word_analyses(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, idx (place among ``words``), and of each word what ``word_analysis`` gives: letters (joined), n_letters, n_marks, vowels (joined by commas), has_wasla, has_marbuta.

    As columns, these take several passes of regular expressions over a word and a string a letter; here a part of a batch is looked at as a whole.
    """
    names = pa.array(["none", *SHORT_MARKS, *TANWEEN_MARKS])
    columns = {"idx": "bigint", "letters": "string", "n_letters": "bigint", "n_marks": "bigint", "vowels": "string", "has_wasla": "boolean", "has_marbuta": "boolean"}
    passed = lambda found: np.concatenate([[0], np.cumsum(found)])

    def run(batches):
        for batch in steps(batches, "_t"):
            codes, starts = _decomposed(batch.column("_t"))
            begins = _IS_SPACE[codes]
            begins = ~begins & np.concatenate([[True], begins[:-1]])[: len(codes)]
            at_start = starts[starts < len(codes)]
            begins[at_start] = ~_IS_SPACE[codes[at_start]]
            words = np.append(np.flatnonzero(begins), len(codes))
            row = np.searchsorted(starts, words[:-1], "right") - 1
            is_letter = _IS_LETTER[codes]
            letters = passed(is_letter)
            # a letter's vowel is the first of those right behind it, with nothing but marks between, in its own text
            vowels = np.flatnonzero(_VOWEL[codes])
            behind = np.maximum.accumulate(np.where(_IS_MARK[codes], -1, np.arange(len(codes))))[vowels] if len(codes) else vowels
            its = (behind >= starts[np.searchsorted(starts, vowels, "right") - 1]) & is_letter[behind] & np.concatenate([[True], behind[1:] != behind[:-1]])[: len(behind)]
            kinds = np.zeros(letters[-1], np.int8)
            kinds[letters[behind[its]]] = _VOWEL[codes[vowels[its]]]
            ends = letters[words].astype(np.int32)
            data = codes[is_letter].tobytes().decode("utf-16-le").encode()  # two bytes a letter
            made = [
                pa.array(np.arange(len(row)) - np.searchsorted(row, row)), pa.StringArray.from_buffers(len(row), pa.py_buffer((2 * ends).tobytes()), pa.py_buffer(data)),
                pa.array(np.diff(letters[words])), pa.array(np.diff(passed(_NUMBER[codes] >= 0)[words])), pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(kinds))), ","),
                *(pa.array(np.diff(passed(codes == ord(c))[words]) > 0) for c in (WASLA, MARBUTA)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in key), *made], names=[*key, *columns])

    chars = texts.select(*key, F.col(text).alias("_t"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chars.schema.fields[:-1]]
    return chars.mapInArrow(run, ", ".join([*kept, *[f"{name} {kind}" for name, kind in columns.items()]]))


def text_statistics(text: Column | str) -> Column:
    """Characters, letters, words, letters a word, marks, and whether the text can be processed."""
    t = as_column(text)
    n = F.size(words(t))
    return F.struct(
        F.length(t).alias("n_chars"), letter_count(t).alias("n_letters"), n.alias("n_words"),
        F.when(n > 0, letter_count(t) / n).otherwise(0.0).alias("letters_a_word"), F.length(_known_marks(t)).alias("n_marks"), validate(t).isNull().alias("is_valid"),
    )


def label_script(text: Column | str) -> Column:
    """Composed text for a label file: no tatweel, no pause signs."""
    return F.translate(normalize(text, "NFC"), TATWEEL + PAUSE_SIGNS, "")


def verses(text: Column | str, separator: str) -> Column:
    """Parts of a text between separators, trimmed, empty ones left out."""
    parts = F.split(as_column(text), F.lit("\\Q" + separator + "\\E"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def letter_spans(word: Column | str) -> Column:
    """Array of (start, end): each base character of a word with the marks behind it."""
    w = as_column(word)
    lead = F.length(F.regexp_extract(w, f"^[{ALL_MARKS}]*", 0))
    units = F.regexp_extract_all(w, F.lit(f"[^{ALL_MARKS}][{ALL_MARKS}]*"), F.lit(0))
    ends = F.aggregate(units, F.array(lead), lambda a, u: F.concat(a, F.array((F.element_at(a, -1) + F.length(u)).cast("int"))))
    return F.zip_with(F.slice(ends, F.lit(1), F.size(units)), F.slice(ends, F.lit(2), F.size(units)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def nearest_span(word: Column | str, targets: str, hint: Column) -> Column:
    """The span that holds one of the characters ``targets``, nearest to letter ``hint``, the first on ties; null if none does."""
    w = as_column(word)
    scored = F.transform(letter_spans(w), lambda s, i: F.struct(
        F.abs(i - hint).alias("far"), i.alias("i"), s.alias("span"), F.substring(w, s["start"] + 1, s["end"] - s["start"]).alias("part")
    ))
    return F.array_min(F.filter(scored, lambda x: x["part"].rlike(f"[{targets}]")))["span"]


def highlight(word: Column | str, span: Column, left: str = "<b>", right: str = "</b>") -> Column:
    """The word with a span between two marks; the whole word between them where there is no span."""
    w = as_column(word)
    part = lambda a, n: F.substring(w, a, n)
    inner = F.concat(
        part(F.lit(1), span["start"]), F.lit(left), part(span["start"] + 1, span["end"] - span["start"]), F.lit(right), part(span["end"] + 1, F.length(w))
    )
    return F.when(span.isNull(), F.concat(F.lit(left), w, F.lit(right))).otherwise(inner)


def advice(rule: Column | str, description: Column | str, expected: Column, actual: Column, unit: Column | str) -> Column:
    """What to do about an error, by its unit, then by its rule, longer or shorter as it is too little or too much."""
    r, short = as_column(rule), actual < expected
    goal = lambda lead: F.concat(F.lit(lead), F.format_string("%.1f", expected.cast("double")), F.lit(" counts"))
    has = lambda *names: F.greatest(*[F.instr(r, n) for n in names], F.lit(0)) > 0
    return (
        F.when(as_column(unit) == "counts", F.when(short, goal("Hold the sound longer — aim for ")).otherwise(goal("Shorten the sound — aim for ")))
        .when(has("backing", "tafkhim"), F.when(short, "Pronounce with more emphasis — raise the back of the tongue").otherwise("Reduce emphasis — lower the back of the tongue slightly"))
        .when(has("ghunnah"), F.when(short, goal("Sustain the nasal sound longer — aim for ")).otherwise(goal("Shorten the nasal sound — aim for ")))
        .when(has("qalqalah"), "Add a slight bounce/echo when releasing the letter")
        .when(has("ikhfa"), "Blend the noon/meem sound partially into the next letter with nasalization")
        .otherwise(as_column(description))
    )


def word_of_position(position: Column, boundaries: Column | str) -> Column:
    """Ordinal of the word that a position lies in, from the ends of words: how many of them it has reached."""
    return F.size(F.filter(as_column(boundaries), lambda b: b <= position))


def words(text: Column | str) -> Column:
    """Words between white space; none for an empty text."""
    t = F.trim(F.regexp_replace(as_column(text), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used in lambdas."""
    return F.transform(F.array(value), body)[0]


def word_offsets(text: Column | str) -> Column:
    """Array of (word, start, end) in code points, in order.

    Offsets are sums over blocks of about the root of the number of words: appending to an
    array copies it, which over a whole text would take the square of its words.
    """
    word = lambda x: F.ltrim(x, F.lit(" \t\n\x0b\f\r"))  # noqa: E731  all that \s matches

    def append(base: Column, block: Column) -> Column:
        return F.aggregate(
            block, F.struct(base.alias("at"), F.array().cast("array<struct<word:string,start:int,end:int>>").alias("out")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x)).cast("int").alias("at"),
                F.concat(a["out"], F.array(F.struct(
                    word(x).alias("word"), (a["at"] + F.length(x) - F.length(word(x))).cast("int").alias("start"),
                    (a["at"] + F.length(x)).cast("int").alias("end"),
                ))).alias("out"),
            ),
        )["out"]

    def blocks(found: Column) -> Column:
        k = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(found))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), k)
        return F.transform(starts, lambda i: F.slice(found, i, k))

    def sums(parts: Column) -> Column:
        return F.aggregate(
            parts, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array((F.element_at(a, -1) + F.length(F.array_join(b, ""))).cast("int")))
        )

    found = F.regexp_extract_all(as_column(text), F.lit(r"(\s*)(\S+)"), F.lit(0))
    return _let(found, lambda f: _let(blocks(f), lambda parts: F.flatten(F.zip_with(
        F.slice(sums(parts), F.lit(1), F.size(parts)), parts, append
    ))))


def context_window(letters: Column | str, at: Column, k: int) -> Column:
    """(before, letter, after): up to k letters on both sides of a 1-based place."""
    a = as_column(letters)
    start = F.greatest(at - k, F.lit(1))
    return F.struct(
        F.slice(a, start, at - start).alias("before"), F.element_at(a, at).alias("letter"), F.slice(a, at + 1, F.lit(k)).alias("after")
    )


def validate(text: Column | str) -> Column:
    """Reason why a text cannot be processed; null: it can."""
    t = as_column(text)
    return (
        F.when(t.isNull() | (F.trim(t) == ""), "empty text").when(~is_arabic(t), "no Arabic text")
        .when(~t.rlike("[" + "".join(MARK_NAMES.values()) + "]"), "no diacritics")
        .when(~t.rlike("[" + "".join((SHORT_MARKS | TANWEEN_MARKS).values()) + "]"), "no vowel marks")
    )


def split_prefix(text: Column | str, prefix: str, never: Column | None = None) -> Column:
    """(found, prefix, rest) of a fixed opening; leading space of the rest goes. ``never``: rows
    whose opening is part of the text (the first chapter's)."""
    t = as_column(text)
    found = t.startswith(prefix) if never is None else t.startswith(prefix) & ~never
    return F.struct(
        found.alias("found"), F.when(found, prefix).alias("prefix"),
        F.when(found, F.ltrim(F.substring(t, F.lit(len(prefix) + 1), F.length(t)))).otherwise(t).alias("rest"),
    )


def display_name(name: Column | str, names: dict[str, str] | None = None) -> Column:
    """Fixed title of a rule, or its name in capitals without underscores."""
    n = as_column(name)
    plain = F.initcap(F.regexp_replace(n, "_", " "))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[n], plain) if names else plain


def before_bracket(text: Column | str) -> Column:
    return F.substring_index(as_column(text), " [", 1)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching blocks of two strings; null if one is null. A whole batch is matched together."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = x.notna() & y.notna()
        return pd.Series(ratios(x[both].tolist(), y[both].tolist()), index=x.index[both], dtype="float64").reindex(x.index)

    return run(as_column(a), as_column(b))


def file_key(chapter: Column | str, verse: Column | str) -> Column:
    return F.format_string("%03d_%03d", as_column(chapter), as_column(verse))

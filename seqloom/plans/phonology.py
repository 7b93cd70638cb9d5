"""From diacritised text to sounds, rule applications and expected durations.

verses(chapter, verse, text) -> letters -> sounds(chapter, verse, pos, word_idx, symbol, ...)
-> rule applications -> expectations. Every step is a projection, an explode or a window over
(chapter, verse); the tables of sounds and rules are small literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules
from ..operators.context import ordered, running_count

VERSE = ["chapter", "verse"]

#: Sound of each consonant letter.
CONSONANTS = {
    "ء": "ʔ", "ا": "aː", "ب": "b", "ت": "t", "ث": "θ", "ج": "dʒ", "ح": "ħ", "خ": "x", "د": "d", "ذ": "ð", "ر": "r", "ز": "z", "س": "s",
    "ش": "ʃ", "ص": "sˤ", "ض": "dˤ", "ط": "tˤ", "ظ": "ðˤ", "ع": "ʕ", "غ": "ɣ", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n",
    "ه": "h", "و": "w", "ي": "j", "ة": "h",
}
#: Names of the disjoined letters as sounds, and their rule.
LETTER_NAMES = {
    "ا": ("ʔ a l i f", None), "ح": ("h aː", "madd_tabii"), "ي": ("j aː", "madd_tabii"), "ط": ("tˤ aː", "madd_tabii"), "ه": ("h aː", "madd_tabii"),
    "ر": ("r aː", "madd_tabii"), "ل": ("l aː m", "madd_lazim"), "م": ("m iː m", "madd_lazim"), "ك": ("k aː f", "madd_lazim"),
    "ع": ("ʕ aj n", "madd_lazim"), "س": ("s iː n", "madd_lazim"), "ن": ("n uː n", "madd_lazim"), "ق": ("q aː f", "madd_lazim"), "ص": ("sˤ aː d", "madd_lazim"),
}
#: Single letters that open a chapter, where the mark above may be missing.
UNMARKED = {(38, 1): "ص", (50, 1): "ق", (68, 1): "ن"}
SUN_LETTERS = "تثدذرزسشصضطظلن"
FIXED_NOUNS = ("ٱسم", "ٱبن", "ٱمرأ", "ٱمرؤ", "ٱثن")
WASLA, MADDAH, SMALL_WAW, T_MARBUTA = "ٱ", "ٓ", "ۥ", "ة"

#: Classes of sounds.
SHORT_VOWELS, LONG_VOWELS, DIPHTHONGS = ("a", "i", "u", "ɑ"), ("aː", "iː", "uː", "ɑː", "aːʔ"), ("aw", "aj")
EMPHATIC = ("tˤ", "dˤ", "ðˤ", "sˤ")
HEAVY = ("sˤ", "dˤ", "tˤ", "ðˤ", "q")
ECHOING = ("q", "tˤ", "b", "dʒ", "d")
BACKING = ("sˤ", "dˤ", "tˤ", "ðˤ", "q", "x", "ɣ", "rˤ")
#: The aligner's symbol of each sound (several sounds share one).
ALIGNER = {"θ": "s", "ð": "z", "dʒ": "j", "ʃ": "$", "sˤ": "S", "dˤ": "D", "tˤ": "T", "ðˤ": "Z", "ħ": "H", "ʕ": "E", "ɣ": "g", "ʔ": "<"}

_VOWEL_SOUNDS = {"fatha": ["a"], "damma": ["u"], "kasra": ["i"], "tanween_fath": ["a", "n"], "tanween_damm": ["u", "n"], "tanween_kasr": ["i", "n"]}


def _sounds(*symbols: str) -> Column:
    return F.array(*[F.lit(s) for s in symbols]) if symbols else F.array().cast("array<string>")


def _choose(column: Column, table: dict, default: Column) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out.otherwise(default)


def letters(verses: DataFrame) -> DataFrame:
    """chapter, verse, word_idx, word, n_letters, letter_idx, letter, vowel, marks flags and neighbours."""
    w = (
        verses.select(*VERSE, F.posexplode(T.words(T.clean("text"))).alias("word_idx", "word"))
        .withColumn("bare", T.strip_marks("word"))
        .withColumn("units", T.letter_units("word"))
    )
    base = F.filter("units", lambda u: u["letter"] != WASLA)
    names = F.array(*[F.lit(x) for x in LETTER_NAMES])
    only_names = (F.size(base) > 0) & F.forall(base, lambda u: F.array_contains(names, u["letter"]))
    unmarked = F.lit(False)
    for (chapter, verse), letter in UNMARKED.items():
        one = (F.size(base) == 1) & (F.get(base, 0)["letter"] == letter)
        unmarked = unmarked | ((F.col("chapter") == chapter) & (F.col("verse") == verse) & one)
    w = w.withColumns(
        {"base": base, "disjoined": (F.contains("word", F.lit(MADDAH)) & only_names) | F.coalesce(unmarked, F.lit(False)), "n_letters": F.size(base)}
    )
    rows = w.select(*VERSE, "word_idx", "word", "bare", "disjoined", "n_letters", F.posexplode_outer("base").alias("letter_idx", "unit"))
    rows = rows.withColumns({"letter": F.col("unit.letter"), "marks": F.coalesce("unit.marks", F.lit(""))})
    rows = rows.withColumns(
        {
            "vowel": T.vowel_of("marks"), "sukoon": T.has_mark("marks", "sukoon"), "shaddah": T.has_mark("marks", "shaddah"),
            "dagger": T.has_mark("marks", "dagger_alif"), "small_waw": F.instr("marks", SMALL_WAW).between(1, 4),
        }
    )
    o = Window.partitionBy(*VERSE, "word_idx").orderBy("letter_idx")
    return rows.withColumns(
        {
            "prev_letter": F.lag("letter").over(o), "prev_vowel": F.lag("vowel").over(o), "next_letter": F.lead("letter").over(o),
            "next_shaddah": F.lead("shaddah").over(o), "second_vowel": F.max(F.when(F.col("letter_idx") == 1, F.col("vowel"))).over(Window.partitionBy(*VERSE, "word_idx")),
        }
    )


def letter_sounds() -> Column:
    """Sounds of one letter in its word, from the columns of ``letters``."""
    letter, vowel, prev = F.col("letter"), F.col("vowel"), F.col("prev_vowel")
    sukoon, dagger = F.col("sukoon"), F.col("dagger")
    marked = F.when(vowel.isNull(), _sounds()).otherwise(_choose(vowel, {k: _sounds(*v) for k, v in _VOWEL_SOUNDS.items()}, _sounds()))
    none = vowel.isNull()
    hamza = F.concat(_sounds("ʔ"), marked)
    alif = F.when((F.col("letter_idx") > 0) & (prev == "fatha"), _sounds("aː")).otherwise(_sounds())
    own = F.when(dagger & (vowel == "fatha"), _sounds("aː")).otherwise(marked)
    waw = (
        F.when((prev == "damma") & none, _sounds("uː")).when(prev == "damma", F.concat(_sounds("w"), marked))
        .when(sukoon | none, _sounds("w")).otherwise(F.concat(_sounds("w"), own))
    )
    yaa = (
        F.when((prev == "kasra") & none, _sounds("iː")).when(prev == "kasra", F.concat(_sounds("j"), marked))
        .when((prev == "fatha") & none & ~sukoon, _sounds("aː")).when(sukoon | none, _sounds("j")).otherwise(F.concat(_sounds("j"), own))
    )
    consonant = _choose(letter, {k: F.lit(v) for k, v in CONSONANTS.items()}, F.lit(None).cast("string"))
    doubled = F.when(F.col("shaddah"), F.array(consonant, consonant)).otherwise(F.array(consonant))
    spoken = F.when(sukoon & ~vowel.startswith("tanween"), _sounds()).otherwise(marked)
    regular = F.when(consonant.isNull(), _sounds()).otherwise(
        F.concat(doubled, spoken, F.when(dagger, _sounds("aː")).otherwise(_sounds()), F.when(F.col("small_waw"), _sounds("uː")).otherwise(_sounds()))
    )
    final = F.col("letter_idx") == F.col("n_letters") - 1
    assimilated = (letter == "ل") & none & F.coalesce(F.instr(F.lit(SUN_LETTERS), F.col("next_letter")) > 0, F.lit(False)) & F.coalesce("next_shaddah", F.lit(False))
    return (
        F.when(letter.isNull() | assimilated, _sounds()).when(letter.isin("ء", "أ", "إ", "ئ"), hamza).when(letter == "ا", alif)
        .when(letter == "آ", _sounds("ʔ", "aː")).when(letter == "ؤ", _sounds("ʔ", "u"))
        .when(letter == T_MARBUTA, F.concat(F.when(final, _sounds("t")).otherwise(_sounds("h")), marked))
        .when(letter == "و", waw).when(letter.isin("ي", "ى"), yaa).otherwise(regular)
    )


def opening_sounds() -> Column:
    """Sounds of a connecting alif that opens a verse: article a, fixed nouns i, else u or i by the third letter."""
    noun = F.lit(False)
    for stem in FIXED_NOUNS:
        noun = noun | F.col("bare").startswith(stem)
    vowel = F.when(F.col("bare").startswith(WASLA + "ل"), "a").when(noun, "i").when(F.col("second_vowel") == "damma", "u").otherwise("i")
    return F.when((F.col("word_idx") == 0) & F.col("word").startswith(WASLA), F.array(F.lit("ʔ"), vowel)).otherwise(_sounds())


def phonemize(verses: DataFrame) -> DataFrame:
    """chapter, verse, pos, word_idx, word, letter, symbol, spec (an injected rule or null)."""
    rows = letters(verses)
    named = _choose(F.col("letter"), {k: _sounds(*v[0].split()) for k, v in LETTER_NAMES.items()}, _sounds())
    plain = F.concat(F.when(F.coalesce(F.col("letter_idx"), F.lit(0)) == 0, opening_sounds()).otherwise(_sounds()), letter_sounds())
    rows = rows.withColumn("sounds", F.when(F.col("disjoined"), named).otherwise(plain))
    rows = rows.select("*", F.posexplode("sounds").alias("k", "symbol"))
    long = [k for k, v in LETTER_NAMES.items() if v[1] == "madd_lazim"]
    spec = F.when(
        F.col("disjoined"),
        F.when((F.col("k") == 1) & F.col("letter").isin(*long), "madd_lazim").when((F.col("k") == 0) & (F.col("letter") == "ق"), "qalqalah_major")
        .when((F.col("k") == 0) & (F.col("letter") == "م") & (F.col("prev_letter") == "ل"), "ghunnah"),
    )
    o = Window.partitionBy(*VERSE).orderBy("word_idx", "letter_idx", "k")
    return rows.select(*VERSE, (F.row_number().over(o) - 1).alias("pos"), "word_idx", "word", "letter", "symbol", spec.alias("spec"))


def with_context(sounds: DataFrame) -> DataFrame:
    """Context columns of the rules; null: not known at this position, so it does not stand against a rule."""
    o = ordered(VERSE, ["pos"])
    s = sounds.withColumns({f"s{k}": F.lead("symbol", k).over(o) for k in (1, 2, 3)} | {"s_1": F.lag("symbol").over(o)})
    s = s.withColumns({f"w{k}": F.lead("word_idx", k).over(o) for k in (1, 2)} | {"n": F.count("*").over(Window.partitionBy(*VERSE))})
    vowel = lambda c: F.coalesce(F.col(c).isin(*SHORT_VOWELS, *LONG_VOWELS, *DIPHTHONGS), F.lit(False))
    consonant = lambda c: F.col(c).isNotNull() & ~vowel(c)
    heavy = lambda c: F.coalesce(F.col(c).isin(*HEAVY), F.lit(False))
    last = F.col("pos") == F.col("n") - 1
    starts1 = F.coalesce(F.col("w1") != F.col("word_idx"), F.lit(False))
    starts2 = F.coalesce(F.col("w2") != F.col("w1"), F.lit(False))
    long = F.col("symbol").isin(*LONG_VOWELS)
    pausal = long & consonant("s1") & (F.col("pos") + 2 >= F.col("n") - 1)
    same = F.coalesce(F.col("s1") == F.col("symbol"), F.lit(False))
    echo_pause = F.col("symbol").isin(*ECHOING) & (
        (F.coalesce(F.col("s1").isin("a", "i", "u"), F.lit(False)) & (F.col("pos") + 2 == F.col("n")))
        | (F.coalesce(F.col("s1").isin("u", "i"), F.lit(False)) & (F.coalesce(F.col("s2") == "n", F.lit(False))) & (F.col("pos") + 3 == F.col("n")))
    )
    here = lambda c: F.when(~last, c)  # noqa: E731  known before the last position only
    word_end = last | starts1
    verse_end = last | echo_pause
    near = heavy("s_1") | heavy("symbol") | heavy("s1")
    so_far = running_count(consonant("symbol"), [*VERSE, "word_idx"], ["pos"])
    pronoun = (
        (F.col("symbol") == "h") & F.coalesce(F.col("s1").isin("i", "u"), F.lit(False)) & starts2
        & F.coalesce(F.col("s2") == "ʔ", F.lit(False)) & (so_far <= 2)
    )
    marbuta = (F.col("symbol") == "t") & (F.col("letter") == T_MARBUTA)
    return s.withColumns(
        {
            "is_vowel": vowel("symbol"), "is_long_vowel": long, "is_emphatic": F.col("symbol").isin(*EMPHATIC),
            "is_word_end": word_end, "not_at_word_end": ~word_end, "position_mid_word": ~word_end & ~(F.coalesce(F.lag("word_idx").over(o) != F.col("word_idx"), F.lit(True))),
            "not_at_verse_end": ~verse_end, "at_verse_end_or_pause": verse_end | pausal | (marbuta & word_end & (F.col("word_idx") == F.max("word_idx").over(Window.partitionBy(*VERSE)))),
            "position_word_end_or_verse_end": word_end | verse_end,
            "hamza_follows_in_next_word": F.when(long, starts1 & (F.col("s1") == "ʔ") & ~last), "word_boundary_between": F.when(long, starts1 & ~last),
            "follows_sukoon": F.when(long, consonant("s_1") | last | pausal),
            "following_has_shaddah": F.when(long, consonant("s1") & F.coalesce(F.col("s1") == F.col("s2"), F.lit(False)) & ~starts1 & ~starts2),
            "has_sukoon": last | ~vowel("s1") | echo_pause, "is_geminate": same, "has_shaddah": same,
            "following_is_baa": here(F.col("s1") == "b"), "following_is_meem": here(F.col("s1") == "m"),
            "following_is_lam_or_raa": here(F.col("s1").isin("l", "r")), "following_is_idgham_letter": here(F.col("s1").isin("j", "w", "n", "m")),
            "following_is_throat_letter": here(F.col("s1").isin("ʔ", "h", "ʕ", "ħ", "ɣ", "x")), "following_is_emphatic": here(heavy("s1")),
            "following_not_emphatic": last | ~heavy("s1"), "following_not_meem": last | (F.col("s1") != "m"), "following_not_baa": last | (F.col("s1") != "b"),
            "not_idhhar_letter": last | ~F.col("s1").isin("ʔ", "h", "ʕ", "ħ", "ɣ", "x"), "not_idgham_letter": last | ~F.col("s1").isin("j", "w", "n", "m", "l", "r"),
            "not_iqlab_letter": last | (F.col("s1") != "b"), "near_emphatic_letter": ~last & near, "near_light_letter": last | ~near,
            "hamza_follows_in_same_word": ~last & (F.col("s1") == "ʔ") & ~starts1, "no_word_boundary_between": last | ~starts1,
            "no_hamza_following": last | (F.col("s1") != "ʔ"), "hamza_follows": F.when(pronoun, True).otherwise(here(F.col("s1") == "ʔ")),
            "no_sukoon_following": last | starts1 | F.when(consonant("s1") & (F.col("pos") + 2 < F.col("n")), vowel("s2")).otherwise(vowel("s1") | (F.col("pos") + 2 >= F.col("n"))),
            "is_pronoun_haa": pronoun, "has_kasra_or_damma": F.when(pronoun, True),
            "is_ta_marbuta": marbuta, "has_following_word": F.col("word_idx") < F.max("word_idx").over(Window.partitionBy(*VERSE)),
        }
    )


def _yes(*names: str) -> dict[str, bool]:
    return {n: True for n in names}


_LONG3 = ("aː", "iː", "uː")
#: Name, targets, category, priority, next sounds, conditions (previous sounds where given).
RULES = (
    rules.Rule("madd_tabii", _LONG3, "madd", 50, conditions=_yes("is_long_vowel", "no_hamza_following", "no_sukoon_following")),
    rules.Rule("madd_muttasil", _LONG3, "madd", 80, next=("ʔ",), conditions=_yes("is_long_vowel", "hamza_follows_in_same_word", "no_word_boundary_between")),
    rules.Rule("madd_munfasil", _LONG3, "madd", 75, next=("ʔ",), conditions=_yes("is_long_vowel", "hamza_follows_in_next_word", "word_boundary_between")),
    rules.Rule("madd_lazim_kalimi", _LONG3, "madd", 88, conditions=_yes("is_long_vowel", "following_has_shaddah")),
    rules.Rule("madd_arid_lissukun", _LONG3, "madd", 60, conditions=_yes("is_long_vowel", "at_verse_end_or_pause", "follows_sukoon")),
    rules.Rule("madd_silah_kubra", ("h",), "madd", 70, conditions=_yes("is_pronoun_haa", "has_kasra_or_damma", "hamza_follows", "not_at_verse_end")),
    rules.Rule("ghunnah_mushaddadah_noon", ("n",), "noon_meem_sakinah", 105, next=("n",), conditions=_yes("is_geminate")),
    rules.Rule("ghunnah_mushaddadah_meem", ("m",), "noon_meem_sakinah", 105, next=("m",), conditions=_yes("is_geminate")),
    rules.Rule("idhhar_halqi_noon", ("n",), "noon_meem_sakinah", 100, next=("ʔ", "h", "ʕ", "ħ", "ɣ", "x"), conditions=_yes("has_sukoon", "following_is_throat_letter")),
    rules.Rule("idgham_ghunnah_noon", ("n",), "noon_meem_sakinah", 95, next=("j", "w", "n", "m"), conditions=_yes("has_sukoon", "following_is_idgham_letter") | {"has_shaddah": False}),
    rules.Rule("idgham_no_ghunnah", ("n",), "noon_meem_sakinah", 95, next=("l", "r"), conditions=_yes("has_sukoon", "following_is_lam_or_raa")),
    rules.Rule("iqlab", ("n",), "noon_meem_sakinah", 98, next=("b",), conditions=_yes("has_sukoon")),
    rules.Rule("ikhfaa_light", ("n",), "noon_meem_sakinah", 90, next=("t", "θ", "dʒ", "d", "ð", "z", "s", "ʃ", "f", "k"), conditions=_yes("has_sukoon", "not_idhhar_letter", "not_idgham_letter", "not_iqlab_letter", "following_not_emphatic")),
    rules.Rule("ikhfaa_heavy", ("n",), "noon_meem_sakinah", 92, next=HEAVY, conditions=_yes("has_sukoon", "not_idhhar_letter", "not_idgham_letter", "not_iqlab_letter", "following_is_emphatic")),
    rules.Rule("idhhar_shafawi", ("m",), "noon_meem_sakinah", 100, not_next=("m", "b"), conditions=_yes("has_sukoon", "following_not_meem", "following_not_baa")),
    rules.Rule("idgham_shafawi_meem", ("m",), "noon_meem_sakinah", 95, next=("m",), conditions=_yes("has_sukoon", "following_is_meem")),
    rules.Rule("ikhfaa_shafawi", ("m",), "noon_meem_sakinah", 93, next=("b",), conditions=_yes("has_sukoon", "following_is_baa")),
    rules.Rule("ta_marbuta_waqf", ("t",), "general", 95, conditions=_yes("at_verse_end_or_pause", "is_ta_marbuta")),
    rules.Rule("ta_marbuta_wasl", ("t",), "general", 94, conditions=_yes("not_at_verse_end", "is_ta_marbuta", "has_following_word")),
    rules.Rule("qalqalah_minor", ECHOING, "qalqalah", 70, conditions=_yes("has_sukoon", "position_mid_word", "not_at_word_end", "not_at_verse_end") | {"has_shaddah": False}),
    rules.Rule("qalqalah_major", ECHOING, "qalqalah", 75, conditions=_yes("has_sukoon", "position_word_end_or_verse_end")),
    rules.Rule("qalqalah_with_shaddah", ECHOING, "qalqalah", 72, conditions=_yes("has_shaddah")),
    rules.Rule("qalqalah_emphatic", ECHOING, "qalqalah", 73, conditions=_yes("has_sukoon", "near_emphatic_letter")),
    rules.Rule("qalqalah_non_emphatic", ("b", "dʒ", "d"), "qalqalah", 73, conditions=_yes("has_sukoon", "near_light_letter", "not_at_verse_end") | {"has_shaddah": False}),
    rules.Rule("vowel_backing_after_emphatic_short", ("a",), "general", 50, prev=BACKING),
    rules.Rule("vowel_backing_after_emphatic_long", ("aː",), "general", 50, prev=BACKING, conditions=_yes("is_long_vowel")),
    rules.Rule("vowel_backing_before_emphatic_short", ("a",), "general", 48, next=BACKING),
    rules.Rule("vowel_backing_before_emphatic_long", ("aː",), "general", 48, next=BACKING, conditions=_yes("is_long_vowel")),
    rules.Rule("emphasis_blocking_by_front_vowel", ("a",), "general", 52),
    rules.Rule("cross_word_emphasis_continuation", ("a",), "general", 45),
    rules.Rule("madd_lazim_muthaqqal_kalimi", _LONG3, "madd", 85, next=("geminate",), conditions=_yes("is_long_vowel")),
)
#: The optional rules of r, as a file; what they ask of vowels around is not told by the context, and the one without a target never fires.
R_RULES = """
rules:
- {name: raa_tafkheem_with_fatha, category: raa, priority: 90, pattern: {target: r, conditions: {has_fatha: true}}}
- {name: raa_tafkheem_with_damma, category: raa, priority: 90, pattern: {target: r, conditions: {has_damma: true}}}
- {name: raa_tarqeeq_with_kasra, category: raa, priority: 91, pattern: {target: r, conditions: {has_kasra: true, no_emphatic_after: true}}}
- {name: raa_tafkheem_sakinah_after_fatha, category: raa, priority: 85, pattern: {target: r, conditions: {has_sukoon: true, preceded_by_fatha: true}}}
- {name: raa_tafkheem_sakinah_after_damma, category: raa, priority: 85, pattern: {target: r, conditions: {has_sukoon: true, preceded_by_damma: true}}}
- {name: raa_tarqeeq_sakinah_after_kasra, category: raa, priority: 86, pattern: {target: r, conditions: {has_sukoon: true, preceded_by_kasra: true, not_followed_by_emphatic_in_word: true, not_followed_by_fatha_or_damma: true}}}
- {name: raa_after_yaa_sakinah, category: raa, priority: 87, pattern: {target: r, conditions: {preceded_by_yaa_sakinah: true}}}
- {name: raa_misr_exception, category: raa, priority: 100, pattern: {word: مِصْر, target_position: -1}}
- {name: raa_after_hamzat_wasl_kasra, category: raa, priority: 88, pattern: {target: r, conditions: {preceded_by_hamzat_wasl: true, hamzat_wasl_has_kasra: true}}}
- {name: raa_emphatic_context_override, category: raa, priority: 95, pattern: {target: r, conditions: {in_same_word_as_emphatic: true, emphatic_influences_raa: true}}}
"""
#: Rules that fire by injection alone.
INJECTED = ("madd_lazim", "ghunnah")
#: Rules that suppress the plain long vowel at the same place.
OVER_PLAIN = ("madd_muttasil", "madd_munfasil", "madd_lazim_kalimi", "madd_lazim", "madd_arid_lissukun", "madd_silah_kubra")
#: Fixed values: (counts, multiplier, tolerance in ms, base ms) that a rule expects; null: unchanged.
EXPECTED = {
    "madd_tabii": (2.0, 2.0, 30.0, 200.0), "madd_muttasil": (4.5, 4.5, 50.0, 450.0), "madd_munfasil": (3.5, 3.5, 50.0, 350.0),
    "madd_lazim_kalimi": (6.0, 3.0, 100.0, 1200.0), "madd_arid_lissukun": (None, 2.0, None, 200.0), "madd_lazim": (6.0, 3.0, 100.0, 1200.0),
    "ghunnah": (2.0, 2.0, 50.0, 400.0), "ghunnah_mushaddadah_noon": (2.0, 2.0, 50.0, 400.0), "ghunnah_mushaddadah_meem": (2.0, 2.0, 50.0, 400.0),
    "iqlab": (2.0, 2.0, 50.0, 400.0), "idgham_ghunnah_noon": (2.0, 2.0, 50.0, 400.0), "qalqalah_major": (None, 1.2, None, None),
}
#: Fixed values in milliseconds and factors.
BASE_MS, BASE_TOLERANCE = {"consonant": 80.0, "short": 100.0, "long": 200.0}, {"consonant": 20.0, "short": 25.0, "long": 50.0}
COUNT_MS, WORD_FINAL, VERSE_FINAL = 200.0, 1.3, 1.5


def apply_rules(sounds: DataFrame, table: Sequence[rules.Rule] = RULES) -> DataFrame:
    """chapter, verse, pos, rule: scanned matches, injected specs, and the general rule suppressed; a projection of each position.

    ``table`` are the rules, built in or of files (``sources.rule_files``); a condition on context
    that ``with_context`` does not give passes.
    """
    placed = with_context(sounds)
    scanned = F.transform(rules.hits(rules.known_conditions(table, placed.columns), "symbol", "s_1", "s1"), lambda h: h["rule"])
    injected = F.when(F.col("spec").isNotNull(), F.array("spec")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(scanned, injected))
    over = F.arrays_overlap(F.col("_rules"), F.array(*[F.lit(r) for r in OVER_PLAIN]))
    kept = F.when(over, F.array_remove("_rules", "madd_tabii")).otherwise(F.col("_rules"))
    return placed.withColumn("_rules", every).select(*VERSE, "pos", F.explode(kept).alias("rule"))


def expected_durations(sounds: DataFrame, apps: DataFrame, table: Sequence[rules.Rule] = RULES) -> DataFrame:
    """chapter, verse, pos, symbol, expected_ms, tolerance_ms.

    The rule of the lowest priority sets the base (counts of 200 ms before milliseconds), all
    rules' multipliers and the word- and verse-final factors apply.
    """
    order = {r.name: i for i, r in enumerate(rules.by_priority(table))} | {name: 1000 + i for i, name in enumerate(INJECTED)}
    pairs = [x for name, v in EXPECTED.items() for x in (F.lit(name), F.struct(*[F.lit(y).cast("double").alias(c) for c, y in zip("cmtb", v)]))]
    effect = F.create_map(*pairs)[F.col("rule")]
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("rule")]
    at = [*VERSE, "pos"]
    e = apps.withColumns({"e": effect, "o": F.coalesce(place, F.lit(999))}).where("e IS NOT NULL")
    base = F.coalesce(F.col("e.c") * COUNT_MS, F.col("e.b"))
    g = e.groupBy(*at).agg(
        F.product(F.coalesce("e.m", F.lit(1.0))).alias("m"), F.max_by(base, F.when(base.isNotNull(), F.col("o"))).alias("base"),
        F.max_by("e.t", F.when(F.col("e.t").isNotNull(), F.col("o"))).alias("tol"),
    )
    o = ordered(VERSE, ["pos"])
    kind = F.when(F.col("symbol").isin(*LONG_VOWELS), "long").when(F.col("symbol").isin(*SHORT_VOWELS, *DIPHTHONGS), "short").otherwise("consonant")
    s = sounds.withColumns(
        {"kind": kind, "word_final": ~F.col("word_idx").eqNullSafe(F.lead("word_idx").over(o)), "verse_final": F.lead(F.lit(1)).over(o).isNull()}
    ).join(g, at, "left")
    pick = lambda table: _choose(F.col("kind"), {k: F.lit(v) for k, v in table.items()}, F.lit(0.0))
    factor = F.coalesce("m", F.lit(1.0)) * F.when(F.col("word_final"), WORD_FINAL).otherwise(1.0) * F.when(F.col("verse_final"), VERSE_FINAL).otherwise(1.0)
    return s.select(*at, "symbol", (F.coalesce("base", pick(BASE_MS)) * factor).alias("expected_ms"), F.coalesce("tol", pick(BASE_TOLERANCE)).alias("tolerance_ms"))


def aligner_symbol(symbol: Column | str) -> Column:
    """The aligner's symbol of a sound; the map is many-to-one and never inverted."""
    s = T.as_column(symbol)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIGNER.items() for x in kv])[s], F.regexp_replace(s, "(.)ː", "$1$1"))

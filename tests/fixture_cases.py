"""Cases of signals, file formats, rule files, repairs and assessors over literal fixtures, for ``test_fixtures.py``.

Expected rows are worked out from the fixtures' design (tones of known place and length, known
bands) and stand in the SQL as VALUES.
"""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import signal
from seqloom.operators import assess, repair, rules, severity
from seqloom.sources import corpus, rule_files, textgrid
from seqloom.plans import recitation

RATE = signal.RATE


def tone(hz: float, seconds: float, level: float = 0.5) -> np.ndarray:
    return np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE) * level


def quiet(seconds: float) -> np.ndarray:
    return np.zeros(int(RATE * seconds))


def wav(*parts: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
        w.writeframes((np.concatenate(parts) * 32767).astype(np.int16).tobytes())
    return out.getvalue()


def recordings() -> dict[str, bytes]:
    rising = np.linspace(0.05, 0.6, int(RATE * 0.6))
    phrase = tone(300, 0.6, 1.0) * rising
    return {
        "nasal": wav(tone(2000, 0.3), tone(300, 0.2), tone(2000, 0.3)),
        "echo": wav(tone(500, 0.05, 0.01), tone(500, 0.05, 0.2), tone(500, 0.1, 0.4), quiet(0.1)),
        "flat": wav(tone(500, 0.3)),
        "restart": wav(tone(300, 1.2), quiet(2.4), tone(300, 1.5)),
        "repeat": wav(phrase, quiet(0.3), phrase, quiet(0.3), phrase[::-1]),
        "pauses": wav(tone(300, 0.9), quiet(0.45), tone(300, 0.9), quiet(0.9), tone(300, 0.9)),
    }


def _files(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in recordings().items()], "file_id string, content binary")


def _spans(spark, *rows):
    return spark.createDataFrame(list(rows), "file_id string, start_ms double, end_ms double")


def nasal_stretches(spark, d):
    """The nasal stretch of a recording with 200 ms of low energy, of a part without any, and of an absent one."""
    def kernel(x, rate):
        return signal.nasal_stretch(x, rate, 200.0)

    seg = _spans(spark, ("nasal", 0.0, 800.0), ("nasal", 0.0, 250.0), ("absent", 0.0, 100.0))
    m = signal.measure(seg, _files(spark), kernel, "acoustic_ms double, found boolean, corrected boolean")
    return m.select("file_id", "end_ms", F.round(F.col("acoustic_ms") / 20).alias("frames_of_20"), "found", "corrected")


def echoes(spark, d):
    """Closure of 50 ms, rise to 20 and 40 times its level; and a sound without closure."""
    def kernel(x, rate):
        e = signal.echo(x, rate, 100.0)
        return e and e | {"skip_reason": e["skip"]}

    m = signal.measure(_spans(spark, ("echo", 0.0, 300.0), ("flat", 0.0, 200.0)), _files(spark), kernel, "peak_ratio double, sustain_ms double, release_ms double, skip_reason string")
    return m.select("file_id", F.round("peak_ratio").alias("peak_ratio"), "sustain_ms", "release_ms", "skip_reason")


def _over_files(spark, names, rows):
    """A row for each number that ``rows(samples, rate)`` gives of each recording."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(r.file_id, k, int(v)) for r in pdf.itertuples(index=False) for k, v in enumerate(rows(*signal.decode_wav(r.content)))]
            yield pd.DataFrame(out, columns=["file_id", "ordinal", "ms"])

    files = _files(spark).where(F.col("file_id").isin(*names))
    return files.mapInPandas(run, "file_id string, ordinal bigint, ms bigint")


def voice_activity(spark, d):
    """Starts and ends of speech, in order."""
    return _over_files(spark, ["restart", "pauses"], lambda x, rate: [v for s in signal.voice_activity(x, rate) for v in s])


def restarts(spark, d):
    """Where the last attempt begins; recordings without a long pause have none."""
    return _over_files(spark, ["restart", "pauses", "flat"], lambda x, rate: [v for v in [signal.restart_ms(x, rate)] if v is not None])


def repeated_phrases(spark, d):
    """Phrases that the next one repeats: the first of three, as the last runs backwards."""
    return _over_files(spark, ["repeat", "pauses"], lambda x, rate: [v for s in signal.repetitions(x, rate) for v in s])


def silent_boundaries(spark, d):
    """Middles of the pauses; of two, the longer where one is expected."""
    both = _over_files(spark, ["pauses"], lambda x, rate: signal.dual_silences(x, rate))
    one = _over_files(spark, ["pauses"], lambda x, rate: signal.dual_silences(x, rate, expected=1))
    return both.withColumn("expected", F.lit(2)).unionByName(one.withColumn("expected", F.lit(1)))


def segment_files(spark, d):
    """Segments cut out with 100 ms of silence on both sides, read back."""
    seg = spark.createDataFrame([("pauses", 1, 0.0, 500.0), ("pauses", 2, 900.0, 1350.0), ("absent", 1, 0.0, 9.0)], "file_id string, segment int, start_ms double, end_ms double")
    parts = corpus.segment_files(seg, _files(spark), 100.0).withColumn("file_id", F.concat_ws("-", "file_id", "segment"))
    whole = parts.select("file_id", F.lit(0.0).alias("start_ms"), F.lit(10_000.0).alias("end_ms"))
    m = signal.measure(whole, parts, lambda x, rate: {"ms": len(x) / rate * 1000, "loud": float(np.abs(x).max() > 0.1)}, "ms double, loud double")
    return m.select("file_id", "ms", "loud")


def audio_files(spark, d):
    """Paths of verses' recordings, and kinds of uploads by their first bytes."""
    rows = [(1, 7, b"RIFF0000WAVEx"), (112, 1, b"OggSxxxx"), (36, 83, b"ID3xxxx"), (2, 286, b"nothing!")]
    f = spark.createDataFrame([(c, v, bytearray(b)) for c, v, b in rows], "chapter int, verse int, content binary")
    return f.select(corpus.audio_path("/data/", F.col("chapter"), F.col("verse")).alias("path"), corpus.is_audio(F.col("content")).alias("kind"))


TIERS = (
    ("f1", "words", 0, 0.0, 0.5, ""), ("f1", "words", 1, 0.5, 1.0, 'a"b'), ("f1", "words", 2, 1.0, 1.5, "c"), ("f1", "phones", 0, 0.5, 0.7, "a"),
    ("f1", "phones", 1, 0.7, 1.0, "b"), ("f1", "phones", 2, 1.0, 1.5, "c"), ("f1", "phones", 3, 1.5, 1.6, "z"), ("f2", "words", 0, 0.0, 2.0, "item [2]:"), ("f2", "phones", 0, 0.0, 2.0, ""),
)


def _tiers(spark):
    return spark.createDataFrame(list(TIERS), "file_id string, tier string, idx int, xmin double, xmax double, text string")


def textgrid_round_trip(spark, d):
    """Tiers written as file texts and read back."""
    return textgrid.parse_textgrids(textgrid.textgrid_text(_tiers(spark)))


def phones_in_words(spark, d):
    return textgrid.phones_in_words(_tiers(spark)).select("file_id", F.col("word_idx").cast("bigint").alias("word_idx"), "word", "phone", "start", "end")


ALIGNED = """{"surah": 2, "num_ayahs": 2, "verses": [
 {"surah": 2, "ayah": 5, "text": "t5", "file_id": "002_005", "duration": 3.5, "words": [
  {"text": "w0", "word_index": 0, "start": 0.1, "end": 0.4, "duration_ms": 300.0, "phones": [
   {"ipa": "a", "mfa": "a", "start": 0.1, "end": 0.2, "duration_ms": 100.0, "tajweed_rules": ["r", "q"], "alignment_confidence": "high"},
   {"ipa": "n", "mfa": "n", "start": 0.2, "end": 0.4, "duration_ms": 200.0, "tajweed_rules": [], "alignment_confidence": "low", "geminate_pair": true, "geminate_total_ms": 250.0, "geminate_position": "first"}]},
  {"text": "w1", "word_index": 1, "start": 0.4, "end": 0.9, "duration_ms": 500.0, "phones": [
   {"ipa": "b", "mfa": "b", "start": 0.4, "end": 0.9, "duration_ms": 120.0, "tajweed_rules": ["x"], "alignment_confidence": "high", "is_verse_final": true,
    "verse_final_silence_trimmed": true, "original_duration_ms": 500.0, "trimmed_duration_ms": 120.0, "skip_assessment": true}]}]},
 {"surah": 2, "ayah": 1, "text": "t1", "file_id": "002_001", "duration": 1.0, "words": [
  {"text": "v0", "word_index": 0, "start": 0.0, "end": 1.0, "duration_ms": 1000.0, "phones": [{"ipa": "m", "mfa": "m", "start": 0.0, "end": 1.0, "duration_ms": 1000.0}]}]}]}"""


def aligned_round_trip(spark, d):
    """An aligned chapter read, written, and read again: everything is still there."""
    first = corpus.parse_aligned(spark.createDataFrame([(ALIGNED,)], "value string"))
    again = corpus.parse_aligned(corpus.aligned_json(first).select("value"))
    return again.select(
        "chapter", "verse", "verse_text", "duration", "word_idx", "word", "word_start", "word_ms", "phone_idx", "ipa", "duration_ms", F.array_join("rules", ",").alias("rules"), "confidence",
        "skip_assessment", "is_verse_final", "verse_final_silence_trimmed", "original_duration_ms", "trimmed_duration_ms", "geminate_pair", "geminate_total_ms", "geminate_position",
    )


CORPUS = '{"metadata":{},"surahs":[{"number":1,"name":"x","ayahs":[{"number":1,"text":"t1","juz":1},{"number":2,"text":"t2"}]},{"number":2,"name":"y","ayahs":[{"number":1,"text":"u1"}]}]}'


def corpus_scan(spark, d):
    """All verses of a corpus, one looked up by its key, and rows that ask for their text."""
    c = corpus.parse_corpus(spark.createDataFrame([(CORPUS,)], "value string"))
    asked = spark.createDataFrame([(1, 2), (2, 9)], "chapter int, verse int")
    parts = [("scan", c), ("lookup", corpus.lookup(c, 2, 1)), ("joined", corpus.with_verses(asked, c))]
    out = [p.select(F.lit(n).alias("how"), "chapter", "verse", "text") for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def dictionary_lines(spark, d):
    """Distinct pronunciations of words as lines of a dictionary, and a word that it lacks."""
    s = spark.createDataFrame([(1, 0, "w", "a"), (1, 1, "w", "b"), (2, 0, "w", "a"), (3, 0, "v", "c"), (4, 0, "w", "a")], "k int, pos int, word string, s string")
    entries = corpus.dictionary(s, ["k"], "word", "pos", "s")
    lacking = corpus.missing_words(spark.createDataFrame([("w",), ("q",)], "word string"), entries)
    return corpus.dictionary_lines(entries).unionByName(lacking.select(F.concat(F.lit("missing "), "word").alias("value")))


RULE_FILE = """
rules:
- name: one
  category: madd
  priority: 5
  pattern: {target: '[a b]', following_context: '![m b]', conditions: {long: true}}
- name: two
  priority: 9
  pattern: {target: c, preceding_context: [a, x]}
- name: bad
  colour: red
"""
SYMBOLS = (("a", "m", True), ("a", "c", True), ("b", "a", False), ("c", "c", None), ("a", None, None))


def rule_file_scan(spark, d):
    """Rules of a file, the faulty one left out, matched over a sequence."""
    from seqloom.operators import context

    found, problems = rule_files.parse_rules(RULE_FILE)
    s = spark.createDataFrame([(1, i, x, long) for i, (x, _, long) in enumerate(SYMBOLS)], "k int, pos int, symbol string, long boolean")
    m = rules.match(context.with_neighbours(s, ["k"], ["pos"], ["symbol"]), found)
    return m.select("pos", "symbol", "rule", "category", "priority", F.lit(len(problems)).alias("n_problems"))


def recovered_segments(spark, d):
    """Short segments merged with what follows, long ones cut at marks."""
    seg = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 9.0), ("a", 9.0, 30.0), ("a", 30.0, 31.0), ("b", 0.0, 5.0)], "file_id string, start double, end double")
    want = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 8.0), ("b", 1, 0.0)], "file_id string, verse int, length double")
    marks = spark.createDataFrame([("a", 15.0), ("a", 4.0), ("b", 2.0)], "file_id string, at double")
    return repair.recover_segments(seg, want, 0.5, marks, 2.0)


def allocated_words(spark, d):
    """Recordings cut at their silences until no part exceeds 30 seconds, words shared out by length."""
    rec = spark.createDataFrame([("a", 50.0, 10), ("b", 5.0, 3), ("c", 100.0, 7)], "file_id string, duration double, n_words int")
    still = spark.createDataFrame([("a", 24.0, 25.0), ("a", 10.0, 10.2), ("c", 49.0, 51.0), ("c", 20.0, 21.0)], "file_id string, start double, end double")
    return repair.split_recordings(rec, still, 30.0)


_PHONES = "chapter int, verse int, pos int, word_idx int, word string, ipa string, duration_ms double, word_ms double, rules array<string>, confidence string, skip boolean, is_final boolean, geminate_position string, geminate_total_ms double"


def _phone(pos, rule, ms, ipa="aː", conf="high", skip=False, final=False, half=None, total=None, word=0, word_ms=500.0):
    return (1, 1, pos, word, "w", ipa, float(ms), word_ms, [rule], conf, skip, final, half, total)


def _calibration(spark):
    return spark.createDataFrame([(1, 100.0, 80.0, 1.0)], "chapter int, unit_ms double, short_median_ms double, tolerance double")


def long_vowels(spark, d):
    """Bands of long vowels: right, style, minor, major, skipped, last, and beside a doubtful sound."""
    rows = [
        _phone(0, "madd_tabii", 200), _phone(1, "madd_tabii", 300), _phone(2, "madd_tabii", 110), _phone(3, "madd_tabii", 70), _phone(4, "madd_muttasil", 260),
        _phone(5, "madd_muttasil", 300, conf="low"), _phone(6, "madd_lazim_kalimi", 480), _phone(7, "none", 30, ipa="n", conf="low"), _phone(8, "madd_muttasil", 320, skip=True),
        _phone(9, "madd_tabii", 700, final=True, word=1), _phone(10, "madd_muttasil", 250, word=1), _phone(11, "none", 500, ipa="m", word=1), _phone(12, "madd_munfasil", 140, word=1),
    ]
    a = severity.assess_long_vowels(spark.createDataFrame(rows, _PHONES), _calibration(spark), ["chapter"])
    return a.select("pos", "rule", "effective", "status", "severity", "expected", "actual")


def nasal_sounds(spark, d):
    """Bands of nasal sounds by their measured or aligned length."""
    rows = [
        (*_phone(0, "iqlab", 200), None, None, None), (*_phone(1, "iqlab", 1600), None, None, None), (*_phone(2, "iqlab", 900), None, 0.1, 50.0), (*_phone(3, "iqlab", 900), None, 0.9, 5.0),
        (*_phone(4, "ghunnah_mushaddadah_noon", 90, half="second"), None, None, None), (*_phone(5, "ghunnah_mushaddadah_noon", 90, half="first", total=250.0), None, None, None),
        (*_phone(6, "ikhfaa_light", 50), 120.0, None, None), (*_phone(7, "ikhfaa_heavy", 50), None, None, None), (*_phone(8, "iqlab", 200, conf="failed"), None, None, None), (*_phone(9, "iqlab", 105), None, None, None),
    ]
    a = assess.assess_nasal(spark.createDataFrame(rows, _PHONES + ", acoustic_ms double, voiced double, pitch_std double"), _calibration(spark), ["chapter"])
    return a.select("pos", "rule", "status", "severity")


def echoed_sounds(spark, d):
    rows = [
        (*_phone(0, "qalqalah_major", 90), 1.0, 0.0, None), (*_phone(1, "qalqalah_major", 90), 2.0, 10.0, None), (*_phone(2, "qalqalah_major", 90), 2.0, 20.0, None), (*_phone(3, "qalqalah_minor", 90), 1.49, 0.0, None),
        (*_phone(4, "qalqalah_minor", 90), 1.5, 19.0, None), (*_phone(5, "qalqalah_minor", 90), 9.0, 50.0, "no_closure_detected"), (*_phone(6, "qalqalah_minor", 25), 9.0, 50.0, None), (*_phone(7, "qalqalah_minor", 90), None, None, None),
    ]
    a = assess.assess_echo(spark.createDataFrame(rows, _PHONES + ", peak_ratio double, sustain_ms double, skip_reason string"))
    return a.select("pos", "rule", "status", "echo", "severity")


def timbre(spark, d):
    """Concealed nasals by mean nasality; heavy sounds and backed vowels by their second formant."""
    rows = [(*_phone(i, rule, 90, conf=conf), nasal, f2) for i, (rule, nasal, f2, conf) in enumerate([
        ("ikhfaa_light", 0.04, None, "high"), ("ikhfaa_light", 0.05, None, "high"), ("ikhfaa_heavy", 0.08, None, "high"), ("ikhfaa_heavy", 0.56, None, "high"), ("ikhfaa_light", None, None, "high"), ("ikhfaa_light", 0.3, None, "low"),
        ("tafkhim", None, 1199.0, "high"), ("tafkhim", None, 1500.0, "high"), ("tafkhim", None, 1501.0, "high"), ("vowel_backing_after_emphatic_short", None, 1399.0, "low"),
        ("vowel_backing_before_emphatic_short", None, 2500.0, "high"), ("vowel_backing_before_emphatic_long", None, 2501.0, "high"),
    ])]
    s = spark.createDataFrame(rows, _PHONES + ", mean_nasality double, f2_hz double")
    parts = [a.select("pos", "rule", "status", "verdict", "severity") for a in (assess.assess_concealed(s), assess.assess_heavy(s), assess.assess_backing(s))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def frame_votes(spark, d):
    f = spark.createDataFrame([(0, ["a", "b", "b"]), (1, ["b", "a"]), (2, []), (3, ["c", "a", "c"])], "k int, labels array<string>")
    return f.select("k", assess.majority_vote(F.col("labels"), ["a", "b", "c"]).alias("vote"))


def unit_pool(spark, d):
    """Sounds that may tell the length of a count."""
    rows = [
        _phone(0, "none", 90, ipa="a"), _phone(1, "none", 29, ipa="a"), _phone(2, "madd_tabii", 90, ipa="i"), _phone(3, "none", 90, ipa="u", conf="low"), _phone(4, "none", 90, ipa="n"),
        _phone(5, "none", 90, ipa="u", half="first"), _phone(6, "iqlab", 30, ipa="i"), _phone(7, "none", 90, ipa="i", final=True),
    ]
    return spark.createDataFrame(rows, _PHONES).where(assess.eligible_for_unit()).select("pos", "duration_ms")


_ALL = recitation.Config(find_restarts=True, flag_repetitions=True, recover_segments=True, trim_finals=True, pair_geminates=True, grade_confidence=True)


def preprocessed(spark, d):
    """Start of the last attempt, length and number of repeated phrases of each recording, with every step on and off."""
    f = _files(spark).where(F.col("file_id").isin("restart", "repeat", "pauses"))
    both = [recitation.preprocess(f, c).withColumn("steps", F.lit(n)) for n, c in (("all", _ALL), ("none", recitation.Config()))]
    return both[0].unionByName(both[1]).select("file_id", "steps", "from_ms", "length_ms", F.size("repeated").cast("bigint").alias("n_repeated"))


def segmented(spark, d):
    """A recording of three verses cut at its two pauses, and one whose second attempt alone counts."""
    f = _files(spark).where(F.col("file_id").isin("restart", "pauses"))
    want = spark.createDataFrame([("pauses", 1, 1000.0), ("pauses", 2, 1500.0), ("pauses", 3, 1300.0), ("restart", 1, 1500.0)], "file_id string, verse int, length double")
    return recitation.segment(f, recitation.preprocess(f, _ALL), want, _ALL)


def postprocessed(spark, d):
    """A long last sound trimmed, a pair of equal sounds, and confidence lowered beside a failed one."""
    rows = [("a", 90.0, "high"), ("n", 60.0, "high"), ("n", 70.0, "high"), ("i", 30.2, "high"), ("b", 80.0, "failed"), ("u", 95.0, "high"), ("m", 900.0, "high")]
    s = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "verse int, pos int, symbol string, duration_ms double, confidence string")
    p = recitation.postprocess(s, ["verse"], _ALL)
    return p.select("pos", "symbol", F.round("trimmed", 2).alias("trimmed"), "pair", "pair_total", "confidence")


QUERIES = {f.__name__: f for f in (
    nasal_stretches, echoes, voice_activity, restarts, repeated_phrases, silent_boundaries, segment_files, audio_files, textgrid_round_trip, phones_in_words,
    aligned_round_trip, corpus_scan, dictionary_lines, rule_file_scan, recovered_segments, allocated_words, long_vowels, nasal_sounds, echoed_sounds, timbre,
    frame_votes, unit_pool, preprocessed, segmented, postprocessed,
)}


def rows(columns: str, *values: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({v})' for v in values)}) AS v({columns})"


_PHONE_COLUMNS = """chapter, verse, verse_text, duration, word_idx, word, word_start, word_ms, phone_idx, ipa, duration_ms, rules, confidence, skip_assessment, is_verse_final, verse_final_silence_trimmed,
    original_duration_ms, trimmed_duration_ms, geminate_pair, geminate_total_ms, geminate_position"""
ORACLES = {
    "voice_activity": rows("file_id, ordinal, ms", "'restart', 0, 0", "'restart', 1, 1200", "'restart', 2, 3600", "'restart', 3, 5100", "'pauses', 0, 0", "'pauses', 1, 900", "'pauses', 2, 1350", "'pauses', 3, 2250", "'pauses', 4, 3150", "'pauses', 5, 4050"),
    "restarts": rows("file_id, ordinal, ms", "'restart', 0, 3600"),
    "repeated_phrases": rows("file_id, ordinal, ms", "'repeat', 0, 0", "'repeat', 1, 600"),
    "silent_boundaries": rows("file_id, ordinal, ms, expected", "'pauses', 0, 1125, 2", "'pauses', 1, 2700, 2", "'pauses', 0, 2700, 1"),
    "nasal_stretches": rows("file_id, end_ms, frames_of_20, found, corrected", "'nasal', 800.0::DOUBLE, 10.0::DOUBLE, true, false", "'nasal', 250.0, 10.0, false, false", "'absent', 100.0, NULL, NULL, NULL"),
    "echoes": rows("file_id, peak_ratio, sustain_ms, release_ms, skip_reason", "'echo', 40.0::DOUBLE, 150.0::DOUBLE, 50.0::DOUBLE, NULL", "'flat', 1.0, 0.0, 0.0, 'no_closure_detected'"),
    "segment_files": rows("file_id, ms, loud", "'pauses-1', 700.0::DOUBLE, 1.0::DOUBLE", "'pauses-2', 650.0, 0.0"),
    "audio_files": rows("path, kind", "'/data/surah_1_wav16k/001_007.wav', 'wav'", "'/data/surah_112_wav16k/112_001.wav', 'ogg'", "'/data/surah_36_wav16k/036_083.wav', 'mp3'", "'/data/surah_2_wav16k/002_286.wav', NULL"),
    "textgrid_round_trip": rows("file_id, tier, idx, xmin, xmax, text", *[f"'{f}', '{t}', {i}, {a}::DOUBLE, {b}::DOUBLE, '{x}'" for f, t, i, a, b, x in TIERS]),
    "phones_in_words": rows('file_id, word_idx, word, phone, start, "end"', "'f1', 1, 'a\"b', 'a', 0.5::DOUBLE, 0.7::DOUBLE", "'f1', 1, 'a\"b', 'b', 0.7, 1.0", "'f1', 2, 'c', 'c', 1.0, 1.5"),
    "aligned_round_trip": rows(
        _PHONE_COLUMNS, "2, 5, 't5', 3.5::DOUBLE, 0, 'w0', 0.1::DOUBLE, 300.0::DOUBLE, 0, 'a', 100.0::DOUBLE, 'r,q', 'high', false, false, false, NULL::DOUBLE, NULL::DOUBLE, false, NULL::DOUBLE, NULL",
        "2, 5, 't5', 3.5, 0, 'w0', 0.1, 300.0, 1, 'n', 200.0, '', 'low', false, false, false, NULL, NULL, true, 250.0, 'first'", "2, 5, 't5', 3.5, 1, 'w1', 0.4, 500.0, 0, 'b', 120.0, 'x', 'high', true, true, true, 500.0, 120.0, false, NULL, NULL",
        "2, 1, 't1', 1.0, 0, 'v0', 0.0, 1000.0, 0, 'm', 1000.0, '', 'high', false, false, false, NULL, NULL, false, NULL, NULL",
    ),
    "corpus_scan": rows("how, chapter, verse, text", "'scan', 1, 1, 't1'", "'scan', 1, 2, 't2'", "'scan', 2, 1, 'u1'", "'lookup', 2, 1, 'u1'", "'joined', 1, 2, 't2'", "'joined', 2, 9, NULL"),
    "dictionary_lines": rows("value", "'v' || chr(9) || 'c'", "'w' || chr(9) || 'a'", "'w' || chr(9) || 'a b'", "'missing q'"),
    "rule_file_scan": rows("pos, symbol, rule, category, priority, n_problems", "0, 'a', 'one', 'madd', 5, 1", "1, 'a', NULL, NULL, NULL, NULL") + " WHERE rule IS NOT NULL",
    "recovered_segments": rows('file_id, ordinal, start, "end", confidence', "'a', 1, 0.0::DOUBLE, 9.0::DOUBLE, 'recovered'", "'a', 2, 9.0, 15.0, 'recovered'", "'a', 3, 15.0, 30.0, 'recovered'", "'a', 4, 30.0, 31.0, 'low'", "'b', 1, 0.0, 5.0, 'high'"),
    "preprocessed": rows("file_id, steps, from_ms, length_ms, n_repeated", "'restart', 'all', 3600, 5100, 0", "'restart', 'none', 0, 5100, 0", "'repeat', 'all', 0, 2400, 1", "'repeat', 'none', 0, 2400, 0", "'pauses', 'all', 0, 4050, 0", "'pauses', 'none', 0, 4050, 0"),
    "segmented": rows('file_id, ordinal, start, "end", confidence', "'pauses', 1, 0.0::DOUBLE, 1125.0::DOUBLE, 'high'", "'pauses', 2, 1125.0, 2700.0, 'high'", "'pauses', 3, 2700.0, 4050.0, 'high'", "'restart', 1, 3600.0, 5100.0, 'high'"),
    "postprocessed": rows("pos, symbol, trimmed, pair, pair_total, confidence", "0, 'a', NULL::DOUBLE, NULL, NULL::DOUBLE, 'high'", "1, 'n', NULL, 'first', 130.0, 'high'", "2, 'n', NULL, 'second', 130.0, 'high'", "3, 'i', NULL, NULL, NULL, 'low'", "4, 'b', NULL, NULL, NULL, 'failed'",
        "5, 'u', NULL, NULL, NULL, 'low'", "6, 'm', 70.87, NULL, NULL, 'low'"),
    "frame_votes": rows("k, vote", "0, 'b'", "1, 'a'", "2, NULL", "3, 'c'"),
    "unit_pool": rows("pos, duration_ms", "0, 90.0::DOUBLE", "6, 30.0"),
    "echoed_sounds": rows("pos, rule, status, echo, severity", "0, 'qalqalah_major', 'assessed', 'absent', 'major'", "1, 'qalqalah_major', 'assessed', 'weak', 'minor'", "2, 'qalqalah_major', 'assessed', 'present', NULL", "3, 'qalqalah_minor', 'assessed', 'absent', 'minor'",
        "4, 'qalqalah_minor', 'assessed', 'weak', 'style'", "5, 'qalqalah_minor', 'skipped', NULL, NULL", "6, 'qalqalah_minor', 'skipped', NULL, NULL", "7, 'qalqalah_minor', 'skipped', NULL, NULL"),
    "timbre": rows("pos, rule, status, verdict, severity", "0, 'ikhfaa_light', 'assessed', 'izhar_error', 'major'", "1, 'ikhfaa_light', 'assessed', 'under_nasalized', 'minor'", "2, 'ikhfaa_heavy', 'assessed', 'pass', NULL", "3, 'ikhfaa_heavy', 'assessed', 'over_nasalized', 'style'",
        "4, 'ikhfaa_light', 'skipped', NULL, NULL", "5, 'ikhfaa_light', 'skipped', NULL, NULL", "6, 'tafkhim', 'assessed', 'pass', NULL", "7, 'tafkhim', 'assessed', 'borderline', 'minor'", "8, 'tafkhim', 'assessed', 'tarqiq_error', 'major'",
        "9, 'vowel_backing_after_emphatic_short', 'assessed', 'pass', NULL", "10, 'vowel_backing_before_emphatic_short', 'assessed', 'borderline', 'minor'", "11, 'vowel_backing_before_emphatic_long', 'assessed', 'front_vowel_error', 'major'"),
    "nasal_sounds": rows("pos, rule, status, severity", "0, 'iqlab', 'assessed', NULL", "1, 'iqlab', 'assessed', 'style'", "2, 'iqlab', 'assessed', 'style'", "3, 'iqlab', 'assessed', 'minor'", "5, 'ghunnah_mushaddadah_noon', 'assessed', NULL",
        "6, 'ikhfaa_light', 'assessed', NULL", "7, 'ikhfaa_heavy', 'assessed', 'major'", "8, 'iqlab', 'skipped', NULL", "9, 'iqlab', 'assessed', 'style'"),
}


#: A few verses in full script.
VERSES = (
    (1, 1, "بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ"),
    (1, 2, "ٱلْحَمْدُ لِلَّهِ رَبِّ ٱلْعَٰلَمِينَ"),
    (1, 5, "إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ"),
    (2, 1, "الٓمٓ"),
    (112, 1, "قُلْ هُوَ ٱللَّهُ أَحَدٌ"),
    (112, 3, "لَمْ يَلِدْ وَلَمْ يُولَدْ"),
    (113, 1, "قُلْ أَعُوذُ بِرَبِّ ٱلْفَلَقِ"),
)


def _verse_sounds(spark):
    from seqloom.plans import phonology

    return phonology.phonemize(spark.createDataFrame(list(VERSES), "chapter int, verse int, text string"))


def verse_sounds(spark, d):
    return corpus.transcripts(_verse_sounds(spark), ["chapter", "verse"], "pos", "symbol").select("chapter", "verse", F.col("value").alias("sounds"))


def verse_rules(spark, d):
    from seqloom.plans import phonology

    s = _verse_sounds(spark)
    return corpus.annotated(s, phonology.apply_rules(s), ["chapter", "verse"]).select("chapter", "verse", F.col("value").alias("annotated"))


def verse_durations(spark, d):
    from seqloom.plans import phonology

    s = _verse_sounds(spark)
    e = phonology.expected_durations(s, phonology.apply_rules(s))
    return e.groupBy("chapter", "verse").agg(F.count("*").alias("n_sounds"), F.round(F.sum("expected_ms"), 3).alias("expected_ms"))


def verse_dictionary(spark, d):
    from seqloom.plans import phonology

    s = _verse_sounds(spark).withColumn("mfa", phonology.aligner_symbol("symbol"))
    return corpus.dictionary(s, ["chapter", "verse", "word_idx"], "word", "pos", "mfa")


QUERIES |= {f.__name__: f for f in (verse_sounds, verse_rules, verse_durations, verse_dictionary)}

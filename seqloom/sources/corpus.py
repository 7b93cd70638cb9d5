"""Text corpora, transcripts, pronunciation dictionaries and aligned chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal

CORPUS = (
    "metadata struct<source:string,edition:string,version:string>, surahs array<struct<number:int,name:string,name_arabic:string,"
    "revelation_type:string,ayahs:array<struct<number:int,text:string,juz:int,manzil:int,page:int>>>>"
)
PHONE = (
    "struct<ipa:string,mfa:string,start:double,end:double,duration_ms:double,tajweed_rules:array<string>,alignment_confidence:string,"
    "skip_assessment:boolean,is_verse_final:boolean,verse_final_silence_trimmed:boolean,original_duration_ms:double,trimmed_duration_ms:double,geminate_pair:boolean,geminate_total_ms:double,geminate_position:string>"
)
ALIGNED = (
    "surah int, num_ayahs int, verses array<struct<surah:int,ayah:int,text:string,file_id:string,duration:double,words:array<struct<text:string,"
    f"word_index:int,start:double,end:double,duration_ms:double,phones:array<{PHONE}>>>>>"
)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """chapter, name, verse, text, juz, manzil, page of the JSON files at a path."""
    return parse_corpus(_whole(spark, path))


def parse_corpus(files: DataFrame) -> DataFrame:
    """The same from rows of JSON text in ``value``."""
    s = files.select(F.explode(F.from_json("value", CORPUS)["surahs"]).alias("s")).select("s.number", "s.name", F.explode("s.ayahs").alias("a"))
    return s.select(
        F.col("number").alias("chapter"), "name", F.col("a.number").alias("verse"), F.col("a.text").alias("text"), "a.juz", "a.manzil", "a.page"
    )


def with_verses(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows of (chapter, verse, ...) with the verse's text; null where the corpus has none."""
    return rows.join(corpus.select("chapter", "verse", "text"), ["chapter", "verse"], "left")


def lookup(corpus: DataFrame, chapter: int, verse: int) -> DataFrame:
    """One verse by its key: the filter reaches the scan of a stored corpus."""
    return corpus.where((F.col("chapter") == chapter) & (F.col("verse") == verse))


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Phones of the aligned chapters at a path, one row each; optional keys have their defaults."""
    return parse_aligned(_whole(spark, path))


def parse_aligned(files: DataFrame) -> DataFrame:
    """The same from rows of JSON text in ``value``."""
    a = files.select(F.from_json("value", ALIGNED).alias("a")).select("a.*")
    v = a.select(F.col("surah").alias("chapter"), F.explode("verses").alias("v"))
    of_verse = ["chapter", "verse", "file_id", "verse_text", "duration"]
    w = v.select(
        "chapter", F.col("v.ayah").alias("verse"), "v.file_id", F.col("v.text").alias("verse_text"), "v.duration", F.posexplode("v.words").alias("k", "w")
    )
    p = w.select(
        *of_verse, F.coalesce("w.word_index", "k").alias("word_idx"), F.col("w.text").alias("word"), F.col("w.start").alias("word_start"),
        F.col("w.end").alias("word_end"), F.col("w.duration_ms").alias("word_ms"), F.posexplode("w.phones").alias("phone_idx", "p"),
    )
    flag = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(False)).alias(c)
    return p.select(
        *of_verse, "word_idx", "word", "word_start", "word_end", "word_ms", "phone_idx", "p.ipa", "p.mfa", "p.start", "p.end", "p.duration_ms",
        F.coalesce("p.tajweed_rules", F.array().cast("array<string>")).alias("rules"), F.coalesce("p.alignment_confidence", F.lit("high")).alias("confidence"),
        flag("skip_assessment"), flag("is_verse_final"), flag("verse_final_silence_trimmed"), "p.original_duration_ms", "p.trimmed_duration_ms",
        flag("geminate_pair"), "p.geminate_total_ms", "p.geminate_position",
    )


def aligned_json(phones: DataFrame) -> DataFrame:
    """chapter, value: one JSON text a chapter in the form that ``read_aligned`` reads; to_json leaves
    null and, here, false keys out, and what belongs to a false key."""
    yes = lambda c: F.when(F.col(c), True).alias(c)
    only = lambda flag, c: F.when(F.col(flag), F.col(c)).alias(c)
    phone = F.struct(
        "ipa", "mfa", "start", "end", "duration_ms", F.col("rules").alias("tajweed_rules"), F.col("confidence").alias("alignment_confidence"),
        yes("skip_assessment"), yes("is_verse_final"), yes("verse_final_silence_trimmed"), only("verse_final_silence_trimmed", "original_duration_ms"),
        only("verse_final_silence_trimmed", "trimmed_duration_ms"), yes("geminate_pair"), only("geminate_pair", "geminate_total_ms"), only("geminate_pair", "geminate_position"),
    )
    in_order = lambda order, x: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.alias("x")))), lambda e: e["x"])
    w = phones.groupBy("chapter", "verse", "file_id", "verse_text", "duration", "word_idx", "word", "word_start", "word_end", "word_ms").agg(in_order("phone_idx", phone).alias("phones"))
    word = F.struct(
        F.col("word").alias("text"), F.col("word_idx").alias("word_index"), F.col("word_start").alias("start"), F.col("word_end").alias("end"),
        F.col("word_ms").alias("duration_ms"), "phones",
    )
    v = w.groupBy("chapter", "verse", "file_id", "verse_text", "duration").agg(in_order("word_idx", word).alias("words"))
    verse = F.struct(F.col("chapter").alias("surah"), F.col("verse").alias("ayah"), F.col("verse_text").alias("text"), "file_id", "duration", "words")
    c = v.groupBy("chapter").agg(in_order("verse", verse).alias("verses"))
    return c.select("chapter", F.to_json(F.struct(F.col("chapter").alias("surah"), F.size("verses").alias("num_ayahs"), "verses")).alias("value"))


def transcripts(texts: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """key, value: texts of a key in order, one line (label files)."""
    return texts.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("value")
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, phones from tab-separated lines; a repeated word is a variant."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.instr("value", "\t") > 0).select(parts[0].alias("word"), F.trim(parts[1]).alias("phones"))


def dictionary(sounds: DataFrame, key: list[str], word: str, order: str, symbol: str) -> DataFrame:
    """word, phones: each distinct pronunciation of each word, sorted."""
    per = sounds.groupBy(*key, word).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, symbol))), lambda x: x[symbol]), " ").alias("phones")
    )
    return per.select(F.col(word).alias("word"), "phones").distinct().orderBy("word", "phones")


def dictionary_lines(entries: DataFrame) -> DataFrame:
    return entries.select(F.concat_ws("\t", "word", "phones").alias("value"))


def annotated(sounds: DataFrame, apps: DataFrame, key: list[str], order: str = "pos", symbol: str = "symbol") -> DataFrame:
    """key, value: symbols in order, each with its rules in brackets."""
    r = apps.groupBy(*key, order).agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("_r"))
    s = sounds.join(r, [*key, order], "left").withColumn("_t", F.concat(F.col(symbol), F.coalesce(F.concat(F.lit("["), "_r", F.lit("]")), F.lit(""))))
    return s.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))), lambda x: x["_t"]), " ").alias("value"))


def missing_words(words: DataFrame, entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct words (with the columns ``keep``) without an entry in the dictionary."""
    return words.select(*keep, "word").distinct().join(entries.select("word").distinct(), "word", "left_anti")


def variants(forms: DataFrame, word: str, form: str) -> DataFrame:
    """word, variants, n: the distinct forms of each word, sorted."""
    g = forms.select(word, form).distinct().groupBy(word).agg(F.sort_array(F.collect_list(form)).alias("variants"))
    return g.withColumn("n", F.size("variants").cast("bigint"))


def json_per_key(rows: DataFrame, key: list[str], items: str, *columns) -> DataFrame:
    """key, json: one JSON text a key with its rows as a sorted list; null keys are left out."""
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(items))
    return g.select(*key, F.to_json(F.struct(*key, items)).alias("json"))


#: Fixed values: (kind, place from 0, first bytes in hex) of accepted files, and endings of their names.
SIGNATURES = (
    ("wav", 0, "52494646"), ("mp3", 0, "494433"), ("mp3", 0, "FFFB"), ("mp3", 0, "FFF3"), ("mp3", 0, "FFF2"), ("aac", 0, "FFF1"), ("aac", 0, "FFF9"),
    ("ogg", 0, "4F676753"), ("m4a", 4, "66747970"),
)
ENDINGS = ("wav", "m4a", "mp3", "aac", "mp4", "ogg")
MOST_BYTES = 50 * 1024 * 1024


def is_audio(content: Column) -> Column:
    """Kind of an uploaded file by its first bytes; null: none that is accepted."""
    out = None
    for kind, at, head in SIGNATURES:
        hit = F.hex(F.substring(content, at + 1, len(head) // 2)) == head
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def upload_problem(name: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """Why an upload is turned away, the first of its name, its size and its first bytes; null: it is not."""
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1))
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return (
        F.when(~ending.isin(*ENDINGS), "format is not supported").when(size == 0, "file is empty").when(size > most, "file is too large")
        .when(is_audio(content).isNull(), "format is not supported")
    )


def audio_path(base: str, chapter: Column, verse: Column) -> Column:
    """Where the recording of a verse lies: a folder for each chapter, keys of three digits."""
    return F.concat(F.lit(base.rstrip("/") + "/surah_"), chapter.cast("string"), F.lit("_wav16k/"), F.format_string("%03d_%03d.wav", chapter, verse))


def segment_files(segments: DataFrame, files: DataFrame, padding_ms: float = 0.0, read=signal.content) -> DataFrame:
    """segments(file_id, segment, start_ms, end_ms), files(file_id, content) -> file_id, segment, content: a
    16-bit file of each segment with silence around it; a recording is read once, an absent one gives none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                file, parts = batch.column("file")[k].as_py(), batch.column("segments")[k].as_py()
                if file is not None:
                    cut = signal.cut_wavs(read(file), [(p["start_ms"], p["end_ms"]) for p in parts], padding_ms)
                    columns = [pa.array([p["file_id"] for p in parts], pa.string()), pa.array([p["segment"] for p in parts], pa.int32()), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file_id", "segment", "content"])

    joined = signal.with_segments(segments, files, ["file_id", "segment", "start_ms", "end_ms"])
    return joined.mapInArrow(run, "file_id string, segment int, content binary")

"""Interval tiers in TextGrid files: reading many files at once, writing one text a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A text ends at a quote that is not doubled; a doubled one stands for one quote.
_TEXT = r'"((?:[^"]|"")*+)"'
_TIER = rf'(?s)name = {_TEXT}(.*?)(?=item \[\d+\]:\s*class = |\z)'
_INTERVAL = rf'(?s)xmin = ([-\d.]+)\s*xmax = ([-\d.]+)\s*text = {_TEXT}'


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """file_id, tier, idx, xmin, xmax, text (empty: silence) of every file under a path or glob."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.TextGrid)?$", 1).alias("file_id"), "value"
    )
    return parse_textgrids(files)


def parse_textgrids(files: DataFrame) -> DataFrame:
    """The same from (file_id, value) rows."""
    names = F.regexp_extract_all("value", F.lit(_TIER), F.lit(1))
    bodies = F.regexp_extract_all("value", F.lit(_TIER), F.lit(2))
    tiers = files.select("file_id", F.explode(F.arrays_zip(names.alias("tier"), bodies.alias("body"))).alias("t")).select("file_id", "t.*")
    part = lambda k: F.regexp_extract_all("body", F.lit(_INTERVAL), F.lit(k))
    rows = tiers.select("file_id", "tier", F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("idx", "i"))
    return rows.select(
        "file_id", "tier", "idx", F.col("i.a").cast("double").alias("xmin"), F.col("i.b").cast("double").alias("xmax"), F.replace("i.c", F.lit('""'), F.lit('"')).alias("text")
    )


def phones_in_words(intervals: DataFrame, words: str = "words", phones: str = "phones") -> DataFrame:
    """file_id, word_idx, word, phone_idx, phone, start, end: spoken phones under spoken words.

    A phone belongs to the first word that ends after the phone starts; silences of both
    tiers are left out. Words of a file do not overlap, so that word is the next end to come.
    """
    spoken = intervals.where(F.col("text") != "")
    w = spoken.where(F.col("tier") == words).select(
        "file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("idx")).alias("word_idx"), F.col("text").alias("word"), "xmin", "xmax"
    )
    p = spoken.where(F.col("tier") == phones).select("file_id", F.col("idx").alias("phone_idx"), F.col("text").alias("phone"), "xmin", "xmax")
    tagged = p.select("file_id", F.col("xmin").alias("at"), F.lit(1).alias("kind"), F.struct("phone_idx", "phone", "xmin", "xmax").alias("p"), F.lit(None).cast("struct<word_idx:int,word:string>").alias("w"))
    ends = w.select("file_id", F.col("xmax").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("struct<phone_idx:int,phone:string,xmin:double,xmax:double>").alias("p"), F.struct("word_idx", "word").alias("w"))
    both = tagged.unionByName(ends)
    # a phone that starts where a word ends belongs to the next word: ends come first at equal times
    o = Window.partitionBy("file_id").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    hit = both.withColumn("own", F.first("w", ignorenulls=True).over(o)).where("kind = 1 AND own IS NOT NULL")
    return hit.select(
        "file_id", "own.word_idx", "own.word", "p.phone_idx", "p.phone", F.col("p.xmin").alias("start"), F.col("p.xmax").alias("end")
    )


def _tier_text(name: Column, index: int, n: Column, end: Column, body: Column) -> Column:
    number = lambda x: F.format_string("%.6f", x)
    head = F.concat(
        F.lit(f"    item [{index}]:\n        class = \"IntervalTier\"\n        name = \""), name, F.lit('"\n        xmin = 0\n        xmax = '),
        number(end), F.lit("\n        intervals: size = "), n.cast("string"), F.lit("\n"),
    )
    return F.concat(head, body)


def textgrid_text(intervals: DataFrame, tiers: tuple[str, ...] = ("words", "phones")) -> DataFrame:
    """file_id, value: the file text of each file's tiers, for a text writer."""
    number = lambda x: F.format_string("%.6f", x)
    one = F.concat(
        F.lit("        intervals ["), (F.col("n")).cast("string"), F.lit("]:\n            xmin = "), number(F.col("xmin")),
        F.lit("\n            xmax = "), number(F.col("xmax")), F.lit('\n            text = "'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'),
    )
    rows = intervals.withColumn("n", F.row_number().over(Window.partitionBy("file_id", "tier").orderBy("idx")))
    per = rows.groupBy("file_id", "tier").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("s")))), lambda x: x["s"]), "\n").alias("body"),
        F.count("*").alias("size"), F.max("xmax").alias("end"),
    )
    head = lambda end: F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), number(end), F.lit(f"\ntiers? <exists>\nsize = {len(tiers)}\nitem []:\n"))
    g = per.groupBy("file_id").agg(
        F.max("end").alias("end"), *[F.max(F.when(F.col("tier") == t, F.struct("size", "body"))).alias(f"t{i}") for i, t in enumerate(tiers)]
    )
    parts = [
        _tier_text(F.lit(t), i + 1, F.coalesce(F.col(f"t{i}.size"), F.lit(0)), F.col("end"), F.coalesce(F.col(f"t{i}.body"), F.lit("")))
        for i, t in enumerate(tiers)
    ]
    return g.select("file_id", F.concat(head(F.col("end")), *[x for p in parts for x in (p, F.lit("\n"))]).alias("value"))

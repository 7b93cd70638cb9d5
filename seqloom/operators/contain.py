"""Which texts contain which others, by their rarest short pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; a shorter needle is a piece of its own length.
PIECE = 3


def pieces(text: Column, size: int) -> Column:
    """Distinct overlapping pieces of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def containments(needles: DataFrame, texts: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """needle, text: every pair of distinct values of which the second contains the first, itself included.

    Pieces of texts are counted; a needle asks for its rarest piece alone, and only texts that have
    it are compared. A needle with a piece that no text has goes before the join. Pieces that no
    needle chose never leave their text. A piece that many texts share is a hot key of a plain inner
    join, which AQE splits; needles that chose it are few, as they have none that is rarer.

    Null and empty values of either side pair with nothing; repeated rows count once; texts of any
    length are read whole. Other columns are left to the caller, who joins them by the value.
    """
    wanted = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    held = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    length = F.least(F.length("needle"), F.lit(PIECE))
    own = F.coalesce(*[F.when(length == n, pieces(F.col("needle"), n)) for n in range(1, PIECE + 1)])
    asked = wanted.select("needle", F.explode(own).alias("piece"))
    # only sizes that some needle has are cut out of the texts: at most PIECE of them
    used = sorted(r[0] for r in wanted.select(length.alias("size")).distinct().collect())
    if not used:
        return wanted.select("needle", F.lit(None).cast("string").alias("text")).limit(0)
    cut = held.select("text", F.explode(F.flatten(F.array(*[pieces(F.col("text"), n) for n in used]))).alias("piece"))
    counts = cut.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = (
        asked.join(counts, "piece", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
        .where("least.n > 0").select("needle", F.col("least.piece").alias("piece"))
    )
    return cut.join(rarest, "piece").where(F.contains("text", "needle")).select("needle", "text")


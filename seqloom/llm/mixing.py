"""Mixing sources to target weights by balanced (cube-method) sampling.

Every source gets a target number of words. A document is taken floor(r) times
whole, with r = target / size of its source, and once more with the remaining
fraction as its inclusion probability. The flight phase of the cube method moves
these fractional probabilities inside the null-space of two constraints, the words
taken and the documents taken, until fewer than ``CONSTRAINTS + 1`` are
fractional. It runs in blocks of about ``BLOCK`` documents of one source, so a
source that holds a third of all rows is many small tasks; what each block leaves
fractional (two documents at most) meets again in blocks of the next level. At the
last level a source is one block and lands: the constraints are dropped one by one,
the document count first.

Size: number of runs of characters other than ASCII white space. Sources by code
point, null last, weigh 5, 2, 1, 5, ... and share ``SHARE`` of all sizes; a target
stops at ``CAP`` times its source's size and the excess is shared again by weight,
which is the water-filling t = min(CAP * size, level * weight).

Defined cases: a null text has size 0; a null source is a source of its own;
documents of size 0 take 0 words; repeated rows are documents of their own; an
empty table gives an empty result; a source of size 0 has target 0. Draws are seeded
by source and block, and rows are ordered within a block by doc_id, size and the hash of
their text, so reruns agree however the input is partitioned; rows alike in all of
these are interchangeable. Blocks are chosen by the same three, so rows without a
doc_id are spread by their texts; ``mix`` returns every column of its input.
"""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 4096
CONSTRAINTS = 2
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
#: Source tables of at most this many rows are broadcast, larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000
EPS = 1e-9

WORD = r"[^\x20\x09-\x0D]+"


def flight(prob: list[float], x: list[float], rng: random.Random, p: int = CONSTRAINTS) -> list[int]:
    """Move ``prob`` in place until at most ``p`` of it are fractional; returns their places.

    Kept constant: sum(prob * x) where p is 2, and sum(prob). A window of p + 1
    fractional units has a null vector; each step carries one unit to 0 or 1.
    """
    held: list[int] = []
    for i in range(len(prob)):
        if not EPS < prob[i] < 1 - EPS:
            prob[i] = float(round(prob[i]))
            continue
        held.append(i)
        while len(held) == p + 1:
            if p == 2:
                a, b, c = (x[k] for k in held)
                u = (b - c, c - a, a - b)
                if not any(u):
                    u = (1.0, -1.0, 0.0)
            elif p == 1:
                u = (1.0, -1.0)
            else:
                u = (1.0,)
            up = min([(1 - prob[k]) / d if d > 0 else prob[k] / -d for k, d in zip(held, u) if d])
            down = min([prob[k] / d if d > 0 else (1 - prob[k]) / -d for k, d in zip(held, u) if d])
            step = up if rng.random() * (up + down) < down else -down
            for k, d in zip(held, u):
                prob[k] = min(1.0, max(0.0, prob[k] + step * d))
                if not EPS < prob[k] < 1 - EPS:
                    prob[k] = float(round(prob[k]))
            held = [k for k in held if EPS < prob[k] < 1 - EPS]
    return held


def land(prob: list[float], x: list[float], rng: random.Random, held: list[int]) -> None:
    """Decide the units that the flight left: words stay balanced longest, then by chance."""
    # with one constraint left it is the words: the null vector of (x1, x2) is (x2, -x1)
    while len(held) >= 2:
        i, j = held[:2]
        u = (x[j], -x[i]) if x[i] and x[j] else (1.0, 0.0) if not x[i] else (0.0, 1.0)
        moves = [(k, d) for k, d in zip((i, j), u) if d]
        up = min((1 - prob[k]) / d if d > 0 else prob[k] / -d for k, d in moves)
        down = min(prob[k] / d if d > 0 else (1 - prob[k]) / -d for k, d in moves)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in moves:
            prob[k] = min(1.0, max(0.0, prob[k] + step * d))
            if not EPS < prob[k] < 1 - EPS:
                prob[k] = float(round(prob[k]))
        held = [k for k in held if EPS < prob[k] < 1 - EPS]
    for k in held:
        prob[k] = float(rng.random() < prob[k])


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources(source, source_size, n_docs) -> the same with ``weight`` and ``target``.

    The rank of a source comes from a range-partitioned sort and the rows of the
    partitions before it, so no task holds all sources.
    """
    ordered = cut(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    counts = sorted((r[0], r[1], r[2]) for r in ordered.groupBy("_part").agg(F.count("*"), F.min("_row")).collect())
    before, offsets = 0, []
    for part, n, first in counts:  # a row for each partition
        offsets += [F.lit(part), F.lit(before - first)]
        before += n
    if not offsets:
        return sources.select("*", F.lit(1.0).alias("weight"), F.lit(0.0).alias("target"))
    rank = F.col("_row") + F.create_map(*offsets)[F.col("_part")]
    array = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(
        ordered.withColumn("weight", F.get(array, (rank % len(weights)).cast("int"))).drop("_part", "_row")
    )

    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # each round caps at least one more source, or ends
        capped = F.col("source_size") * cap <= level * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(capped, F.col("source_size") * cap).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not row[1]:
            break
        new = (total - row[0]) / row[1]
        if new <= level * (1 + 1e-15):
            break
        level = new
    target = F.least(F.col("source_size") * cap, F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target.cast("double"))


def _decide(last: bool):
    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "size", "hash", "frac"], kind="stable", na_position="last", ignore_index=True)
        rng = random.Random(zlib.crc32(repr((key[0], int(key[1]), int(key[2]))).encode()))
        prob, x = pdf["frac"].tolist(), [float(v) for v in pdf["size"]]
        order = list(range(len(prob)))
        rng.shuffle(order)
        p, y = [prob[i] for i in order], [x[i] for i in order]
        held = flight(p, y, rng)
        if last:
            land(p, y, rng, held)
        for at, i in enumerate(order):
            prob[i] = p[at]
        pdf["frac"] = prob
        return pdf

    return run


def cube_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units(doc_id, hash, source, size, n_docs, frac, ...) -> the same with frac 0.0 or 1.0.

    ``n_docs`` is the number of units of the source. Levels of blocks follow each
    other until every source fits into one; each level leaves at most
    ``CONSTRAINTS`` of a block's units to the next.
    """
    schema = units.schema
    most = units.agg(F.max("n_docs")).first()[0] or 0
    done, level = [], 0
    while True:
        last = most <= block
        n = F.ceil(F.col("n_docs") / F.lit(block))
        spread = F.pmod(F.xxhash64("doc_id", "size", "hash", F.lit(level)), n)
        keyed = units.withColumn("_b", F.lit(0).cast("bigint") if last else spread).withColumn("_l", F.lit(level))
        out = cut(
            keyed.groupBy("source", "_b", "_l")
            .applyInPandas(_decide(last), keyed.schema)
            .select(*schema.fieldNames())
        )
        if last:
            done.append(out)
            break
        open_ = (F.col("frac") > 0) & (F.col("frac") < 1)
        done.append(out.where(~open_))
        rest = out.where(open_)
        # at most CONSTRAINTS of each block are left: one count for each source
        left = rest.groupBy("source").agg(F.count("*").alias("n_docs"))
        units = rest.drop("n_docs").join(
            left.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        ).select(*schema.fieldNames())
        most = left.agg(F.max("n_docs")).first()[0] or 0
        level += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def drawn(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken and the columns ``keep``."""
    sized = cut(
        docs.select(
            F.col("doc_id").cast("bigint"), F.col("source").cast("string").alias("source"), *keep,
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
            F.xxhash64("text").alias("hash"),
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = cut(with_targets(cut(sources), weights, share, cap).drop("weight"))
    side = sources.withColumnRenamed("source", "_s")
    if sources.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sized.join(side, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("whole", F.floor(ratio + EPS))
        .withColumn("frac", F.when(F.col("size") > 0, F.greatest(ratio - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    )
    units = units.withColumn("n_docs", F.col("n_docs").cast("bigint"))
    copies = (F.col("whole") + F.col("frac").cast("bigint")).cast("bigint")
    return cube_sample(units).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *keep,
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken beside its own columns.

    Rows are numbered and written once to the shared folder; the draw works on numbers and
    sizes, and its decisions come back to the rows by number. Columns of ``docs`` of those
    five names give way.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    rows = cut(docs.drop(*new).withColumn("_row", F.monotonically_increasing_id()))
    found = drawn(rows, ("_row",), weights, share, cap).select(F.col("_row").alias("_drawn"), *new)
    return rows.join(found, F.col("_row") == F.col("_drawn")).drop("_row", "_drawn")


def mix_report(docs: DataFrame) -> DataFrame:
    """The thin result of the query."""
    return drawn(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")

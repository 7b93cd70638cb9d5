"""Documents drawn by how much likelier their n-grams are in a target corpus than in their own.

1. Texts are cut into features a block of documents at a time: what leaves a block is its distinct
   strings with their totals, and its documents as packed (document, code of string, count).
2. One dictionary of distinct strings over all blocks, own and target corpus together; each string
   is hashed there, once, and buckets are summed.
3. Gains go back to the strings of each block and from there to its documents. A string that is
   in very many blocks is joined by broadcast, of which there are at most ``HOT`` by definition
   (more than a ``HOT``-th of all entries each); all others are shuffled, and no key of that
   join holds more than a ``HOT``-th of the entries.
4. The draw: scores are integers in a narrow range, so their counts tell the lowest drawn score;
   the rows from there up are ordered by ranges and numbered from the sizes of the ranges.

Defined cases: a null or empty text has no features and weight 0; a row without a doc_id is a
document whose seed ends at the colon and comes last among ties; rows that repeat a doc_id are
documents each, equal ones in any order; empty tables give no rows, an empty target an empty
count; other columns are ignored. A text of any length is one entry of its block.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, pack, scratch, tidy, unpack

#: Shares of all entries: strings in more blocks than that are broadcast, so at most this many.
HOT = 50_000
#: Longer strings are never broadcast.
HOT_CHARS = 256
#: Digits, a-z and everything beyond ASCII stay, A-Z become small, the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BLOCK = "block bigint, doc_ids array<bigint>, n_words binary, n_features binary, pairs binary, features array<string>, totals array<bigint>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features_of(words: list[bytes], n: int) -> list[bytes]:
    """Runs of 1 to n consecutive words, joined by one space, repeats counted."""
    if n == 1:
        return words
    return [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def packed_pairs(doc: np.ndarray, code: np.ndarray, times: np.ndarray) -> bytes:
    parts = [pack(a.astype(np.int32)) for a in (doc, code)] + [pack(times.astype(np.int64))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpacked_pairs(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind in (np.int32, np.int32, np.int64):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def block_counts(texts: list[bytes], n: int):
    """(words of each text, features of each text, (document, code, count), strings, totals) of a block."""
    codes: dict[bytes, int] = defaultdict(count().__next__)
    n_words, n_features, docs, firsts, times = [], [], [], [], []
    for at, text in enumerate(texts):
        words = words_of(text)
        found = features_of(words, n)
        code, many = np.unique(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)), return_counts=True)
        n_words.append(len(words))
        n_features.append(len(found))
        docs.append(np.full(len(code), at))
        firsts.append(code)
        times.append(many)
    flat = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in (docs, firsts, times)]
    totals = np.bincount(flat[1], flat[2], len(codes)).astype(np.int64)
    return np.array(n_words, np.int64), np.array(n_features, np.int64), flat, list(codes), totals


def counted_blocks(texts: DataFrame, n: int) -> DataFrame:
    """Blocks of (doc_id, text), written once: their documents and their distinct strings."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words, n_features, pairs, strings, totals = block_counts(as_bytes(batch.column("text")), n)
            row = {
                "block": pa.array([block], pa.int64()),
                "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "n_words": pa.array([pack(n_words)], pa.binary()),
                "n_features": pa.array([pack(n_features)], pa.binary()),
                "pairs": pa.array([packed_pairs(*pairs)], pa.binary()),
                "features": pa.array([[s.decode() for s in strings]], pa.list_(pa.string())),
                "totals": pa.array([totals], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(row)
            block += 1

    session = texts.sparkSession
    path = scratch(session, "importance-blocks")
    texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), _BLOCK).write.parquet(path)
    return session.read.parquet(path)


def entries(blocks: DataFrame) -> DataFrame:
    """block, code, feature, total: a row for each distinct string of a block."""
    zipped = blocks.select("block", F.posexplode(F.arrays_zip("features", "totals")).alias("code", "_e"))
    return zipped.select("block", "code", F.col("_e.features").alias("feature"), F.col("_e.totals").alias("total"))


def dictionary(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """feature, s, t, blocks, bucket: every distinct string of both corpora, hashed once."""
    zero = F.lit(0).cast("bigint")
    both = own.select("feature", F.col("total").alias("s"), zero.alias("t"), F.lit(1).cast("bigint").alias("blocks")).unionAll(
        target.select("feature", zero.alias("s"), F.col("total").alias("t"), zero.alias("blocks"))
    )
    summed = both.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("s", "t", "blocks")))
    return summed.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def bucket_gains(strings: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: at most ``buckets`` rows."""
    sums = cut(strings.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    all_s, all_t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("int").alias("gain"))


def document_weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    bounded_batches(docs.sparkSession)
    blocks = counted_blocks(docs.select("doc_id", "text"), n)
    wanted = counted_blocks(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), n)
    own = entries(blocks)
    strings = cut(dictionary(own, entries(wanted), buckets))
    total = strings.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    gained = strings.where("blocks > 0").join(F.broadcast(bucket_gains(strings, buckets)), "bucket").select("feature", "blocks", "gain")
    is_hot = (F.col("blocks") * hot > total) & (F.length("feature") <= HOT_CHARS)
    first = own.select("block", "code", "feature").join(F.broadcast(gained.where(is_hot).select("feature", "gain")), "feature", "left")
    rest = first.where("gain IS NULL").drop("gain").join(gained.where(~is_hot).select("feature", "gain"), "feature")
    known = first.where("gain IS NOT NULL").select("block", "code", "gain").unionAll(rest.select("block", "code", "gain"))
    by_block = known.groupBy("block").agg(F.collect_list(F.struct("code", "gain")).alias("gains"))  # a block's own strings

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                doc, code, times = unpacked_pairs(r["pairs"])
                n_words, n_features = unpack(r["n_words"], np.int64), unpack(r["n_features"], np.int64)
                gain = np.zeros(len(r["gains"] or ()), np.int64)
                for g in r["gains"] or ():
                    gain[g["code"]] = g["gain"]
                total = np.zeros(len(n_words), np.int64)
                np.add.at(total, doc, times * gain[code])
                values = [pa.array(r["doc_ids"], pa.int64()), n_words, n_features, total // np.maximum(n_features, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["doc_id", "n_words", "n_features", "weight"])

    sides = blocks.select("block", "doc_ids", "n_words", "n_features", "pairs").join(by_block, "block", "left")
    return sides.mapInArrow(tidy(weigh), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int, doc_id) -> F.Column:
    """floor(-1000 ln(-ln u)), u from a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order: ranges are sorted in parallel and each
    starts where the ones before it end. Equal rows are split too, by the salt."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(parts, *order, "_salt").sortWithinPartitions(*order, "_salt")
    fixed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + (F.col("_at") - F.shiftleft("_part", 33)) + 1
    return fixed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_salt", "_at", "_part", "_n", "_before")


def drawn(scored: DataFrame, eligible, share: int) -> DataFrame:
    """``rank`` of the best ``share`` percent of the eligible rows, null for all others.

    ``scored`` is written: it is read more than once.
    """
    counts = scored.where(eligible).groupBy("score").count().orderBy(F.desc("score")).collect()  # integers in a narrow range
    size = share * sum(r["count"] for r in counts) // 100
    least, have = None, 0
    for r in counts:
        if have >= size:
            break
        least, have = r["score"], have + r["count"]
    no_rank = F.lit(None).cast("bigint")
    if least is None:
        return scored.withColumn("rank", no_rank)
    chosen = eligible & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = numbered(scored.where(chosen), order, "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    return placed.unionByName(scored.where(~chosen).withColumn("rank", no_rank))


def importance_draw(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, share: int = 10, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the undrawn have no rank."""
    weights = document_weights(docs, target, n, buckets)
    scored = cut(weights.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
    found = drawn(scored, F.col("n_words") >= least_words, share)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is worked out a byte at a time: shifting eight bits and adding the polynomial where a one falls out.
_EIGHT = "list_reduce([xor({0}, {1}), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"

ORACLE = f"""
WITH own AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
own_counts AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM own) GROUP BY r, w),
strings AS (
  SELECT w, sum(s) AS s, sum(t) AS t FROM (
    SELECT w, sum(n) AS s, 0 AS t FROM own_counts GROUP BY w
    UNION ALL SELECT w, 0, count(*) FROM (SELECT unnest(words) AS w FROM target) GROUP BY w) GROUP BY w),
hashed AS (
  SELECT w, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(w))) // 2 + 1),
    lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT))),
    lambda c, byte: {_EIGHT.format("c", "byte")}), 4294967295) % 10000 AS bucket FROM strings),
buckets AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM buckets),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM buckets, totals),
weights AS (
  SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
  FROM own_counts JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM own LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, CAST(s.n_features AS BIGINT) AS n_features, s.weight, s.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p USING (r)
"""

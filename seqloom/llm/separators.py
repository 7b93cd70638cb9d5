"""Token counts from flat token files by scanning for separators.

A token file is one run of fixed-width token ids with an end-of-document id after each
document and no index. It is read as blocks (file, block, data). Each block is searched
for separators in one vectorised comparison; a prefix scan over block lengths and last
separators stitches documents that cross blocks. The scan goes in two levels,
superblocks of ``SUPER`` blocks and blocks within them, so no task holds a large file.

Defined cases: an empty document has 0 tokens; tokens after a file's last separator are
a document without an end and are returned with ``ended`` false; empty blocks count
nothing; a null block of data is empty; blocks may arrive in any order, and (file, block)
must be unique. Texts of documents: null is empty; rows that repeat a doc_id are counted
each; a very long text crosses as many blocks as it needs; an empty table gives no
rows; other columns are ignored. Ids have 2 bytes, or 4 where an id above 65,535 occurs.

What a scan finds of each block (its length and separators) is written once to the shared
folder, so tokenising happens once, and the numbers of files, which are numbers of
partitions, are the same for all later steps.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, tidy

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
EOD = 50256
#: Fixed value: the pattern that splits text before merges, which belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens in a block of a file, and blocks in a superblock.
BLOCK = 1 << 16
SUPER = 1024

BLOCKS = "file bigint, block bigint, data binary, labels array<bigint>"


def load_encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A public byte-level vocabulary; ids of special tokens never come from text."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def kind_of(encoding, eod: int) -> str:
    """Type of the ids in a file: the narrowest that holds every id of the vocabulary and the separator."""
    return "uint16" if max(encoding.max_token_value, eod) < 1 << 16 else "uint32"


def token_files(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """Flat token blocks of ``docs``, a file for each partition; blocks cut documents anywhere.

    ``labels`` are the doc_ids whose separators lie in the block, in order; they are not
    part of the file and only name the counts that the scan finds.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoding = load_encoding(folder, vocabulary)
        kind = kind_of(encoding, eod)
        file, block = TaskContext.get().partitionId(), 0
        held, n, ends, labels = [], 0, [], []  # tokens not yet written, and where their documents end

        def rows(last: bool):
            nonlocal held, n, ends, labels, block
            every = np.concatenate(held) if held else np.zeros(0, kind)
            size = n if last else n // BLOCK * BLOCK
            out, done = [], 0
            for at in range(0, size, BLOCK):
                stop = min(at + BLOCK, size)
                until = int(np.searchsorted(ends, stop))
                out.append((file, block, every[at:stop].tobytes(), labels[done:until]))
                done, block = until, block + 1
            held, n = [every[size:]], n - size
            ends, labels = [e - size for e in ends[done:]], labels[done:]
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            names = ["file", "block", "data", "labels"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoding.encode_to_numpy(text or "", disallowed_special=())
                held.append(np.append(ids, eod).astype(kind))
                n += len(ids) + 1
                ends.append(n - 1)
                labels.append(doc_id)
            yield rows(False)
        yield rows(True)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), BLOCKS)


def read_token_files(df: DataFrame, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks of rows of Spark's ``binaryFile`` source (path, content)."""
    step = block * width
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / step).cast("int")))
    return df.where(F.length("content") > 0).select(F.xxhash64("path").alias("file"), "content", cut.alias("block")).select(
        "file", F.col("block").cast("bigint"), F.expr(f"substring(content, block * {step} + 1, {step})").alias("data"),
        F.lit(None).cast("array<bigint>").alias("labels"),
    )


def separator_counts(blocks: DataFrame, eod: int = EOD, kind: str = "uint16") -> DataFrame:
    """Per document of the files: file, ordinal, start, n_tokens, ended, blocks (touched), label."""
    bounded_batches(blocks.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            n, ends = [], []
            for data in batch.column("data").to_pylist():
                ids = np.frombuffer(data or b"", kind)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == eod))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"), batch.column("block"), pa.array(n, pa.int64()),
                    pa.array(ends, pa.list_(pa.int64())), batch.column("labels"),
                ],
                names=["file", "block", "n", "ends", "labels"],
            )

    found = blocks.select("file", "block", "data", "labels").mapInArrow(
        tidy(scan), "file bigint, block bigint, n bigint, ends array<bigint>, labels array<bigint>"
    )
    found = cut(found).withColumn("super", F.floor(F.col("block") / SUPER))
    # within a superblock: what lies before a block, and the last separator before it
    inside = Window.partitionBy("file", "super").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))
    local = found.withColumn("last", F.last(last, ignorenulls=True).over(before)).withColumn("own", last)
    local = local.withColumn("seen", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    # between superblocks: one row for each
    totals = local.groupBy("file", "super").agg(
        F.sum("n").alias("sn"), F.max("own").alias("slast"), F.sum(F.size("ends")).alias("sends")
    )
    over = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("sn").over(over), F.lit(0)))
    totals = totals.withColumn(
        "carried", F.coalesce(F.last(F.col("base") + F.col("slast"), ignorenulls=True).over(over), F.lit(-1))
    ).withColumn("ordinals", F.coalesce(F.sum("sends").over(over), F.lit(0)))
    placed = local.join(totals.select("file", "super", "base", "carried", "ordinals"), ["file", "super"])
    start = F.col("base") + F.col("at")
    begin = F.coalesce(F.col("base") + F.col("last"), F.col("carried"))
    placed = placed.withColumn("labels", F.coalesce("labels", F.array().cast("array<bigint>")))
    docs = placed.where(F.size("ends") > 0).select(
        "file", "block", start.alias("start"), begin.alias("begin"), "ends",
        (F.col("ordinals") + F.col("seen")).alias("first"), F.posexplode(F.arrays_zip("ends", "labels")),
    )
    earlier = F.when(F.col("pos") == 0, F.col("begin")).otherwise(F.col("start") + F.expr("element_at(ends, pos)"))
    ended = docs.select(
        "file", (F.col("first") + F.col("pos")).alias("ordinal"), (earlier + 1).alias("begins"),
        (F.col("start") + F.col("col.ends") - earlier - 1).alias("n_tokens"), F.lit(True).alias("ended"),
        F.col("col.labels").alias("label"),
    )
    tail = totals.groupBy("file").agg(
        F.max(F.col("base") + F.col("sn")).alias("length"), F.max(F.col("base") + F.col("slast")).alias("end"),
        F.sum("sends").alias("ordinal"),
    )
    open_ = tail.select(
        "file", "ordinal", (F.coalesce("end", F.lit(-1)) + 1).alias("begins"),
        (F.col("length") - F.coalesce("end", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("ended"),
        F.lit(None).cast("bigint").alias("label"),
    ).where("n_tokens > 0")
    return ended.unionByName(open_)


def token_count_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of every document, counted in flat token blocks."""
    kind = kind_of(load_encoding(), EOD)
    return separator_counts(token_files(docs), kind=kind).select(F.col("label").alias("doc_id"), "n_tokens")

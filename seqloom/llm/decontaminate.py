"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to words (A-Z lower-cased; letters, digits and
non-ASCII characters form words) and cut into windows of ``size`` consecutive
words; a shorter text is one window. All windows go into a single automaton
which reads each document once. Occurrences are mapped to word numbers and to
code-point offsets in the original text.

The automaton's texts are broadcast, so their size is bounded: distinct benchmark texts are
dealt into shards of about ``SHARD_CHARS`` characters. Each shard is one pass over the
documents with one automaton, built once in a task and broadcast for that pass alone; what
a pass finds travels beside the text to the next one. A usual benchmark is one shard and one
pass. A single item longer than a shard is a shard of its own.

Defined cases: a null or empty document has no words and no hits; a benchmark
text without words gives no window; rows that repeat an ``item_id`` count as one
item (a repeated row adds nothing); a null ``item_id`` counts as the item with the empty id; a document row is
answered as often as it occurs; other columns of both tables are ignored; with an
empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, bounded_batches, cut, tidy

SHARD_CHARS = 4_000_000
WINDOW_WORDS = 10

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: ASCII letters in lower case, digits and bytes of non-ASCII characters stay; the rest are spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, "
    "spans array<struct<start:bigint,end:bigint>>"
)


def fold(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def line_of(data: bytes) -> str:
    """A text's words with a space around each, a byte a character; empty without words.

    One string takes a tenth of the memory of a list of words.
    """
    words = fold(data)
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(item_words: list[bytes], size: int) -> Iterator[bytes]:
    if item_words:
        for i in range(max(1, len(item_words) - size + 1)):
            yield b" ".join(item_words[i : i + size])


class Scanner:
    """Automaton over the windows of some benchmark items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], size: int):
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item_id, text in items:
            for window in windows(fold(text), size):
                owners.setdefault(window, set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            # a byte a character: spaces around the window keep matches on whole words
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def hits(self, line: str) -> list[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of every occurrence in a ``line_of`` a text."""
        if self.empty or not line:
            return []
        out, at, word = [], 0, -1
        for end, (n, ids) in self.automaton.iter(line):  # ends ascend: count the spaces in between once
            word += line.count(" ", at, end + 1)
            at = end + 1
            out.append((word - n, word, ids))
        return out

    def any_hit(self, line: str) -> bool:
        return bool(line) and not self.empty and next(self.automaton.iter(line), None) is not None


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def shards_of(benchmark: DataFrame) -> Iterator:
    """Broadcasts of (item id, text), each of about ``SHARD_CHARS`` characters, one at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // SHARD_CHARS))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    context = benchmark.sparkSession.sparkContext
    for i in range(n):
        yield context.broadcast([(r[0], r[1].encode()) for r in items.where(shard == i).collect()])


def passes(docs: DataFrame, benchmark: DataFrame, step) -> DataFrame:
    """``step(shard)`` -> an Arrow iterator function over ``docs``; one pass for each shard.

    Between passes the rows are written to the shared folder, so a task holds one automaton.
    """
    bounded_batches(docs.sparkSession)
    waiting = None
    for shard in shards_of(benchmark):
        if waiting is not None:
            docs = cut(docs)
            waiting.unpersist()
        docs, waiting = docs.mapInArrow(tidy(step(shard)), docs.schema), shard
    return docs


HITS = "array<struct<a:bigint,b:bigint>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, item_ids, spans.

    ``spans`` are the merged code-point ranges of hit words in the original text.
    """

    def step(shard):
        def scan(batches):
            import pyarrow as pa

            scanner = Scanner(shard.value, size)
            for batch in batches:
                hits, items, n_words = [], [], []
                before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())
                for data, (had, owners) in zip(as_bytes(batch.column("text")), before):
                    line = line_of(data)
                    n_words.append(max(0, line.count(" ") - 1))
                    found = scanner.hits(line)
                    spans = [(h["a"], h["b"]) for h in had] + [(a, b) for a, b, _ in found]
                    hits.append([{"a": a, "b": b} for a, b in merged(spans)])
                    items.append(sorted(set(owners).union(*(x for _, _, x in found))))
                columns = [
                    batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                    pa.array(hits, batch.schema.field("hits").type), pa.array(items, batch.schema.field("items").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "hits", "items"])

        return scan

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            n_hit, spans = [], []
            for data, hits in zip(as_bytes(batch.column("text")), batch.column("hits").to_pylist()):
                n_hit.append(sum(h["b"] - h["a"] for h in hits))
                places = [m.span() for m in _WORD.finditer(data.translate(LOWER).decode())] if hits else []
                spans.append([{"start": places[h["a"]][0], "end": places[h["b"] - 1][1]} for h in hits])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    texts = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"),
        F.lit(0).cast("bigint").alias("n_words"), F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    return passes(texts, benchmark, step).mapInArrow(tidy(finish), SCHEMA)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The thin result of the query: counts and the digest of the item ids."""
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, all columns kept.

    Without a join: a text's verdict is computed beside its columns.
    """

    def step(shard):
        def clean(batches):
            import pyarrow as pa

            scanner = Scanner(shard.value, size)
            for batch in batches:
                yield batch.filter(pa.array([not scanner.any_hit(line_of(x)) for x in as_bytes(batch.column("text"))], pa.bool_()))

        return clean

    return passes(docs, benchmark, step)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

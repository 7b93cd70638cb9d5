"""Nearest vectors by a block matrix join of int8 codes with error bounds.

A vector x has int8 codes c, a step s and an error e = |x - s c|. For two vectors

    q . x = sq sx (cq . cx) + r,   |r| <= |q| ex + eq |sx cx|,

so a tile of products of codes gives every inner product with bounds on both sides. A pair whose
upper bound is below the query's threshold is out; the others are computed from the vectors
themselves, in double precision and in the order of components, and kept in the query's heap. No
pair is lost, so recall is 1; what grows with queries times rows are the products of codes.

- Rows are packed where they are, into blocks of at most ``BLOCK`` vectors, written once; candidates
  are never shuffled. Copies of a vector within a block are one column of the tile with the least
  ids that can matter, so a very common vector is one pair a query and block.
- A bounded sample of rows (``SAMPLE`` vectors) gives each query its first threshold, its k-th best
  lower bound there. It only saves work: every row is still met by every query.
- Queries are sent to the blocks ``QUERY_BYTES`` at a time, one pass over the blocks each; a task
  holds one block and the heaps of those queries, and its heaps are merged by rank.

Defined cases: a vector that is null, empty, all zero, or holds a null or non-finite component takes
no part, neither does a row without a vec_id; rows that repeat a vec_id are candidates each, no
candidate of that id's own query, and as queries one query (with different vectors: the k best of
them together, each row and score once for each vector); vectors of different lengths are not
compared; a score that overflows to no number counts as the least; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scratch, tidy

BLOCK = 4096
#: Rows that first thresholds come from, and the bytes of their vectors at most.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Bytes of queries that are sent to all tasks at once, and queries multiplied at once.
QUERY_BYTES, STEP = 32 << 20, 512
#: Share of a tile's pairs beyond which thresholds are raised from the tile's own lower bounds first.
DENSE = 1 / 64
#: Products of codes are exact in float32 up to this length of vectors.
_EXACT = (1 << 24) // (127 * 127)

_PACK = "dim int, n int, ids binary, starts binary, vecs binary, codes binary, step binary, error binary"


class Block:
    """Distinct vectors with their ids, and their codes.

    ids of vector j are ``ids[starts[j]:starts[j + 1]]``, ascending.
    """

    def __init__(self, dim, ids, starts, vecs, codes, step, error):
        self.ids, self.starts, self.vecs, self.step, self.error = ids, starts, vecs, step, error
        self.codes = codes.astype(np.float32 if dim <= _EXACT else np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt((vecs * vecs).sum(1))
            self.coded = step * np.sqrt((self.codes.astype(float) ** 2).sum(1))

    @classmethod
    def of(cls, r) -> Block:
        """From a row of ``_PACK``, any side's prefix removed."""
        read = lambda name, kind: np.frombuffer(r[name], kind)
        shape = (-1, r["dim"])
        return cls(
            r["dim"], read("ids", np.int64), read("starts", np.int64), read("vecs", float).reshape(shape), read("codes", np.int8).reshape(shape),
            read("step", float), read("error", float),
        )


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, step and error of each vector."""
    step = np.abs(x).max(1, initial=0) / 127
    codes = np.rint(x / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
    left = x - step[:, None] * codes
    with np.errstate(over="ignore"):
        return codes, step, np.sqrt((left * left).sum(1))


def kept_ids(ids: np.ndarray, k: int) -> int:
    """How many of sorted ids can matter: k are left whichever one id is taken out."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    run = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0)) + 1
    enough = np.flatnonzero(np.arange(1, len(ids) + 1) - np.maximum.accumulate(run) >= k)
    return int(enough[0]) + 1 if len(enough) else len(ids)


def packed_block(ids: np.ndarray, x: np.ndarray, k: int | None) -> dict:
    """A row of ``_PACK``. k: copies of a vector are one, with the ids that matter; None: every row is its own."""
    order = np.lexsort((ids,) + tuple(x.T[::-1])) if k is not None else np.arange(len(ids))
    ids, x = ids[order], x[order]
    starts = np.arange(len(ids))
    if k is not None and len(ids):
        starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))
        groups = [g[: kept_ids(g, k)] for g in np.split(ids, starts[1:])]
        x, ids = x[starts], np.concatenate(groups)
        starts = np.cumsum([0, *map(len, groups)])[:-1]
    codes, step, error = coded(x)
    bounds = np.append(starts, len(ids)).astype(np.int64)
    parts = (ids.astype(np.int64), bounds, x, codes, step, error)
    return {"dim": x.shape[1], "n": len(x), **dict(zip(("ids", "starts", "vecs", "codes", "step", "error"), (p.tobytes() for p in parts)))}


def in_order(q: np.ndarray, x: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products of the listed pairs, component after component in double precision."""
    out = np.zeros(len(qi))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(qi), 65536):
            a, b, s = qi[at : at + 65536], ci[at : at + 65536], np.zeros(min(65536, len(qi) - at))
            for d in range(q.shape[1]):
                s += q[a, d] * x[b, d]
            out[at : at + 65536] = s
    return np.where(np.isnan(out), -np.inf, out)


def bounds(q: Block, rows: slice, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the range of every inner product of a tile."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (q.codes[rows] @ c.codes.T) * q.step[rows, None] * c.step
        width = q.norm[rows, None] * (c.error + 1e-9 * c.norm) + q.error[rows, None] * c.coded
    return middle, width


class Heaps:
    """The k best of each query so far, and the score below which nothing is needed."""

    def __init__(self, q: Block, q_ids: np.ndarray, limits: np.ndarray, k: int):
        self.q, self.q_ids, self.k = q, q_ids, k
        self.limits = limits.copy()
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, c: Block) -> None:
        """Every query with every vector of a block."""
        own = self._own_columns(c)
        for at in range(0, len(self.q_ids), STEP):
            rows = slice(at, at + STEP)
            middle, width = bounds(self.q, rows, c)
            alive = ~(middle + width < self.limits[rows, None])
            if alive.mean() > DENSE and middle.shape[1] >= self.k:
                low = np.nan_to_num(middle - width, nan=-np.inf)
                here = (own[0] >= at) & (own[0] < at + STEP)
                low[own[0][here] - at, own[1][here]] = -np.inf
                kth = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
                self.limits[rows] = np.maximum(self.limits[rows], kth)
                alive = ~(middle + width < self.limits[rows, None])
            qi, ci = np.nonzero(alive)
            if len(qi):
                self._push(qi + at, ci, c)

    def _own_columns(self, c: Block) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) where a column holds the query's own id."""
        column = np.repeat(np.arange(len(c.starts) - 1), np.diff(c.starts))
        order = np.argsort(c.ids, kind="stable")
        left, right = (np.searchsorted(c.ids[order], self.q_ids, s) for s in ("left", "right"))
        many = right - left
        qi = np.repeat(np.arange(len(self.q_ids)), many)
        at = np.repeat(left, many) + np.arange(len(qi)) - np.repeat(np.cumsum(many) - many, many)
        return qi, column[order[at]]

    def _push(self, qi: np.ndarray, ci: np.ndarray, c: Block) -> None:
        score = in_order(self.q.vecs, c.vecs, qi, ci)
        keep = score >= self.limits[qi]
        qi, ci, score = qi[keep], ci[keep], score[keep]
        many = c.starts[ci + 1] - c.starts[ci]
        at = np.repeat(c.starts[ci], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        qi, ids, score = np.repeat(qi, many), c.ids[at], np.repeat(score, many)
        other = ids != self.q_ids[qi]
        qi, ids, score = (np.concatenate([old, new[other]]) for old, new in zip(self.rows, (qi, ids, score)))
        order = np.lexsort((ids, -score, qi))
        qi, ids, score = qi[order], ids[order], score[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        full = place == self.k - 1
        self.limits[qi[full]] = np.maximum(self.limits[qi[full]], score[full])
        self.rows = tuple(v[place < self.k] for v in (qi, ids, score))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (array<double>) of the rows that take part."""
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
        .where(fine)
    )


def packed(rows: DataFrame, k: int | None, block: int = BLOCK) -> DataFrame:
    """Blocks of a partition's rows, a length of vectors apart, written once."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(f.split()[0], {"int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in _PACK.split(", ")])
        held: dict[int, list] = {}

        def full(dim, least):
            ids, vecs = (np.concatenate(p) for p in zip(*held[dim]))
            while len(ids) >= least and len(ids):
                yield pa.RecordBatch.from_pylist([packed_block(ids[:block], vecs[:block], k)], schema=schema)
                ids, vecs = ids[block:], vecs[block:]
            held[dim] = [(ids, vecs)]

        for batch in batches:
            vec = batch.column("vec")
            length = np.asarray(vec.value_lengths())
            flat, ids = np.asarray(vec.flatten(), float), np.asarray(batch.column("vec_id"), np.int64)
            ends = np.cumsum(length)
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                held.setdefault(int(dim), []).append((ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]))
                yield from full(int(dim), block)
        for dim in held:
            yield from full(dim, 1)

    return cut(rows.mapInArrow(tidy(run), _PACK))


def sample_blocks(rows: DataFrame) -> dict[int, Block]:
    """A bounded sample in hash order, by length of vectors."""
    first = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE)
    out: dict[int, tuple[list, list]] = {}
    spent = 0
    for r in first.toLocalIterator():
        spent += 8 * len(r.vec)
        if spent > SAMPLE_BYTES and out:
            break
        ids, vecs = out.setdefault(len(r.vec), ([], []))
        ids.append(r.vec_id)
        vecs.append(r.vec)
    return {dim: Block.of(packed_block(np.array(ids, np.int64), np.array(vecs, float), None)) for dim, (ids, vecs) in out.items()}


def with_limits(asked: DataFrame, sample: dict[int, Block], k: int) -> DataFrame:
    """Blocks of queries and each query's k-th best lower bound within the sample, written once."""
    sent = asked.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE_BYTES of vectors and their codes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                q = Block.of(r)
                limits = np.full(len(q.vecs), -np.inf)
                c = sent.value.get(r["dim"])
                if c is not None and len(c.vecs) >= k:
                    for at in range(0, len(limits), STEP):
                        middle, width = bounds(q, slice(at, at + STEP), c)
                        low = np.nan_to_num(middle - width, nan=-np.inf)
                        low[q.ids[at : at + STEP, None] == c.ids[None]] = -np.inf
                        limits[at : at + STEP] = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
                row = pa.RecordBatch.from_pylist([r], schema=batch.schema)
                yield row.append_column("limits", pa.array([limits.tobytes()], pa.binary()))

    return cut(asked.mapInArrow(tidy(run), _PACK + ", limits binary"))


def joined(rows: list) -> dict[int, tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks of queries of each length as one: vectors, ids, limits."""
    out = {}
    for dim in {r["dim"] for r in rows}:
        mine = [r for r in rows if r["dim"] == dim]
        ids = b"".join(r["ids"] for r in mine)
        bounds = np.arange(len(ids) // 8 + 1).tobytes()
        whole = {"dim": dim, "ids": ids, "starts": bounds, **{c: b"".join(r[c] for r in mine) for c in ("vecs", "codes", "step", "error")}}
        out[dim] = Block.of(whole), np.frombuffer(ids, np.int64), np.frombuffer(b"".join(r["limits"] for r in mine), float)
    return out


def searched(blocks: DataFrame, queries: list, k: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best of each query among its own blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast([r.asDict() for r in queries])  # QUERY_BYTES of codes and vectors

    def run(batches):
        import pyarrow as pa

        heaps = {dim: Heaps(q, ids, limits, k) for dim, (q, ids, limits) in joined(sent.value).items()}
        for batch in batches:
            for r in batch.to_pylist():
                if (mine := heaps.get(r["dim"])) is not None:
                    mine.meet(Block.of(r))
        for mine in heaps.values():
            qi, ids, score = mine.rows
            for at in range(0, len(qi), 65536):
                cols = mine.q_ids[qi[at : at + 65536]], ids[at : at + 65536], score[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["query_id", "vec_id", "score"])

    return blocks.mapInArrow(tidy(run), "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, is_query, k: int = 20, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product among all rows but its own.

    ``is_query`` is a condition on vec_id.
    """
    session = vectors.sparkSession
    bounded_batches(session)
    usable = usable_vectors(vectors)
    blocks = packed(usable, k, block)
    asked = with_limits(packed(usable.where(is_query).distinct(), None, STEP), sample_blocks(usable), k)
    asked = cut(asked.withColumn("_turn", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.length("vecs") + F.length("codes")), F.lit(0))).first()[0]
    turns = max(1, -(-size // query_bytes))
    path = scratch(session, "neighbours")
    for turn in range(turns):
        mine = asked.where(F.pmod(F.xxhash64("_turn"), F.lit(turns)) == turn).drop("_turn").collect()
        searched(blocks, mine, k).write.mode("append").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = session.read.parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

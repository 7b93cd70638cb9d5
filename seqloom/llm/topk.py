"""Exact top-k inner products with multi-resolution segment statistics.

Every vector is cut into 1, 4, 16 nearly equal segments; of each segment the mean and the
deviation from it are kept. For a segment of length m

    x . y = m * mean(x) * mean(y) + (x - mean) . (y - mean)
         <= m * (mean(x) * mean(y) + dev(x) * dev(y)),

so the sum over segments bounds the score from above, which is the same as a lower bound
of the distance when both norms are known. The same holds for a block of vectors with the
ranges of its means and its largest deviations. Nothing is approximate.

1. Vectors go to the nearest of a few pivots (a bounded sample of ``PIVOTS`` vectors, only a
   means of putting like vectors together: results do not depend on it), and every pivot's
   vectors into blocks of about ``BLOCK``. Queries are dealt into blocks in the same way.
2. Seeds: a query block meets one block of its own pivot, which gives every query a
   threshold, its k-th best score there; it is global, since the k best of all rows are at least
   as high.
3. Statistics of blocks, ``PAGE`` of them a row, meet the query blocks, and a pair of blocks
   whose bound is below the least threshold, coarse to fine, is out.
4. In the pairs that stay, queries and then candidates are tested coarse to fine against each
   query's threshold, and exact integer scores are computed for the survivors only.

The stated queries meet all rows in blocks: what grows with queries times rows is the test
of two blocks' statistics. No block of vectors is sent to a pair that its statistics rule out.

Components become floor(scale * x). Defined cases: a vector that is null or holds a null
or non-finite component takes no part, neither does a row without a vec_id; rows that
repeat a vec_id are candidates each, no candidate of that id's own query, and as queries
one query (with different vectors: the k best scores of them together); vectors of different
lengths are not compared; scores are exact in 64 bits and stop at the ends of that range,
components at the largest double; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, tidy

BLOCK = 4096
LEVELS = (1, 4, 16)
#: Vectors of the sample that pivots are taken from, pivots at most, and blocks in a row of statistics.
SAMPLE, PIVOTS, PAGE = 4096, 256, 512
EXACT = float(1 << 53)
#: Queries tested together, and the share of pairs from which on matrix products cost less than pairs one by one.
STEP, SPARSE = 256, 1 / 32
#: Tables of pivots of at most this many rows are broadcast.
BROADCAST_PIVOTS = 100_000

_PACK = "dim int, pivot int, piece bigint, n int, ids binary, vecs binary, stats binary"


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Root-length-weighted mean and deviation of each segment: their products bound the inner product."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    mean, dev = np.empty((len(x), segments)), np.empty((len(x), segments))
    for i in range(segments):
        part = x[:, edges[i] : edges[i + 1]]
        m = max(1, part.shape[1])
        mu = part.sum(1) / m
        mean[:, i] = mu * np.sqrt(m)
        dev[:, i] = np.sqrt(((part - mu[:, None]) ** 2).sum(1))
    return mean, dev


def _paired(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Inner products of the listed pairs of rows, a slice of them at a time."""
    parts = [np.einsum("ij,ij->i", q[qi[i : i + 65536]], c[ci[i : i + 65536]]) for i in range(0, len(qi), 65536)]
    return np.concatenate(parts or [np.zeros(0)])


def box_of(x: np.ndarray) -> np.ndarray:
    """Of a block's vectors, for each level: least and largest mean and largest deviation of each segment."""
    out = []
    for level in LEVELS:
        mean, dev = segment_stats(x, level)
        out += [mean.min(0), mean.max(0), dev.max(0)]
    return np.concatenate(out)


def _levels(boxes: np.ndarray):
    """For each level (least means, largest means, deviations) of rows of ``box_of``."""
    at = 0
    for level in LEVELS:
        yield tuple(boxes[..., at + i * level : at + (i + 1) * level] for i in range(3))
        at += 3 * level


def box_bounds(q: np.ndarray, boxes: np.ndarray, limit: float) -> np.ndarray:
    """Whether a block of box ``q`` may reach ``limit`` with each of ``boxes``, coarse to fine."""
    keep = np.arange(len(boxes))
    with np.errstate(over="ignore", invalid="ignore"):
        for (low, high, dev), (lows, highs, devs) in zip(_levels(q), _levels(boxes)):
            a, b, d = lows[keep], highs[keep], devs[keep]
            bound = (np.maximum(np.maximum(low * a, low * b), np.maximum(high * a, high * b)) + dev * d).sum(1)
            keep = keep[~(bound + 1e-9 * np.abs(bound) + 1e-6 < limit)]
    out = np.zeros(len(boxes), bool)
    out[keep] = True
    return out


def block_topk(q_ids, q, c_ids, c, k: int, limits=None):
    """(query place, candidate place, score) of each query's k best among the candidates.

    limits: scores below which a query needs no candidate (None: none is known).
    """
    if not len(q) or not len(c):
        return []
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) >= EXACT:
        return _wide_topk(q_ids, q, c_ids, c, k)
    threshold = np.full(len(q), -np.inf) if limits is None else limits
    stats_q = [segment_stats(q, s) for s in LEVELS]
    stats_c = [segment_stats(c, s) for s in LEVELS]
    out = []
    for at in range(0, len(q), STEP):
        rows = slice(at, at + STEP)
        limit = threshold[rows]
        alive = q_ids[rows, None] != c_ids[None]
        pairs = None
        for (mq, dq), (mc, dc) in zip(stats_q, stats_c):
            if pairs is None:  # all pairs by matrix products, while many are left
                bound = mq[rows] @ mc.T + dq[rows] @ dc.T
                alive &= bound + 1e-9 * np.abs(bound) + 1e-6 >= limit[:, None]
                if alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
            else:
                qi, ci = pairs
                bound = _paired(mq[rows], mc, qi, ci) + _paired(dq[rows], dc, qi, ci)
                keep = bound + 1e-9 * np.abs(bound) + 1e-6 >= limit[qi]
                pairs = qi[keep], ci[keep]
        if pairs is None:
            every = np.where(alive, q[rows] @ c.T, -np.inf)
            last = max(0, every.shape[1] - k)
            least = np.partition(every, last, axis=1)[:, last]
            qi, ci = np.nonzero((every >= least[:, None]) & alive)
            score = every[qi, ci]
        else:
            qi, ci = pairs
            score = _paired(q[rows], c, qi, ci)
        best = np.lexsort((c_ids[ci], -score, qi))
        qi, ci, score = qi[best], ci[best], score[best]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        for a, b, s in zip(qi[place < k], ci[place < k], score[place < k]):
            out.append((at + int(a), int(b), int(s)))
    return out


def _wide_topk(q_ids, q, c_ids, c, k: int):
    """The same with Python integers, for components beyond what doubles hold exactly."""
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [[int(v) for v in r] for r in c]
    out = []
    for a in range(len(q)):
        mine = [int(v) for v in q[a]]
        scored = [
            (-max(low, min(high, sum(x * y for x, y in zip(mine, r)))), int(c_ids[b]), b)
            for b, r in enumerate(rows)
            if c_ids[b] != q_ids[a]
        ]
        out += [(a, b, -s) for s, _, b in sorted(scored)[:k]]
    return out


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (array<double>) of the rows that take part."""
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vec"))
        .where(fine)
    )


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x * scale))


def pivots_of(usable: DataFrame, many: int, scale: float) -> dict[int, np.ndarray]:
    """For each length of vectors, pivots taken from a sample in hash order and moved to the middle of their vectors."""
    rows = usable.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    out = {}
    for dim, vecs in by_dim.items():
        x = scaled(np.array(vecs, float).reshape(len(vecs), dim), scale)
        p = x[:many].copy()
        for _ in range(4):
            near = nearest(x, p)
            for k in range(len(p)):
                if (near == k).any():
                    p[k] = x[near == k].mean(0)
        out[dim] = p
    return out


def nearest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        far = (p * p).sum(1)[None] - 2 * (x @ p.T)
    return np.nan_to_num(far, nan=np.inf).argmin(1)


def placed(usable: DataFrame, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    """vec_id, vec, dim, pivot, salt of every vector, written once: blocks are made of it more than once."""
    sent = usable.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            dims = np.array([len(v) for v in vecs], np.int64)
            pivot = np.zeros(len(vecs), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if (p := sent.value.get(int(dim))) is not None and dim:
                    pivot[at] = nearest(scaled(np.array([vecs[i] for i in at], float), scale), p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(dims, pa.int32()), pa.array(pivot, pa.int32())], names=["vec_id", "vec", "dim", "pivot"]
            )

    found = usable.select("vec_id", "vec").mapInArrow(tidy(run), "vec_id bigint, vec array<double>, dim int, pivot int")
    return cut(found.withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id())))


def packed(vectors: DataFrame, block: int, scale: float) -> DataFrame:
    """Blocks of about ``block`` vectors of a pivot: ids as int64 and floor(scale * x) as doubles in
    binary columns, and the block's statistics."""

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["vec_id", "salt"])
        ids = pdf["vec_id"].to_numpy(np.int64)
        x = scaled(np.array(pdf["vec"].tolist(), float).reshape(len(pdf), int(key[0])), scale)
        values = (key[0], key[1], key[2], len(ids), ids.tobytes(), x.tobytes(), box_of(x).tobytes())
        return pd.DataFrame([values], columns=[c.split()[0] for c in _PACK.split(", ")])

    counts = cut(vectors.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block).alias("pieces")))
    if counts.count() <= BROADCAST_PIVOTS:  # a row for each pivot and length of vectors
        counts = F.broadcast(counts)
    keyed = vectors.join(counts, ["dim", "pivot"]).withColumn("piece", F.pmod("salt", "pieces"))
    keyed = keyed.select("dim", "pivot", "piece", "vec_id", "vec", "salt")
    # a shuffle by pivot alone would do for the grouping, and put a common pivot into one task
    return keyed.repartition("dim", "pivot", "piece").groupBy("dim", "pivot", "piece").applyInPandas(pack, _PACK)


def _arrays(r, side: str):
    ids = np.frombuffer(getattr(r, f"{side}_ids"), np.int64)
    return ids, np.frombuffer(getattr(r, f"{side}_vecs"), float).reshape(len(ids), r.dim)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all rows but its own.

    ``is_query`` is a condition on vec_id.
    """
    bounded_batches(vectors.sparkSession)
    usable = clean_vectors(vectors)
    total = usable.count()
    all_ = placed(usable, pivots_of(usable, min(PIVOTS, max(1, total // block)), scale), scale)
    asked = all_.where(is_query).groupBy("vec_id", "vec", "dim", "pivot").agg(F.min("salt").alias("salt"))
    cand = cut(packed(all_, block, scale).withColumn("cb", F.monotonically_increasing_id()))
    query = cut(packed(asked, block, scale).withColumn("qb", F.monotonically_increasing_id()))
    c_side = cand.select("cb", "dim", "pivot", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    q_side = query.select("qb", "dim", "pivot", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("stats").alias("q_stats"))

    # seeds: the first block of the queries' own pivot (every query is a candidate too, so there is one)
    def seed(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                (q_ids, q), (c_ids, c) = _arrays(r, "q"), _arrays(r, "c")
                limits, have = np.full(len(q_ids), -np.inf), np.zeros(len(q_ids), int)
                for a, _, score in block_topk(q_ids, q, c_ids, c, k):  # a query's scores descend
                    have[a] += 1
                    if have[a] == k:
                        limits[a] = score
                rows.append((r.qb, r.dim, limits.tobytes(), float(limits.min(initial=np.inf)), r.q_stats))
            yield pd.DataFrame(rows, columns=["qb", "dim", "limits", "least", "q_stats"])

    firsts = cand.where("piece = 0").select("cb")
    first = c_side.join(firsts, "cb", "left_semi").drop("cb")
    seeds = cut(q_side.join(first, ["dim", "pivot"]).mapInPandas(tidy(seed), "qb bigint, dim int, limits binary, least double, q_stats binary"))

    # statistics of PAGE blocks a row meet every query block of their length
    pages = cand.groupBy("dim", F.pmod(F.xxhash64("cb"), F.lit(max(1, -(-cand.count() // PAGE)))).alias("page")).agg(
        F.collect_list(F.struct("cb", "stats")).alias("boxes")
    )

    def bound(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                boxes = np.stack([np.frombuffer(b["stats"], float) for b in r.boxes])
                keep = box_bounds(np.frombuffer(r.q_stats, float), boxes, r.least)
                out += [(r.qb, r.boxes[i]["cb"]) for i in np.flatnonzero(keep)]
            yield pd.DataFrame(out, columns=["qb", "cb"], dtype="int64")

    pairs = pages.join(seeds, "dim").select("qb", "q_stats", "least", "boxes").mapInPandas(tidy(bound), "qb bigint, cb bigint")
    work = (
        pairs.join(c_side.drop("dim", "pivot"), "cb").join(q_side.select("qb", "dim", "q_ids", "q_vecs"), "qb").join(seeds.select("qb", "limits"), "qb")
    )

    def search(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                (q_ids, q), (c_ids, c) = _arrays(r, "q"), _arrays(r, "c")
                found = block_topk(q_ids, q, c_ids, c, k, np.frombuffer(r.limits, float))
                values = {
                    "query_id": [int(q_ids[a]) for a, _, _ in found],
                    "vec_id": [int(c_ids[b]) for _, b, _ in found],
                    "score": [s for _, _, s in found],
                }
                yield pd.DataFrame(values, dtype="int64")

    near = work.mapInPandas(tidy(search), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def topk_report(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

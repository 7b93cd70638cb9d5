"""N-gram Jaccard self-join with R-trees of count vectors.

A document's set holds its distinct ``size``-word shingles. Two documents link when
100 * |A & B| >= 85 * |A | B|. The result is each document's component under links.

Shingles are hashed into groups; a document is the point of its group counts, and two
documents share at most the sum of the minima of their coordinates. A box of points is
bounded by its upper corner in the same way. In hundreds of coordinates, boxes over
unlike documents prune nothing, so points are first dealt to many trees:

1. Shingles become 64-bit hashes in numpy, sorted and distinct. Documents with equal sets
   collapse into one representative (the smallest doc_id).
2. Dealing. A linking pair differs in at most 15 / 85 of the smaller set, and there are
   more non-empty groups than that, so some groups hold the same shingles in both
   (pigeonhole); the hash of such a group is a cell, and each cell is one tree. Documents that
   share no cell with another cannot link and leave here. Set sizes fall into classes of
   doubling size with a fixed number of groups; a set near a border uses both classes. As
   at most k groups of a set can differ from a partner's, its k + 1 rarest cells hold a common
   one (the same order everywhere: number of documents, then hash), and the others are left
   out; cells of one document alone come first and need no row.
3. First probe. In each tree one point is held against every other, bounded by coordinate minima
   and verified: the one with the fewest groups of its own, as a text has that others were made
   from. Copies of one text become one component without meeting pairwise. While trees hold more
   pairs of components than points, another point of each is held against the points of other
   components: a dense group becomes one component in a few such turns.
4. Trees that still hold several components are bulk-loaded by sort-tile packing: a node for
   each band of sizes (a link spans the width of a band), below it slabs by one coordinate
   and tiles by another, cut into leaves of about ``LEAF`` points. Cuts are the quantiles that
   counts of hashed groups have, so packing needs no sort. Slabs and leaves have boxes of
   ``COARSE`` coordinates. The tree is joined with itself from the top: slab with slab, then
   leaf with leaf, then point with point in all coordinates (a set of n shingles has n to 2 n, a
   power of two; two points meet in the coarser one's). A pair goes on when the sum of minima
   reaches the overlap that a link needs and its sides are not already one component: a link
   inside a component changes nothing.
5. Surviving pairs are verified on their whole shingle sets; components are taken again.

Every linking pair is in one component after 3 or shares a tree in 4, so no link between
different texts is lost, whatever the sizes of groups.

Defined cases: null and texts without words have an empty set and are their own
component; a text of fewer words is one shingle; a very long text is one set, whatever its
size; rows that repeat a doc_id are one vertex (their sets' links join up) and each row is
answered; a null doc_id links with nothing and gets a null component; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, give_back, pack, tidy, unpack, with_keys
from .hashing import mix64, word_hashes

SHINGLE = 4
NUM, DEN = 85, 100
LEAF = 128
#: Counts from here on bound nothing: they are kept in one byte.
FULL = 255
#: Coordinates of a box, and slabs of a node and tiles of a slab at most.
COARSE, TILES = 16, 16
#: Probes of a tree after the first, at most.
PROBES = 6
#: Buckets of cells at most, and so rows that a batch of documents sends.
BUCKETS = 1 << 14
#: Bits of a cell beyond the logarithm of the input's size.
SPARE = 12
#: Bytes of text hashed at once.
CHUNK = 1 << 20

SETS = "doc_id bigint, n bigint, f1 bigint, f2 bigint, c0 bigint, c1 bigint, counts binary, coarse array<int>, cells binary"


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, sorted within each text; where each text's hashes begin)."""
    h, first = word_hashes(texts)
    n_words = np.diff(first)
    out = np.zeros(len(h), np.uint64)
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
        out[: len(s)] = s
    counts = np.where(n_words == 0, 0, np.maximum(1, n_words - size + 1))
    parts = []
    for k in range(len(texts)):
        a, n = first[k], counts[k]
        if n == 0:
            continue
        if n_words[k] < size:
            s = np.uint64(n_words[k])
            for i in range(n_words[k]):
                s = mix64(np.array([s * np.uint64(0xD1B54A32D192ED03) + h[a + i]], np.uint64))[0]
            parts.append(np.array([s], np.uint64))
            continue
        mine = out[a : a + n]
        mine.sort()
        keep = np.empty(n, bool)
        keep[0] = True
        np.not_equal(mine[1:], mine[:-1], out=keep[1:])
        parts.append(mine[keep])
        counts[k] = len(parts[-1])
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return every, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def cells_of(h: np.ndarray, class_: int) -> np.ndarray:
    """A hash for each non-empty group of a sorted set, under the groups of a size class."""
    groups = 1 << 24 if class_ <= 4 else int(0.42 * (1 << class_)) + 16
    g = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    total = np.add.reduceat(mix64(h), starts)
    return mix64(total ^ mix64(g[starts] + np.uint64(class_ << 40)))


def classes_of(n: int) -> list[int]:
    """The size class of a set, and the next one if a link may reach into it."""
    own = n.bit_length() - 1
    return [own, own + 1] if n * DEN // NUM >= 1 << (own + 1) else [own]


def coordinates_of(n: int) -> int:
    """Number of group counts of a set: the first power of two above its size, 16 at least."""
    return 1 << max(4, n.bit_length())


def _sets(bits: int):
    def run(batches):
        import pyarrow as pa

        with np.errstate(over="ignore"):
            for batch in batches:
                texts = as_bytes(batch.column("text"))
                ns, f1, f2, c0, c1, counts, coarse, cells = [], [], [], [], [], [], [], []
                at = 0
                while at < len(texts):
                    end, held = at, 0
                    while end < len(texts) and (end == at or held + len(texts[end]) < CHUNK):
                        held += len(texts[end])
                        end += 1
                    every, first = shingles(texts[at:end])
                    mixed = mix64(every ^ np.uint64(0xA0761D6478BD642F))
                    for a, b in zip(first[:-1], first[1:]):
                        mine, n = every[a:b], int(b - a)
                        ns.append(n)
                        if not n:
                            f1.append(0), f2.append(0), c0.append(0), c1.append(0), counts.append(b""), coarse.append([]), cells.append(b"")
                            continue
                        f1.append(int(mine.sum(dtype=np.uint64).view(np.int64)))
                        f2.append(int(mixed[a:b].sum(dtype=np.uint64).view(np.int64)))
                        g = coordinates_of(n)
                        point = np.bincount((mine & np.uint64(g - 1)).astype(np.int64), minlength=g)
                        coarse.append(point.reshape(-1, COARSE).sum(0).tolist())
                        counts.append(pack(np.minimum(point, FULL).astype(np.uint8)))
                        # the last bit tells the two classes of a set apart
                        parts = [cells_of(mine, c) >> np.uint64(65 - bits) << np.uint64(1) | np.uint64(c & 1) for c in classes_of(n)]
                        own = np.unique(np.concatenate(parts))
                        odd = int((own & np.uint64(1)).sum())
                        c0.append(len(own) - odd)
                        c1.append(odd)
                        cells.append(pack(np.diff(own, prepend=np.uint64(0))))
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                        pa.array(c0, pa.int64()), pa.array(c1, pa.int64()), pa.array(counts, pa.binary()), pa.array(coarse, pa.list_(pa.int32())), pa.array(cells, pa.binary()),
                    ],
                    names=["doc_id", "n", "f1", "f2", "c0", "c1", "counts", "coarse", "cells"],
                )

    return run


PACKED = "bucket bigint, ids binary, cell binary, owner binary, flag binary, many_cell binary, many_doc binary"


def _deal(buckets: int, bits: int):
    """Cells of a batch of documents, packed into a row for each bucket (a range of cells).

    A cell that several documents of the batch share is sent once, flagged; those documents'
    pairs (cell, doc_id) travel in rows of their own, dealt without regard to the cell.
    """
    limits = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("rep").to_numpy(zero_copy_only=False).astype(np.int64)
            per = [np.cumsum(unpack(c, np.uint64), dtype=np.uint64) for c in batch.column("cells").to_pylist()]
            if not per:
                continue
            owner = np.repeat(np.arange(len(per)), [len(c) for c in per])
            cell = np.concatenate(per)
            order = np.argsort(cell, kind="stable")
            cell, owner = cell[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
            size = np.diff(np.append(starts, len(cell)))
            many = np.repeat(size > 1, size)
            rows = []
            if many.any():
                rows.append((int(ids[0]) % buckets, *[b""] * 4, pack(cell[many]), pack(ids[owner[many]])))
            one, who, flag = cell[starts], owner[starts].astype(np.uint32), size > 1
            edges = np.concatenate([[0], np.searchsorted(one, limits), [len(one)]])
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    used, place = np.unique(who[a:b], return_inverse=True)
                    gaps = np.diff(one[a:b], prepend=np.uint64(0))
                    rows.append((k, pack(ids[used]), pack(gaps), pack(place.astype(np.uint32)), pack(flag[a:b]), b"", b""))
            kinds = [pa.int64()] + [pa.binary()] * 6
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                names=[x.split()[0] for x in PACKED.split(", ")],
            )

    return run


def _meet(key, pdf):
    """(cell, doc_id) of the cells that more than one document has."""
    import pandas as pd

    cells, docs, flags, many = [], [], [], []
    for r in pdf.itertuples(index=False):
        if r.cell:
            cells.append(np.cumsum(unpack(r.cell, np.uint64), dtype=np.uint64))
            docs.append(unpack(r.ids, np.int64)[unpack(r.owner, np.uint32)])
            flags.append(unpack(r.flag, bool))
        else:
            many.append((unpack(r.many_cell, np.uint64), unpack(r.many_doc, np.int64)))
    cell = np.concatenate(cells) if cells else np.zeros(0, np.uint64)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    flag = np.concatenate(flags) if flags else np.zeros(0, bool)
    order = np.argsort(cell, kind="stable")
    cell, doc, flag = cell[order], doc[order], flag[order]
    shared = np.zeros(len(cell), bool)
    if len(cell) > 1:
        same = cell[1:] == cell[:-1]
        shared[1:] |= same
        shared[:-1] |= same
    single = shared & ~flag  # flagged ones travel with the documents that share them
    give_back()
    return pd.DataFrame(
        {
            "cell": np.concatenate([cell[single]] + [m[0] for m in many]).view(np.int64),
            "doc": np.concatenate([doc[single]] + [m[1] for m in many]),
        }
    )


def fold(point: np.ndarray, size: int) -> np.ndarray:
    """Counts in ``size`` coordinates; a full count stays without bound."""
    full = point >= FULL
    out = point.astype(np.int32).reshape(-1, size).sum(0)
    out[full.reshape(-1, size).any(0)] = 1 << 24
    return out


def _able(n_a, n_b):
    """Whether sizes alone allow a link."""
    return DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)


def _bounded(batches):
    """The pairs whose summed coordinate minima reach the overlap that a link needs."""
    import pyarrow as pa

    for batch in batches:
        n_a, n_b = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("n_a", "n_b"))
        keep = _able(n_a, n_b)
        points = [batch.column(c).to_pylist() for c in ("counts_a", "counts_b")]
        for i in np.flatnonzero(keep):
            x, y = (unpack(p[i], np.uint8) for p in points)
            size = min(len(x), len(y))
            keep[i] = np.minimum(fold(x, size), fold(y, size)).sum() * (NUM + DEN) >= NUM * (n_a[i] + n_b[i])
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def within_bound(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs(a, b) of documents whose points(doc, n, counts) allow a link."""
    side = lambda c: points.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(_bounded), "a bigint, b bigint").distinct()


def links(pair_texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """pairs(a, b, text_a, text_b) -> the pairs (a, b) that link, by their whole sets."""

    def run(batches):
        import pyarrow as pa

        with np.errstate(over="ignore"):
            for batch in batches:
                sides = [as_bytes(batch.column(c)) for c in ("text_a", "text_b")]
                texts = list(dict.fromkeys(sides[0] + sides[1]))  # a hub's text comes many times
                every, first = shingles(texts, size)
                sets = {t: every[first[i] : first[i + 1]] for i, t in enumerate(texts)}
                keep = []
                for a, b in zip(*sides):
                    x, y = sets[a], sets[b]
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    if not len(small) or DEN * len(small) < NUM * len(large):
                        keep.append(False)
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pair_texts.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (doc, comp): the smallest vertex that each vertex reaches.

    Alternating large-star and small-star steps over written tables, until nothing moves;
    vertices without an edge are not listed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    check = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = check(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        new = check(now)
        if new == state:
            break
        state = new
    vertices = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("doc"), "comp")
    roots = now.select(F.col("v").alias("doc")).distinct().select("doc", F.col("doc").alias("comp"))
    return vertices.unionByName(roots).groupBy("doc").agg(F.min("comp").alias("comp"))


def _one_row_each(texts: DataFrame, usable: DataFrame) -> DataFrame:
    """``texts`` with equal rows of one doc_id once, so that a pair of documents is not a pair of all their rows.

    Only ids of several rows are gathered, equal rows before they are shuffled.
    """
    repeated = cut(usable.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        return texts
    once = with_keys(texts, "doc_id", repeated).select("doc_id", "text").dropDuplicates()
    return with_keys(texts, "doc_id", repeated, "left_anti").select("doc_id", "text").unionByName(once)


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs(a, b) with both texts; only documents of a pair are read on."""
    pairs = cut(pairs)
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    texts = with_keys(docs.select(F.col("doc_id").alias("doc"), "text"), "doc", ids)
    a = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b")


def _leaf_pairs(batches):
    """Pairs of points of two leaves that may link and are in different components."""
    import pandas as pd

    for frame in batches:
        a_out, b_out = [], []
        for r in frame.itertuples(index=False):
            size = coordinates_of(min(p["n"] for leaf in (r.leaf_a, r.leaf_b) for p in leaf))
            left, right = _leaf(r.leaf_a, size), _leaf(r.leaf_b, size)
            n_a, n_b = left[2], right[2]
            box = np.minimum(left[3].max(0), right[3].max(0)).sum()
            if box * (NUM + DEN) < NUM * (n_a.min() + n_b.min()):
                continue
            for i in range(len(n_a)):
                able = (left[1][i] != right[1]) & (left[0][i] < right[0] if r.same else left[0][i] != right[0])
                j = np.flatnonzero(able & _able(n_a[i], n_b))
                if len(j):
                    overlap = np.minimum(left[3][i], right[3][j]).sum(1)
                    j = j[overlap * (NUM + DEN) >= NUM * (n_a[i] + n_b[j])]
                    a_out += [int(left[0][i])] * len(j)
                    b_out += right[0][j].tolist()
        # a pair meets in several cells: once for each batch is enough
        pairs = np.unique(np.array([np.minimum(a_out, b_out), np.maximum(a_out, b_out)], np.int64).reshape(2, -1), axis=1)
        yield pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def _leaf(points, size: int):
    doc, comp, n = (np.array([p[c] for p in points], np.int64) for c in ("doc", "comp", "n"))
    return doc, comp, n, np.stack([fold(unpack(p["counts"], np.uint8), size) for p in points])


def tree_leaves(inside: DataFrame) -> DataFrame:
    """inside(cell, m, doc, comp, n, counts, coarse) -> leaves of the trees: id, place (cell, band,
    slab), n (the least), lo and hi (components), b0, b1, ... (upper corner) and points.

    ``m`` is the number of points of the cell. Of n hashed shingles, half the groups hold n / 2,
    give or take sqrt(n) / 2, so the share of points below a count is known without sorting.
    """
    part = lambda places: sum((F.get("coarse", i) for i in places), F.lit(0))
    wide = F.least(F.lit(TILES), F.ceil(F.sqrt(F.col("m") / LEAF)))

    def cut_of(half: Column) -> Column:
        z = (2 * half - F.col("n")) / F.sqrt("n")
        return F.floor(wide / (1 + F.exp(-1.702 * z))).cast("int")  # the logistic curve follows the normal's within 0.01

    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM))).cast("int")
    rows = inside.withColumns({
        "band": band, "slab": cut_of(part(range(COARSE // 2))),
        "tile": cut_of(part([i for i in range(COARSE) if i // (COARSE // 4) in (0, 2)])),
    })
    place = ["cell", "band", "slab", "tile"]
    filled = rows.groupBy(*place).agg(F.ceil(F.count("*") / LEAF).alias("pieces"))
    rows = rows.join(filled, place).withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("pieces")))
    leaves = rows.groupBy(*place, "piece").agg(
        F.collect_list(F.struct("doc", "comp", "n", "counts")).alias("points"), F.min("n").alias("n"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        *[F.max(F.get("coarse", i)).alias(f"b{i}") for i in range(COARSE)],
    )  # fmt: skip  (a leaf has about LEAF points)
    return cut(leaves.withColumn("id", F.monotonically_increasing_id()))


def _meeting(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of nodes, columns ending in _a and _b, that may hold a link between two components."""
    near = F.col("band_b").between(F.col("band_a"), F.col("band_a") + 2)  # a link spans a band's width
    apart = (F.col("lo_a") != F.col("hi_b")) | (F.col("hi_a") != F.col("lo_b"))
    overlap = sum((F.least(f"b{i}_a", f"b{i}_b") for i in range(COARSE)), F.lit(0))
    return a.join(b, on).where(near & apart & (overlap * (NUM + DEN) >= NUM * (F.col("n_a") + F.col("n_b"))))


def _side(nodes: DataFrame, c: str, keep: tuple[str, ...]) -> DataFrame:
    return nodes.select(*[F.col(x) if x in keep else F.col(x).alias(f"{x}_{c}") for x in nodes.columns])


def leaf_pairs(leaves: DataFrame) -> DataFrame:
    """Pairs of leaves (leaf_a, leaf_b, same) that the boxes of slabs and then of leaves let through."""
    heads = leaves.drop("points", "tile", "piece")
    box = [F.max(f"b{i}").alias(f"b{i}") for i in range(COARSE)]
    slabs = heads.groupBy("cell", "band", "slab").agg(F.min("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *box)
    once = (F.col("band_b") > F.col("band_a")) | (F.col("slab_b") >= F.col("slab_a"))
    above = _meeting(_side(slabs, "a", ("cell",)), _side(slabs, "b", ("cell",)), ["cell"]).where(once)
    above = above.select("cell", "band_a", "slab_a", "band_b", "slab_b")
    left = above.join(_side(heads, "a", ("cell",)), ["cell", "band_a", "slab_a"])
    met = _meeting(left, _side(heads, "b", ("cell",)), ["cell", "band_b", "slab_b"])
    same_slab = (F.col("band_a") == F.col("band_b")) & (F.col("slab_a") == F.col("slab_b"))
    met = met.where(~same_slab | (F.col("id_b") >= F.col("id_a"))).select("id_a", "id_b")
    points = lambda c: leaves.select(F.col("id").alias(f"id_{c}"), F.col("points").alias(f"leaf_{c}"))
    return met.join(points("a"), "id_a").join(points("b"), "id_b").select("leaf_a", "leaf_b", (F.col("id_a") == F.col("id_b")).alias("same"))


def _prefixes(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(cell, doc, alone) of the cells among each set's k + 1 rarest, where two documents still meet.

    A set has c0 and c1 cells of its two classes; those it shares with nobody, ``alone`` of them, are the rarest.
    """
    sizes = sets.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max("n").alias("n"), F.max("c0").alias("c0"), F.max("c1").alias("c1"),
        (F.min(F.struct("f1", "f2")) != F.max(F.struct("f1", "f2"))).alias("several"),
    )
    counted = shared.join(shared.groupBy("cell").agg(F.count("*").alias("df")), "cell").withColumn("odd", F.col("cell").bitwiseAND(F.lit(1)))
    w = Window.partitionBy("doc", "odd")
    ranked = counted.withColumns({"rank": F.row_number().over(w.orderBy("df", "cell")), "mine": F.count("*").over(w)}).join(sizes, "doc")
    alone = F.greatest(F.when(F.col("odd") == 1, F.col("c1")).otherwise(F.col("c0")) - F.col("mine"), F.lit(0))
    differ = F.floor(F.col("n") * (DEN - NUM) / NUM)
    # rows of one doc_id with several sets keep all cells: their ranks are of both together
    ranked = ranked.withColumn("alone", alone)
    kept = cut(ranked.where((F.col("rank") <= differ + 1 - F.col("alone")) | F.col("several")).select("cell", "doc", "alone"))
    met = kept.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1").select("cell")
    return kept.join(met, "cell", "left_semi")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(62, max(32, int(size + 2).bit_length() + SPARE))
    sets = cut(texts.mapInArrow(tidy(_sets(bits)), SETS))
    usable = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    texts = _one_row_each(texts, usable)

    # 1. equal sets: one representative; rows of one doc_id with several sets are tied together
    same = ["n", "f1", "f2"]
    groups = usable.select("doc_id", *same).groupBy(*same).agg(F.min("doc_id").alias("rep"))
    members = cut(usable.select("doc_id", *same).distinct().join(groups, same).select("doc_id", "n", "rep"))
    ties = (
        members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
        .join(members.select("doc_id", F.col("rep").alias("b")), "doc_id").where("a <> b").select("a", "b")
    )

    # 2. cells that more than one representative has
    buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // 32_000_000) + 1))
    reps = usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("cells").alias("cells"))
    packed = reps.select("rep", "cells").mapInArrow(tidy(_deal(buckets, bits)), PACKED)
    shared = cut(packed.groupBy("bucket").applyInPandas(_meet, "cell bigint, doc bigint"))
    shared = cut(_prefixes(shared, usable))
    in_cells = cut(shared.select("doc").distinct())
    points = cut(
        with_keys(usable, "doc_id", in_cells)
        .dropDuplicates(["doc_id", *same]).select(F.col("doc_id").alias("doc"), "n", "counts", "coarse")
    )

    # 3. first links: each document with the most common one of its cells
    hubs = shared.groupBy("cell").agg(F.min(F.struct("alone", "doc"))["doc"].alias("hub"))
    first = shared.join(hubs, "cell").where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    edges = cut(links(_with_texts(within_bound(first, points), texts)).unionByName(ties))
    comps = cut(components(edges))

    # more probes, while trees hold so many components that pairs of them outnumber the points
    turn = 0

    def in_trees():
        placed = shared.join(comps, "doc", "left").select("cell", "doc", F.coalesce("comp", "doc").alias("comp"))
        trees = placed.groupBy("cell").agg(F.countDistinct("comp").alias("n"), F.count("*").alias("m"), F.min(F.struct(F.xxhash64("doc", F.lit(turn)), "doc", "comp")).alias("hub"))
        return placed, trees.where("n > 1").select("cell", "n", "m", F.col("hub.doc").alias("hub"), F.col("hub.comp").alias("hub_comp"))

    for turn in range(PROBES):
        placed, mixed = in_trees()
        mixed = cut(mixed)
        pairs, many = mixed.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("m")).first()
        if (pairs or 0) <= (many or 0):
            break
        again = placed.join(mixed, "cell").where("comp <> hub_comp").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
        found = cut(links(_with_texts(within_bound(again, points), texts)))
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        comps = cut(components(edges))

    # 4. trees of several components, joined with themselves from the top
    placed, mixed = in_trees()
    leaves = tree_leaves(placed.join(mixed.select("cell", "m"), "cell").join(points, "doc"))
    pairs = leaf_pairs(leaves).mapInPandas(tidy(_leaf_pairs), "a bigint, b bigint").distinct()

    # 5. survivors on their whole sets, and components over all links
    edges = edges.unionByName(links(_with_texts(pairs, texts)))
    final = cut(components(edges))

    classes = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    placed = classes.join(final.withColumnRenamed("doc", "rep"), "rep", "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("comp", "rep").alias("comp")
    )
    return sets.join(placed, sets.doc_id == placed._id, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id")
    )


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM d, unnest(range(1, greatest(2, len(w) - 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(k.c AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) k ON k.v = d.doc_id
"""

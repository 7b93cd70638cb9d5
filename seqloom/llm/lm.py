"""Language-model scores from a weighted backoff automaton.

Tokens are words (A-Z lower-cased) and one end per text. N-grams of up to three tokens
are counted over all training texts. The model interpolates them,

    P3(w | t u) = (1 - L3) c(t u w) / c(t u) + L3 P2(w | u)
    P2(w | u)   = (1 - L2) c(u w) / c(u)     + L2 P1(w)
    P1(w)       = (c(w) + 1) / (N + V + 1),

and is run as an automaton: a state is the longest known context (t u, u or none), an
arc carries log10 of the probability of a known n-gram and leads to the longest known
context that ends in its token, and where no arc exists the failure arc adds log10 L of the
state and goes on from the shorter context. L2 depends on the count of u: it is ``NEW`` times
the chance that a word drawn from the corpus is new after c(u) draws, taken from the counts
of all words; L3 is constant.

The model is as large as the corpus, so no task or driver holds it. A task cuts the texts of
its partition into blocks of about ``BLOCK`` bytes. A block asks for its distinct n-grams by
sending their hashes and training counts to buckets (ranges of the hash, one for each
``BUCKET`` characters of the input, ``BUCKETS`` at most, so a block sends a bounded number of
rows whatever the input; a bucket is read by one task, so inputs of many terabytes take more ``BUCKETS``); a bucket adds up the counts of a hash over all blocks and answers
each block in the order of its question. So a frequent word or n-gram is one entry for each
block, however often it occurs, and buckets are even. A block then has every state, arc and
failure arc that its texts can meet: its part of the automaton (``Automaton``), built for
about ``PART`` tokens at a time. One pass reads the texts from left to right, the state
carried along; many texts advance side by side, and a text of more than ``SEGMENT`` tokens
enters at several places, in the state that the tokens before the place lead to.

N-grams of two and three tokens are known by hashes of log2(bytes) + ``SPARE`` bits, so a few
lookups in a million may meet another n-gram's count: at sf0.1, 3 of 10,000 scores differ
from those of 24 bits more, the most by 0.17 %. Words are known by 64 bits.

Defined cases: a null or empty text is its end token alone; held out are texts whose
crc32(doc_id as text) mod 7 is 2, a null doc_id trains; repeated rows are texts of their
own; a very long text is a block of its own; without training texts N and V are 0 and scores
follow from the formula; an empty table gives no rows; other columns are ignored. Rows of a
partition stay together, so rows of one or no doc_id fill no block more than others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, give_back, pack, tidy, unpack
from .hashing import mix64, word_hashes

FOLDS, HELD = 7, 2
BLOCK = 12_000_000
BUCKET, BUCKETS = 1_000_000, 1 << 14
SPARE = 16
NEW = 0.7
L3 = 0.5
ORDERS = (1, 2, 3)
#: Tokens whose automaton is built at once, and of a text between two places of entry.
PART, SEGMENT = 1 << 18, 256
#: Bytes of text hashed at once.
CHUNK = 1 << 20
END = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block bigint, ids binary, known binary, held binary, lens binary, texts binary"
REQUESTS = "bucket bigint, block bigint, " + ", ".join(f"keys{k} binary, counts{k} binary" for k in ORDERS)
ANSWERS = "block bigint, bucket bigint, answer1 binary, answer2 binary, answer3 binary, bins array<struct<bin:int,types:bigint,tokens:bigint>>"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _blocks(size: int):
    """Texts of a partition in blocks of about ``size`` bytes, a row for each, packed and compressed."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        zstd, names = pa.Codec("zstd", 1), [x.split()[0] for x in BLOCKS.split(", ")]
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0

        def packed():
            ids, lens = [r[0] for r in rows], [len(r[2]) for r in rows]
            values = (
                block, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids], bool).tobytes(),
                np.array([r[1] for r in rows], bool).tobytes(), np.array(lens, np.int64).tobytes(),
                zstd.compress(b"".join(r[2] for r in rows), asbytes=True),
            )
            kinds = [pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), as_bytes(batch.column("text"))):
                rows.append(row)
                held += len(row[2]) + 16
                if held >= size:
                    yield packed()
                    rows, held, block = [], 0, block + 1
        if rows:
            yield packed()

    return run


def _tokens(table):
    """(ids, known, held, tokens of all texts of a block, where each text's tokens begin)."""
    import pyarrow as pa

    zstd = pa.Codec("zstd")
    parts: dict[str, list] = {"ids": [], "known": [], "held": [], "lens": []}
    kinds = {"ids": np.int64, "known": bool, "held": bool, "lens": np.int64}
    hashes, counts = [], []
    for row in table.select(["ids", "known", "held", "lens", "texts"]).to_pylist():
        for name, kind in kinds.items():
            parts[name].append(np.frombuffer(row[name], kind))
        lens = parts["lens"][-1]
        data = zstd.decompress(row["texts"], int(lens.sum()), asbytes=True) if lens.sum() else b""
        edges = np.concatenate([[0], np.cumsum(lens)])
        at = 0
        while at < len(lens):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1)
            h, first = word_hashes([data[edges[i] : edges[i + 1]] for i in range(at, min(end, len(lens)))])
            counts.append(np.diff(first))
            hashes.append(h)
            at = end
    ids, known, held = (np.concatenate(parts[k]) for k in ("ids", "known", "held"))
    words, n = np.concatenate(hashes), np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.full(first[-1], END, np.uint64)
    is_end = np.zeros(first[-1], bool)
    is_end[first[1:] - 1] = True
    tokens[~is_end] = words
    return ids, known, held, tokens, first


def _keys(tokens: np.ndarray, first: np.ndarray, bits: int) -> list[np.ndarray]:
    """Hash of the n-gram of each order that ends at each position; the text before is an END."""
    with np.errstate(over="ignore"):
        start = first[:-1]
        before = np.concatenate([[END], tokens[:-1]])
        before[start] = END
        two = mix64(mix64(before * _K) + tokens)
        pair = np.concatenate([[END], two[:-1]])
        pair[start] = mix64(np.array([END], np.uint64))[0]  # no text has it as a context
        three = mix64(mix64(pair * _K + np.uint64(1)) + tokens)
        cut_ = np.uint64(64 - bits)
        return [tokens, two >> cut_ << cut_, three >> cut_ << cut_]


def _request(buckets: int, bits: int):
    def one(table):
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        _, _, held, tokens, first = _tokens(table)
        train = np.repeat(~held, np.diff(first))
        # what a bucket gets: a range of each order's sorted keys
        limits = [np.uint64((i << 64) // buckets) for i in range(1, buckets)]
        columns: dict[str, list] = {x.split()[0]: [] for x in REQUESTS.split(", ")}
        columns["bucket"], columns["block"] = list(range(buckets)), [block] * buckets
        asked = np.zeros(buckets, bool)
        for k, keys in zip(ORDERS, _keys(tokens, first, bits)):
            unique, back = np.unique(keys, return_inverse=True)
            count = np.bincount(back, train, len(unique)).astype(np.uint32)
            edges = np.concatenate([[0], np.searchsorted(unique, np.array(limits, np.uint64)), [len(unique)]])
            asked |= np.diff(edges) > 0
            shift = np.uint64(0 if k == 1 else 64 - bits)
            for a, b in zip(edges[:-1], edges[1:]):
                columns[f"keys{k}"].append(pack(np.diff(unique[a:b] >> shift, prepend=np.uint64(0))))
                columns[f"counts{k}"].append(pack(count[a:b]))
        kinds = [pa.int64()] * 2 + [pa.binary()] * 6
        rows = pa.array(np.flatnonzero(asked))
        return [pa.array(c, t).take(rows) for c, t in zip(columns.values(), kinds)], list(columns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                arrays, names = one(batch.slice(i, 1))
                for at in range(0, len(arrays[0]), 1024):
                    yield pa.RecordBatch.from_arrays([x.slice(at, 1024) for x in arrays], names=names)
                give_back()

    return run


def bin_of(count: np.ndarray) -> np.ndarray:
    """Eight bins for each doubling of a count."""
    return np.floor(8 * np.log2(np.maximum(count, 1))).astype(np.int64)


def _answer(table):
    """Counts over all blocks, for each block in the order it asked; bins of the words' counts."""
    import pyarrow as pa

    rows = table.num_rows
    answers: dict[int, list[bytes]] = {}
    bins: list = []
    for k in ORDERS:
        with np.errstate(over="ignore"):
            keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column(f"keys{k}").to_pylist()]
        counts = [unpack(x, np.uint32) for x in table.column(f"counts{k}").to_pylist()]
        unique, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(unique)).astype(np.uint64)
        edges = np.cumsum([0] + [len(x) for x in keys])
        answers[k] = [pack(total[back[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
        if k == 1:
            seen = total[total > 0]
            which, place = np.unique(bin_of(seen), return_inverse=True)
            types, tokens = np.bincount(place, minlength=len(which)), np.bincount(place, seen, len(which))
            bins = [{"bin": int(b), "types": int(t), "tokens": int(c)} for b, t, c in zip(which, types, tokens)]
    give_back()
    kind = pa.list_(pa.struct([("bin", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64())]))
    return pa.table(
        [
            table.column("block"), table.column("bucket"), *[pa.array(answers[k], pa.binary()) for k in ORDERS],
            pa.array([bins if i == 0 else None for i in range(rows)], kind),
        ],
        names=["block", "bucket", "answer1", "answer2", "answer3", "bins"],
    )


def new_word_chance(bins: list[tuple[int, int, int]], n: int, v: int) -> np.ndarray:
    """By bin of a context's count: NEW times the chance that a drawn word is new."""
    out = np.ones(8 * 64)
    if n:
        types, tokens = (np.array([b[i] for b in bins], float) for i in (1, 2))
        p = tokens / types / n
        draws = 2.0 ** ((np.arange(len(out)) + 0.5) / 8)
        out = (tokens[None] / n * np.exp(-p[None] * draws[:, None])).sum(1) + v / (n + v)
    return np.minimum(NEW * out, 0.999)


class Automaton:
    """The states, arcs and failure arcs that some texts can meet.

    tokens: their hashes; first: where each text begins; counts: training counts of the n-gram of
    each order that ends at a token. State 0 is the empty context, then come known words, then
    known pairs of words.

    keys, weight, target: arcs out of words and pairs, sorted by source * words + word;
    root_weight, root_target: arcs out of state 0, which has one for every word;
    fail_weight, fail_target: the failure arc of each state.
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, counts: list[np.ndarray], n: int, v: int, chance: np.ndarray):
        words, w = np.unique(tokens, return_inverse=True)
        end, n_words = int(np.searchsorted(words, END)), len(words)
        c1 = np.zeros(n_words)
        c1[w] = counts[0]
        before = np.concatenate([[end], w[:-1]])
        before[first[:-1]] = end  # a text begins after an END
        pairs, p = np.unique(before * n_words + w, return_inverse=True)
        c2 = np.zeros(len(pairs))
        c2[p] = counts[1]
        u, x = pairs // n_words, pairs % n_words
        c2[c1[u] == 0] = 0
        known1, known2 = c1 > 0, c2 > 0
        n1 = int(known1.sum())
        word_state = np.where(known1, np.cumsum(known1), 0)
        pair_state = np.where(known2, n1 + np.cumsum(known2), word_state[x])
        #: the state that each token leads to, and what texts begin in
        self.after, self.start = pair_state[p], int(word_state[end])
        self.words, self.w = n_words, w

        p1 = (c1 + 1) / (n + v + 1)
        lost = chance[bin_of(c1)]
        p2 = np.where(known1[u], (1 - lost[u]) * c2 / np.maximum(c1[u], 1) + lost[u] * p1[x], p1[x])
        self.root_weight, self.root_target = np.log10(p1), word_state
        self.fail_weight = np.concatenate([[0.0], np.log10(lost[known1]), np.full(int(known2.sum()), math.log10(L3))])
        self.fail_target = np.concatenate([[0], np.zeros(n1, np.int64), word_state[x[known2]]])

        # three tokens: a known pair and what follows it; no pair ends before a text's first token
        inner = np.ones(len(w), bool)
        inner[first[:-1]] = False
        context = np.concatenate([[0], p[:-1]])
        inner &= known2[context] & (counts[2] > 0)
        at = np.flatnonzero(inner)
        source = pair_state[context[at]]
        keys, unique = np.unique(source * n_words + w[at], return_index=True)
        at = at[unique]
        p3 = (1 - L3) * counts[2][at] / np.maximum(c2[context[at]], 1) + L3 * p2[p[at]]
        # the sources of two-token arcs are words, whose numbers come before those of pairs
        two = np.flatnonzero(known2)
        two_keys = word_state[u[two]] * n_words + x[two]
        order = np.argsort(two_keys, kind="stable")
        two = two[order]
        self.keys = np.concatenate([two_keys[order], keys])
        self.weight = np.concatenate([np.log10(p2[two]), np.log10(p3)])
        self.target = np.concatenate([pair_state[two], self.after[at]])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of a word in each state."""
        total, now, out = np.zeros(len(state)), state.copy(), np.empty_like(state)
        open_ = np.arange(len(state))
        while len(open_):
            s, x = now[open_], word[open_]
            root = s == 0
            key = s * self.words + x
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = ~root & (self.keys[at] == key) if len(self.keys) else np.zeros(len(s), bool)
            i = open_[hit]
            total[i] += self.weight[at[hit]]
            out[i] = self.target[at[hit]]
            i = open_[root]
            total[i] += self.root_weight[x[root]]
            out[i] = self.root_target[x[root]]
            failed = ~(root | hit)
            open_, s = open_[failed], s[failed]
            total[open_] += self.fail_weight[s]
            now[open_] = self.fail_target[s]
        return total, out

    def traverse(self, first: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each text, read from left to right with the state carried along.

        Texts are cut into segments of ``segment`` tokens at most, which advance side by side.
        """
        lens = np.diff(first)
        n = -(-lens // segment)
        owner = np.repeat(np.arange(len(lens)), n)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * segment
        begin, size = first[:-1][owner] + place, np.minimum(lens[owner] - place, segment)
        order = np.argsort(-size, kind="stable")
        begin, size, owner, place = begin[order], size[order], owner[order], place[order]
        state = np.where(place == 0, self.start, self.after[np.maximum(begin - 1, 0)])
        total = np.zeros(len(owner))
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t, "left"))  # segments of more than t tokens
            gain, state[:k] = self.step(state[:k], self.w[begin[:k] + t])
            total[:k] += gain
        return np.bincount(owner, total, len(lens))


def _score(n: int, v: int, chance: np.ndarray, bits: int):
    def run(texts, answers):
        import pyarrow as pa

        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, known, held, tokens, first = _tokens(texts)
        answers = answers.sort_by("bucket")
        counts = []
        every = _keys(tokens, first, bits)
        for k in ORDERS:
            keys = every.pop(0)
            _, back = np.unique(keys, return_inverse=True)
            counts.append(np.concatenate([unpack(x, np.uint64) for x in answers.column(f"answer{k}").to_pylist()])[back])
            del keys, back
        base, model_score = np.empty(len(ids)), np.empty(len(ids))
        at = 0
        while at < len(ids):  # a part of the texts at a time
            end = max(at + 1, int(np.searchsorted(first, first[at] + PART, "right")) - 1)
            a, b = first[at], first[end]
            part = first[at : end + 1] - a
            model = Automaton(tokens[a:b], part, [c[a:b] for c in counts], n, v, chance)
            base[at:end] = np.add.reduceat(model.root_weight[model.w], part[:-1])
            model_score[at:end] = model.traverse(part)
            at = end
        per = [base, model_score, np.add.reduceat((counts[0] > 0).astype(np.int64), first[:-1])]
        give_back()
        columns = [pa.array(ids, mask=~known), held, np.diff(first), per[2], np.full(len(ids), n), per[0], per[1]]
        return pa.table([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, kinds)], names=names)

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the columns of ``SCORES``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    buckets = min(BUCKETS, max(1, -(-size // BUCKET)))
    bits = min(64, max(32, math.ceil(math.log2(size + 2)) + SPARE))
    crc = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD
    # written once: questions and scores read the same blocks
    blocks = cut(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc, F.lit(False)).alias("held"),
    ).mapInArrow(tidy(_blocks(BLOCK)), BLOCKS))
    asked = blocks.mapInArrow(tidy(_request(buckets, bits)), REQUESTS)
    answers = cut(asked.groupBy("bucket").applyInArrow(_answer, ANSWERS), settle=3.0)  # the requests are three times the answers
    del asked
    bins = [
        tuple(r)
        for r in answers.where("bins IS NOT NULL").select(F.explode("bins").alias("b")).select("b.*")
        .groupBy("bin").agg(F.sum("types"), F.sum("tokens")).orderBy("bin").collect()
    ]  # fmt: skip  (at most 8 bins for each doubling)
    n, v = sum(b[2] for b in bins), sum(b[1] for b in bins)
    score = _score(n, v, new_word_chance(bins, n, v), bits)
    return blocks.groupBy("block").cogroup(answers.drop("bins").groupBy("block")).applyInArrow(score, SCORES)

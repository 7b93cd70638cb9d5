"""Order-preserving alignment of symbol sequences and time intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matching import edit_script, matching_blocks

#: Columns of an edit block.
EDITS = "tag string, i1 int, i2 int, j1 int, j2 int"


def suffix_align(left: DataFrame, right: DataFrame, key: Sequence[str], l_order: str, r_order: str) -> DataFrame:
    """Rows paired from the end of both sequences; the surplus at the longer one's head stays out.

    Adds ``from_end`` (1 = last).
    """
    number = lambda df, order: df.withColumn("from_end", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order))))
    return number(left, l_order).join(number(right, r_order), [*key, "from_end"])


def ordinal_align(left: DataFrame, right: DataFrame, key: Sequence[str], l_order: str, r_order: str) -> DataFrame:
    """Rows paired from the start; used where both sequences have equal length."""
    number = lambda df, order: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return number(left, l_order).join(number(right, r_order), [*key, "ordinal"])


def greedy_match(words: list[str], found: list[str], strict: bool = True) -> list[int | None]:
    """Place in ``found`` of each word, scanning forward only. ``strict``: a word that is not
    found uses up the rest, so later words have no place; otherwise it is passed over."""
    out: list[int | None] = []
    at = 0
    for word in words:
        place = next((i for i in range(at, len(found)) if found[i] == word), None)
        out.append(place)
        if place is not None:
            at = place + 1
        elif strict:
            at = len(found)
    return out


def _both(left: DataFrame, right: DataFrame, key: Sequence[str], order: str, word: str) -> DataFrame:
    """One row a key of either side: key, and the sides ``_l`` and ``_r`` as arrays of (order, word), sorted."""
    one = lambda df, side: df.select(*key, F.lit(side).alias("_side"), F.struct(F.col(order).alias("o"), F.col(word).alias("w")).alias("_x"))
    sides = [F.array_sort(F.collect_list(F.when(F.col("_side") == k, F.col("_x")))).alias(k) for k in ("_l", "_r")]
    return one(left, "_l").unionByName(one(right, "_r")).groupBy(*key).agg(*sides)


def _per_key(both: DataFrame, key: Sequence[str], schema: str, rows) -> DataFrame:
    """The key's columns before each row of its pair; ``rows`` gets the pairs of a batch and returns a list for each."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = {f.name: f.dataType for f in both.schema.fields}
    out = StructType([*[f for f in both.schema.fields if f.name in key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)
    places = [list(kinds).index(k) for k in key]

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, new in enumerate(rows(list(zip(batch.column("_l").to_pylist(), batch.column("_r").to_pylist())))):
                at += [i] * len(new)
                found += new
            held = [batch.column(p).take(pa.array(at, pa.int32())) for p in places]
            columns = list(zip(*found)) or [()] * (len(arrow) - len(held))
            made = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(held):])]
            yield pa.RecordBatch.from_arrays([*held, *made], names=arrow.names)

    return both.mapInArrow(run, out)


def greedy_word_match(left: DataFrame, right: DataFrame, key: Sequence[str], order: str, word: str, strict: bool = True) -> DataFrame:
    """key, left_pos, right_pos (null if not found), word: greedy forward match of two word sequences.

    One group is one verse, so a group is small and one row; the scan is stateful and runs in Python.
    """

    def one(a, b):
        places = greedy_match([x["w"] for x in a], [y["w"] for y in b], strict)
        return [(x["o"], None if p is None else b[p]["o"], x["w"]) for x, p in zip(a, places)]

    def rows(pairs):
        return [one(a, b) for a, b in pairs]

    return _per_key(_both(left, right, key, order, word), key, "left_pos bigint, right_pos bigint, word string", rows)


def diff_opcodes(left: DataFrame, right: DataFrame, key: Sequence[str], order: str, word: str) -> DataFrame:
    """Edit blocks between two word sequences: key, tag (equal, replace, delete, insert), i1, i2, j1, j2."""

    def rows(pairs):
        words = [[[x["w"] for x in side] for side in pair] for pair in pairs]
        blocks = matching_blocks([a for a, _ in words], [b for _, b in words])
        return [edit_script(m, len(a), len(b)) for m, (a, b) in zip(blocks, words)]

    return _per_key(_both(left, right, key, order, word), key, EDITS, rows)


class EditScript:
    """Table function ``edit_script(TABLE(t), 'key', 'side', 'order', 'word')``: the edit blocks of each key's two sequences.

    ``side`` 0 is the left one, anything else the right one. The key keeps its type; rows of a key
    come together and sorted by the function's own demand, whatever the caller's table looks like.
    A null word equals a null word; a null key is a key.
    """

    def __init__(self):
        self.key, self.words = None, ([], [])

    @staticmethod
    def analyze(rows, key, side, order, word):
        from pyspark.sql.types import IntegerType, StringType, StructField, StructType
        from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn

        names = [x.value for x in (key, side, order, word)]
        if lacking := [n for n in names if n not in rows.dataType.names]:
            raise ValueError(f"no column {lacking[0]} in the table")
        kinds = {"string": StringType(), "int": IntegerType()}
        schema = StructType([rows.dataType[names[0]], *[StructField(n, kinds[k]) for n, k in (x.split() for x in EDITS.split(", "))]])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1]), OrderingColumn(names[2])])

    def eval(self, row, key, side, order, word):
        self.key = row[key]
        self.words[row[side] != 0].append(row[word])

    def terminate(self):
        left, right = self.words
        for edit in edit_script(matching_blocks([left], [right])[0], len(left), len(right)):
            yield self.key, *edit


def register_edit_script(spark: SparkSession, name: str = "edit_script") -> None:
    """Make ``EditScript`` callable from SQL."""
    spark.udtf.register(name, F.udtf(EditScript))


def word_errors(opcodes: DataFrame) -> DataFrame:
    """Edit blocks -> one row a word error: missing (left only), added (right only), wrong (both)."""
    kind = F.when(F.col("tag") == "delete", "missing").when(F.col("tag") == "insert", "added").when(F.col("tag") == "replace", "wrong")
    n = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    rows = opcodes.where("tag <> 'equal'").withColumn("kind", kind).withColumn("_off", F.explode(F.sequence(F.lit(0), n - 1)))
    left = F.when(F.col("i1") + F.col("_off") < F.col("i2"), F.col("i1") + F.col("_off"))
    right = F.when(F.col("j1") + F.col("_off") < F.col("j2"), F.col("j1") + F.col("_off"))
    rows = rows.withColumns({"left_pos": left, "right_pos": right})
    fixed = F.when((F.col("kind") == "wrong") & F.col("left_pos").isNull(), "added").when(
        (F.col("kind") == "wrong") & F.col("right_pos").isNull(), "missing"
    ).otherwise(F.col("kind"))
    return rows.withColumn("kind", fixed).drop("tag", "i1", "i2", "j1", "j2", "_off")


def count_mismatch(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys whose expected and actual numbers differ; a key that one side lacks counts 0 there."""
    j = expected.groupBy(*on).agg(F.count("*").alias("n_expected")).join(
        actual.groupBy(*on).agg(F.count("*").alias("n_actual")), list(on), "full_outer"
    )
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_expected", "n_actual")})
    return j.where("n_expected <> n_actual")


def ranked_lookup(df: DataFrame, needle: str, table: DataFrame, text: str, pos: str, key: Sequence[str]) -> DataFrame:
    """The entry of a small table for each needle: exact match first, then containment either way, then none.

    The table is a list of names (a verse's words); its size is checked by the caller.
    """
    rank = F.when(F.col(text) == F.col(needle), 0).when(F.col(text).contains(F.col(needle)) | F.col(needle).contains(F.col(text)), 1)
    hits = df.join(table, list(key)).withColumn("_rank", rank).where("_rank IS NOT NULL")
    best = hits.groupBy(*df.columns).agg(F.min(F.struct("_rank", pos)).alias("b"))
    return df.join(best.select(*df.columns, F.col("b." + pos).alias("found"), F.col("b._rank").alias("rank")), df.columns, "left")


def upsert(base: DataFrame, patch: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """``base`` with corrected values and ``changed``: whether the value differs from before."""
    p = patch.select(*on, F.col(column).alias("_new"))
    new = F.coalesce("_new", column)
    return base.join(p, list(on), "left").withColumn("changed", ~new.eqNullSafe(F.col(column))).withColumn(column, new).drop("_new")


def confidence(flags: dict[str, str], short_ms: float = 30.0) -> "Column":  # noqa: F821
    """Waterfall: failed and low stay; a value within half a millisecond of the frame is low; trimmed and lossy are low."""
    c = F.col(flags["confidence"])
    out = F.when(c.isin("failed", "low"), c).when(F.abs(F.col(flags["ms"]) - short_ms) <= 0.5, "low")
    for name in ("trimmed", "lossy"):
        if name in flags:
            out = out.when(F.coalesce(F.col(flags[name]), F.lit(False)), "low")
    return out.otherwise("high")

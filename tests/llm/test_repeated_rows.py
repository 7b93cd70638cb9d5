"""Rows that repeat or share a doc_id in the licence scan and the n-gram join, and the entry's imports."""

import importlib

from pyspark.sql import functions as F

from seqloom.llm import jaccard, licenses
from seqloom.llm.common import cut

DOCS = "doc_id bigint, text string"


def test_a_namesake_takes_no_licence(spark):
    mit = licenses._MIT
    rows = [(1, mit), (1, mit), (1, "unlike text"), (None, mit), (None, "x\nReleased under the MIT License."), (2, None), (2, "")]
    got = licenses.license_scan(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    shown = sorted(map(str, (tuple(r) for r in got)))
    n = max(r.n_lines for r in got if r.license == "MIT")  # lines of the text that are notices of their own
    want = [(1, "MIT", "", n), (1, "MIT", "", n), (1, None, "", 0), (None, "MIT", "", n), (None, None, "MIT", 1), (2, None, "", 0), (2, None, "", 0)]
    assert shown == sorted(map(str, want))


def test_repeated_rows_are_not_multiplied(spark):
    """Two near copies in thousands of rows each are one pair of texts, and a third of another text is left alone."""
    words = [f"w{k}" for k in range(100)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(reversed(words))}
    df = spark.range(9000).select((F.col("id") % 3 + 1).alias("doc_id"), F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[(F.col("id") % 3 + 1).cast("int")].alias("text"))
    extra = spark.createDataFrame([(3, "unlike the other row of three " * 5)], DOCS)
    got = jaccard.jaccard_components(df.unionByName(extra)).groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 3000), (2, 1, 3000), (3, 3, 3001)]
    texts_of = df.unionByName(extra)
    usable = cut(texts_of.select("doc_id", F.lit(1).alias("n")))
    once = jaccard._one_row_each(texts_of, usable)
    pair = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    assert once.count() == 4 and jaccard._with_texts(pair, once).count() == 3


def test_entry_imports_the_corpus_operators():
    """The entry skips them where their import fails; this fails with the reason."""
    for name in ("seqloom.llm.queries", "corpus_pipeline"):
        importlib.import_module(name)
    import __spark_entry__

    assert __spark_entry__.HAS_CORPUS and {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in __spark_entry__.queries()}

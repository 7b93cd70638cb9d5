"""Text functions, dictionaries, exports, and the sounds of verses made of benchmark texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, contain
from ..sources import corpus
from . import phonology
from .scripted import SQL_DOCUMENT_VERSES, benchmark_verses, document_verses
from .tables import positions, table

LETTERS_ANY = "A-Za-z\\u00c0-\\u017f"
def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def text_clean(spark, d):
    """Cleaned text of each document: its length and its first word."""
    c = T.clean("text")
    return _docs(spark, d).withColumn("c", c).select("doc_id", F.length("c").cast("bigint").alias("n_chars"), F.get(T.words("c"), F.lit(0)).alias("first_word"))


def text_fold(spark, d):
    """Accented letters folded by a fixed table; the digest of the result and its number of plain letters."""
    c = T.fold(F.lower("text"), "äöüáéíóúàèìòùâêîôûçñ", "aouaeiouaeiouaeioucn")
    return _docs(spark, d).select("doc_id", F.md5(c).alias("digest"), T.letter_count(c, "a-z").cast("bigint").alias("n_plain"))


def strip_marks(spark, d):
    """Decomposed text without combining marks: how many marks each language has."""
    n = F.length(T.normalize("text", "NFD")) - F.length(T.strip_category_mn(T.normalize("text", "NFD")))
    return _docs(spark, d).groupBy("lang").agg(F.sum(n).cast("bigint").alias("n_marks"))


def token_offsets(spark, d):
    """Words of all documents with their offsets."""
    x = _docs(spark, d).select("doc_id", F.posexplode(T.word_offsets("text")).alias("idx", "w"))
    return x.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "w.word", F.col("w.start").cast("bigint").alias("start_at"), F.col("w.end").cast("bigint").alias("end_at"))


def char_context(spark, d):
    """Two characters before and after the middle of each document; a text of fewer than two
    characters has no middle: no letter, nothing on both sides (null for a null text)."""
    at = F.floor(F.length("text") / 2).cast("int")
    first = F.greatest(at - 2, F.lit(1))
    near = F.split(F.substring(F.col("text"), first, F.lit(5)), "")
    c = F.when(at > 0, T.context_window(near, F.greatest(at - first + 1, F.lit(1)), 2))
    side = lambda k: F.coalesce(F.array_join(F.col("c")[k], ""), F.when(F.col("text").isNotNull(), ""))
    x = _docs(spark, d).withColumn("c", c)
    return x.select("doc_id", side("before").alias("before"), F.col("c.letter").alias("letter"), side("after").alias("after"))


def mark_stats(spark, d):
    """Accented letters by language: how many, in how many documents, most in one."""
    c = T.letter_count("text", "À-ſ")
    return _docs(spark, d).groupBy("lang").agg(
        F.sum(c).cast("bigint").alias("n"), F.count_if(c > 0).alias("n_docs"), F.max(c).cast("bigint").alias("most")
    )


def letter_frequencies(spark, d):
    """Count of each letter over all documents: counted in each text, then summed, so no row a character is made."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    low = _docs(spark, d).select(F.lower("text").alias("t"))
    sums = low.agg(*[F.sum(F.length("t") - F.length(F.translate("t", c, ""))).alias(c) for c in letters])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in letters])).alias("x")).select("x.*").where("n > 0")


def validate_text_reason(spark, d):
    """Reason why a text cannot be processed, over all documents and the fixture verses."""
    texts = _docs(spark, d).select("text").unionByName(document_verses(spark, d).select("text"))
    return texts.groupBy(F.coalesce(T.validate("text"), F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


def prefix_split(spark, d):
    """Documents that open with a fixed word, and the length of the rest."""
    s = T.split_prefix("text", "The ")
    return _docs(spark, d).withColumn("s", s).where("s.found").select("doc_id", F.col("s.prefix").alias("prefix"), F.length("s.rest").cast("bigint").alias("n_rest"))


def pattern_candidates(spark, d):
    """Documents with a word that ends in a vowel right before one that begins with one."""
    w = F.split(F.lower("text"), " ")
    pair = F.exists(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: a.rlike("[aeiou]$") & F.coalesce(b, F.lit("")).rlike("^[aeiou]")), lambda x: F.coalesce(x, F.lit(False)))
    return _docs(spark, d).where(pair).groupBy("lang").agg(F.count("*").alias("n"))


def ranked_lookup(spark, d):
    """Part of each brand for each short name: the same name first, then one that holds it or is held by it, smallest key."""
    needles = F.array(*[F.lit(x) for x in ("red widget", "ring", "small ring of gold", "nothing alike")])
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    asked = p.select("p_brand").distinct().withColumn("needle", F.explode(needles))
    found = align.ranked_lookup(asked, "needle", p, "p_name", "p_partkey", ["p_brand"])
    return found.select("p_brand", "needle", F.coalesce("found", F.lit(-1)).alias("found"), F.col("rank").cast("bigint").alias("rank"))


def oov_anti(spark, d):
    """Words of documents that no benchmark text holds, by language."""
    w = lambda t: F.explode(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))).alias("word")
    words = _docs(spark, d).select("lang", w("text"))
    return corpus.missing_words(words, table(spark, d, "benchmark").select(w("text")), ("lang",)).groupBy("lang").agg(F.count("*").alias("n"))


def dictionary_variants(spark, d):
    """Distinct spellings (as written) of each lower-case word, sorted, where there are more than two."""
    x = _docs(spark, d).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("v"))
    g = corpus.variants(x.withColumn("word", F.lower("v")), "word", "v")
    return g.where("n > 2").select("word", F.array_join("variants", ",").alias("variants"), "n")


def ordered_concat(spark, d):
    """Transcript of each conversation: texts in order of turn."""
    c = table(spark, d, "conversations")
    t = corpus.transcripts(c, ["conv_id"], "turn")
    return t.select("conv_id", F.md5("value").alias("digest"), F.length("value").cast("bigint").alias("n_chars"))


def json_envelope(spark, d):
    """One JSON text a user and day: kind and place of all its events; null keys are left out."""
    p = positions(spark, d).withColumn("day", F.to_date("ts"))
    return corpus.json_per_key(p, ["user_id", "day"], "events", "pos", "event_type", F.when(F.col("event_type") == "error", True).alias("bad"))


def display_names(spark, d):
    """Titles of names with underscores."""
    p = table(spark, d, "part").select(F.regexp_replace("p_name", " ", "_").alias("rule")).distinct()
    return p.select("rule", T.display_name("rule", {"red_widget": "The red one"}).alias("title"), T.file_key(F.length("rule"), F.lit(7)).alias("file_key"))


def words_in_words(spark, d):
    """Words of four letters or more of benchmark texts, and the longer words of documents that they are in."""
    words = lambda name: table(spark, d, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    return contain.containments(words("benchmark"), words("documents"), "word", "word").where("needle <> text").withColumnRenamed("text", "word")


def similarity_ratio(spark, d):
    """Neighbours among sorted part names, and how alike they are by the ratio of matching blocks.

    Names are in order within their first two letters; the last of these meets the first of the
    next two letters, of which there are few.
    """
    p = table(spark, d, "part").select("p_name").distinct().withColumn("head", F.substring("p_name", 1, 2))
    heads = p.groupBy("head").agg(F.min("p_name").alias("least"))
    heads = heads.select("head", F.lead("least").over(Window.orderBy("head")).alias("after"))
    pairs = p.join(heads, "head").withColumn("other", F.coalesce(F.lead("p_name").over(Window.partitionBy("head").orderBy("p_name")), "after"))
    return pairs.where("other IS NOT NULL").select("p_name", "other", F.round(T.similarity("p_name", "other"), 4).alias("ratio"))


def verse_sounds(spark, d):
    """Sounds of every verse, in order."""
    s = phonology.phonemize(benchmark_verses(spark, d))
    return corpus.transcripts(s, ["chapter", "verse"], "pos", "symbol").select("chapter", "verse", F.col("value").alias("sounds"))


def verse_rules(spark, d):
    """Rule applications of every verse, inline."""
    s = phonology.phonemize(benchmark_verses(spark, d))
    return corpus.annotated(s, phonology.apply_rules(s), ["chapter", "verse"]).select("chapter", "verse", F.col("value").alias("annotated"))


def verse_durations(spark, d):
    """Expected total duration of every verse."""
    s = phonology.phonemize(benchmark_verses(spark, d))
    e = phonology.expected_durations(s, phonology.apply_rules(s))
    return e.groupBy("chapter", "verse").agg(F.count("*").alias("n_sounds"), F.round(F.sum("expected_ms"), 3).alias("expected_ms"))


def verse_dictionary(spark, d):
    s = phonology.phonemize(benchmark_verses(spark, d)).withColumn("mfa", phonology.aligner_symbol("symbol"))
    return corpus.dictionary(s, ["chapter", "verse", "word_idx"], "word", "pos", "mfa")


QUERIES = {f.__name__: f for f in (
    text_clean, text_fold, strip_marks, token_offsets, char_context, mark_stats, letter_frequencies, validate_text_reason, prefix_split,
    pattern_candidates, ranked_lookup, oov_anti, dictionary_variants, ordered_concat, json_envelope, display_names, similarity_ratio, words_in_words,
    verse_sounds, verse_rules, verse_durations, verse_dictionary,
)}

ORACLES = {
    "words_in_words": """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS needle FROM benchmark),
        w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS word FROM documents)
        SELECT needle, word FROM n JOIN w ON contains(word, needle) AND needle <> word""",
    "text_clean": r"""WITH c AS (SELECT doc_id, nfc_normalize(regexp_replace(text, '[\x{0640}\x{200B}-\x{200D}\x{FEFF}\x{06D6}-\x{06E0}\x{06E2}\x{06ED}]', '', 'g')) AS c FROM documents)
        SELECT doc_id, length(c) AS n_chars, nullif(string_split(trim(regexp_replace(c, '\s+', ' ', 'g')), ' ')[1], '') AS first_word FROM c""",
    "text_fold": """WITH c AS (SELECT doc_id, translate(lower(text), 'äöüáéíóúàèìòùâêîôûçñ', 'aouaeiouaeiouaeioucn') AS c FROM documents)
        SELECT doc_id, md5(c) AS digest, CAST(len(regexp_extract_all(c, '[a-z]')) AS BIGINT) AS n_plain FROM c""",
    "token_offsets": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\s*)(\S+)')) AS m, generate_subscripts(regexp_extract_all(text, '(\s*)(\S+)'), 1) - 1 AS idx FROM documents),
        o AS (SELECT *, regexp_replace(m, '^\s+', '') AS word, sum(length(m)) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM w)
        SELECT doc_id, CAST(idx AS BIGINT) AS idx, word, CAST(e - length(word) AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at FROM o""",
    "char_context": """WITH c AS (SELECT *, length(text) // 2 AS k FROM documents)
        SELECT doc_id, CASE WHEN k = 0 THEN '' ELSE substring(text, greatest(k - 2, 1), k - greatest(k - 2, 1)) END AS before, CASE WHEN k > 0 THEN substring(text, k, 1) END AS letter,
        CASE WHEN k = 0 THEN '' ELSE substring(text, k + 1, 2) END AS after FROM c""",
    "mark_stats": """WITH c AS (SELECT lang, len(regexp_extract_all(text, '[À-ſ]')) AS c FROM documents)
        SELECT lang, CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (WHERE c > 0) AS n_docs, max(c) AS most FROM c GROUP BY lang""",
    "letter_frequencies": "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM documents) WHERE regexp_matches(c, '^[a-z]$') GROUP BY c",
    "validate_text_reason": f"""WITH t AS (SELECT text FROM documents UNION ALL SELECT text FROM ({SQL_DOCUMENT_VERSES}))
        SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty text' WHEN NOT regexp_matches(text, '[ء-يݐ-ݿ]') THEN 'no Arabic text' WHEN NOT regexp_matches(text, '[{"".join(T.MARK_NAMES.values())}]') THEN 'no diacritics'
        WHEN NOT regexp_matches(text, '[{"".join((T.SHORT_MARKS | T.TANWEEN_MARKS).values())}]') THEN 'no vowel marks' ELSE 'fine' END AS reason, count(*) AS n FROM t GROUP BY ALL""",
    "prefix_split": "SELECT doc_id, 'The ' AS prefix, length(ltrim(substring(text, 5), ' ')) AS n_rest FROM documents WHERE starts_with(text, 'The ')",
    "pattern_candidates": """WITH w AS (SELECT lang, string_split(lower(text), ' ') AS w FROM documents)
        SELECT lang, count(*) AS n FROM w WHERE len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda p: regexp_matches(p[1], '[aeiou]$') AND regexp_matches(p[2], '^[aeiou]'))) > 0 GROUP BY lang""",
    "ranked_lookup": """WITH k AS (SELECT DISTINCT p_brand, unnest(['red widget', 'ring', 'small ring of gold', 'nothing alike']) AS needle FROM part),
        h AS (SELECT k.p_brand, needle, p_partkey, CASE WHEN p_name = needle THEN 0 ELSE 1 END AS rank FROM k JOIN part USING (p_brand) WHERE contains(p_name, needle) OR contains(needle, p_name)),
        b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, needle ORDER BY rank, p_partkey) AS b FROM h)
        SELECT k.p_brand, k.needle, coalesce(p_partkey, -1) AS found, CAST(rank AS BIGINT) AS rank FROM k LEFT JOIN b ON b.p_brand = k.p_brand AND b.needle = k.needle AND b = 1""",
    "oov_anti": """WITH d AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
        SELECT lang, count(*) AS n FROM d WHERE word NOT IN (SELECT word FROM k) GROUP BY lang""",
    "dictionary_variants": """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS v FROM documents)
        SELECT lower(v) AS word, string_agg(v, ',' ORDER BY v) AS variants, count(*) AS n FROM v GROUP BY lower(v) HAVING count(*) > 2""",
    "ordered_concat": "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, length(string_agg(text, ' ' ORDER BY turn)) AS n_chars FROM conversations GROUP BY conv_id",
    "json_envelope": """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
        SELECT user_id, day, '{"user_id":' || user_id || ',"day":"' || day || '","events":[' || string_agg('{"pos":' || pos || ',"event_type":"' || event_type || '"' || CASE WHEN event_type = 'error' THEN ',"bad":true' ELSE '' END || '}', ',' ORDER BY pos) || ']}' AS json
        FROM p GROUP BY user_id, day""",
    "display_names": """SELECT DISTINCT replace(p_name, ' ', '_') AS rule, CASE WHEN p_name = 'red widget' THEN 'The red one' ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS title,
        printf('%03d_007', length(p_name)) AS file_key FROM part""",
    "strip_marks": """SELECT lang, CAST(sum(len(list_filter(string_split(text, ''), lambda c: strip_accents(c) <> c))) AS BIGINT) AS n_marks FROM documents GROUP BY lang""",
}

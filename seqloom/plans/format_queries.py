"""File formats as round trips of conversations, lines and events: written as texts, read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, rules
from ..sources import corpus, rule_files, textgrid
from .scripted import choice, choice_sql
from .tables import KEY, ORDER, SQL_POS, positions, table

#: Phones of a word.
PHONES = 3


def _tiers(spark, d):
    """Turns as words of a second each, a pause where a turn has no text, and three phones to each, the last of every fourth turn silent."""
    t = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    words = t.select("file_id", F.lit("words").alias("tier"), F.col("turn").cast("int").alias("idx"), F.col("turn").cast("double").alias("xmin"), (F.col("turn") + 1.0).alias("xmax"), "text")
    k = t.select("file_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(PHONES - 1))).alias("k"))
    silent = (F.col("turn") % 4 == 3) & (F.col("k") == PHONES - 1)
    phones = k.select(
        "file_id", F.lit("phones").alias("tier"), (F.col("turn") * PHONES + F.col("k")).cast("int").alias("idx"), (F.col("turn") + F.col("k") / 4).alias("xmin"),
        (F.col("turn") + (F.col("k") + 1) / 4).alias("xmax"), F.when(silent, "").otherwise(F.concat(F.lit("p"), F.col("k").cast("string"))).alias("text"),
    )
    return words.unionByName(phones)


_TURNS = "SELECT CAST(conv_id AS VARCHAR) AS file_id, turn, coalesce(text, '') AS text FROM conversations"
_WORDS = f"SELECT file_id, 'words' AS tier, turn AS idx, CAST(turn AS DOUBLE) AS xmin, turn + 1.0::DOUBLE AS xmax, text FROM ({_TURNS})"
_PHONES = f"""SELECT file_id, 'phones' AS tier, turn * {PHONES} + k AS idx, turn + k / 4.0::DOUBLE AS xmin, turn + (k + 1) / 4.0::DOUBLE AS xmax,
    CASE WHEN turn % 4 = 3 AND k = {PHONES - 1} THEN '' ELSE 'p' || k END AS text FROM ({_TURNS}), unnest(range(0, {PHONES})) AS t(k)"""


def textgrid_round_trip(spark, d):
    """Tiers of all conversations written as file texts and read back; the words' texts by digest."""
    t = textgrid.parse_textgrids(textgrid.textgrid_text(_tiers(spark, d)))
    return t.select("file_id", "tier", F.col("idx").cast("bigint").alias("idx"), "xmin", "xmax", F.md5("text").alias("digest"))


def phones_in_words(spark, d):
    """Spoken phones under spoken words."""
    p = textgrid.phones_in_words(textgrid.parse_textgrids(textgrid.textgrid_text(_tiers(spark, d))))
    return p.select("file_id", F.col("word_idx").cast("bigint").alias("word_idx"), F.md5("word").alias("word"), "phone", "start", "end")


def _phones(spark, d):
    """Events as phones: a user is a verse, two events a word."""
    i, q, word = F.col("event_id"), F.col("value"), F.floor(F.col("pos") / 2).cast("int")
    trimmed, pair = i % 5 == 0, i % 7 == 0
    return positions(spark, d).select(
        (F.col("user_id") % 20).cast("int").alias("chapter"), F.col("user_id").cast("int").alias("verse"), F.concat(F.lit("f_"), F.col("user_id").cast("string")).alias("file_id"), F.lit('a "text"').alias("verse_text"),
        F.lit(3.5).alias("duration"), word.alias("word_idx"), F.concat(F.lit('w"'), word.cast("string")).alias("word"), F.lit(0.5).alias("word_start"), F.lit(1.5).alias("word_end"),
        F.lit(1000.0).alias("word_ms"), (F.col("pos") % 2).cast("int").alias("phone_idx"), F.col("event_type").alias("ipa"), F.col("event_type").alias("mfa"), F.col("pos").cast("double").alias("start"), (F.col("pos") + 1.0).alias("end"),
        q.alias("duration_ms"), F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r"), F.lit("q"))).alias("rules"), F.when(q > 25, "high").otherwise("low").alias("confidence"),
        (q > 45).alias("skip_assessment"), (i % 11 == 0).alias("is_verse_final"), trimmed.alias("verse_final_silence_trimmed"), F.when(trimmed, q * 2).alias("original_duration_ms"),
        F.when(trimmed, q).alias("trimmed_duration_ms"), pair.alias("geminate_pair"), F.when(pair, q + 1).alias("geminate_total_ms"), F.when(pair, "first").alias("geminate_position"),
    )


def aligned_round_trip(spark, d):
    """Aligned chapters written as JSON and read back: everything is still there."""
    again = corpus.parse_aligned(corpus.aligned_json(_phones(spark, d)).select("value"))
    return again.select(
        "chapter", "verse", "file_id", "verse_text", "word_idx", "word", "phone_idx", "ipa", "mfa", "start", "duration_ms", F.array_join("rules", ",").alias("rules"), "confidence", "skip_assessment", "is_verse_final",
        "verse_final_silence_trimmed", "original_duration_ms", "trimmed_duration_ms", "geminate_pair", "geminate_total_ms", "geminate_position",
    )


def _corpus(spark, d):
    """All conversations as one corpus text: a chapter each, its turns the verses."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("number"), F.coalesce("text", F.lit("")).alias("text")))).alias("ayahs"))
    chapters = c.select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").cast("int").alias("number"), F.lit("name").alias("name"), "ayahs")).alias("surahs"))).alias("value"))
    return corpus.parse_corpus(chapters)


def corpus_scan(spark, d):
    """All verses of a corpus, one looked up by its key, and rows that ask for their text."""
    c = _corpus(spark, d)
    asked = table(spark, d, "conversations").select(F.col("conv_id").cast("int").alias("chapter"), (F.col("turn") + 2).cast("int").alias("verse"))
    parts = [("scan", c), ("lookup", corpus.lookup(c, 2, 1)), ("joined", corpus.with_verses(asked, c))]
    out = [p.select(F.lit(n).alias("how"), "chapter", "verse", F.md5("text").alias("digest")) for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def dictionary_lines(spark, d):
    """Distinct pronunciations of kinds of events (their sounds within ten events of a user) as lines of a dictionary, and the words that it lacks."""
    s = positions(spark, d).select("user_id", F.floor(F.col("pos") / 10).alias("ten"), "pos", F.col("event_type").alias("word"), choice("abc", F.col("event_id") % 3).alias("s"))
    entries = corpus.dictionary(s, ["user_id", "ten"], "word", "pos", "s")
    words = table(spark, d, "customer").select(F.col("c_mktsegment").alias("word")).unionByName(s.select("word"))
    lacking = corpus.missing_words(words, entries)
    return corpus.dictionary_lines(entries).unionByName(lacking.select(F.concat(F.lit("missing "), "word").alias("value")))


RULE_FILE = """
rules:
- name: one
  category: madd
  priority: 5
  pattern: {target: '[view click]', following_context: '![error signup]', conditions: {long: true}}
- name: two
  priority: 9
  pattern: {target: purchase, preceding_context: [view, click]}
- name: bad
  colour: red
"""


def rule_file_scan(spark, d):
    """Rules of a file, the faulty one left out, matched over all events."""
    found, problems = rule_files.parse_rules(RULE_FILE)
    s = positions(spark, d).select(*KEY, *ORDER, "pos", F.col("event_type").alias("symbol"), (F.col("value") > 30).alias("long"))
    m = rules.match(context.with_neighbours(s, KEY, ORDER, ["symbol"]), found)
    return m.select("event_id", "symbol", "rule", "category", "priority", F.lit(len(problems)).alias("n_problems"))


#: First bytes and endings of uploads, by the rest of a page's id.
HEADS = ("RIFF0000WAVE", "ID3", "OggS", "0000ftyp", "fLaC", "<html>", "RIF")
ENDINGS = (".wav", ".MP3", ".ogg", ".m4a", ".txt", "")


def audio_files(spark, d):
    """Pages as uploads: what is wrong with each, its kind by its first bytes, and where the recording of a verse lies."""
    i = F.col("page_id")
    p = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("file"), choice(ENDINGS, i % len(ENDINGS))).alias("name"),
        F.when(i % 13 == 0, F.lit("").cast("binary")).otherwise(F.concat(choice(HEADS, i % len(HEADS)), F.coalesce("html", F.lit(""))).cast("binary")).alias("content"),
    )
    return p.select(
        "page_id", corpus.upload_problem(F.col("name"), F.col("content"), 9000).alias("problem"), corpus.is_audio(F.col("content")).alias("kind"),
        corpus.audio_path("/data/", (i % 114 + 1).cast("int"), (i % 286 + 1).cast("int")).alias("path"),
    )


QUERIES = {f.__name__: f for f in (
    textgrid_round_trip, phones_in_words, aligned_round_trip, corpus_scan, dictionary_lines, rule_file_scan, audio_files,
)}

_TURN_WORDS = f"SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS word_idx FROM ({_WORDS}) WHERE text <> ''"
_NAME = f"'file' || {choice_sql(ENDINGS, f'page_id % {len(ENDINGS)}')}"
_HEAD = choice_sql(HEADS, f"page_id % {len(HEADS)}")

ORACLES = {
    "textgrid_round_trip": f"SELECT file_id, tier, idx, xmin, xmax, md5(text) AS digest FROM ({_WORDS} UNION ALL {_PHONES})",
    "phones_in_words": f"""SELECT p.file_id, w.word_idx, md5(w.text) AS word, p.text AS phone, p.xmin AS start, p.xmax AS "end" FROM ({_PHONES}) p JOIN ({_TURN_WORDS}) w ON w.file_id = p.file_id AND p.text <> ''
        AND w.word_idx = (SELECT min(word_idx) FROM ({_TURN_WORDS}) x WHERE x.file_id = p.file_id AND x.xmax > p.xmin)""",
    "aligned_round_trip": f"""SELECT user_id % 20 AS chapter, user_id AS verse, 'f_' || user_id AS file_id, 'a "text"' AS verse_text, pos // 2 AS word_idx,
        'w"' || (pos // 2) AS word, pos % 2 AS phone_idx, event_type AS ipa, event_type AS mfa, CAST(pos AS DOUBLE) AS start, value AS duration_ms,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE 'r,q' END AS rules, CASE WHEN value > 25 THEN 'high' ELSE 'low' END AS confidence, value > 45 AS skip_assessment, event_id % 11 = 0 AS is_verse_final, event_id % 5 = 0 AS verse_final_silence_trimmed,
        CASE WHEN event_id % 5 = 0 THEN value * 2 END AS original_duration_ms, CASE WHEN event_id % 5 = 0 THEN value END AS trimmed_duration_ms, event_id % 7 = 0 AS geminate_pair,
        CASE WHEN event_id % 7 = 0 THEN value + 1 END AS geminate_total_ms, CASE WHEN event_id % 7 = 0 THEN 'first' END AS geminate_position FROM ({SQL_POS})""",
    "corpus_scan": """WITH c AS (SELECT conv_id AS chapter, turn + 1 AS verse, md5(coalesce(text, '')) AS digest FROM conversations)
        SELECT 'scan' AS how, * FROM c UNION ALL SELECT 'lookup', * FROM c WHERE chapter = 2 AND verse = 1
        UNION ALL SELECT 'joined', a.chapter, a.verse + 1, c.digest FROM c a LEFT JOIN c ON c.chapter = a.chapter AND c.verse = a.verse + 1""",
    "dictionary_lines": f"""WITH s AS (SELECT user_id, pos // 10 AS ten, event_type AS word, string_agg({choice_sql("abc", "event_id % 3")}, ' ' ORDER BY pos) AS p FROM ({SQL_POS}) GROUP BY ALL)
        SELECT DISTINCT word || chr(9) || p AS value FROM s
        UNION ALL SELECT 'missing ' || w FROM (SELECT DISTINCT c_mktsegment AS w FROM customer UNION SELECT event_type FROM events) WHERE w NOT IN (SELECT word FROM s)""",
    "rule_file_scan": f"""WITH s AS (SELECT *, lag(event_type) OVER w AS b, lead(event_type) OVER w AS a FROM ({SQL_POS}) WINDOW w AS (PARTITION BY user_id ORDER BY pos))
        SELECT event_id, event_type AS symbol, 'one' AS rule, 'madd' AS category, 5 AS priority, 1 AS n_problems FROM s WHERE event_type IN ('view', 'click') AND a NOT IN ('error', 'signup') AND value > 30
        UNION ALL SELECT event_id, event_type, 'two', 'general', 9, 1 FROM s WHERE event_type = 'purchase' AND b IN ('view', 'click')""",
    "audio_files": f"""WITH p AS (SELECT page_id, {_NAME} AS name, CASE WHEN page_id % 13 = 0 THEN '' ELSE {_HEAD} || coalesce(html, '') END AS c FROM pages),
        k AS (SELECT *, CASE WHEN starts_with(c, 'RIFF') THEN 'wav' WHEN starts_with(c, 'ID3') THEN 'mp3' WHEN starts_with(c, 'OggS') THEN 'ogg' WHEN substring(c, 5, 4) = 'ftyp' THEN 'm4a' END AS kind FROM p)
        SELECT page_id, CASE WHEN NOT regexp_matches(lower(name), '[.](wav|m4a|mp3|aac|mp4|ogg)$') THEN 'format is not supported' WHEN c = '' THEN 'file is empty' WHEN octet_length(encode(c)) > 9000 THEN 'file is too large'
        WHEN kind IS NULL THEN 'format is not supported' END AS problem, kind, printf('/data/surah_%d_wav16k/%03d_%03d.wav', page_id % 114 + 1, page_id % 114 + 1, page_id % 286 + 1) AS path FROM k""",
}

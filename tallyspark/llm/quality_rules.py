"""Line-first cleaning with built-in functions only.

Every line is held against three rules; a line that breaks one is removed:

* punctuation: at least ``MIN_LINE_WORDS`` words without one punctuation mark, or over
  ``MAX_SYMBOL_PCT`` percent symbols, or doubled exclamation marks on half of its words;
* navigation: at least ``MIN_BARS`` menu separators, one for every ``WORDS_A_BAR`` words or more;
* boilerplate: one of ``BOILERPLATE`` in it, whatever the case of A-Z.

A document is rejected if fewer than ``MIN_KEPT_PCT`` percent of its words are left, or if it
fails the base rules (under 50 words, or over half of the words in repeated 3-word windows).
Null and empty texts have no words and are rejected. Rows stay as they are, so repeated rows,
null ids and extra columns pass through; a column that has the name of an added one is replaced
by it. An empty table gives an empty result.

Repeated windows are found by 64-bit hashes within one text, at odds of about n*n/2**65 for a text of n words.
Everything is row-wise: no shuffle, no Python, whatever the source or the length of a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD_RE, lower_ascii, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_LINE_WORDS = 6
MAX_SYMBOL_PCT = 10
MIN_BARS = 3
WORDS_A_BAR = 5
MIN_KEPT_PCT = 50
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies",
    "accept cookies", "click here", "sign up for", "subscribe to", "enable javascript", "lorem ipsum",
    "licensed under", "released under", "share on facebook", "skip to content",
    "alle rechte vorbehalten", "wir verwenden cookies", "tous droits r\u00e9serv\u00e9s", "nous utilisons des cookies",
    "todos los derechos reservados", "utilizamos cookies",
)
#: What ends or parts sentences, also in scripts other than Latin.
MARKS = ".,;:!?\u2026\u3002\uff0c\u3001\uff1b\uff1a\uff01\uff1f\u0964\u061f\u060c"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "clean_text", "n_words_kept", "base_failed", "kept")


def count_of(c: Column, part: str) -> Column:
    """How often a part occurs in a text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def n_line_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RE))


def n_line_symbols(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{SYMBOLS}]"))


def any_phrase(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(phrase) for phrase in BOILERPLATE))


def line_fails(line: Column, symbols: Column, shouts: Column, phrases: Column) -> Column:
    """Whether a line breaks a rule. The three flags say whether its document has what the costly
    tests look for; cheap tests stand first, as And and Or stop at the first that decides."""
    n = n_line_words(line)
    bars = count_of(line, "|")
    return (
        (~line.rlike(f"[{MARKS}]") & (n >= MIN_LINE_WORDS))
        | (symbols & (n_line_symbols(line) * 100 > F.length(line) * MAX_SYMBOL_PCT))
        | (shouts & line.contains("!!") & (n >= MIN_LINE_WORDS) & (count_of(line, "!!") * 2 >= n))
        | (symbols & line.contains("|") & (bars >= MIN_BARS) & (bars * WORDS_A_BAR >= n))
        | (phrases & any_phrase(lower_ascii(line)))
    )


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df``, with the base counts, ``base_failed``, ``clean_text`` (without the
    lines that fail), ``n_lines``, ``n_lines_removed``, ``n_words_kept`` and ``kept``."""
    # The columns stay together, so that none of their names can meet one of ours.
    kept = [c for c in df.columns if c not in ADDED]
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__q_row"), F.col(f"`{text}`").alias("__q_text"))
    t = F.col("__q_text")
    # Arrays that lambdas refer to stand in a projection of their own; else each element would compute them again.
    split = df.select(
        "*",
        words(t).alias("__q_words"),
        F.coalesce(F.split(t, "\n"), F.array().cast("array<string>")).alias("__q_lines"),
        F.coalesce(n_line_symbols(t), F.lit(0)).cast("long").alias("__q_symbols"),
        F.coalesce(t.contains("!!"), F.lit(False)).alias("__q_shouts"),
        F.coalesce(any_phrase(F.lower(t)), F.lit(False)).alias("__q_phrases"),
    )
    n = F.size("__q_words")
    window = lambda i: F.struct(
        F.xxhash64(*(F.get("__q_words", i + k) for k in (0, 1, 2))).alias("w"), i.alias("i")
    )
    fails = lambda x: line_fails(x, F.col("__q_symbols") > 0, F.col("__q_shouts"), F.col("__q_phrases"))
    windows = split.select(
        "*",
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).alias("__q_windows"),
        F.filter("__q_lines", lambda x: ~fails(x)).alias("__q_good"),
        F.filter("__q_lines", lambda x: x.rlike(WORD_RE)).alias("__q_worded"),
    )
    here = F.col("__q_windows")
    same = lambda x, j: F.coalesce(F.get(here, j)["w"] == x["w"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(here, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    counted = windows.select(
        *(F.col("__q_row").getField(c).alias(c) for c in kept),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__q_words", "")).cast("long").alias("word_chars"),
        F.col("__q_symbols").alias("n_symbols"),
        (F.size("__q_worded") - F.size(F.array_distinct("__q_worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__q_lines").cast("long").alias("n_lines"),
        (F.size("__q_lines") - F.size("__q_good")).cast("long").alias("n_lines_removed"),
        F.array_join("__q_good", "\n").alias("clean_text"),
    )
    left = F.when(F.col("n_lines_removed") == 0, F.col("n_words")).otherwise(n_line_words(F.col("clean_text")))
    bad = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return counted.select("*", left.cast("long").alias("n_words_kept"), bad.alias("base_failed")).select(
        "*", (~F.col("base_failed") & (F.col("n_words_kept") * 100 >= F.col("n_words") * MIN_KEPT_PCT)).alias("kept")
    )


def op1_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_removed", "n_words_kept",
    )


def _sql_contains(column: str) -> str:
    return " OR ".join(f"contains({column}, '{p}')" for p in BOILERPLATE)


#: What a line must not be, and the counts, in DuckDB's SQL.
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_FAILS_SQL = f"""(
    (len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) >= {MIN_LINE_WORDS} AND NOT regexp_matches(l, '[{MARKS}]'))
    OR (length(l) - length(translate(l, '{SYMBOLS}', ''))) * 100 > length(l) * {MAX_SYMBOL_PCT}
    OR (len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) >= {MIN_LINE_WORDS}
        AND (length(l) - length(replace(l, '!!', ''))) // 2 * 2 >= len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')))
    OR (length(l) - length(replace(l, '|', '')) >= {MIN_BARS}
        AND (length(l) - length(replace(l, '|', ''))) * {WORDS_A_BAR} >= len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')))
    OR {_sql_contains("translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})"""


def verdict_sql(source: str) -> str:
    """CTEs ``ln``, ``wd``, ``q_lines``, ``q_reps`` and ``verdict`` (one row per doc_id) over a relation with doc_id, text."""
    return f"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k
       FROM {source} WHERE text IS NOT NULL),
q_lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {LINE_FAILS_SQL}) AS n_lines_removed,
    count(*) FILTER (WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]'))
      - count(DISTINCT l) FILTER (WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS n_dup_lines,
    coalesce(sum(len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'))) FILTER (WHERE NOT {LINE_FAILS_SQL}), 0) AS n_words_kept,
    coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (WHERE NOT {LINE_FAILS_SQL}), '') AS clean_text
  FROM ln GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS k
       FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM {source})),
q_tri AS (SELECT doc_id, k, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
q_flag AS (SELECT doc_id, k, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS f FROM q_tri),
q_reps AS (SELECT doc_id, count(*) FILTER (WHERE f OR f1 OR f2) AS n_repeat_words FROM (
  SELECT doc_id, f, coalesce(lag(f) OVER o, false) AS f1, coalesce(lag(f, 2) OVER o, false) AS f2
  FROM q_flag WINDOW o AS (PARTITION BY doc_id ORDER BY k)) GROUP BY doc_id),
q_base AS (
  SELECT d.doc_id, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_words,
    coalesce(length(translate(d.text, {WHITE_SQL}, '')), 0)::BIGINT AS word_chars,
    coalesce(length(d.text) - length(translate(d.text, '{SYMBOLS}', '')), 0)::BIGINT AS n_symbols,
    coalesce(q.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(q.n_lines, 0)::BIGINT AS n_lines, coalesce(q.n_lines_removed, 0)::BIGINT AS n_lines_removed,
    coalesce(q.n_words_kept, 0)::BIGINT AS n_words_kept, coalesce(q.clean_text, '') AS clean_text
  FROM {source} d LEFT JOIN q_lines q USING (doc_id) LEFT JOIN q_reps r USING (doc_id)),
verdict AS (SELECT *, base_failed IS FALSE AND n_words_kept * 100 >= n_words * {MIN_KEPT_PCT} AS kept FROM (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM q_base))"""


OP1_SQL = f"""WITH {verdict_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
  n_lines, n_lines_removed, n_words_kept FROM verdict"""

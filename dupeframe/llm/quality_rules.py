"""Operator 3: line-first cleaning, in column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dupeframe.llm.words import GAP, WORD

SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = "[.!?…;:。！？]"
SEPARATORS = "[|»›·•>]"
# Phrases of page furniture, looked for in lower-cased lines.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "sign up for our newsletter", "subscribe to our newsletter",
    "click here to", "lorem ipsum", "skip to content", "back to top",
)


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda word: word != "")


def line_facts(lines: Column, any_symbols: Column, phrase_words: int = 30) -> Column:
    """Struct<line, words, chars, symbols, low> per line, so that no rule computes one twice;
    ``low`` is set for lines of up to ``phrase_words`` words."""
    parted = F.transform(lines, lambda line: F.struct(line.alias("line"), _words(line).alias("parts")))
    return F.transform(parted, lambda x: F.struct(
        x["line"].alias("line"), F.size(x["parts"]).alias("words"),
        F.length(F.array_join(x["parts"], "")).alias("chars"),
        F.when(any_symbols, _symbols(x["line"])).otherwise(F.lit(0)).alias("symbols"),
        F.when(F.size(x["parts"]) <= phrase_words, F.lower(x["line"])).alias("low")))


def line_fails(
    fact: Column,
    symbols_per_word: float = 0.5,
    shout_words: int = 3,
    nav_words: int = 8,
    mark_words: int = 12,
) -> Column:
    """Whether a line with words fails a rule: navigation and markup (a symbol for every second
    word, or a short line with separators), shouting (capitals only), punctuation (a long line
    without any mark that ends a sentence or clause), or a boilerplate phrase in a line that is
    no long paragraph."""
    line, words = fact["line"], fact["words"]
    navigation = (words <= nav_words) & line.rlike(rf"{WORD}{GAP}{SEPARATORS}{GAP}{WORD}")
    shouting = (words >= shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
    unmarked = (words >= mark_words) & ~line.rlike(SENTENCE_MARKS)
    fails = (fact["symbols"] >= symbols_per_word * words) | navigation | shouting | unmarked
    return fails | F.coalesce(reduce(
        lambda a, b: a | b, [fact["low"].contains(phrase) for phrase in BOILERPLATE]), F.lit(False))


def clean_lines(
    docs: DataFrame,
    text_col: str = "text",
    max_lost: float = 0.4,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """All columns of ``docs`` and one struct column ``_quality``:

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed: the base rules.
    cleaned: the text without failed lines, repeats of an earlier line and lines without words;
    unchanged where no line fails or repeats.
    lost_chars: code points in words that the cleaning removed.
    kept: not base_failed, and at most ``max_lost`` of ``word_chars`` lost.

    Everything is computed inside the row, so nothing is shuffled and no row depends on another;
    sorting the windows of one text is the largest step. Null and empty texts have no words:
    base_failed. An existing column ``_quality`` is replaced, others are kept as they are.
    """
    # Arrays that a lambda looks into are columns of their own with two or more uses, so that
    # the optimiser keeps them materialised instead of computing them once per element.
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "_quality"]
    step = docs.select(F.struct(*kept).alias("_q_row"), F.coalesce(
        F.col(text_col).cast("string"), F.lit("")).alias("_q_text"))
    step = step.withColumn("_q_symbols", _symbols(F.col("_q_text")).cast("long"))
    step = step.withColumn("_q_words", _words(F.col("_q_text")))
    step = step.withColumn("_q_hashes", F.transform("_q_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("_q_n", F.size("_q_hashes"))
    hashes = F.col("_q_hashes")
    step = step.withColumn("_q_windows", F.when(F.col("_q_n") >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.col("_q_n") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"),
            i.alias("at"))))))
    windows = F.col("_q_windows")

    def same(i: Column, x: Column) -> Column:
        return F.coalesce(F.get(windows, i)["h"] == x["h"], F.lit(False))

    step = step.withColumn("_q_at", F.sort_array(F.filter(F.transform(
        windows, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["at"])),
        lambda at: at.isNotNull())))
    at = F.col("_q_at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    lines = F.filter(F.split(F.col("_q_text"), "\n"), lambda line: line.rlike(WORD))
    step = step.withColumn("_q_lines", lines)
    distinct = F.array_distinct(F.col("_q_lines"))
    step = step.withColumn("_q_kept_lines", F.filter(
        line_facts(distinct, F.col("_q_symbols") > 0), lambda x: ~line_fails(x)))
    n_words = F.col("_q_n").cast("long")
    base = step.withColumn("_q_repeat", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (n_words < min_words) | (100 * F.col("_q_repeat") > max_repeat_percent * n_words)
    chars = F.length(F.array_join("_q_words", "")).cast("long")
    left = F.aggregate("_q_kept_lines", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    # Always true. As it is not deterministic to the optimiser, a filter on the verdict stays above
    # this projection; moved below, it would compute every array anew where it is used.
    here = F.monotonically_increasing_id() >= 0
    quality = F.struct(
        n_words.alias("n_words"),
        chars.alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"),
        (F.size("_q_lines") - F.size(distinct)).cast("long").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.when(chars == left, F.col("_q_text")).otherwise(
            F.array_join(F.col("_q_kept_lines.line"), "\n")).alias("cleaned"),
        (chars - left).alias("lost_chars"),
        (here & ~failed & (chars - left <= max_lost * chars)).alias("kept"),
    )
    return base.select("_q_row.*", quality.alias("_quality"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of line-first cleaning for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "lost_chars")
    return clean_lines(docs).select("doc_id", *[F.col(f"_quality.{name}") for name in names])


# Written for DuckDB. Every rule is the contract's or a rule of line_fails in SQL's own terms.
_W = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_W}') AS words,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_W}')] AS lines
  FROM documents
), spots AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS spot, words FROM base WHERE len(words) >= 3
), grams AS (
  SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, words[spot], words[spot + 1], words[spot + 2]) AS n
  FROM spots
), repeats AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([spot, spot + 1, spot + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id
), line AS (
  SELECT DISTINCT doc_id, unnest(lines) AS line FROM base
), judged AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '{_W}')) AS w,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS s,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c
  FROM line
), good AS (
  SELECT doc_id, sum(c)::BIGINT AS left_chars FROM judged
  WHERE NOT (s >= 0.5 * w
    OR (w <= 8 AND regexp_matches(line, '[^\x20\x09-\x0D][\x20\x09-\x0D]+[|»›·•>][\x20\x09-\x0D]+[^\x20\x09-\x0D]'))
    OR (w >= 3 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
    OR (w >= 12 AND NOT regexp_matches(line, '[.!?…;:。！？]'))
    OR (w <= 30 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')))
  GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM base b LEFT JOIN repeats USING (doc_id) LEFT JOIN good USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars - left_chars AS lost_chars FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= 0.4 * word_chars AS kept, lost_chars
FROM failed
"""

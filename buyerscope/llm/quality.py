"""Quality rules, line first: rules judge every line, failing lines go, and documents that lose too much go.

Everything is array and string functions inside one projection chain: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import SPACE_CLASS, WORD_CLASS, split_words

SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»•·]"
# Phrases that mark a line as boilerplate; compared in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "privacy policy",
    "cookie policy", "enable javascript", "lorem ipsum", "skip to content", "subscribe to our",
)
# A line longer than this many words is prose even if it holds one of the phrases.
BOILERPLATE_WORDS = 30
# Lines of fewer words need closing punctuation.
OPEN_WORDS = 4


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_rule(line: Column) -> Column:
    """Name of the first rule that a line breaks, null for a good line.

    ``symbols``: more than a tenth of its characters are mark-up symbols; ``navigation``: at least one separator
    for every three words; ``shouting``: at least one exclamation mark for every two words, four at least;
    ``boilerplate``: a short line with a stock phrase; ``open``: a very short line without closing punctuation.
    """
    words = F.size(split_words(line))
    phrases = "|".join(BOILERPLATE)
    bangs = _count(line, "!")
    return (
        F.when(~line.rlike(WORD_CLASS), F.lit(None).cast("string"))
        .when(_count(line, r"[#*$%&<>]") * 10 > F.length(line), "symbols")
        .when(_count(line, SEPARATORS) * 3 >= words, "navigation")
        .when((bangs >= 4) & (bangs * 2 >= words), "shouting")
        .when(F.lower(line).rlike(phrases) & (words <= BOILERPLATE_WORDS), "boilerplate")
        .when((words < OPEN_WORDS) & ~line.rlike(r"[.!?:;…\"'»)]" + SPACE_CLASS + "*$"), "open")
    )


def judge(df: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """Every row of ``df`` with its cleaned text and verdict; other columns pass unchanged.

    Added: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (of the whole text), ``base_failed``,
    ``rules`` (rules broken, one per removed line), ``lost_chars`` (characters of words in removed lines),
    ``clean_text`` and ``kept``. A document is kept if it passes the base counts and its removed lines hold at most
    ``max_lost`` of its word characters.

    ``n_repeat_words`` counts the words inside any three-word window that the text holds twice or more. Windows are
    compared by a 64-bit hash within one text.

    A null text counts as empty: all counts 0, not kept, ``clean_text`` empty. Rows are judged one by one, so ties and
    repeated rows get equal verdicts. Working columns start with ``_q_`` and must not occur in ``df``; columns named like
    an added one are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumns({"_q_text": whole, "_q_words": split_words(whole)})
    step = step.withColumns(
        {
            "_q_lines": F.split("_q_text", "\n"),
            "_q_windows": F.when(
                F.size("_q_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_q_words") - 3),
                    lambda i: F.xxhash64(F.get("_q_words", i), F.get("_q_words", i + 1), F.get("_q_words", i + 2)),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
            "n_words": F.size("_q_words").cast("long"),
        }
    ).drop("_q_words")
    step = step.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
            F.sort_array(F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("_q_windows")

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get("_q_sorted", i - 1)["h"], F.get("_q_sorted", i + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), x["i"])

    step = step.withColumn("_q_starts", F.array_compact(F.transform("_q_sorted", twice))).drop("_q_sorted")
    later = [F.transform("_q_starts", lambda i: i + 1), F.transform("_q_starts", lambda i: i + 2)]
    worded = F.filter("_q_lines", lambda x: x.rlike(WORD_CLASS))
    step = step.withColumns(
        {
            "word_chars": _count(F.col("_q_text"), WORD_CLASS + "+").cast("long"),
            "n_symbols": _count(F.col("_q_text"), SYMBOLS).cast("long"),
            "n_repeat_words": F.size(F.array_union(F.array_union("_q_starts", later[0]), later[1])).cast("long"),
            "_q_worded": worded,
            "_q_rules": F.transform("_q_lines", line_rule),
        }
    ).drop("_q_starts")
    step = step.withColumns(
        {
            "n_dup_lines": (F.size("_q_worded") - F.size(F.array_distinct("_q_worded"))).cast("long"),
            "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            "rules": F.array_compact("_q_rules"),
            "clean_text": F.array_join(F.filter("_q_lines", lambda x, i: F.get("_q_rules", i).isNull()), "\n"),
        }
    ).drop("_q_worded", "_q_lines", "_q_rules")
    step = step.withColumn(
        "lost_chars",
        F.when(F.size("rules") == 0, F.lit(0).cast("long")).otherwise(
            F.col("word_chars") - _count(F.col("clean_text"), WORD_CLASS + "+").cast("long")
        ),
    )
    return step.withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * F.lit(max_lost))
    ).drop("_q_text")


ADDED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rules", "lost_chars",
    "clean_text", "kept",
]


def clean(docs: DataFrame, **options) -> DataFrame:
    """Kept documents only, with their cleaned text and its length, in the columns of ``docs``."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    row = F.struct(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
    # A plain filter would be pushed down to the scan, with the whole chain of expressions repeated inside it.
    judged = judge(docs, **options).select(F.explode_outer(F.when(F.col("kept"), F.array(row))).alias("_q"))
    return judged.where("_q is not null").select("_q.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), pos AS (
  SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM pos
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY rid
), ln AS (
  SELECT rid, unnest(lines) AS line FROM w
), lw AS (
  SELECT rid, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS symbols,
    length(line) - length(regexp_replace(line, '[|»•·]', '', 'g')) AS separators,
    length(line) - length(replace(line, '!', '')) AS bangs
  FROM ln
), lost AS (
  SELECT rid, sum(chars) AS lost_chars, count(*) AS n_lost FROM lw
  WHERE symbols * 10 > length(line) OR separators * 3 >= n OR (bangs >= 4 AND bangs * 2 >= n)
    OR (n <= 30 AND regexp_matches(lower(line), 'all rights reserved|licensed under|released under the|terms of use|privacy policy|cookie policy|enable javascript|lorem ipsum|skip to content|subscribe to our'))
    OR (n < 4 AND NOT regexp_matches(line, '[.!?:;…"''»)][\x20\x09-\x0D]*$'))
  GROUP BY rid
), base AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(n_lost, 0)::BIGINT AS n_lost_lines
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND lost_chars <= word_chars * 0.5 AS kept,
  n_lost_lines, lost_chars
FROM base
"""


def op10_line_first_quality(spark, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    from buyerscope.llm.common import table

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.size("rules").cast("long").alias("n_lost_lines"), "lost_chars",
    )

"""Line de-duplication by spread over sites: a line found on many distinct sites is boilerplate, whatever its count.

HyperLogLog sketches of the sites are merged per line; lines whose estimate is near the threshold get an exact distinct count.
The document with the smallest id keeps the line, so that no text is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buyerscope.llm.common import free_names, table
from buyerscope.storage import write_once

LINE = ["h1", "h2"]
# A counted table below this many rows of three numbers (under 50 MB) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def _hashes(line: Column) -> list[Column]:
    """128 bits of hash: equal hashes are taken for equal lines."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def boilerplate_lines(lines: DataFrame, min_sites: int, precision: int = 12) -> DataFrame:
    """``h1, h2, keeper`` of lines on at least ``min_sites`` distinct sites, exact.

    ``lines``: ``doc_id, site, h1, h2``. The sketch holds 2^precision registers, error 1.04 / 2^(precision / 2); estimates within four
    errors (one site at least) of the threshold are counted exactly.
    """
    band = max(1.0, 4 * 1.04 / 2 ** (precision / 2) * min_sites)
    spread = (
        lines.groupBy(*LINE)
        .agg(F.hll_sketch_agg("site", precision).alias("sketch"), F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
        .where(F.col("n") >= min_sites)
        .select(*LINE, "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") > min_sites - band - 1)
    )
    spread = write_once(spread, "line_spread")
    sure = spread.where(F.col("sites") > min_sites + band).select(*LINE, "keeper")
    near = spread.where(F.col("sites") <= min_sites + band).select(*LINE, "keeper")
    # Few (line, site) pairs are left of many rows: both counts are reduced before they are shuffled.
    counted = (
        lines.join(_bounded(near), LINE)
        .groupBy(*LINE, "keeper", "site").agg(F.lit(1).alias("one"))
        .groupBy(*LINE, "keeper").agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sure.unionByName(counted.select(*LINE, "keeper"))


def mark_lines(docs: DataFrame, min_sites: int = 5, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``removed_at``: 0-based numbers of the lines to remove (null if none).

    Lines are the text between ``\\n``, compared without blanks at their ends; empty lines stay. A null or empty text has no lines
    to remove. A null site counts as no site. The document with the smallest id keeps its copies of the line; a null id is never the
    smallest unless all are null, and rows that repeat an id share its fate. Nothing is shuffled but hashes, and each text once.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_key"), F.col(site).alias("site"),
        F.posexplode(F.split(whole, "\n")).alias("pos", "line"),
    ).withColumn("line", F.trim("line")).where("line <> ''")
    lines = write_once(lines.select("doc_id", "text_key", F.col("site").cast("string").alias("site"), "pos", *_hashes(F.col("line"))), "lines")
    found = write_once(boilerplate_lines(lines, min_sites), "boilerplate")
    left = docs.drop("removed_at")
    owner, key, own = free_names(left, "line_owner", "line_key", "line_text")
    gone = (
        lines.join(_bounded(found), LINE)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias(owner), F.col("text_key").alias(key))
        .agg(F.collect_set("pos").alias("removed_at"))
    )
    left = left.withColumn(own, F.xxhash64(whole))
    same = left[doc_id].eqNullSafe(gone[owner]) & (left[own] == gone[key])
    return left.join(gone, same, "left").drop(owner, key, own)


def kept_text(text: Column, removed_at: Column) -> Column:
    """The text without the numbered lines; null stays null."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed_at, i)), "\n")
    return F.when(removed_at.isNull() | text.isNull(), text).otherwise(kept)


def dedup_lines(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """All documents, in the same columns, with boilerplate lines removed from ``text`` (and ``n_chars`` counted anew). Columns of any name pass through."""
    own = {c: free_names(docs, "own_marks")[0] for c in docs.columns if c.lower() == "removed_at"}
    marked = mark_lines(docs.withColumnsRenamed(own), min_sites)
    fresh = free_names(marked, "fresh_text")[0]
    marked = marked.withColumn(fresh, kept_text(F.col("text"), F.col("removed_at")))
    new = {"text": F.col(fresh), "n_chars": F.length(fresh).cast("long")}
    return marked.select(*[new[c].alias(c) if c in new else F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def op7_line_spread(spark, folder: str) -> DataFrame:
    """Lines removed from every document, and a digest of the text that is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    rest = F.coalesce(kept_text(F.col("text"), F.col("removed_at")), F.lit(""))
    removed = F.when(F.col("removed_at").isNull(), 0).otherwise(F.size("removed_at")).cast("long")
    return mark_lines(docs).select(
        "doc_id", removed.alias("n_removed"), F.length(rest).cast("long").alias("n_kept_chars"), F.md5(rest).alias("kept_md5")
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), b AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS keeper FROM l WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= 5
), m AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND l.doc_id <> b.keeper AS gone
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM m GROUP BY doc_id
)
SELECT doc_id, n_removed::BIGINT AS n_removed, length(rest)::BIGINT AS n_kept_chars, md5(rest) AS kept_md5 FROM r
"""

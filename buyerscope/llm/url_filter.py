"""URL filters as a temporal list join: dated entries become validity intervals, captures meet those active at fetch time.

Column functions only. A capture is judged by the entries that were active when it was fetched, never by later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buyerscope.llm.common import free_names, table

KEY = ["list_id", "kind", "value"]
# More specific kinds decide before less specific ones.
RANK = {"url": 4, "prefix": 3, "host": 2, "domain": 1}


def url_parts(url: Column) -> dict[str, Column]:
    """Lower-case host without user and port, and path without query and fragment; empty texts where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return {"host": host, "path": path}


def list_intervals(entries: DataFrame) -> DataFrame:
    """``list_id, kind, value, action, valid_from, valid_to, month``: one row per interval and month it touches (start months only here).

    ``entries``: ``list_id, kind (url | prefix | host | domain), value, action (block | allow | remove), effective_at``.
    An entry holds until the next entry of the same list, kind and value; ``remove`` ends the one before. Of entries with the
    same time the alphabetically last action counts (remove, block, allow). Entries with a null field are ignored.

    The next entry is looked up within the month, and from month to month by each month's first entry: a value with very many
    entries is never ordered in one group.
    """
    dated = (
        entries.select(*KEY, "action", "effective_at")
        .dropna()
        .groupBy(*KEY, "effective_at")
        .agg(F.max("action").alias("action"))
        .withColumn("month", F.date_trunc("month", "effective_at"))
    )
    inside = F.lead("effective_at").over(Window.partitionBy(*KEY, "month").orderBy("effective_at"))
    firsts = dated.groupBy(*KEY, "month").agg(F.min("effective_at").alias("first_at"))
    following = firsts.select(
        *KEY, "month", F.lead("first_at").over(Window.partitionBy(*KEY).orderBy("month")).alias("following")
    )
    joined = dated.withColumn("inside", inside).join(following, [*KEY, "month"])
    return joined.where("action <> 'remove'").select(
        *KEY, "action", F.col("effective_at").alias("valid_from"), F.coalesce("inside", "following").alias("valid_to")
    )


def candidate_keys(url: Column) -> Column:
    """All (kind, value) pairs under which a list may name a URL: itself, its path prefixes, its host, the host's domains."""
    parts = url_parts(url)
    host, path = parts["host"], parts["path"]
    labels = F.split(host, r"\.")
    folders = F.split(path, "/")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    # Folder k of "/a/b/c" gives "host/a/", "host/a/b/"; the last part is no folder unless the path ends in "/".
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))),
        lambda i: pair("prefix", F.concat(host, F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/"))),
    )
    both = F.array(pair("url", F.concat(host, path)), pair("host", host))
    return F.when(host != "", F.concat(both, prefixes, domains)).otherwise(
        F.array().cast("array<struct<kind:string,value:string>>")
    )


def _by_month(intervals: DataFrame, seen: DataFrame, low: Column, high: Column) -> DataFrame:
    """The intervals once for every month in which they are active and something was fetched; a single far date adds one month, no more."""
    active = intervals.where((F.col("valid_from") <= high) & (F.col("valid_to").isNull() | (F.col("valid_to") > low)))
    active = active.withColumn("fetched", seen.agg(F.collect_set(F.date_trunc("month", "_t"))).scalar())
    first, last = F.date_trunc("month", "valid_from"), F.coalesce("valid_to", high)
    return active.withColumn("month", F.explode(F.filter("fetched", lambda m: (m >= first) & (m <= last)))).drop("fetched")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``blocked`` and the deciding entry (``hit_list, hit_kind, hit_value, hit_from``; null if none).

    Of the active entries the most specific kind decides, then the longest value; ``allow`` wins over ``block``, then the
    smallest list id. Captures without a URL, host or fetch time meet no entry and are not blocked. Repeated captures are judged
    once and get equal results. Added columns replace columns of the same name.

    Intervals are cut at months and joined on (kind, value, month), so that a long history of one value meets
    only the captures of its months; a hot host is an ordinary skewed equality join that adaptive execution can split.
    """
    seen = captures.select(F.col(url).alias("_u"), F.col(fetched_at).alias("_t")).dropna().distinct()
    span = seen.agg(F.min("_t").alias("low"), F.max("_t").alias("high")).first()
    added = ["blocked", "hit_list", "hit_kind", "hit_value", "hit_from"]
    left = captures.drop(*added)
    if span["high"] is None:
        nothing = {c: F.lit(None).cast("string") for c in added[1:4]} | {"hit_from": F.lit(None).cast("timestamp")}
        return left.withColumns({"blocked": F.lit(False), **nothing})
    active = _by_month(list_intervals(entries), seen, F.lit(span["low"]), F.lit(span["high"]))
    asked = seen.select(
        "_u", "_t", F.date_trunc("month", "_t").alias("month"), F.explode(F.array_distinct(candidate_keys(F.col("_u")))).alias("k")
    ).select("_u", "_t", "month", "k.kind", "k.value")
    met = asked.join(active, ["kind", "value", "month"]).where("valid_from <= _t and (valid_to is null or _t < valid_to)")
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[F.col("kind")]
    order = F.struct(
        (-rank).alias("rank"), (-F.length("value")).alias("len"), F.when(F.col("action") == "allow", 0).otherwise(1).alias("act"),
        F.col("list_id").alias("list"), "kind", "value", F.col("valid_from").alias("start"),
    )
    u, t, hit = free_names(left, "seen_url", "seen_at", "seen_hit")
    hits = met.groupBy(F.col("_u").alias(u), F.col("_t").alias(t)).agg(F.min(order).alias(hit))
    joined = left.join(hits, (left[url] == hits[u]) & (left[fetched_at] == hits[t]), "left")
    return joined.withColumns(
        {
            "blocked": F.coalesce(F.col(f"{hit}.act") == 1, F.lit(False)),
            "hit_list": F.col(f"{hit}.list"), "hit_kind": F.col(f"{hit}.kind"), "hit_value": F.col(f"{hit}.value"),
            "hit_from": F.col(f"{hit}.start"),
        }
    ).drop(u, t, hit)


# The tables hold no lists and no fetch times; both are derived from the pages themselves, by rules any engine can repeat.
_FETCH = "timestamp_seconds(1704067200 + (page_id * 7919) % 366 * 86400 + (page_id * 104729) % 86400)"


def _derived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures, and dated entries: hosts by their hash (blocked, lifted, blocked again), folders allowed, single URLs blocked."""
    parts = url_parts(F.col("url"))
    captures = pages.select("page_id", "url", F.expr(_FETCH).alias("fetched_at"))
    named = pages.select("page_id", parts["host"].alias("host"), parts["path"].alias("path")).where("host <> ''")
    number = lambda text, at: F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("long")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    hosts = named.select("host").distinct().where(number(F.col("host"), 1) % 2 == 0)
    first, held = number(F.col("host"), 5) % 200, number(F.col("host"), 9) % 90 + 1
    entry = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    by_host = hosts.select(
        F.lit("hosts").alias("list_id"), F.lit("host").alias("kind"), F.col("host").alias("value"),
        F.explode(F.array(entry("block", day(first)), entry("remove", day(first + held)), entry("block", day(first + held + 30)))).alias("e"),
    ).select("list_id", "kind", "value", "e.action", F.col("e.at").alias("effective_at"))
    folder = F.concat("host", F.regexp_extract("path", "^(/[^/]*/)", 1))
    by_folder = named.select(folder.alias("value")).where("value like '%/'").distinct().where(number(F.col("value"), 1) % 3 == 0)
    by_folder = by_folder.select(
        F.lit("folders").alias("list_id"), F.lit("prefix").alias("kind"), "value", F.lit("allow").alias("action"),
        day(number(F.col("value"), 5) % 300).alias("effective_at"),
    )
    by_url = named.where("page_id % 10 = 0").select(
        F.lit("urls").alias("list_id"), F.lit("url").alias("kind"), F.concat("host", "path").alias("value"),
        F.lit("block").alias("action"), day(F.col("page_id") % 366).alias("effective_at"),
    )
    return captures, by_host.unionByName(by_folder).unionByName(by_url)


def op3_temporal_url_filter(spark, folder: str) -> DataFrame:
    """Verdict of every page at its fetch time."""
    captures, entries = _derived(table(spark, folder, "pages").select("page_id", "url"))
    return filter_captures(captures, entries).select(
        "page_id", F.unix_seconds("fetched_at").alias("fetched_s"), "blocked", "hit_list", "hit_kind", "hit_value",
        F.unix_seconds("hit_from").alias("hit_from_s"),
    )


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 366 * 86400 + (page_id * 104729) % 86400 AS t,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), h AS (
  SELECT host, ('0x' || substr(md5(host), 5, 4))::BIGINT % 200 AS first_day, ('0x' || substr(md5(host), 9, 4))::BIGINT % 90 + 1 AS held
  FROM (SELECT DISTINCT host FROM p WHERE host <> '') WHERE ('0x' || substr(md5(host), 1, 4))::BIGINT % 2 = 0
), f AS (
  SELECT DISTINCT host || regexp_extract(path, '^(/[^/]*/)', 1) AS value FROM p WHERE host <> ''
), e AS (
  SELECT 'hosts' AS list_id, 'host' AS kind, host AS value, 'block' AS action, first_day AS d FROM h
  UNION ALL SELECT 'hosts', 'host', host, 'remove', first_day + held FROM h
  UNION ALL SELECT 'hosts', 'host', host, 'block', first_day + held + 30 FROM h
  UNION ALL SELECT 'folders', 'prefix', value, 'allow', ('0x' || substr(md5(value), 5, 4))::BIGINT % 300 FROM f
    WHERE value LIKE '%/' AND ('0x' || substr(md5(value), 1, 4))::BIGINT % 3 = 0
  UNION ALL SELECT DISTINCT 'urls', 'url', host || path, 'block', page_id % 366 FROM p WHERE host <> '' AND page_id % 10 = 0
), i AS (
  SELECT list_id, kind, value, action, 1704067200 + d * 86400 AS lo,
    lead(1704067200 + d * 86400) OVER (PARTITION BY list_id, kind, value ORDER BY d) AS hi
  FROM (SELECT DISTINCT * FROM e)
), m AS (
  SELECT page_id, i.*, row_number() OVER (PARTITION BY page_id ORDER BY
    CASE kind WHEN 'url' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, length(value) DESC, action, list_id, value, lo) AS n
  FROM p JOIN i ON i.value = CASE kind WHEN 'host' THEN p.host WHEN 'url' THEN p.host || p.path
      ELSE p.host || regexp_extract(p.path, '^(/[^/]*/)', 1) END
    AND i.action <> 'remove' AND i.lo <= p.t AND (i.hi IS NULL OR p.t < i.hi)
)
SELECT p.page_id, p.t AS fetched_s, coalesce(m.action = 'block', false) AS blocked, m.list_id AS hit_list, m.kind AS hit_kind,
  m.value AS hit_value, m.lo AS hit_from_s
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""

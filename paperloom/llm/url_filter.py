"""URL filters over time: every capture is judged by the list entries active when it was fetched.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An entry's action; ``remove`` ends what stood before and has no verdict of its own.
ACTIONS = ("block", "allow", "remove")
#: Verdict where no entry is active.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, trailing dot and leading ``www.``; empty where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def patterns_of(url: Column, host: Column) -> Column:
    """What an entry may name: the host, each parent domain of two labels or more, and host with first path segment."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)", 1)
    own = F.when(segment != "", F.array_append(parents, F.concat(host, segment))).otherwise(parents)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(own))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, active_from, active_to (exclusive, null: still active) of dated entries (pattern, action, listed_at).

    An entry holds until the next one of its pattern. Of several at one instant the last in the order block, allow,
    remove by name's rank (``ACTIONS``) holds. Entries with a null pattern or date, or another action, are dropped.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    known = entries.select("pattern", "action", "listed_at").where(
        F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin(*ACTIONS)
    )
    last = known.groupBy("pattern", "listed_at").agg(F.max_by("action", rank).alias("action"))
    follows = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return last.select("pattern", "action", F.col("listed_at").alias("active_from"), follows.alias("active_to")).where(
        "action <> 'remove'"
    )


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, url, host, fetched_at, verdict, pattern, active_from of every row of ``captures`` (id, url, fetched_at).

    Of the active entries that match, the longest pattern decides. Null or hostless URLs and null
    fetch times match nothing: verdict ``allow``, null pattern. Each input row gives one row,
    repeated rows too; an empty list allows all; other columns are not read.

    The as-of join is an equality on the pattern with a range on time: a host with very many
    captures is a skewed key that adaptive execution splits, and a small list is broadcast by size.
    """
    own = captures.select(
        F.col(id_col), F.col("url"), F.col("fetched_at"), host_of(F.col("url")).alias("host"),
        F.monotonically_increasing_id().alias("__row"),
    )
    asked = own.withColumn("own_pattern", F.explode_outer(patterns_of(F.col("url"), F.col("host"))))
    active = F.expr("own_pattern = pattern and fetched_at >= active_from and (active_to is null or fetched_at < active_to)")
    joined = asked.join(intervals(entries), active, "left")
    hit = F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "pattern", "action", "active_from"))
    best = joined.groupBy("__row").agg(
        *(F.first(c).alias(c) for c in (id_col, "url", "host", "fetched_at")), F.max(hit).alias("hit")
    )
    return best.select(
        id_col, "url", "host", "fetched_at", F.coalesce("hit.action", F.lit(DEFAULT)).alias("verdict"),
        F.col("hit.pattern").alias("pattern"), F.col("hit.active_from").alias("active_from"),
    )


def fetched(pages: DataFrame) -> DataFrame:
    """The pages as captures; the table has no fetch time, so the id gives one within thirty days."""
    minutes = F.expr("pmod(page_id * 7919, 43200)")
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("fetched_at"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts of ``pages``, as the tables hold none: from digits of its MD5 each host is blocked on
    one day, allowed or taken off later, its parent domain may be blocked and its ``/en`` allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = lambda k: F.conv(F.substring(F.md5(F.col("host")), k, 1), 16, 10).cast("int")
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    entry = lambda pattern, action, on: F.struct(pattern.alias("pattern"), action.alias("action"), day(on).alias("listed_at"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    later = F.when(digit(2) < 8, F.lit("allow")).otherwise(F.lit("remove"))
    rows = F.array(
        F.when(digit(1) < 10, entry(F.col("host"), F.lit("block"), digit(3))),
        F.when(digit(1) < 10, entry(F.col("host"), later, 16 + digit(4))),
        F.when(digit(5) < 2, entry(parent, F.lit("block"), 5 + digit(6))),
        F.when(digit(7) < 6, entry(F.concat("host", F.lit("/en")), F.lit("allow"), digit(8))),
    )
    return hosts.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")).select("e.*")


ORACLE = r"""
WITH own AS (
  SELECT page_id, url, to_timestamp(1704067200 + ((page_id * 7919) % 43200 + 43200) % 43200 * 60) AT TIME ZONE 'UTC' AS fetched_at,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)),
                        '\.$', ''), '^www\.', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) AS segment
  FROM pages
), hosts AS (
  SELECT DISTINCT host FROM own WHERE host <> ''
), digits AS (
  SELECT host, list_transform(range(1, 9), lambda k: ('0x' || substr(md5(host), k::INT, 1))::INT) AS d FROM hosts
), entries AS (
  SELECT host AS pattern, 'block' AS action, d[3] AS day FROM digits WHERE d[1] < 10
  UNION ALL SELECT host, CASE WHEN d[2] < 8 THEN 'allow' ELSE 'remove' END, 16 + d[4] FROM digits WHERE d[1] < 10
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'block', 5 + d[6] FROM digits WHERE d[5] < 2
  UNION ALL SELECT host || '/en', 'allow', d[8] FROM digits WHERE d[7] < 6
), last AS (
  SELECT pattern, day, arg_max(action, list_position(['block', 'allow', 'remove'], action)) AS action FROM entries GROUP BY ALL
), spans AS (
  SELECT pattern, action, to_timestamp(1704067200 + day * 86400) AT TIME ZONE 'UTC' AS active_from,
         to_timestamp(1704067200 + lead(day) OVER (PARTITION BY pattern ORDER BY day) * 86400) AT TIME ZONE 'UTC' AS active_to
  FROM last
), asked AS (
  SELECT page_id, url, host, fetched_at, unnest(CASE WHEN host = '' OR host IS NULL THEN [NULL] ELSE list_distinct(
           list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))
           || CASE WHEN segment <> '' THEN [host || segment] ELSE [] END) END) AS own_pattern
  FROM own
), joined AS (
  SELECT a.*, s.pattern, s.action, s.active_from,
         row_number() OVER (PARTITION BY page_id ORDER BY length(s.pattern) DESC NULLS LAST, s.pattern DESC) AS k
  FROM asked a LEFT JOIN spans s ON own_pattern = s.pattern AND s.action <> 'remove' AND fetched_at >= active_from
       AND (active_to IS NULL OR fetched_at < active_to)
)
SELECT page_id, url, host, fetched_at, coalesce(action, 'allow') AS verdict, pattern, active_from FROM joined WHERE k = 1
"""

"""Operator 8: URL filters as a temporal list join.

A list is a log of dated entries: a pattern (a host, which covers its subdomains, or a host with a
path, which covers what lies below) is added to a category or removed from it. Entries become
validity intervals that end where the next entry of the same pattern and category begins. A capture asks for all
hosts and paths above its URL (hosts without case, paths with it); an equi-join on the pattern with the interval around its fetch time gives the
entries that were active then, never those of another day. Both sides are shuffled by
pattern unless the list is small enough for Spark to broadcast by its own size limit; hosts with very many captures
are left to adaptive skew joins.

Defined results: a URL that is null or has no host has host null and no entries; a null fetch time or
entry date is at no time, and such entries are dropped, as are null patterns; of entries of one pattern, category and date a
removal counts last; equal entries count once; repeated captures each have their row; order in the list is irrelevant.
An empty URL is one without host; a URL of any length asks for all the paths above it; without captures there are no rows, with
an empty list nothing is blocked; other columns of either side are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def patterns_above(url: Column) -> Column:
    """Every pattern that covers the URL: its host and parent domains of two labels at least, and the host with each path prefix."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: F.length(x) > 0)
    paths = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def normal_pattern(pattern: Column) -> Column:
    """The pattern with its host in lower case, without dots after the host and slashes at the end; the path keeps its case."""
    host = F.substring_index(pattern, "/", 1)
    path = F.substring(pattern, F.length(host) + 1, F.length(pattern))
    return F.concat(F.regexp_replace(F.lower(host), r"\.+$", ""), F.regexp_replace(path, "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from (pattern, category, action, dated); valid_to null: still active."""
    e = entries.where("pattern is not null and dated is not null and action in ('add', 'remove')").select(
        normal_pattern(F.col("pattern")).alias("pattern"), "category", "action", "dated"
    )
    # One entry a date; 'remove' > 'add'.
    e = e.groupBy("pattern", "category", "dated").agg(F.max("action").alias("action"))
    own = Window.partitionBy("pattern", "category").orderBy("dated")
    e = e.withColumn("valid_to", F.lead("dated").over(own))
    return e.where("action = 'add'").select("pattern", "category", F.col("dated").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, url, host, fetched_at, entries, categories, blocked) of every row of captures (id, url, fetched_at).

    entries: how many were active; categories: theirs, sorted, with commas.
    """
    asked = captures.select(F.col(id_column).alias("id"), "url", "fetched_at")
    known = asked.where(host_of(F.col("url")).isNotNull() & F.col("fetched_at").isNotNull())
    # Each distinct capture is looked up once and joined back by value, so rows need no number.
    keys = known.select("url", "fetched_at").distinct().withColumn("pattern", F.explode(patterns_above(F.col("url"))))
    listed = intervals(entries)
    active = keys.join(listed, "pattern").where(
        (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    found = active.groupBy("url", "fetched_at").agg(
        F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )
    return asked.join(found, ["url", "fetched_at"], "left").select(
        F.col("id").alias(id_column),
        "url",
        host_of(F.col("url")).alias("host"),
        "fetched_at",
        F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        (F.coalesce("entries", F.lit(0)) > 0).alias("blocked"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time. The table has none: a day of 2024 and a second of it stand in, from page_id."""
    return pages.select(
        "page_id", "url",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page_id", F.lit(366)) * 86_400 + F.pmod("page_id", F.lit(86_399))).alias("fetched_at"),
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """A list that grows with the pages: their hosts and first path parts, added on dates of 2024 and partly removed and added again."""
    hosts = pages.where(host_of(F.col("url")).isNotNull()).select(
        host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH.replace("(/[^?#]*)", "/([^/?#]+)"), 1).alias("part"), "page_id"
    )
    by_host = hosts.groupBy(F.col("host").alias("pattern")).agg(F.min("page_id").alias("m"))
    by_part = hosts.where("part <> ''").groupBy(F.concat("host", F.lit("/"), "part").alias("pattern")).agg(F.min("page_id").alias("m"))
    both = by_host.where("m % 3 = 0").withColumn("category", F.lit("spam")).unionByName(
        by_part.where("m % 2 = 1").withColumn("category", F.when(F.col("m") % 5 == 0, "adult").otherwise("malware"))
    )
    logs = F.array(
        F.struct(F.lit("add").alias("action"), (F.col("m") % 180).alias("day")),
        F.struct(F.when(F.col("m") % 4 < 3, "remove").otherwise("none").alias("action"), (F.col("m") % 180 + 45 + F.col("m") % 60).alias("day")),
        F.struct(F.when(F.col("m") % 4 == 1, "add").otherwise("none").alias("action"), (F.col("m") % 180 + 150).alias("day")),
    )
    each = both.select("pattern", "category", F.explode(logs).alias("e")).where("e.action <> 'none'")
    return each.select("pattern", "category", "e.action", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("e.day") * 86_400).alias("dated"))


SQL = r"""
WITH captures AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path,
    make_timestamp((1704067200 + page_id % 366 * 86400 + page_id % 86399) * 1000000) AS fetched_at
  FROM pages),
hosts AS (SELECT host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS part, page_id FROM captures WHERE host IS NOT NULL),
named AS (
  SELECT pattern, m, 'spam' AS category FROM (SELECT host AS pattern, min(page_id) AS m FROM hosts GROUP BY 1) WHERE m % 3 = 0
  UNION ALL
  SELECT pattern, m, CASE WHEN m % 5 = 0 THEN 'adult' ELSE 'malware' END FROM (SELECT host || '/' || part AS pattern, min(page_id) AS m FROM hosts WHERE part <> '' GROUP BY 1) WHERE m % 2 = 1),
logs AS (
  SELECT pattern, category, 'add' AS action, m % 180 AS day FROM named
  UNION ALL SELECT pattern, category, 'remove', m % 180 + 45 + m % 60 FROM named WHERE m % 4 < 3
  UNION ALL SELECT pattern, category, 'add', m % 180 + 150 FROM named WHERE m % 4 = 1),
dated AS (SELECT rtrim(lower(split_part(pattern, '/', 1)), '.') || rtrim(substring(pattern, length(split_part(pattern, '/', 1)) + 1), '/') AS pattern, category, make_timestamp((1704067200 + day * 86400) * 1000000) AS dated, max(action) AS action FROM logs GROUP BY ALL),
valid AS (SELECT *, lead(dated) OVER (PARTITION BY pattern, category ORDER BY dated) AS valid_to FROM dated),
keys AS (
  SELECT page_id, fetched_at, unnest(list_distinct(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1), lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[:i], '/')))) AS pattern
  FROM captures WHERE host IS NOT NULL),
found AS (
  SELECT page_id, count(*) AS entries, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM keys k JOIN valid v USING (pattern) WHERE v.action = 'add' AND v.dated <= k.fetched_at AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)
  GROUP BY 1)
SELECT page_id, url, host, fetched_at, coalesce(entries, 0) AS entries, coalesce(categories, '') AS categories, coalesce(entries, 0) > 0 AS blocked
FROM captures LEFT JOIN found USING (page_id)
"""

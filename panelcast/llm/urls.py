"""URL filters with dated list entries, evaluated as of each capture's fetch time.

Entries of one pattern, in the order of their dates, become validity intervals:
each holds until the pattern's next entry. A pattern is a host (which covers its
subdomains) or a host and a path prefix that ends at a slash. Every capture is
looked up under its host suffixes and path prefixes; of the patterns with an
entry in force at fetch time the most specific one decides (longer host, then
longer path). ``allow`` keeps and ``block`` drops; a capture without a pattern in
force is kept. ``remove`` ends a pattern's entry.

The as-of join is an equality join on (pattern hash, year) with the interval as
condition, so one pattern with many entries stays small per key, and a popular
host is a skewed key of one side only, which adaptive execution splits.

Null or unparsable URLs match no pattern, and a null fetch time is before every
interval: both are kept with verdict ``none``. Entries with a null pattern, date
or action are left out; of entries of one pattern with equal dates ``block``
wins over ``allow``, and both over ``remove``. Repeated captures give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.lines import bound
from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """``pattern``, ``verdict``, ``since`` and ``until`` (null: still in force) from ``pattern``, ``action``, ``dated``."""
    weight = F.expr("CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 WHEN 'remove' THEN 0 END")
    rows = entries.select(F.lower("pattern").alias("pattern"), F.col("dated").cast("date").alias("since"), weight.alias("w"))
    rows = rows.dropna().groupBy("pattern", "since").agg(F.max("w").alias("w"))
    following = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    rows = rows.withColumn("until", following).where("w > 0")
    return rows.select("pattern", F.when(F.col("w") == 2, "block").otherwise("allow").alias("verdict"), "since", "until")


def lookups(captures: DataFrame) -> DataFrame:
    """One row per capture and pattern that could cover it, with ``rank`` growing with specificity."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    # The folders of the path, each with its closing slash: /a/b/c has /, /a/ and /a/b/.
    def folders(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))

    prefixes = bound(F.split("path", "/", -1), folders)
    hosts = F.transform(suffixes, lambda s: F.struct(s.alias("pattern"), (F.length(s).cast("long") * 1_000_000).alias("rank")))
    paths = F.transform(
        F.when(F.length("path") > 0, prefixes).otherwise(F.array().cast("array<string>")),
        lambda p: F.struct(F.concat(F.col("host"), p).alias("pattern"), (F.length("host").cast("long") * 1_000_000 + F.length(p)).alias("rank")),
    )
    rows = captures.where(F.length("host") > 0).select("row", "fetched", F.explode(F.concat(hosts, paths)).alias("p"))
    return rows.select("row", "fetched", "p.pattern", "p.rank")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``id_col``, ``url_col``, ``time_col`` (date), the deciding ``pattern``, its ``verdict`` and ``kept`` for every capture."""
    held = write_stage(validity(entries), "url-validity")
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("date").alias("fetched"))
    # Equal captures get one verdict and are counted, so they stay repeated.
    rows = rows.groupBy("id", "url", "fetched").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("row", F.struct("id", "url", "fetched", "times")).withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    rows = write_stage(rows, "url-captures")
    last = rows.agg(F.max(F.year("fetched"))).head()[0]
    ends = F.least(F.year(F.coalesce(F.date_sub("until", 1), F.lit("9999-12-31").cast("date"))), F.lit(last))
    years = held.where(F.year("since") <= F.lit(last)).withColumn("year", F.explode(F.sequence(F.year("since"), ends))).select("pattern", "year", "verdict", "since", "until")
    asked = lookups(rows).where("fetched is not null").withColumn("year", F.year("fetched"))
    inside = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hits = asked.join(years, ["pattern", "year"]).where(inside)
    best = hits.groupBy("row").agg(F.max(F.struct("rank", "pattern", "verdict")).alias("hit")).select("row", "hit.pattern", "hit.verdict")
    out = rows.select("row").join(best, "row", "left")
    out = out.select("row.*", "pattern", F.coalesce("verdict", F.lit("none")).alias("verdict"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(time_col), "pattern", "verdict", (F.col("verdict") != "block").alias("kept"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts and first folders of a page table, with dates that follow from its smallest ids."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), "^(/[^/]+/)", 1).alias("folder")).where("host <> ''")
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), c.cast("int"))
    m = F.col("m")
    hosts = base.groupBy("host").agg(F.min("page_id").alias("m"))
    dated = F.array(
        F.struct(F.col("host").alias("pattern"), F.lit("block").alias("action"), day((m * 31) % 900).alias("dated")),
        F.struct(F.col("host").alias("pattern"), F.lit("remove").alias("action"), day((m * 31) % 900 + 40 + (m * 17) % 300).alias("dated")),
        F.struct(F.col("host").alias("pattern"), F.lit("block").alias("action"), day((m * 31) % 900 + 400 + (m * 13) % 300).alias("dated")),
    )
    folders = base.where("folder <> ''").groupBy("host", "folder").agg(F.min("page_id").alias("m"))
    spot = F.concat("host", "folder")
    also = F.array(
        F.struct(spot.alias("pattern"), F.lit("allow").alias("action"), day((m * 7) % 1200).alias("dated")),
        F.struct(spot.alias("pattern"), F.lit("remove").alias("action"), day((m * 7) % 1200 + 90).alias("dated")),
    )
    return hosts.select(F.explode(dated).alias("e")).unionByName(folders.select(F.explode(also).alias("e"))).select("e.*")


SQL_URLS = r"""
WITH c AS (
  SELECT page_id, url, DATE '2020-01-01' + CAST((page_id * 7919) % 1461 AS INTEGER) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages
), h AS (SELECT host, min(page_id) AS m FROM c WHERE host <> '' GROUP BY host),
f AS (SELECT host || folder AS spot, min(page_id) AS m FROM (SELECT *, regexp_extract(path, '^(/[^/]+/)', 1) AS folder FROM c) WHERE host <> '' AND folder <> '' GROUP BY 1),
e AS (
  SELECT host AS pattern, 2 AS w, (m * 31) % 900 AS d FROM h UNION ALL SELECT host, 0, (m * 31) % 900 + 40 + (m * 17) % 300 FROM h
  UNION ALL SELECT host, 2, (m * 31) % 900 + 400 + (m * 13) % 300 FROM h
  UNION ALL SELECT spot, 1, (m * 7) % 1200 FROM f UNION ALL SELECT spot, 0, (m * 7) % 1200 + 90 FROM f
), v AS (
  SELECT pattern, w, DATE '2020-01-01' + CAST(d AS INTEGER) AS since, lead(DATE '2020-01-01' + CAST(d AS INTEGER)) OVER (PARTITION BY pattern ORDER BY d) AS until
  FROM (SELECT pattern, d, max(w) AS w FROM e GROUP BY pattern, d)
), hits AS (
  SELECT c.page_id, v.pattern, v.w, length(v.pattern) AS len, contains(v.pattern, '/') AS deep
  FROM c JOIN v ON v.w > 0 AND c.fetched >= v.since AND (v.until IS NULL OR c.fetched < v.until)
    AND CASE WHEN contains(v.pattern, '/') THEN starts_with(c.host || c.path, v.pattern) ELSE c.host = v.pattern OR ends_with(c.host, '.' || v.pattern) END
), best AS (SELECT page_id, arg_max(pattern, (deep, len)) AS pattern, arg_max(w, (deep, len)) AS w FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched, b.pattern, CASE b.w WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict, coalesce(b.w, 0) <> 2 AS kept
FROM c LEFT JOIN best b USING (page_id)
"""


@query("op6_url_filters", SQL_URLS)
def op6_url_filters(spark, folder: str) -> DataFrame:
    """Verdict on every page, fetched on a day that follows from its id, by a dated list over all hosts and folders."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("page_id") * 7919) % 1461).cast("int"))
    return filter_urls(pages.withColumn("fetched", fetched), dated_list(pages))

"""Filtering of captures by dated URL lists: validity intervals and an as-of join, native expressions only.

A list is a log of entries (scope, host, path, action, at, category): ``domain`` entries cover a host and
all hosts below it, ``host`` entries that host alone; either may be narrowed to paths that begin with
``path``. An ``add`` holds from its time until the next entry of the same scope, host and path; a
``remove`` ends it; of entries of one time the removal counts last. A capture is blocked if an entry that
covers its URL is valid at its fetch time.

Captures are reduced to distinct (url, time) pairs first, which folds hot hosts' repeats; a pair's host
and its parent domains are the equality keys of the join with the intervals.

Defined results: a null or unparsable URL, a host longer than 253 characters and a null fetch time match
nothing and are not blocked; hosts are compared in lower case without a final dot, port or user; a
missing path is "/"; entries with a null host or time are ignored; an empty list blocks nothing; repeated
captures are each judged alike; other columns pass through, internal names start with ``__uf``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"

#: The list that the query applies (fixed values): scope, host, path, action, date, category.
ENTRIES = (
    ("domain", "casino-win.example.com", "/", "add", "2023-11-05", "gambling"),
    ("domain", "casino-win.example.com", "/", "remove", "2024-09-01", "gambling"),
    ("domain", "casino-win.example.com", "/", "add", "2025-02-10", "gambling"),
    ("domain", "free-bets.example.com", "/", "add", "2024-03-15", "gambling"),
    ("host", "www.cheap-pills.example.com", "/", "add", "2024-01-20", "pharmacy"),
    ("host", "www.cheap-pills.example.com", "/", "remove", "2025-06-01", "pharmacy"),
    ("domain", "cheap-pills.example.com", "/de/", "add", "2024-06-01", "pharmacy"),
    ("domain", "cheap-pills.example.com", "/", "add", "2025-01-01", "pharmacy"),
    ("domain", "example.org", "/fr/", "add", "2024-08-01", "language"),
    ("domain", "example.org", "/fr/", "remove", "2024-12-01", "language"),
    ("host", "tionsh.example.com", "/en/1", "add", "2024-02-01", "spam"),
    ("host", "blog.tionsh.example.com", "/", "add", "2024-05-01", "spam"),
    ("host", "blog.tionsh.example.com", "/", "add", "2024-07-01", "malware"),
    ("host", "blog.tionsh.example.com", "/", "remove", "2024-10-15", "malware"),
    ("domain", "example.net", "/es/", "add", "2025-03-01", "language"),
    ("domain", "theror.example.com", "/", "remove", "2024-01-01", "spam"),
)


def entries(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT scope, host, path, action, to_timestamp(at) AS at, category FROM VALUES {values} AS t(scope, host, path, action, at, category)")


def intervals(log: DataFrame) -> DataFrame:
    """Validity intervals [since, until) of the list's entries; ``until`` is null while one is open."""
    log = log.where("host IS NOT NULL AND at IS NOT NULL").select(
        F.coalesce("scope", F.lit("domain")).alias("scope"), F.regexp_replace(F.lower("host"), r"\.$", "").alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "action", "at", "category"
    )
    # One entry a time: a removal, else the category that comes first.
    log = log.groupBy("scope", "host", "path", "at").agg(F.max(F.struct((F.col("action") == "remove").cast("int"), "action")).getField("action").alias("action"), F.min("category").alias("category"))
    after = Window.partitionBy("scope", "host", "path").orderBy("at")
    return log.withColumn("until", F.lead("at").over(after)).where("action = 'add'").select("scope", "host", "path", "category", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when((host != "") & (F.length(host) <= 253), host)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, PATH, 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def judge(captures: DataFrame, log: DataFrame, *, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``n_active`` (entries that cover it) and the ``category`` of the most specific one."""
    names = [c for c in captures.columns if c not in ("host", "blocked", "n_active", "category")]
    captures = captures.select(*names)
    pairs = captures.select(F.col(url).alias("__uf_url"), F.col(at).alias("__uf_at")).where("__uf_url IS NOT NULL AND __uf_at IS NOT NULL").distinct()
    pairs = pairs.withColumns({"__uf_host": host_of(F.col("__uf_url")), "__uf_path": path_of(F.col("__uf_url"))}).where("__uf_host IS NOT NULL")
    labels = F.split("__uf_host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (i == 1).alias("own")))
    looked = pairs.withColumn("__uf_key", F.explode(keys))
    valid = intervals(log)
    held = looked.join(
        valid,
        (F.col("__uf_key.key") == valid["host"])
        & (F.col("__uf_key.own") | (valid["scope"] == "domain"))
        & (F.col("__uf_at") >= valid["since"])
        & (valid["until"].isNull() | (F.col("__uf_at") < valid["until"]))
        & F.col("__uf_path").startswith(valid["path"]),
    )
    rank = F.struct(F.length("host"), F.length("path"), (F.col("scope") == "host").cast("int"), "since", "category")
    found = held.groupBy("__uf_url", "__uf_at").agg(F.count(F.lit(1)).alias("n_active"), F.max(rank).getField("category").alias("category"))
    out = captures.join(found, (captures[url] == found["__uf_url"]) & (captures[at] == found["__uf_at"]), "left")
    return out.select(*(captures[c] for c in names), host_of(captures[url]).alias("host"), F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "category")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures. The table holds no fetch time: one is derived from the id, over 600 days from 2024 on."""
    day = F.pmod(F.col("page_id") * 37, F.lit(600)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))


ORACLE = r"""
WITH log(scope, host, path, action, on_day, category) AS (VALUES {values}),
l AS (SELECT scope, host, path, CAST(on_day AS TIMESTAMP) AS since, max(action) AS action, min(category) AS category FROM log GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY scope, host, path ORDER BY since) AS until FROM l),
c AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 600 AS INTEGER) AS TIMESTAMP) AS fetched_at,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS p
  FROM pages),
d AS (SELECT *, CASE WHEN h <> '' AND length(h) <= 253 THEN h END AS host, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM c),
m AS (
  SELECT d.page_id, d.url, d.fetched_at, count(*) AS n_active, arg_max(v.category, (length(v.host), length(v.path), CASE WHEN v.scope = 'host' THEN 1 ELSE 0 END, v.since, v.category)) AS category
  FROM (SELECT DISTINCT * FROM d) d JOIN v ON v.action = 'add' AND d.fetched_at >= v.since AND (v.until IS NULL OR d.fetched_at < v.until)
    AND (d.host = v.host OR (v.scope = 'domain' AND ends_with(d.host, '.' || v.host))) AND starts_with(d.path, v.path)
  GROUP BY ALL)
SELECT d.page_id, d.url, strftime(d.fetched_at, '%Y-%m-%d') AS fetched_on, d.host, m.n_active IS NOT NULL AS blocked, CAST(coalesce(m.n_active, 0) AS BIGINT) AS n_active, m.category
FROM d LEFT JOIN m ON d.page_id = m.page_id AND d.url = m.url AND d.fetched_at = m.fetched_at
""".replace("{values}", ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in ENTRIES))

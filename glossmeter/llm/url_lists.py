"""URL lists with dates: each capture is judged by the entries that were active when it was fetched.

A list is a log of dated entries (list, pattern, day, active). Entries of a pattern become validity
intervals: one ends where the next begins. Patterns are hosts or parent domains (`d:example.com`) and
path beginnings (`p:www.example.com/a`). A URL offers its host, the parent domains and the path
beginnings as keys, no deeper than the deepest pattern of the lists, which cannot match anything deeper;
an equi-join on the key brings the pattern's intervals, and those around the day of the fetch count.

Per pattern there is at most one state a list and day (if a day has both, the entry is active), so its
intervals are bounded by the calendar and lie in one array. Captures are judged once per distinct (URL,
day). A host with most captures is split by Spark as a skewed join; nothing is gathered by host.

Defined results: a null URL or fetch day, or a URL without a host, matches nothing; entries with a null
are no entries; repeated rows of a capture all get their verdict; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glossmeter.llm.common import free_name
from glossmeter.stage import staged

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def _parts(text: Column, at: str) -> Column:
    return F.filter(F.split(text, at), lambda x: x != "")


def keys(url: Column, labels: int, segments: int) -> Column:
    """Keys of a URL: domains of at most `labels` labels, path beginnings of at most `segments` segments."""
    name, of_host, of_path = host(url), _parts(host(url), "[.]"), _parts(F.regexp_extract(url, _PATH, 1), "/")
    n, k = F.least(F.size(of_host), F.lit(labels)), F.least(F.size(of_path), F.lit(segments))
    domains = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(of_host, F.size(of_host) - i + 1, i), "."))))
    paths = F.when((n > 0) & (k > 0), F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(
        F.lit("p:"), name, F.lit("/"), F.array_join(F.slice(of_path, 1, i), "/"))))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(domains, none), F.coalesce(paths, none))


def validity(entries: DataFrame) -> DataFrame:
    """pattern -> intervals [first, until) of its active states; until is null while the last state holds."""
    states = (entries.where("list is not null and pattern is not null and day is not null and active is not null")
              .groupBy("list", "pattern", "day").agg(F.max("active").alias("active")))
    until = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return (states.withColumn("until", until).where("active")
            .groupBy("pattern").agg(F.collect_list(F.struct("list", F.col("day").alias("first"), "until")).alias("intervals")))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """Captures with `blocked`, `n_entries` (active entries that match) and `lists` (their lists, in order).

    These three replace columns of the same names; all others stay, whatever they are called.
    """
    own_url, own_day = free_name(captures, "_url"), free_name(captures, "_day")
    captures = captures.drop(*[c for c in captures.columns if c.lower() in ("blocked", "n_entries", "lists") and c not in (url, day)])
    patterns = staged(validity(entries))
    deep = patterns.agg(
        F.max(F.when(F.col("pattern").startswith("d:"), F.size(F.split("pattern", "[.]")))).alias("labels"),
        F.max(F.when(F.col("pattern").startswith("p:"), F.size(F.split("pattern", "/")) - 1)).alias("segments")).first()
    distinct = captures.select(F.col(url).alias("_url"), F.col(day).alias("_day")).where("_url is not null and _day is not null").distinct()
    asked = distinct.select("_url", "_day", F.explode(keys(F.col("_url"), deep["labels"] or 0, deep["segments"] or 0)).alias("pattern"))
    active = F.filter("intervals", lambda i: (i["first"] <= F.col("_day")) & (i["until"].isNull() | (F.col("_day") < i["until"])))
    hits = (asked.join(patterns, "pattern").select("_url", "_day", F.explode(active["list"]).alias("_list"))
            .groupBy("_url", "_day", "_list").agg(F.count("*").alias("_n"))
            .groupBy("_url", "_day").agg(F.sum("_n").alias("n_entries"), F.array_join(F.sort_array(F.collect_list("_list")), ",").alias("lists")))
    hits = hits.withColumnsRenamed({"_url": own_url, "_day": own_day})
    joined = captures.join(hits, (F.col(url) == F.col(own_url)) & (F.col(day) == F.col(own_day)), "left").drop(own_url, own_day)
    return joined.withColumns({"blocked": F.col("n_entries").isNotNull(), "n_entries": F.coalesce("n_entries", F.lit(0)),
                               "lists": F.coalesce("lists", F.lit(""))})


# -- the query: lists kept on the hosts of the pages themselves ---------------------------------

def _number(text: Column, at: int) -> Column:
    """Four hexadecimal digits of the MD5 of a text as a number."""
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def _on(number: Column) -> Column:
    return F.date_add(F.lit("2023-01-01").cast("date"), number)


def captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", _on(_number(F.col("page_id").cast("string"), 1) % 730).alias("fetch_day"))


def entries(pages: DataFrame) -> DataFrame:
    """A log over the hosts met: listings, removals and new listings on days that follow from the name."""
    hosts = pages.select(host(F.col("url")).alias("h")).where("h <> ''").distinct()
    h, d = F.col("h"), F.regexp_extract("h", r"([^.]+[.][^.]+)$", 1)

    def logs(name, pattern, key, when, *days):
        rows = hosts.where(when).select(F.lit(name).alias("list"), pattern.alias("pattern"), key.alias("k")).where("pattern is not null")
        return rows.select("list", "pattern", F.explode(F.array(*[
            F.struct(_on(day(F.col("k"))).alias("day"), F.lit(i % 2 == 0).alias("active")) for i, day in enumerate(days)])).alias("e")) \
            .select("list", "pattern", "e.day", "e.active")

    malware = logs("malware", F.concat(F.lit("d:"), h), h, _number(h, 1) % 2 == 0,
                   lambda k: _number(k, 5) % 500, lambda k: _number(k, 5) % 500 + 20 + _number(k, 9) % 100,
                   lambda k: _number(k, 5) % 500 + 150 + _number(k, 13) % 100)
    adult = logs("adult", F.when(d != "", F.concat(F.lit("d:"), d)), d, _number(d, 1) % 3 == 0,
                 lambda k: _number(k, 5) % 700)
    spam = logs("spam", F.concat(F.lit("p:"), h, F.lit("/fr")), h, _number(h, 17) % 2 == 0,
                lambda k: _number(k, 21) % 600, lambda k: _number(k, 21) % 600 + 60)
    return malware.unionByName(adult).unionByName(spam)


def filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judge(captures(pages), entries(pages))
    return out.select("page_id", F.col("fetch_day").cast("string").alias("fetch_day"), host(F.col("url")).alias("host"),
                      "blocked", "n_entries", "lists")


ORACLE = r"""
WITH page AS (
    SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
           CAST(DATE '2023-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4)) AS INTEGER) % 730 AS DATE) AS fetch_day
    FROM pages),
hosts AS (SELECT DISTINCT host AS h, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS d FROM page WHERE host <> ''),
n AS (
    SELECT h, d, CAST(('0x' || substr(md5(h), 1, 4)) AS INTEGER) AS h1, CAST(('0x' || substr(md5(h), 5, 4)) AS INTEGER) AS h5,
           CAST(('0x' || substr(md5(h), 9, 4)) AS INTEGER) AS h9, CAST(('0x' || substr(md5(h), 13, 4)) AS INTEGER) AS h13,
           CAST(('0x' || substr(md5(h), 17, 4)) AS INTEGER) AS h17, CAST(('0x' || substr(md5(h), 21, 4)) AS INTEGER) AS h21,
           CAST(('0x' || substr(md5(d), 1, 4)) AS INTEGER) AS d1, CAST(('0x' || substr(md5(d), 5, 4)) AS INTEGER) AS d5
    FROM hosts),
entry AS (
    SELECT 'malware' AS list, h AS pattern, h5 % 500 AS first_n, h5 % 500 + 20 + h9 % 100 AS until_n FROM n WHERE h1 % 2 = 0
    UNION ALL SELECT 'malware', h, h5 % 500 + 150 + h13 % 100, NULL FROM n WHERE h1 % 2 = 0
    UNION ALL SELECT DISTINCT 'adult', d, d5 % 700, NULL FROM n WHERE d <> '' AND d1 % 3 = 0
    UNION ALL SELECT 'spam', h || '/fr', h21 % 600, h21 % 600 + 60 FROM n WHERE h17 % 2 = 0),
hit AS (
    SELECT p.page_id, p.url, e.list FROM page p JOIN entry e
    ON fetch_day >= DATE '2023-01-01' + first_n AND (until_n IS NULL OR fetch_day < DATE '2023-01-01' + until_n)
       AND (CASE e.list
            WHEN 'spam' THEN split_part(e.pattern, '/', 1) = p.host
                 AND regexp_matches(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+fr([/?#]|$)')
            WHEN 'adult' THEN p.host = e.pattern OR ends_with(p.host, '.' || e.pattern)
            ELSE p.host = e.pattern OR ends_with(p.host, '.' || e.pattern) END)),
found AS (SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hit GROUP BY page_id)
SELECT p.page_id, CAST(p.fetch_day AS VARCHAR) AS fetch_day, p.host, f.page_id IS NOT NULL AS blocked,
       coalesce(f.n_entries, 0) AS n_entries, coalesce(f.lists, '') AS lists
FROM page p LEFT JOIN found f ON p.page_id = f.page_id
"""

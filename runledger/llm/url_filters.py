"""URL filters by a temporal list join: every capture is judged by the list entries active when it was fetched.

Dated list changes become validity intervals. Intervals are cut at time buckets, so that the as-of join is an
equi-join on (key, bucket) with a residual range test: a hot host spreads over its buckets, and no capture
meets the whole history of a pattern. DataFrame expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.scratch import Scratch, aliased, col, restored

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
DAY = 86_400


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user and port; empty for any other text or null."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def path_of(url: Column) -> Column:
    """The URL's path, without query and fragment; the case of the path is ignored."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), PATH, 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) in which a pattern is on a list.

    ``entries``: list_name, action (block or allow), kind (domain or prefix), pattern, change (add or
    remove), at (timestamp). Changes with a null in any of these are ignored. Of changes to one pattern at
    one moment a removal wins. valid_to is null while a pattern stays listed; repeated adds prolong nothing.
    A prefix is the same with and without trailing slashes.
    """
    known = entries.select("list_name", "action", "kind", F.lower(F.trim("pattern")).alias("pattern"), "change", "at").dropna()
    # As the paths of captures, prefixes lose trailing slashes: x.net/ads/ and x.net/ads are one pattern.
    known = known.withColumn("pattern", F.when(F.col("kind") == "prefix", F.regexp_replace("pattern", "/+$", "")).otherwise(F.col("pattern")))
    known = known.filter(F.col("pattern") != "")
    one = known.groupBy("list_name", "action", "kind", "pattern", "at").agg(F.max((F.col("change") == "remove").cast("int")).alias("gone"))
    w = Window.partitionBy("list_name", "action", "kind", "pattern").orderBy("at")
    turns = one.withColumn("_was", F.lag("gone").over(w)).filter("_was is null or _was <> gone")
    return turns.withColumn("valid_to", F.lead("at").over(w)).filter("gone = 0").select("list_name", "action", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", bucket_days: int = 32) -> DataFrame:
    """``captures`` with host, blocked, and the deciding list, action, pattern and validity.

    A domain entry holds for the host and everything below it; a prefix entry (host and path) for that path and
    everything below it. Of the entries active at the fetch the longest pattern decides, a prefix before a
    domain, allow before block, then the first list by name. A null URL, one without a host, or a null fetch
    time meets no entry and is not blocked. Repeated rows are judged alike; columns named as the new ones are
    replaced, all others stay, whatever their names.
    """
    spark = captures.sparkSession
    scratch = Scratch(spark, "filters")
    new = ("host", "blocked", "list_name", "action", "pattern", "valid_from", "valid_to")
    own = [c for c in captures.columns if c not in new]
    intervals = scratch.write(validity_intervals(entries), "intervals")
    # The list's own depth bounds the keys that a capture needs: two numbers come to the driver.
    labels, steps = intervals.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/"))))).first()
    judged = captures.select(col(url).alias("u"), col(fetched).cast("timestamp").alias("t"))
    pairs = scratch.write(judged.dropna().distinct().withColumn("host", host_of(F.col("u"))).filter("host <> ''"), "pairs")
    last = pairs.agg(F.max("t")).first()[0]
    parts, path = F.split("host", r"\."), F.split(F.regexp_replace(path_of(F.col("u")), "/+$", ""), "/")
    kinds = []
    if labels:
        n = F.least(F.size(parts), F.lit(labels))
        kinds.append(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, -i, i), ".").alias("pattern"))))
    if steps:
        n = F.least(F.size(path), F.lit(steps))
        kinds.append(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(path, 1, i), "/")).alias("pattern"))))
    bucket = lambda c: F.floor(F.unix_seconds(c) / F.lit(bucket_days * DAY)).cast("long")
    if kinds and last is not None:
        keys = pairs.select("u", "t", bucket(F.col("t")).alias("bucket"), F.explode(F.concat(*kinds)).alias("k")).select("u", "t", "bucket", "k.kind", "k.pattern")
        until = F.least(F.coalesce(F.col("valid_to"), F.lit(last)), F.lit(last))
        cut = intervals.filter(F.col("valid_from") <= F.lit(last)).withColumn("bucket", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(until))))
        active = keys.join(cut, ["kind", "pattern", "bucket"]).filter((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
        rank = F.struct(-F.length("pattern"), F.col("kind") == "domain", F.col("action") == "block", F.col("list_name"))
        won = active.groupBy("u", "t").agg(F.min_by(F.struct("list_name", "action", "pattern", "valid_from", "valid_to"), rank).alias("w"))
    else:
        won = judged.filter("false").withColumn("w", F.lit(None).cast("struct<list_name:string,action:string,pattern:string,valid_from:timestamp,valid_to:timestamp>"))
    rows = captures.select(*aliased(own), col(url).alias("url"), col(fetched).cast("timestamp").alias("at"))
    out = rows.join(won, (F.col("url") == F.col("u")) & (F.col("at") == F.col("t")), "left")
    return out.select(*restored(own), host_of(F.col("url")).alias("host"), F.coalesce(F.col("w.action") == "block", F.lit(False)).alias("blocked"), "w.list_name", "w.action", "w.pattern", "w.valid_from", "w.valid_to")


#: The query's dated lists, by rule from the hosts of ``pages`` (n: the host's length): list, action, kind, pattern, change, day from 2024-01-01, hosts.
CHANGES = (
    ("spam", "block", "domain", "host", "add", "n * 17 % 400", "n % 3 = 0"),
    ("spam", "block", "domain", "host", "remove", "n * 17 % 400 + 90", "n % 3 = 0"),
    ("spam", "block", "domain", "host", "add", "n * 17 % 400 + 200", "n % 6 = 0"),
    ("sections", "block", "prefix", "concat(host, '/en')", "add", "n * 29 % 500", "n % 3 = 1"),
    ("sections", "block", "prefix", "concat(host, '/en')", "remove", "n * 29 % 500 + 300", "n % 6 = 1"),
    ("trusted", "allow", "domain", "host", "add", "n * 13 % 600", "n % 4 = 1"),
    ("parents", "block", "domain", "regexp_replace(host, '^[^.]*[.]', '')", "add", "n * 31 % 700", "n % 5 = 0"),
)
FETCH_DAY = "page_id * 37 % 730"


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture fetched on day ``FETCH_DAY`` from 2024-01-01, against the lists of ``CHANGES``."""
    day = lambda x: f"timestampadd(DAY, cast({x} as int), timestamp'2024-01-01 00:00:00')"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(day(FETCH_DAY)).alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("n", F.length("host"))
    rows = [F.struct(F.lit(a).alias("list_name"), F.lit(b).alias("action"), F.lit(c).alias("kind"), F.expr(d).alias("pattern"), F.lit(e).alias("change"), F.expr(day(f)).alias("at"), F.expr(g).alias("_in")) for a, b, c, d, e, f, g in CHANGES]
    entries = hosts.select(F.explode(F.array(*rows)).alias("e")).select("e.*").filter("_in").drop("_in")
    out = filter_captures(pages, entries)
    days = lambda c: F.datediff(F.col(c), F.lit("2024-01-01").cast("date")).cast("long")
    return out.select("page_id", "host", "blocked", "list_name", "action", "pattern", days("valid_from").alias("from_day"), days("valid_to").alias("to_day"))


def _op2_sql() -> str:
    changes = " union all ".join(f"select '{a}' list_name, '{b}' action, '{c}' kind, {d} pattern, '{e}' change, {f} as since from hosts where {g}" for a, b, c, d, e, f, g in CHANGES)
    return f"""
with p as (
  select page_id, {FETCH_DAY} as t, regexp_extract(lower(coalesce(url, '')), '{HOST}', 1) as host,
    regexp_replace(regexp_extract(lower(coalesce(url, '')), '{PATH}', 1), '/+$', '') as path from pages
), hosts as (select distinct host, length(host) as n from p where host <> ''),
changes as (select distinct * from ({changes})),
one as (select list_name, action, kind, pattern, since, max(case when change = 'remove' then 1 else 0 end) as gone from changes where pattern <> '' group by all),
turns as (select *, lag(gone) over (partition by list_name, action, kind, pattern order by since) as was from one),
spans as (
  select * from (select *, lead(since) over (partition by list_name, action, kind, pattern order by since) as until from turns where was is null or was <> gone)
  where gone = 0
), won as (
  select p.page_id, s.*, row_number() over (partition by p.page_id order by length(pattern) desc, kind = 'domain', action = 'block', list_name) as rn
  from p join spans s on since <= t and (until is null or t < until) and (
    (kind = 'domain' and (host = pattern or suffix(host, '.' || pattern))) or (kind = 'prefix' and (host || path = pattern or prefix(host || path, pattern || '/'))))
  where host <> ''
)
select p.page_id, p.host, coalesce(action = 'block', false) as blocked, list_name, action, pattern, cast(since as bigint) as from_day, cast(until as bigint) as to_day
from p left join won on p.page_id = won.page_id and rn = 1"""


OP2_SQL = _op2_sql()

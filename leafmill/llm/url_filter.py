"""Operator 5: URL filters by a temporal list join.

A list is dated entries (pattern, action, listed_at): from that moment on the
action holds for the pattern, until its next entry. Actions are ``block``,
``allow`` and ``off`` (delisted). Dated entries become validity intervals
[valid_from, valid_to), and every capture is evaluated as of its fetch time
against the intervals of all patterns that cover its URL: its host and every
parent domain of at least two labels, each alone or with a beginning of the
path, in whole segments, up to the whole of it. Patterns may be written as
URLs are (see normal_pattern); queries and fragments are no part of them.
Among the active entries the longest pattern decides.

Captures are reduced to their distinct (host, beginning of the path as deep as
patterns go, fetch time) before the list is joined, and the verdicts are
joined back on that key, so a hot host is spread over its fetch times and its
copies are judged once. The list is broadcast only if it has at most
BROADCAST_ENTRIES intervals and BROADCAST_BYTES of patterns; a longer one is
joined by shuffle, where adaptive execution splits hot patterns.

Defined results: a null or unparsable URL, or a null fetch time, is kept with
verdict ``none``; entries with a null pattern, action or date are left out; of
entries of one pattern and date ``block`` wins over ``allow`` over ``off``;
of active patterns of one length the last in order decides; very long URLs are
read whole;
equal captures are judged alike and each returned; an empty list keeps all;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.storage import Scratch

#: Intervals, and bytes of their patterns, up to which the list is broadcast.
BROADCAST_ENTRIES, BROADCAST_BYTES = 100_000, 8 << 20


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, leading www. and trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def path_of(url: Column, depth: int) -> Column:
    """The first `depth` segments of the path, without empty ones at its end."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    return F.slice(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "/"), 1, depth) if depth else F.array().cast("array<string>")


def first_segment(url: Column) -> Column:
    """First path segment; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1), F.lit(""))


def normal_pattern(pattern: Column) -> Column:
    """A list's pattern as URLs are read: without scheme, user, port, leading www., trailing dot, query and trailing
    slashes, the host in lower case; null if it has no host."""
    bare = F.regexp_replace(F.trim(pattern), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = host_of(F.concat(F.lit("x://"), bare))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*(/[^?#]*)", 1), "/+$", "")
    return F.concat(host, path)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from dated entries; valid_to is null for the last of a pattern."""
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    clean = entries.withColumn("pattern", normal_pattern(F.col("pattern"))).where("pattern is not null and action is not null and listed_at is not null")
    one = clean.groupBy("pattern", "listed_at").agg(F.min(F.struct(rank.alias("r"), F.col("action").alias("action"))).alias("s"))
    following = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return one.select("pattern", F.col("s.action").alias("action"), F.col("listed_at").alias("valid_from"), following.alias("valid_to"))


def patterns_of(host: Column, path: Column) -> Column:
    """Patterns that cover a URL: host and parents of two labels or more, each alone and with every beginning of the path."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size(path)), lambda k: (k == 0) | (F.get(path, F.lit(0)) != "")), lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/"))))
    return F.array_distinct(F.flatten(F.transform(parents, lambda h: F.transform(starts, lambda t: F.concat(h, t)))))


def filter_captures(captures: DataFrame, entries: DataFrame, keep: list[str], url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The columns of keep and (host, verdict, pattern, listed_at, blocked) of every capture."""
    scratch = Scratch(captures.sparkSession, "urls")
    # written, as it is counted before it is joined
    valid = scratch.table(intervals(entries).where("action <> 'off'"), "intervals")
    n, size, depth = valid.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()
    rows = captures.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col), depth).alias("path"), F.col(time_col).alias("at"))
    asked = rows.where("host is not null and at is not null").select("host", "path", "at").distinct()
    asked = asked.withColumn("pattern", F.explode(patterns_of(F.col("host"), F.col("path"))))
    if n <= BROADCAST_ENTRIES and size <= BROADCAST_BYTES:
        valid = F.broadcast(valid)
    active = asked.join(valid, "pattern").where("valid_from <= at and (valid_to is null or at < valid_to)")
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "valid_from"))
    verdicts = active.groupBy("host", "path", "at").agg(best.alias("best"))
    # written, so that both sides of the join back are shuffled and the copies of a hot capture can be split
    verdicts = scratch.table(verdicts, "verdicts")
    scratch.keep(verdicts)
    judged = rows.join(verdicts, ["host", "path", "at"], "left")
    return judged.select(
        *(F.col(f"_k{n}").alias(c) for n, c in enumerate(keep)), "host", F.coalesce("best.action", F.lit("none")).alias("verdict"),
        F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("listed_at"), F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
    )


def _number(text: Column) -> Column:
    """The first 28 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """The list of the query. The tables hold none, so it is derived from the hosts of all pages:
    by the digest of its name a host is listed on one day, delisted or allowed on a later one, and
    its parent domain or its path may be listed as well."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), first_segment(F.col("url")).alias("segment")).where("host is not null").distinct()
    hosts = Scratch(pages.sparkSession, "hosts").table(hosts, "hosts")  # read several times
    h = hosts.select("host").distinct().withColumn("x", _number(F.col("host")))
    listed = h.where("x % 3 = 0").select(F.col("host").alias("pattern"), F.lit("block").alias("action"), (F.col("x") % 180).alias("listed_at"))
    later = h.where("x % 3 = 0 and x % 2 = 0").select(
        F.col("host").alias("pattern"), F.when(F.col("x") % 4 == 0, "off").otherwise("allow").alias("action"), (F.col("x") % 180 + 30 + F.floor(F.col("x") / 180) % 90).alias("listed_at")
    )
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    p = hosts.select(parent.alias("pattern")).where("pattern <> ''").distinct().withColumn("x", _number(F.concat(F.lit("p:"), F.col("pattern")))).where("x % 5 = 0")
    parents = p.select("pattern", F.lit("block").alias("action"), (F.lit(100) + F.col("x") % 200).alias("listed_at"))
    q = hosts.where("segment <> ''").select(F.concat_ws("/", "host", "segment").alias("pattern")).withColumn("x", _number(F.col("pattern"))).where("x % 4 = 1")
    paths = q.select("pattern", F.when(F.col("x") % 8 == 1, "allow").otherwise("block").alias("action"), (F.col("x") % 250).alias("listed_at"))
    return listed.unionByName(later).unionByName(parents).unionByName(paths).withColumn("listed_at", F.col("listed_at").cast("long"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as of their fetch day; the tables hold no fetch time, so it is derived from the page id and host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.withColumn("fetched_at", F.pmod(F.col("page_id") * 37, F.lit(365)))
    found = filter_captures(captures, dated_entries(pages), ["page_id", "fetched_at"])
    return found.select("page_id", "fetched_at", "host", "verdict", "pattern", "listed_at", "blocked")


ORACLE = r"""
with c as (
  select page_id, url, ((page_id * 37) % 365 + 365) % 365 as fetched_at,
    nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '^www\.', ''), '') as host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1), '') as segment
  from pages),
hosts as (select distinct host, segment from c where host is not null),
h as (select host, ('0x' || substr(md5(host), 1, 7))::bigint as x from (select distinct host from hosts)),
p as (select pattern, ('0x' || substr(md5('p:' || pattern), 1, 7))::bigint as x
  from (select distinct regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) as pattern from hosts) where pattern <> ''),
q as (select pattern, ('0x' || substr(md5(pattern), 1, 7))::bigint as x from (select host || '/' || segment as pattern from hosts where segment <> '')),
e as (
  select host as pattern, 'block' as action, x % 180 as listed_at from h where x % 3 = 0
  union all select host, case when x % 4 = 0 then 'off' else 'allow' end, x % 180 + 30 + (x // 180) % 90 from h where x % 3 = 0 and x % 2 = 0
  union all select pattern, 'block', 100 + x % 200 from p where x % 5 = 0
  union all select pattern, case when x % 8 = 1 then 'allow' else 'block' end, x % 250 from q where x % 4 = 1),
one as (select pattern, listed_at, arg_min(action, case action when 'block' then 0 when 'allow' then 1 else 2 end) as action from e group by all),
v as (select pattern, action, listed_at as valid_from, lead(listed_at) over (partition by pattern order by listed_at) as valid_to from one),
ask as (
  select distinct host, segment, fetched_at, unnest(list_concat(
    [array_to_string(string_split(host, '.')[k:], '.') for k in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)],
    case when segment <> '' then [host || '/' || segment] else [] end)) as pattern
  from c where host is not null),
hit as (
  select host, segment, fetched_at, pattern, action, valid_from,
    row_number() over (partition by host, segment, fetched_at order by length(pattern) desc, pattern desc, action desc, valid_from desc) as rn
  from ask join v using (pattern)
  where action <> 'off' and valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to))
select c.page_id, c.fetched_at, c.host, coalesce(hit.action, 'none') as verdict, hit.pattern, hit.valid_from as listed_at, coalesce(hit.action = 'block', false) as blocked
from c left join hit on c.host = hit.host and c.segment = hit.segment and c.fetched_at = hit.fetched_at and hit.rn = 1
"""

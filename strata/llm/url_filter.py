"""URL filters by a temporal list join.

A list is a log of dated entries: from a day on, a key (a domain with all its
subdomains, a host, or one URL) has the action ``block``, ``allow`` or
``remove``.  The entries of one key and scope become validity intervals, each
ending where the next one starts.  Every capture looks up its own keys and, as
of its fetch day, finds the interval that is active for each; ``allow`` beats
``block`` on the same capture.  Hosts and URLs are normalised first.

The as-of join is an equality join on the key with a range condition on the
day.  The intervals are a table of their own, so Spark broadcasts them if they
are below its threshold, and splits a key that many captures share if not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.decontamination import hash_set, may_hold
from strata.llm.shared import plain, stored, table

ACTIONS = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:\d*)$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(F.length(host) > 0, host)


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, query, fragment and trailing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, r"/+$", ""))


def list_key(scope: Column, key: Column) -> Column:
    """The key of a list entry in the form that captures have: a URL keeps the case of its path, other scopes are a host."""
    url = F.when(key.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), key).otherwise(F.concat(F.lit("http://"), F.regexp_replace(key, "^//", "")))
    return F.when(scope == "url", canonical_url(url)).otherwise(host_of(url))


def capture_keys(host: Column, url: Column) -> Column:
    """(scope, key) of a capture: each domain that its host is in, the host, the URL."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.struct(F.lit("domain").alias("scope"), F.concat_ws(".", F.slice(labels, k, F.size(labels))).alias("key")),
    )
    return F.when(host.isNotNull(), F.concat(domains, F.array(F.struct(F.lit("host").alias("scope"), host.alias("key")), F.struct(F.lit("url").alias("scope"), url.alias("key")))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(scope, key, action, valid_from, valid_to) of dated entries; valid_to is null while open.

    Entries with a null scope, key, action or day, or a day that is no integer,
    count for nothing, as do entries with an unknown action.  Keys are normalised as captures are.  Of entries of one key and day ``allow``
    wins over ``block`` and ``block`` over ``remove``; repeated rows are one.
    Each key's entries are the list's history of that key.
    """
    known = entries.select(F.lower("scope").alias("scope"), list_key(F.lower("scope"), F.col("key").cast("string")).alias("key"), F.lower("action").alias("action"), F.col("day").try_cast("int").alias("day"))
    known = known.where(F.col("action").isin(*ACTIONS) & F.col("scope").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull())
    strength = F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1).otherwise(0)
    daily = known.groupBy("scope", "key", "day").agg(F.max_by("action", strength).alias("action"))
    by_day = Window.partitionBy("scope", "key").orderBy("day")
    spans = daily.select("scope", "key", "action", F.col("day").alias("valid_from"), F.lead("day").over(by_day).alias("valid_to"))
    return spans.where("action <> 'remove'")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, day_col: str) -> DataFrame:
    """Per capture: id, host, n_active (active entries), n_block, n_allow, blocked.

    A capture with a null or odd URL, or a null day, meets no entry and is not
    blocked.  Captures that share an id, URL and day give one row, with each
    active entry once.  Keys of captures that no entry has, such as those of
    whole top-level domains, are dropped before the join by a set of bits of the
    list's keys, of a bounded size; what it lets through by chance meets nothing.
    """
    spans = stored(validity_intervals(entries), "intervals")
    listed = hash_set(spans.select(_key_hash(F.col("scope"), F.col("key")).alias("hash")).distinct())
    shared = captures.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("boolean")
    def may_be_listed(hashes: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, hashes.to_numpy().view(np.uint64)))

    seen = captures.select(plain(id_col).alias("id"), plain(url_col).cast("string").alias("url"), plain(day_col).try_cast("int").alias("day")).withColumn("host", host_of(F.col("url")))
    keys = seen.select("id", "day", "url", F.explode(capture_keys(F.col("host"), canonical_url(F.col("url")))).alias("k")).select("id", "day", "url", "k.scope", "k.key")
    keys = keys.where(may_be_listed(_key_hash(F.col("scope"), F.col("key"))))
    active = keys.join(spans, ["scope", "key"]).where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    hits = active.select("id", "day", "url", F.lit(None).cast("string").alias("host"), F.lit(1).alias("n"), F.col("action"))
    rows = seen.select("id", "day", "url", "host", F.lit(0).alias("n"), F.lit(None).cast("string").alias("action")).unionByName(hits)
    total = lambda test: (F.count_if(test) / F.count_if(F.col("n") == 0)).cast("long")  # noqa: E731  each copy of a capture has met the same entries
    counted = rows.groupBy("id", "url", "day").agg(
        F.max("host").alias("host"), total(F.col("n") == 1).alias("n_active"), total(F.col("action") == "block").alias("n_block"), total(F.col("action") == "allow").alias("n_allow"),
    )
    return counted.select("id", "url", "day", "host", "n_active", "n_block", "n_allow", ((F.col("n_block") > 0) & (F.col("n_allow") == 0)).alias("blocked"))


def _key_hash(scope: Column, key: Column) -> Column:
    return F.xxhash64(scope, key)


def _fetched(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day of the year derived from the page id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int").alias("fetch_day"))


def _list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, with days derived from checksums of the keys."""
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("host"), canonical_url(F.col("url")).alias("page")).where("host is not null")
    site = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    named = hosts.select(F.explode(F.array(
        F.struct(F.lit("domain").alias("scope"), site.alias("key")), F.struct(F.lit("host").alias("scope"), F.col("host").alias("key")), F.struct(F.lit("url").alias("scope"), F.col("page").alias("key")),
    )).alias("k")).select("k.*").where("key <> ''").distinct()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "scope", "key").cast("binary")), 1, 8), 16, 10).cast("long")
    chosen = named.withColumn("h", h).where("(scope = 'domain' and h % 3 = 0) or (scope = 'host' and h % 5 = 0) or (scope = 'url' and h % 7 = 0)")
    first, length = (F.col("h") % 200).cast("int"), (F.floor(F.col("h") / 256) % 90 + 1).cast("int")
    events = F.array(
        F.struct(F.when(F.col("scope") == "url", "allow").otherwise("block").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), (first + length).alias("day")),
        F.struct(F.lit("block").alias("action"), (first + length * 2).alias("day")),
    )
    return chosen.select("scope", "key", F.explode(events).alias("e")).select("scope", "key", "e.action", "e.day")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(_fetched(pages), _list_entries(pages), "page_id", "url", "fetch_day")
    return out.select(F.col("id").alias("page_id"), "host", F.col("day").alias("fetch_day"), "n_active", "n_block", "n_allow", "blocked")


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES: dict[str, str] = {
    "op4_url_filter": r"""
with p as (select page_id, url, ((page_id * 37) % 365)::int as fetch_day, nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '\.+$', ''), '') as host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path from pages),
named as (select distinct scope, key from (
  select 'domain' as scope, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) as key from p where host is not null
  union all select 'host', host from p where host is not null union all select 'url', host || path from p where host is not null) where key <> ''),
hashed as (select *, ('0x' || substr(md5(scope || ':' || key), 1, 8))::bigint as h from named),
chosen as (select *, (h % 200)::int as f, (h // 256 % 90 + 1)::int as l from hashed where (scope = 'domain' and h % 3 = 0) or (scope = 'host' and h % 5 = 0) or (scope = 'url' and h % 7 = 0)),
ev as (select scope, key, case scope when 'url' then 'allow' else 'block' end as action, f as day from chosen union all select scope, key, 'remove', f + l from chosen union all select scope, key, 'block', f + 2 * l from chosen),
spans as (select *, lead(day) over (partition by scope, key order by day) as until from ev),
k as (select page_id, fetch_day, 'host' as scope, host as key from p where host is not null union all select page_id, fetch_day, 'url', host || path from p where host is not null
  union all select page_id, fetch_day, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p where host is not null)),
hit as (select k.page_id, action from k join spans s on k.scope = s.scope and k.key = s.key and k.fetch_day >= s.day and (s.until is null or k.fetch_day < s.until) where action <> 'remove')
select p.page_id, host, fetch_day, count(action)::bigint as n_active, count(*) filter (where action = 'block')::bigint as n_block, count(*) filter (where action = 'allow')::bigint as n_allow,
 count(*) filter (where action = 'block') > 0 and count(*) filter (where action = 'allow') = 0 as blocked
from p left join hit on p.page_id = hit.page_id group by p.page_id, host, fetch_day
"""
}

"""URL filters by a temporal list join.

A list is a history of dated entries: at a date a key (a domain with its subdomains, or one address) is added to or
removed from a list. The history of a key becomes validity intervals, from each addition to the next removal. A
capture is evaluated against the entries that were valid when it was fetched: all parent domains of its host and its
address are looked up by key, and the interval that holds the time of the fetch is the as-of match (at most one per
list and key, as intervals of a key do not overlap). A capture is blocked if a blocking list matches and no
allowing list does.

Hosts and addresses are made distinct per day of fetch before the join, so a host with very many captures is joined
once a day, and summed up per task first. On one date a removal is undone by an addition. Entries without key, list
or date are ignored; a removal without a previous addition has no effect. Captures without an address, host or time
match nothing and pass. Repeated rows get equal results; other columns are kept, columns that bear a new name are
replaced. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a last dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    found = F.regexp_replace(found, r"\.+$", "")
    return F.when(found != "", found)


def address(url: Column) -> Column:
    """Host and path: without scheme, query, fragment and last slash."""
    rest = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(rest, "/+$", ""))


def domains(name: Column) -> Column:
    """A host and its parent domains, up to the last label."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name``, ``effect``, ``key``, ``since``, ``until`` (exclusive, null: still valid) from dated entries.

    ``entries``: list_name, effect (block or allow), key, day, action (add or remove).
    """
    days = (entries.where("list_name is not null and key is not null and day is not null")
            .groupBy("list_name", "effect", "key", "day").agg(F.max(F.col("action") == "add").alias("added")))
    history = Window.partitionBy("list_name", "effect", "key").orderBy("day")
    turns = days.withColumn("before", F.coalesce(F.lag("added").over(history), F.lit(False))).where("added <> before")
    return (turns.withColumn("until", F.lead("day").over(history)).where("added")
            .select("list_name", "effect", "key", F.col("day").alias("since"), "until"))


def _matches(keys: DataFrame, key: Column, valid: DataFrame, by: str) -> DataFrame:
    """Lists by ``by`` and day of fetch: which ones held one of the keys then."""
    wanted = keys.select(by, "__day", F.explode(key).alias("key"))
    hit = wanted.join(valid, (wanted.key == valid.key) & (F.col("since") <= F.col("__day"))
                      & (F.col("until").isNull() | (F.col("__day") < F.col("until"))))
    return hit.groupBy(by, "__day").agg(F.collect_set(F.struct("effect", "list_name", "since")).alias(f"{by}_lists"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``lists`` (matching, sorted), ``listed_since`` (earliest) and ``blocked``."""
    valid = intervals(entries)
    rows = (captures.withColumn("host", host(F.col(f"`{url}`"))).withColumn("__address", address(F.col(f"`{url}`")))
            .withColumn("__day", F.to_date(F.col(f"`{fetched}`"))))
    hosts = rows.where("host is not null and __day is not null").select("host", "__day").distinct()
    pages = rows.where("__address is not null and __day is not null").select("__address", "__day").distinct()
    by_host = _matches(hosts, domains(F.col("host")), valid, "host")
    by_page = _matches(pages, F.array("__address"), valid.where("key like '%/%'"), "__address")
    both = rows.join(by_host, ["host", "__day"], "left").join(by_page, ["__address", "__day"], "left")
    none = F.expr("cast(array() as array<struct<effect:string,list_name:string,since:date>>)")
    both = both.withColumn("__lists", F.array_union(F.coalesce("host_lists", none), F.coalesce("__address_lists", none)))
    return (both.withColumn("lists", F.array_join(F.array_sort(F.array_distinct(F.transform("__lists", lambda x: x.list_name))), ","))
            .withColumn("listed_since", F.array_min(F.transform("__lists", lambda x: x.since)))
            .withColumn("blocked", F.exists("__lists", lambda x: x.effect == "block") & ~F.exists("__lists", lambda x: x.effect == "allow"))
            .drop("__address", "__day", "host_lists", "__address_lists", "__lists"))

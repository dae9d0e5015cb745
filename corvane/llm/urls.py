"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

Entries say when a pattern was added to a list or removed from it. Each key's events become intervals
[from, to) that do not overlap, so a capture meets at most one interval of each of its own keys (its
host, the host's parent domains, its path prefixes): the join is an equality on the key with
the as-of condition on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without port and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1)), r"\.+$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), PATH, 1)


def entry_key(kind: Column, pattern: Column) -> Column:
    """``domain`` (a host and all below it), ``host`` (just it) or ``prefix`` (host/path at a segment's end)."""
    p = F.regexp_replace(F.trim(pattern), r"[./]+$", "")
    head = F.lower(F.substring_index(p, "/", 1))
    return F.concat(F.substr(kind, F.lit(1), F.lit(1)), F.lit(":"), F.when(kind == "prefix", F.concat(head, F.substr(p, F.length(head) + 1))).otherwise(F.lower(p)))


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (kind, pattern, action add|remove, at) as (key, list_name, valid_from, valid_to).

    An interval runs from an ``add`` to the key's next event (open: null). At one time a ``remove`` comes
    after an ``add``; repeated events merge. Rows with a null in any of these columns, and kinds other than domain, host and prefix, are no entries.
    """
    e = entries.where(F.col("kind").isin("domain", "host", "prefix")).select(entry_key(F.col("kind"), F.col("pattern")).alias("key"), "action", "at").dropna()
    # one event per key and time: a remove wins
    e = e.groupBy("key", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key").orderBy("at")
    return e.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'").select("key", F.col("at").alias("valid_from"), "valid_to")


def capture_keys(url: Column, depth: int, levels: list[int]) -> Column:
    """All keys under which a list may name this URL: domains of as many labels as an entry has (``levels``), so that a top-level
    domain is no hot key unless it is listed, and path prefixes as deep as the list's deepest entry."""
    labels = F.split(host_of(url), r"\.")
    listed = F.array(*[F.lit(n) for n in levels]).cast("array<int>")
    places = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_contains(listed, F.size(labels) - i + 1))
    domains = F.transform(places, lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    n = F.least(F.size(steps), F.lit(depth))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.concat(F.lit("p:"), host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))
    )
    return F.when(host_of(url) != "", F.concat(domains, F.array(F.concat(F.lit("h:"), host_of(url))), prefixes)).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched_at", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``captures`` plus blocked boolean and matched array<string> (sorted keys active at fetch time).

    A null or malformed URL or a null fetch time matches nothing and is not blocked; repeated captures
    are judged each; a very long URL is cut into no more keys than the list can hold; columns blocked or matched in ``captures`` are refused. The interval table is
    broadcast only if it is counted to have at most ``broadcast_rows`` rows.
    """
    if {"blocked", "matched"} & set(captures.columns):
        raise ValueError("captures has a column blocked or matched")
    spans = intervals(entries)
    deep = F.coalesce(F.max(F.when(F.col("key").startswith("p:"), F.size(F.split("key", "/")) - 1)), F.lit(0))
    # numbers of labels: 127 at most, as a host has no more
    n, depth, levels = spans.agg(F.count(F.lit(1)), deep, F.collect_set(F.when(F.col("key").startswith("d:"), F.least(F.size(F.split("key", r"\.")), F.lit(128))))).first()
    if n <= broadcast_rows:
        spans = F.broadcast(spans)
    # copies of one capture (same URL and time) are looked up once
    at = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at")).where("__url IS NOT NULL AND __at IS NOT NULL").distinct()
    probe = at.withColumn("key", F.explode(capture_keys(F.col("__url"), depth, sorted(levels))))
    active = (F.col("valid_from") <= F.col("__at")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to")))
    found = probe.join(spans, "key").where(active).groupBy("__url", "__at").agg(F.sort_array(F.collect_set("key")).alias("matched"))
    out = captures.join(found, (captures[url] == found["__url"]) & (captures[fetched] == found["__at"]), "left").drop("__url", "__at")
    return out.withColumn("blocked", F.col("matched").isNotNull()).withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))

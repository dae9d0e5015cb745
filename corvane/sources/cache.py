"""What was fetched, kept by what was asked for: look-up with an expiry, an append-only log, compaction."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, at timestamp, payload string"


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the log, one for each append since the last compaction."""
    p, fs = _folder(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("batch=")) if fs.exists(p) else []


def append(entries: DataFrame, path: str) -> None:
    """Adds entries (key, at, payload) as a folder of their own, so that writers at the same time don't meet.

    Entries without a key, a time or a payload are left out. Folders are divided by the key's first digit, which look-ups use to prune; Spark splits and merges what goes into each by size.
    """
    whole = entries.select("key", F.col("at").cast("timestamp").alias("at"), "payload").dropna().withColumn("shard", F.substring("key", 1, 1))
    whole.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{path}/batch={uuid.uuid4().hex}")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The whole log (key, at, payload, shard, batch); empty where nothing was ever written. A key may have many entries."""
    schema = ENTRY + ", shard string, batch string"
    if not batches(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def newest(log: DataFrame) -> DataFrame:
    """Each key's last entry (of equal times the greatest payload)."""
    last = log.groupBy("shard", "key").agg(F.max(F.struct("at", "payload")).alias("e"))
    return last.select("shard", "key", "e.at", "e.payload")


def lookup(requests: DataFrame, log: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Requests (key and more) with status hit, stale or miss, and at and payload of the last entry no later than ``as_of``.

    An entry is stale from ``ttl_seconds`` after its time on. Only entries that are asked for are aggregated: a semi-join on shard
    and key comes first. Every request stays, repeated ones and those without a key (misses) too.
    """
    asked = requests.select(F.substring("key", 1, 1).alias("shard"), "key").dropna().distinct()
    found = newest(log.where(F.col("at") <= as_of).join(asked, ["shard", "key"], "left_semi")).drop("shard")
    old = F.unix_micros(as_of) - F.unix_micros("at") >= ttl_seconds * 1_000_000
    return requests.join(found, "key", "left").withColumn("status", F.when(F.col("at").isNull(), "miss").when(old, "stale").otherwise("hit"))


def through(requests: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], as_of: Column, ttl_seconds: int) -> DataFrame:
    """``lookup`` after what was stale or missing has been fetched and appended.

    ``fetch`` takes the requests to be made, one for each key (that with the greatest other columns, compared in their order), and returns
    (key, payload). What it does not return stays stale or missing.
    """
    spark = requests.sparkSession
    open_ = lookup(requests, entries(spark, path), as_of, ttl_seconds).where("status <> 'hit' AND key IS NOT NULL").select(*requests.columns)
    others = [c for c in requests.columns if c != "key"]
    made = open_.groupBy("key").agg(F.max(F.struct(*others)).alias("r")).select("key", "r.*") if others else open_.distinct()
    append(fetch(made.select(*requests.columns)).select("key", as_of.alias("at"), "payload"), path)
    return lookup(requests, entries(spark, path), as_of, ttl_seconds)


def compact(spark: SparkSession, path: str, as_of: Column) -> list[str]:
    """Writes each key's last entry no later than ``as_of``, and all later ones, as one new folder; returns the folders that it stands for, for ``vacuum``.

    Until those are removed the log holds entries twice, which look-ups don't see. Appends at the same time are not among them. Look-ups as of
    ``as_of`` or later find what they found before.
    """
    old = batches(spark, path)
    if len(old) < 2:
        return []
    log = entries(spark, path).where(F.col("batch").isin(*[b.removeprefix("batch=") for b in old]))
    append(newest(log.where(F.col("at") <= as_of)).select("key", "at", "payload").unionByName(log.where(F.col("at") > as_of).select("key", "at", "payload")), path)
    return old


def vacuum(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Removes folders that a compaction stands for, when no reader uses them any more."""
    for name in folders:
        p, fs = _folder(spark, f"{path}/{name}")
        fs.delete(p, True)

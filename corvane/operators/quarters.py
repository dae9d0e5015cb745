"""Quarters that were asked for, what was found for them, and why the rest is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def parse_label(label: Column) -> Column:
    """struct<year, quarter> of YYYY-Qn; nulls if it is none."""
    y, q = (F.regexp_extract(F.coalesce(label, F.lit("")), r"^(-?[0-9]+)-Q([1-4])$", k).try_cast("int") for k in (1, 2))
    return F.struct(y.alias("year"), q.alias("quarter"))


def recent_quarters(year: int, quarter: int, n: int) -> list[tuple[int, int]]:
    """``n`` quarters back from the given one, itself first."""
    at = year * 4 + quarter - 1
    return [((at - k) // 4, (at - k) % 4 + 1) for k in range(n)]


def outcomes(requested: DataFrame, found: DataFrame, errors: DataFrame, discovery: DataFrame) -> DataFrame:
    """symbol, quarter, place, status, detail: one row per requested quarter, then one per error outside the request.

    requested: symbol, quarter, place. found: symbol, quarter. errors: symbol, quarter, error, ord (the last one of a quarter counts).
    discovery: symbol, quarter, status. Found goes before an error, and that before not_found, which says whether there was a link.
    """
    keys = ["symbol", "quarter"]
    have = found.select(*keys).distinct().withColumn("have", F.lit(True))
    last = errors.where(F.trim("quarter") != "").groupBy(*keys).agg(F.max_by("error", "ord").alias("error"), F.min("ord").alias("ord"), F.lit(True).alias("failed"))
    seen = discovery.groupBy(*keys).agg(F.max(F.col("status") == "not_found").alias("unlinked"))
    said = F.when(F.trim(F.coalesce("error", F.lit(""))) != "", F.trim("error")).otherwise("Scrape error.")
    r = requested.join(have, keys, "left").join(last.drop("ord"), keys, "left").join(seen, keys, "left")
    status = F.when(F.col("have"), "found").when(F.col("failed"), "error").otherwise("not_found")
    missing = F.when(F.coalesce("unlinked", F.lit(False)), "No transcript URL resolved during discovery.").otherwise("Transcript was not available after discovery and scrape.")
    rows = r.withColumn("status", status).withColumn("detail", F.when(F.col("status") == "error", said).when(F.col("status") == "not_found", missing)).select(*keys, "place", "status", "detail")
    extra = last.join(requested.select(*keys), keys, "left_anti").select(*keys, (F.col("ord") + 1_000_000).alias("place"), F.lit("error").alias("status"), said.alias("detail"))
    return rows.unionByName(extra)


def diagnostics(rows: DataFrame) -> DataFrame:
    """Per symbol from ``outcomes``: quarters requested, found and missing in order, and the errors."""
    pick = lambda c, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("place", v.alias("v"))))), lambda x: x["v"]), ",")
    is_ = lambda s: F.col("status") == s
    q = F.col("quarter")
    return rows.groupBy("symbol").agg(pick(is_("found"), q).alias("found"), pick(is_("not_found"), q).alias("missing"), pick(is_("error"), F.concat(q, F.lit(": "), "detail")).alias("errors"), F.count(F.lit(1)).alias("selected"))


def in_requested_order(records: DataFrame, requested: DataFrame, target: int) -> DataFrame:
    """Records (symbol, quarter, ord) of requested quarters in the request's order, then others in their own; ``target`` per symbol (rank)."""
    asked = records.join(requested.select("symbol", "quarter", "place"), ["symbol", "quarter"], "left")
    w = Window.partitionBy("symbol").orderBy(F.col("place").isNull(), "place", "ord")
    return asked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= target).drop("place")


def first_parsed(attempts: DataFrame, target: int, tries: int = 8) -> DataFrame:
    """Attempts (symbol, ord, parsed) in rank order until ``target`` bodies are parsed, ``tries`` times that many at most; adds attempt and taken."""
    w = Window.partitionBy("symbol").orderBy("ord")
    a = attempts.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= tries * target)
    before = F.coalesce(F.count_if("parsed").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return a.withColumn("before", before).where(F.col("before") < target).withColumn("taken", F.col("parsed")).drop("before")


def discovery_phases(phases: list[tuple[str, DataFrame]], wanted: DataFrame) -> DataFrame:
    """symbol, quarter, url, phase, status: each phase (name, candidates with symbol, quarter, url, quality, ord) only fills what those before it left open."""
    open_, out = wanted.select("symbol", "quarter"), None
    for name, candidates in phases:
        w = Window.partitionBy("symbol", "quarter").orderBy(F.desc("quality"), "ord")
        best = candidates.join(open_, ["symbol", "quarter"], "left_semi").withColumn("n", F.row_number().over(w)).where("n = 1")
        got = best.select("symbol", "quarter", "url", F.lit(name).alias("phase"), F.lit("found").alias("status"))
        out = got if out is None else out.unionByName(got)
        open_ = open_.join(got, ["symbol", "quarter"], "left_anti")
    none = F.lit(None).cast("string")
    rest = open_.select("symbol", "quarter", none.alias("url"), none.alias("phase"), F.lit("not_found").alias("status"))
    return rest if out is None else out.unionByName(rest)


def page_scan(pages: DataFrame, keys: list[str], least: int = 3, empty: int = 2) -> DataFrame:
    """Pages (keys, page, hits) read before a scan stops: from page ``least`` on, after ``empty`` pages in a row without a hit."""
    w = Window.partitionBy(*keys).orderBy("page")
    blank = F.when(F.col("hits") == 0, 1).otherwise(0)
    run = F.sum(blank).over(w.rowsBetween(-(empty - 1), 0)) == empty
    stops = pages.withColumn("stop", run & (F.col("page") >= least))
    first = F.min(F.when(F.col("stop"), F.col("page"))).over(Window.partitionBy(*keys))
    return stops.withColumn("last", first).where(F.col("last").isNull() | (F.col("page") <= F.col("last"))).drop("stop", "last")

"""What a reader of one call asks for: filters, sorts, metrics beside blocks, roles where they are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quarters import parse_label, quarter_label


def filtered(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns have the wanted values; ``all`` asks for nothing."""
    for column, value in wanted.items():
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows


def sort_keys(column: str, descending: bool) -> list[Column]:
    """By a column, nulls last, then in the order of the call."""
    c = F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("doc_id").asc(), F.col("order_index").asc()]


def mentions(text: Column) -> Column:
    """How much a block counts: one for each 220 characters, one at least (halves up)."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 220.0 + 0.5)).cast("bigint")


def mention_totals(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.sum(mentions(F.col("text"))).alias("mentions"), F.count(F.lit(1)).alias("blocks"))


def with_metrics(blocks: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks with the metrics of their (url, speaker, section, place), else of the same place in any document: the first by url."""
    key = ["speaker", "section_type", "order_index"]
    one = lambda by: metrics.groupBy(*by).agg(F.min_by(F.struct(*columns), "url").alias("m"))
    out = blocks.join(one(["url", *key]).withColumnRenamed("m", "m1"), ["url", *key], "left").join(one(key).withColumnRenamed("m", "m2"), key, "left")
    return out.withColumn("m", F.coalesce("m1", "m2")).select(*blocks.columns, "m.*")


def role_tiers(rows: DataFrame, known: DataFrame, *, blank_url: bool = True) -> DataFrame:
    """Fills null speaker_role from rows of known role: same url, speaker, section and place; then (``blank_url``) such rows without
    url; then speaker and section; then the speaker's commonest role (management on a tie). Adds hydrated_role and tier.

    Among several known values the one placed last counts.
    """
    who, url = F.lower(F.trim(F.col("speaker"))), F.coalesce("url", F.lit(""))
    k = known.where("speaker_role IS NOT NULL").select(url.alias("__u"), who.alias("__w"), "section_type", "order_index", "speaker_role")
    exact = ["__u", "__w", "section_type", "order_index"]
    last = lambda df, by, name: df.groupBy(*by).agg(F.max_by("speaker_role", F.struct("order_index", "speaker_role")).alias(name))
    common = k.groupBy("__w").agg(F.count_if(F.col("speaker_role") == "analyst").alias("a"), F.count_if(F.col("speaker_role") == "management").alias("m")).where("a > 0 OR m > 0")
    common = common.select("__w", F.when(F.col("a") > F.col("m"), "analyst").otherwise("management").alias("r4"))
    out = rows.withColumns({"__u": url, "__w": who}).join(last(k, exact, "r1"), exact, "left")
    if blank_url:
        out = out.join(last(k.where("__u = ''"), exact[1:], "r2"), exact[1:], "left")
    else:
        out = out.withColumn("r2", F.lit(None).cast("string"))
    out = out.join(last(k, exact[1:3], "r3"), exact[1:3], "left").join(common, "__w", "left")
    tier = F.when(F.col("speaker_role").isNotNull(), 0).when(F.col("r1").isNotNull(), 1).when(F.col("r2").isNotNull(), 2).when(F.col("r3").isNotNull(), 3).when(F.col("r4").isNotNull(), 4)
    return out.withColumns({"hydrated_role": F.coalesce("speaker_role", "r1", "r2", "r3", "r4"), "tier": tier}).drop("__u", "__w", "r1", "r2", "r3", "r4")


def quarter_key(label: Column, title: Column, date: Column) -> Column:
    """Where a document belongs: its label, else a quarter in its title, else that of its date (timestamp); YYYY-Qn or null."""
    p = parse_label(label)
    t = F.coalesce(title, F.lit(""))
    q, y = (F.regexp_extract(t, r"(?i)\bQ([1-4])\s+([0-9]{4})\b", k).try_cast("int") for k in (1, 2))
    return F.coalesce(quarter_label(p["year"], p["quarter"]), quarter_label(y, q), quarter_label(F.year(date), F.quarter(date)))


def documents_by_quarter(documents: DataFrame) -> DataFrame:
    """quarter, n, documents: ids of (doc_id, label, title, date) that belong to a quarter, comma-joined in order; newest first is the caller's."""
    keyed = documents.withColumn("quarter", quarter_key(F.col("label"), F.col("title"), F.col("date"))).where("quarter IS NOT NULL")
    return keyed.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 82, "very high").when(value >= 65, "high").when(value >= 48, "medium").when(value >= 30, "low").otherwise("very low")


def evasiveness_band(value: Column) -> Column:
    return F.when(value <= 22, "very low").when(value <= 35, "low").when(value <= 52, "medium").when(value <= 70, "high").otherwise("very high")


def analyst_tone(key: Column) -> Column:
    """A recommendation key in words of stance."""
    low = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return F.when(low.isin("strong_buy", "buy", "outperform", "overweight"), "bullish").when(low.isin("sell", "strong_sell", "underperform", "underweight"), "bearish").when(low.isin("hold", "neutral", ""), "neutral").otherwise("muted")


def shown_recommendation(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", "n/a").otherwise(F.initcap(F.trim(F.replace(key, F.lit("_"), F.lit(" ")))))

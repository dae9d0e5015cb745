"""Payloads of providers: one JSON text per item in, rows of one form out.

Items come as (symbol, ord, payload). What a provider requires and lacks (title, URL, body) drops an item; a time that
can't be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..functions.times import compact_time, epoch_time, iso_time, number

# The parts of each provider's items that are read.
NEWS_A = "title string, summary string, url string, source string, time_published string, ticker_sentiment array<struct<ticker:string,relevance_score:string>>"
NEWS_B = (
    "title string, shortTitle string, summary string, link string, url string, publisher string, providerPublishTime string, relatedTickers array<string>, "
    "content struct<title:string,shortTitle:string,summary:string,description:string,pubDate:string,canonicalUrl:struct<url:string>,provider:struct<displayName:string>,symbols:array<string>>"
)
POSTS_A = "id string, permalink string, title string, selftext string, subreddit string, created_utc string"
POSTS_B = "id string, body string, created_at string"
OFFICER = "name string, title string"
#: Ranks of providers in unions: the earlier one's item wins over an equal one.
NEWS_PROVIDERS, POST_PROVIDERS = ("alpha", "yahoo"), ("reddit", "stocktwits")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, trimmed; empty if none is."""
    return F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))


def _parsed(items: DataFrame, schema: str) -> DataFrame:
    # a generated column: filters on its fields stay above it, while on a projected one each would parse the payload again
    return items.select("symbol", "ord", F.explode(F.array(F.from_json("payload", schema))).alias("p")).where("p IS NOT NULL")


def _required(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.where(F.trim(c) != "")
    return rows


def news_a(items: DataFrame) -> DataFrame:
    """symbol, provider, ord, title, summary, url, source, published_ts, tagged, related: tagged is the relevance for the symbol itself."""
    mine = F.get(F.filter("p.ticker_sentiment", lambda t: F.upper(t.ticker) == F.upper("symbol")), F.lit(0))
    rows = _parsed(items, NEWS_A).select(
        "symbol", F.lit("alpha").alias("provider"), "ord", first_text(F.col("p.title")).alias("title"), first_text(F.col("p.summary")).alias("summary"), first_text(F.col("p.url")).alias("url"),
        first_text(F.col("p.source"), F.lit("Alpha Vantage")).alias("source"), compact_time(F.col("p.time_published")).alias("published_ts"), number(mine["relevance_score"]).alias("tagged"), F.lit(False).alias("related"),
    )
    return _required(rows, "title", "url")


def news_b(items: DataFrame) -> DataFrame:
    """As ``news_a``; related: whether the item lists the symbol."""
    c = "p.content."
    tickers = F.coalesce("p.relatedTickers", F.col(c + "symbols"), F.array().cast("array<string>"))
    rows = _parsed(items, NEWS_B).select(
        "symbol", F.lit("yahoo").alias("provider"), "ord",
        first_text(F.col("p.title"), F.col("p.shortTitle"), F.col(c + "title"), F.col(c + "shortTitle")).alias("title"), first_text(F.col("p.summary"), F.col(c + "summary"), F.col(c + "description")).alias("summary"),
        first_text(F.col("p.link"), F.col("p.url"), F.col(c + "canonicalUrl.url")).alias("url"), first_text(F.col("p.publisher"), F.col(c + "provider.displayName"), F.lit("Yahoo Finance")).alias("source"),
        F.coalesce(epoch_time(F.col("p.providerPublishTime")), iso_time(F.col(c + "pubDate"))).alias("published_ts"), F.lit(None).cast("double").alias("tagged"),
        F.exists(tickers, lambda t: F.upper(t) == F.upper("symbol")).alias("related"),
    )
    return _required(rows, "title", "url")


def posts_a(items: DataFrame, site: str = "https://www.reddit.com") -> DataFrame:
    """symbol, source, ord, title, body, excerpt, url, forum, created_ts; of posts with one link (or id) the first counts."""
    p = _parsed(items, POSTS_A).withColumn("key", first_text(F.col("p.permalink"), F.col("p.id"))).where("key != ''")
    once = p.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "key").orderBy("ord"))).where("n = 1")
    rows = once.select(
        "symbol", F.lit("reddit").alias("source"), "ord", first_text(F.col("p.title")).alias("title"), first_text(F.col("p.selftext")).alias("body"), F.concat(F.lit(site), first_text(F.col("p.permalink"))).alias("url"),
        F.nullif(first_text(F.col("p.subreddit")), F.lit("")).alias("forum"), epoch_time(F.nullif("p.created_utc", F.lit("0"))).alias("created_ts"),
    )
    return _required(rows, "title").withColumn("excerpt", excerpt(first_text(F.col("body"), F.col("title"))))


def posts_b(items: DataFrame, site: str = "https://stocktwits.com") -> DataFrame:
    """As ``posts_a``; the title is the head of the body."""
    rows = _parsed(items, POSTS_B).select("symbol", F.lit("stocktwits").alias("source"), "ord", first_text(F.col("p.body")).alias("body"), "p.id", iso_time(F.col("p.created_at")).alias("created_ts"))
    rows = _required(rows, "body").withColumns({"title": excerpt(F.col("body"), 96), "excerpt": excerpt(F.col("body")), "forum": F.lit("stocktwits")})
    url = F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit(f"{site}/message/"), "id")).otherwise(F.concat(F.lit(f"{site}/symbol/"), "symbol"))
    return rows.select("symbol", "source", "ord", "title", "body", url.alias("url"), "forum", "created_ts", "excerpt")


def officers(items: DataFrame, most: int = 40) -> DataFrame:
    """symbol, rank, name, title: the first ``most`` officers with a name, in the order listed."""
    rows = _required(_parsed(items, OFFICER).select("symbol", "ord", first_text(F.col("p.name")).alias("name"), first_text(F.col("p.title")).alias("title")), "name")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("ord"))).where(F.col("rank") <= most).drop("ord")

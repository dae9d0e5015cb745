"""Queries from providers' payloads to the feeds shown, and on fundamentals as providers give them.

Payloads are made from the tables (documents as news, conversations as posts) and parsed again; the SQL goes to the tables directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import times
from .operators import feeds, fundamentals
from .queries import AGE, AS_OF, DOUBLED, NAME, NEWS, POST, RECENCY, TITLE_KEY, WORDS_FIN, first_wins, query, shaped, sql_contains, sql_hits, sql_phrase
from .sources import domain, providers

#: A company that the corpus names by two of its words.
COMPANY = "With Have Inc"


def news_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads of both news providers: English and French documents come from the first one, the rest from the other."""
    n = domain.news(spark, sf_dir, "lang").where("ord IS NOT NULL")
    first = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    i, url = F.col("ord"), F.when(F.col("ord") % 11 != 0, F.col("url"))
    third = lambda k, c: F.when(i % 3 == k, c)
    rated = F.when(i % 3 == 0, F.array(F.struct(F.lit("OTHER").alias("ticker"), F.lit("0.9").alias("relevance_score")), F.struct(F.col("symbol").alias("ticker"), (i % 10 / 10.0).cast("string").alias("relevance_score")), F.struct(F.col("symbol").alias("ticker"), F.lit("1.0").alias("relevance_score"))))
    a = n.where(first).select("symbol", "ord", F.to_json(F.struct("title", "summary", url.alias("url"), F.date_format("published_ts", "yyyyMMdd'T'HHmmss").alias("time_published"), rated.alias("ticker_sentiment"))).alias("payload"))
    content = F.struct(
        third(2, F.col("title")).alias("title"), F.when(i % 2 == 0, F.col("summary")).alias("description"), F.when(i % 2 == 1, F.date_format("published_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("pubDate"),
        F.struct(third(2, url).alias("url")).alias("canonicalUrl"), F.when(i % 7 == 1, F.array("symbol")).alias("symbols"),
    )
    b = n.where(~first).select(
        "symbol", "ord",
        F.to_json(F.struct(
            third(0, F.col("title")).alias("title"), third(1, F.col("title")).alias("shortTitle"), F.when(i % 2 == 1, F.col("summary")).alias("summary"), third(0, url).alias("link"), third(1, url).alias("url"),
            F.when(i % 2 == 0, F.unix_timestamp("published_ts")).alias("providerPublishTime"), F.when(i % 7 == 0, F.array(F.lit("x"), F.lower("symbol"))).alias("relatedTickers"), content.alias("content"),
        )).alias("payload"),
    )
    return a, b


def provider_news(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    a, b = news_items(spark, sf_dir)
    fetched, kept = feeds.provider_news(providers.news_a(a).unionByName(providers.news_b(b)), NAME, domain.as_of(), finance=WORDS_FIN, keys=("symbol", "provider"))
    return [(fetched.where(F.col("provider") == name), kept.where(F.col("provider") == name)) for name in providers.NEWS_PROVIDERS]


_SECOND = "date_trunc('second', published_ts)"
PNEWS = f"""{NEWS}, item AS (SELECT n.symbol, n.ord, trim(n.title) AS title, trim(coalesce(n.summary, '')) AS summary, n.url, {_SECOND} AS published_ts, CASE WHEN d.lang IN ('en', 'fr') THEN 'alpha' ELSE 'yahoo' END AS provider,
  CASE WHEN d.lang IN ('en', 'fr') AND n.ord % 3 = 0 THEN 3.0 + 4.0 * (n.ord % 10 / 10.0)::DOUBLE ELSE 0.0 END AS tagged, CASE WHEN coalesce(d.lang NOT IN ('en', 'fr'), TRUE) AND n.ord % 7 < 2 THEN 3.0 ELSE 0.0 END AS related
  FROM news n JOIN documents d ON d.doc_id = n.ord WHERE trim(coalesce(n.title, '')) <> '' AND n.ord % 11 <> 0 AND coalesce({_SECOND} >= {AS_OF} - INTERVAL 30 DAYS, TRUE)),
ilow AS (SELECT *, lower(concat_ws(' ', title, summary)) AS t, {AGE.format(at="published_ts")} AS age FROM item),
irel AS (SELECT *, CASE WHEN {sql_hits(NAME, DOUBLED.replace("lower(text)", "t"))} > 0 OR contains(t, '${NAME}') THEN 2.5 ELSE 0.0 END::DOUBLE + least({sql_contains("t", WORDS_FIN)}, 5) * 0.18::DOUBLE + tagged + related AS raw, round(raw, 4) AS relevance, {RECENCY.format(at="published_ts")} AS recency FROM ilow),
irank AS (SELECT *, round(relevance * 0.72::DOUBLE + recency * 1.28::DOUBLE, 4) AS rank_score, {TITLE_KEY.format("title")} AS key FROM irel WHERE raw >= 0.9),
itier AS (SELECT *, CASE WHEN count(*) FILTER (rank_score >= 1.2) OVER w >= 100 THEN 1.2 WHEN count(*) FILTER (rank_score >= 0.75) OVER w >= 66 THEN 0.75 ELSE -1e9 END AS least_score FROM irank WINDOW w AS (PARTITION BY symbol, provider)),
ifetched AS (SELECT *, symbol AS company FROM itier WHERE rank_score >= least_score)"""
_BY_PROVIDER = "(SELECT * REPLACE (symbol || '|' || provider AS symbol) FROM ifetched)"
PKEPT = f"""{PNEWS}, {first_wins(_BY_PROVIDER, "rank_score DESC, ord", "p")},
ikept AS (SELECT f.*, row_number() OVER (PARTITION BY f.symbol, f.provider ORDER BY f.rank_score DESC, f.ord) AS rank FROM walkp w JOIN ifetched f ON w.symbol = f.symbol || '|' || f.provider AND w.ord = f.ord WHERE w.stays)"""


@query(f"WITH RECURSIVE {PKEPT} SELECT symbol, provider, ord, rank, round(relevance, 4) AS relevance, round(rank_score, 4) AS rank_score FROM ikept WHERE rank <= 200")
def news_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's news from its payloads: parsed, filtered, ranked, each story once."""
    kept = [k for _, k in provider_news(spark, sf_dir)]
    return shaped(kept[0].unionByName(kept[1]), "symbol", "provider", "ord", "rank", "relevance", "rank_score")


PSHOWN = f"""{PKEPT}, {first_wins("(SELECT symbol, ord, url, key, provider, rank FROM ikept WHERE rank <= 200)", "provider, rank", "u")},
ideduped AS (SELECT k.* FROM walku w JOIN ikept k USING (symbol, ord) WHERE w.stays),
ishown AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY relevance DESC, coalesce(published_ts, TIMESTAMP '1970-01-01') DESC, provider, rank) AS rank, provider, ord FROM ideduped)"""


@query(f"WITH RECURSIVE {PSHOWN} SELECT * FROM ishown WHERE rank <= 50")
def news_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both providers' news in one feed."""
    return shaped(feeds.combined_news(provider_news(spark, sf_dir), 50)[2], "symbol", "rank", "provider", "ord")


@query(f"""WITH RECURSIVE {PSHOWN}, a AS (SELECT symbol, count(*) AS fetched FROM ifetched GROUP BY symbol), b AS (SELECT symbol, count(*) AS deduped FROM ideduped GROUP BY symbol)
  SELECT symbol, fetched, deduped, least(deduped, 50) AS displayed, round((fetched - deduped) * 100.0::DOUBLE / fetched, 4) AS repeat_pct FROM a JOIN b USING (symbol)""")
def news_fetch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ladders gave, what was left of it, what is shown."""
    fetched, deduped, _ = feeds.combined_news(provider_news(spark, sf_dir), 50)
    return shaped(feeds.pool_audit(fetched, deduped, ["symbol"], 50))


def post_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads of both post providers; posts of forums come with the first one, twice (as of two pages)."""
    p = domain.posts(spark, sf_dir)
    i = F.col("ord")
    a = p.where("provider != 'stocktwits'").select("symbol", "ord", F.to_json(F.struct(
        F.when(i % 5 != 0, F.concat(F.lit("/r/"), i)).alias("permalink"), i.alias("id"), "title", F.when(i % 4 != 0, F.col("body")).alias("selftext"),
        F.when(F.col("provider") == "forum", "Stocks").otherwise("misc").alias("subreddit"), F.when(i % 6 != 0, F.unix_timestamp("created_ts")).alias("created_utc"),
    )).alias("payload"))
    a = a.unionByName(a.withColumn("ord", i + 1_000_000_000))
    b = p.where("provider = 'stocktwits'").select("symbol", "ord", F.to_json(F.struct(F.when(i % 5 != 0, i).alias("id"), "body", F.date_format("created_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))).alias("payload"))
    return a, b


def provider_posts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    a, b = post_items(spark, sf_dir)
    return [feeds.provider_posts(rows, NAME, domain.as_of(), company=COMPANY, finance=WORDS_FIN) for rows in (providers.posts_a(a), providers.posts_b(b))]


_EXCERPT = r"CASE WHEN length({s}[1]) BETWEEN 1 AND 96 THEN {s}[1] WHEN length({c}) <= 96 THEN {c} ELSE rtrim(substr({c}, 1, 95)) || '…' END"
_COMPACT = r"trim(regexp_replace(body, '\s+', ' ', 'g'))"
_SENTS = rf"list_filter(string_split(regexp_replace({_COMPACT}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')"
_LINK = "'https://www.reddit.com' || CASE WHEN ord % 5 <> 0 THEN '/r/' || ord ELSE '' END"
PPOSTS = f"""{POST}, raw AS (SELECT symbol, ord, CASE WHEN provider = 'stocktwits' THEN 'stocktwits' ELSE 'reddit' END AS source, date_trunc('second', created_ts) AS ts, trim(body) AS body, trim(title) AS title, provider FROM post),
pitem AS (SELECT symbol, ord, source, title, CASE WHEN ord % 4 <> 0 THEN body ELSE '' END AS body, {_LINK} AS url, CASE provider WHEN 'forum' THEN 2.5 ELSE 0.0 END::DOUBLE AS weight, CASE WHEN ord % 6 <> 0 THEN ts END AS created_ts FROM raw WHERE source = 'reddit' AND title <> ''
  UNION ALL SELECT symbol, ord, source, {_EXCERPT.format(s=_SENTS, c=_COMPACT)}, body, CASE WHEN ord % 5 <> 0 THEN 'https://stocktwits.com/message/' || ord ELSE 'https://stocktwits.com/symbol/' || symbol END, 0.0, ts FROM raw WHERE source = 'stocktwits' AND body <> ''),
plow2 AS (SELECT *, lower(concat_ws(' ', title, body)) AS t, {AGE.format(at="created_ts")} AS age FROM pitem WHERE coalesce(created_ts >= {AS_OF} - INTERVAL 30 DAYS, TRUE)),
phit2 AS (SELECT *, len(regexp_extract_all({DOUBLED.replace("lower(text)", "t")}, '{sql_phrase(NAME)}')) AS hits, CASE WHEN contains(t, 'with have inc') THEN 1 ELSE 0 END AS full_name, {sql_contains("t", ("with", "have"))} AS tokens, {sql_contains("t", WORDS_FIN)} AS fin FROM plow2),
prel2 AS (SELECT *, hits * 3.2::DOUBLE + least(full_name * 2 + tokens, 5) * 1.1::DOUBLE + fin * 0.32::DOUBLE + weight - CASE WHEN hits <= 1 AND full_name * 2 + tokens = 0 THEN 0.7 ELSE 0.0 END::DOUBLE - CASE WHEN regexp_matches(t, 'https?://') THEN 0.15 ELSE 0.0 END::DOUBLE AS relevance,
  {RECENCY.format(at="created_ts")} AS recency FROM phit2 WHERE hits > 0 OR full_name > 0 OR (tokens >= 2 AND fin >= 1)),
pfetched AS (SELECT *, round(relevance + recency * CASE source WHEN 'reddit' THEN 2.4 ELSE 1.8 END::DOUBLE, 3) AS score, {TITLE_KEY.format("title")} AS key FROM prel2 WHERE relevance > 0),
{first_wins("(SELECT * REPLACE (symbol || '|' || source AS symbol) FROM pfetched)", "score DESC, ord", "s")},
pdistinct AS (SELECT f.* FROM walks w JOIN pfetched f ON w.symbol = f.symbol || '|' || f.source AND w.ord = f.ord WHERE w.stays),
pgate AS (SELECT *, count(*) FILTER (score >= CASE source WHEN 'reddit' THEN 2.6 ELSE 2.1 END) OVER w AS n1, count(*) FILTER (score >= CASE source WHEN 'reddit' THEN 1.8 ELSE 1.0 END) OVER w AS n2 FROM pdistinct WINDOW w AS (PARTITION BY symbol, source)),
pkept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY score DESC, coalesce(created_ts, TIMESTAMP '1970-01-01') DESC, ord) AS rank FROM pgate
  WHERE CASE WHEN n1 >= 5 AND n1 >= 66 THEN score >= CASE source WHEN 'reddit' THEN 2.6 ELSE 2.1 END WHEN n1 < 5 AND n2 >= 66 THEN score >= CASE source WHEN 'reddit' THEN 1.8 ELSE 1.0 END ELSE TRUE END) WHERE rank <= 200)"""


@query(f"WITH RECURSIVE {PPOSTS} SELECT symbol, source, ord, rank, round(score, 4) AS score FROM pkept")
def social_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's posts from its payloads. SQL knows equal titles only; alike ones are tested apart (no post here is merely alike)."""
    kept = [k for _, k in provider_posts(spark, sf_dir)]
    return shaped(kept[0].unionByName(kept[1]), "symbol", "source", "ord", "rank", "score")


PMIX = f"""{PPOSTS}, {first_wins("pkept", "score DESC, ord", "m")}, pdeduped AS (SELECT k.* FROM walkm w JOIN pkept k USING (symbol, ord) WHERE w.stays),
pturn AS (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY score DESC, coalesce(created_ts, TIMESTAMP '1970-01-01') DESC, ord) AS turn FROM pdeduped),
pshown AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY turn, source) AS position, source, ord FROM pturn)"""


@query(f"WITH RECURSIVE {PMIX} SELECT * FROM pshown WHERE position <= 50")
def social_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both providers' posts in one feed, turn by turn."""
    return shaped(feeds.combined_posts(provider_posts(spark, sf_dir), 50)[2], "symbol", "position", "source", "ord")


@query(f"""WITH RECURSIVE {PMIX}, a AS (SELECT symbol, count(*) AS fetched FROM pfetched GROUP BY symbol), b AS (SELECT symbol, count(*) AS deduped FROM pdeduped GROUP BY symbol)
  SELECT symbol, fetched, deduped, least(deduped, 50) AS displayed, round((fetched - deduped) * 100.0::DOUBLE / fetched, 4) AS repeat_pct FROM a JOIN b USING (symbol)""")
def social_fetch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched, deduped, _ = feeds.combined_posts(provider_posts(spark, sf_dir), 50)
    return shaped(feeds.pool_audit(fetched, deduped, ["symbol"], 50))


# Spellings of times and numbers, and what each is.
TIMES = (
    ("compact", "20240131T101500", "2024-01-31 10:15:00"), ("compact", "2024-01-31T10:15:00", None), ("compact", "", None), ("iso", "2024-01-31T10:15:00Z", "2024-01-31 10:15:00"), ("iso", "2024-01-31T12:15:00+02:00", "2024-01-31 10:15:00"),
    ("iso", "yesterday", None), ("epoch", "1706696100", "2024-01-31 10:15:00"), ("epoch", "soon", None), ("any", "2024-01-31", "2024-01-31 00:00:00"), ("any", "2024/01/31", "2024-01-31 00:00:00"), ("any", " 20240131 ", "2024-01-31 00:00:00"),
    ("any", "20240131T101500", "2024-01-31 10:15:00"), ("any", "2024-01-31T10:15:00", "2024-01-31 10:15:00"), ("any", "31 Jan 2024", None), ("any", "2024-13-01", None),
)
NUMBERS = (("number", " 12.5 ", 12.5), ("number", "None", None), ("number", "-", None), ("number", "NaN", None), ("number", "", None), ("number", "1e3", 1000.0), ("number", "x", None), ("percent", "3/4", 75.0), ("percent", "12.5%", 12.5), ("percent", "$-4", -4.0), ("percent", "n/a", None), ("percent", "3/0", 30.0))


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) if not isinstance(x, float) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows)


@query(f"""SELECT form, text, CAST(value AS TIMESTAMP) AS value FROM (VALUES {_values(TIMES)}) t(form, text, value)
  UNION ALL SELECT ['compact', 'iso', 'epoch', 'any'][event_id % 4 + 1], CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%dT%H%M%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS VARCHAR) ELSE strftime(ts, ' %Y/%m/%d ') END,
  CASE WHEN event_id % 4 = 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END::TIMESTAMP FROM events""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' times in four spellings, read back, and a seed of others."""
    k, at = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    spelt = F.when(k == 0, F.date_format(at, "yyyyMMdd'T'HHmmss")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.unix_timestamp(at).cast("string")).otherwise(F.date_format(at, " yyyy/MM/dd "))
    form = F.when(k == 0, "compact").when(k == 1, "iso").when(k == 2, "epoch").otherwise("any")
    rows = spark.createDataFrame([r[:2] for r in TIMES], "form string, text string").unionByName(domain.read(spark, sf_dir, "events").select(form.alias("form"), spelt.alias("text")))
    parse = {"compact": times.compact_time, "iso": times.iso_time, "epoch": times.epoch_time, "any": times.any_date}
    value = F.coalesce(*[F.when(F.col("form") == k, f(F.col("text"))) for k, f in parse.items()])
    return rows.withColumn("value", value)


@query(f"""SELECT * FROM (VALUES {_values(NUMBERS)}) t(form, text, value)
  UNION ALL SELECT CASE WHEN k % 5 < 2 THEN 'number' ELSE 'percent' END, CASE k % 5 WHEN 0 THEN ' ' || b || ' ' WHEN 1 THEN 'None' WHEN 2 THEN b || '%' WHEN 3 THEN '$' || b ELSE a || '/' || d END,
  CASE WHEN k % 5 = 1 THEN NULL WHEN k % 5 < 4 THEN b WHEN d = 0 THEN CAST(a || '0' AS DOUBLE) ELSE a::DOUBLE / d * 100 END FROM (SELECT c_custkey AS k, c_acctbal AS b, c_custkey % 50 AS a, c_custkey % 8 AS d FROM customer)""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances and fractions in five spellings, read back, and a seed of others."""
    k, b = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    said = F.when(k % 5 == 0, F.concat(F.lit(" "), b, F.lit(" "))).when(k % 5 == 1, "None").when(k % 5 == 2, F.concat(b, F.lit("%"))).when(k % 5 == 3, F.concat(F.lit("$"), b)).otherwise(F.concat_ws("/", k % 50, k % 8))
    told = domain.read(spark, sf_dir, "customer").select(F.when(k % 5 < 2, "number").otherwise("percent").alias("form"), said.alias("text"))
    rows = spark.createDataFrame([r[:2] for r in NUMBERS], "form string, text string").unionByName(told)
    return rows.withColumn("value", F.coalesce(F.when(F.col("form") == "number", times.number(F.col("text"))), F.when(F.col("form") == "percent", times.percent_number(F.col("text")))))


@query("""WITH o AS (SELECT n_name AS symbol, c_custkey AS ord, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' Officer' ELSE '' END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ord) AS rank, name, title FROM o WHERE name IS NOT NULL) WHERE rank <= 40""")
def company_officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = domain.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
    c = domain.read(spark, sf_dir, "customer")
    title = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit(" Officer")))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("symbol", F.col("c_custkey").alias("ord"), F.to_json(F.struct(F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"), title.alias("title"))).alias("payload"))
    return shaped(providers.officers(rows), "symbol", "rank", "name", "title")


CALENDAR = """cal AS (SELECT 'SYM' || o_custkey % 5 AS symbol, o_orderdate AS announced, o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 1000 END AS reported_eps, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 1100 END AS eps_estimate FROM orders),
recent AS (SELECT *, year(announced) AS year, quarter(announced) AS quarter FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY announced DESC, ord) AS n FROM cal) WHERE n <= 12)"""


@query(f"""WITH {CALENDAR} SELECT symbol, year, quarter, round(arg_min(reported_eps, n) FILTER (reported_eps IS NOT NULL), 4) AS reported_eps, round(arg_min(eps_estimate, n) FILTER (eps_estimate IS NOT NULL), 4) AS eps_estimate FROM recent GROUP BY ALL""")
def eps_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest known EPS of each quarter among a company's last twelve announcements."""
    o = domain.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.concat(F.lit("SYM"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), F.col("o_orderdate").alias("announced"), k.alias("ord"),
        F.when(k % 3 != 0, F.col("o_totalprice") / 1000).alias("reported_eps"), F.when(k % 4 != 0, F.col("o_totalprice") / 1100).alias("eps_estimate"),
    )
    return shaped(fundamentals.eps_calendar(rows), "symbol", "year", "quarter", "reported_eps", "eps_estimate")


SERIES = """f AS (SELECT 'SYM' || o_custkey % 5 AS symbol, CASE WHEN o_custkey % 5 = 3 THEN 'Revenue' ELSE o_orderstatus END AS metric, date_trunc('month', o_orderdate) AS period_end, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
named AS (SELECT *, CASE metric WHEN 'Total Revenue' THEN 0 WHEN 'F' THEN 1 WHEN 'Revenue' THEN 2 END AS place FROM f),
best AS (SELECT * FROM named WHERE place IS NOT NULL QUALIFY place = min(place) OVER (PARTITION BY symbol)),
cols AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS col FROM best QUALIFY col <= 4)"""


@query(f"WITH {SERIES} SELECT symbol, year(period_end) AS year, quarter(period_end) AS quarter, round(arg_max(value, col) + 0.001, 1) AS value FROM cols GROUP BY ALL")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a metric's names that a statement has, its newest four columns by quarter."""
    o = domain.read(spark, sf_dir, "orders")
    rows = o.groupBy(
        F.concat(F.lit("SYM"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), F.when(F.col("o_custkey") % 5 == 3, "Revenue").otherwise(F.col("o_orderstatus")).alias("metric"),
        F.date_trunc("month", "o_orderdate").alias("period_end"),
    ).agg(F.sum("o_totalprice").alias("value"))
    out = fundamentals.series_row(rows, ("Total Revenue", "F", "Revenue"))
    return shaped(out.withColumn("value", F.round(F.col("value") + 0.001, 1)), "symbol", "year", "quarter", "value")


TARGETS = """t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 1000 END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 900 END AS mean_target, o_totalprice / 800 AS high, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / (900 + o_orderkey % 400) ELSE 0 END AS low FROM orders)"""


@query(f"""WITH {TARGETS} SELECT id, round((mean_target - price) / nullif(price, 0) * 100, 4) AS upside_pct, round(s, 4) AS spread_pct, CASE WHEN s IS NULL THEN 'unknown' WHEN s < 15 THEN 'tight' WHEN s < 35 THEN 'moderate' ELSE 'wide' END AS spread
  FROM (SELECT *, (high - low) / nullif(mean_target, 0) * 100 AS s FROM t)""")
def price_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upside to the mean price target and how far targets lie apart."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    t = domain.read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 9 != 0, p / 1000).alias("price"), F.when(k % 7 != 0, p / 900).alias("mean_target"), (p / 800).alias("high"), F.when(k % 5 != 0, p / (k % 400 + 900)).otherwise(0.0).alias("low")
    )
    return shaped(fundamentals.price_targets(t), "id", "upside_pct", "spread_pct", "spread")


@query("""WITH c AS (SELECT symbol, day, avg(close) AS close, sum(volume) AS volume FROM (SELECT 'SYM' || user_id % 5 AS symbol, CAST(ts AS DATE) AS day, value AS close, 1 AS volume FROM events) GROUP BY ALL),
  r AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS n, count(*) OVER (PARTITION BY symbol) AS days FROM c)
  SELECT symbol, day, 11 - n AS position, days >= 3 AS charted FROM r WHERE n <= 10""")
def fundamentals_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest points oldest first, and whether there are enough for a chart."""
    p = domain.prices(spark, sf_dir)
    return shaped(fundamentals.trend(p, "symbol", "day", 10, 3), "symbol", "day", "position", "charted")

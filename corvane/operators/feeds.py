"""Feed operators: relevance, recency, ranking ladders, deduplication, interleaving and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import company_tokens, mentions, phrase, title_key
from ..sources.store import store
from .distinct import greedy_distinct
from .mentions import mentions as company_mentions
from .neardup import distinct_posts

#: Words of finance news.
FINANCE = ("stock", "shares", "earnings", "eps", "revenue", "guidance", "valuation", "market cap", "dividend", "buyback", "analyst", "quarter")
#: Weights of finance forums.
FORUMS = {"stocks": 2.5, "investing": 2.5, "wallstreetbets": 2.0, "stockmarket": 2.0, "options": 1.5, "securityanalysis": 2.5, "valueinvesting": 2.5}


def _hits(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """How many of the words occur, as plain substrings."""
    return reduce(lambda a, w: a + F.contains(text, F.lit(w)).cast("int"), words, F.lit(0))


def news_relevance(title: Column, summary: Column, symbol: str, company: str | None = None, finance: tuple[str, ...] = FINANCE, tagged: Column | None = None, related: Column | None = None) -> Column:
    """Relevance of a news item to one company; 0 below 0.9.

    ``tagged`` is the provider's own relevance for the symbol (null if it has none), ``related`` whether the
    provider lists the symbol.
    """
    return news_score(**_news_facts(title, summary, symbol, company, finance), tagged=tagged, related=related)


def _news_facts(title: Column, summary: Column, symbol: str, company: str | None, finance: tuple[str, ...]) -> dict[str, Column]:
    """What ``news_score`` asks of a text."""
    text = F.lower(F.concat_ws(" ", title, summary))
    facts = {"mentioned": mentions(text, symbol), "finance_hits": _hits(text, finance)}
    return facts | ({"named": F.contains(text, F.lit(company.lower().strip())), "tokens": _hits(text, company_tokens(company))} if company else {})


def news_score(mentioned: Column, finance_hits: Column, named: Column | None = None, tokens: Column | None = None, tagged: Column | None = None, related: Column | None = None) -> Column:
    """Relevance from what a text holds: the symbol, words of finance, the company's name and words, and the provider's marks."""
    score = F.when(mentioned, 2.5).otherwise(0.0) + F.least(finance_hits, F.lit(5)) * 0.18
    if tagged is not None:
        score = score + F.coalesce(F.lit(3.0) + tagged * 4.0, F.lit(0.0))
    if related is not None:
        score = score + F.when(related, 3.0).otherwise(0.0)
    if named is not None:
        score = score + F.when(named, 2.0).otherwise(0.0) + F.least(tokens, F.lit(4)) * 0.45
    return F.when(score < 0.9, 0.0).otherwise(F.round(score, 4))


def post_relevance(title: Column, body: Column, symbol: str, forum: Column | None = None, company: str | None = None, finance: tuple[str, ...] = FINANCE) -> Column:
    """Relevance of a social post to one company; 0 if it names neither symbol nor company."""
    text = F.lower(F.concat_ws(" ", title, body))
    words = F.regexp_count(text, F.lit(phrase(symbol)))
    cash = F.regexp_count(text, F.lit(rf"\Q${symbol.lower()}\E"))
    named = F.lit(0)
    if company:
        named = F.contains(text, F.lit(company.lower().strip())).cast("int") * 2 + _hits(text, company_tokens(company))
    return post_score(words, cash, named, _hits(text, finance), text.rlike("https?://"), forum)


def post_score(words: Column, cash: Column, named: Column, finance_hits: Column, linked: Column, forum: Column | None = None) -> Column:
    """Relevance from what a text holds: the symbol as a word and behind a dollar sign, the company (2 for its name, 1 for each of its words), words of finance, a link."""
    score = words * 3.2 + cash * 4.0 + F.least(named, F.lit(5)) * 1.1 + finance_hits * 0.32
    if forum is not None:
        score = score + F.coalesce(F.create_map(*[F.lit(x) for kv in FORUMS.items() for x in kv])[F.lower(forum)], F.lit(0.0))
    score = score - F.when((words + cash <= 1) & (named == 0), 0.7).otherwise(0.0) - F.when(linked, 0.15).otherwise(0.0)
    return F.when((words + cash == 0) & (named == 0), 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def company_scores(rows: DataFrame, key: list[str], text: Column, companies: DataFrame, finance: tuple[str, ...] = FINANCE) -> DataFrame:
    """key, company, words, cash, named, tokens, news_relevance, post_relevance, related: every row against every company (company, symbol, name) that it names.

    One pass over the texts whatever the number of companies; pairs that share nothing have no row (their relevance is 0). ``key`` names a row.
    """
    low = F.lower(text)
    facts = rows.select(*key, _hits(low, finance).alias("finance_hits"), F.coalesce(low.rlike("https?://"), F.lit(False)).alias("linked"))
    met = company_mentions(rows, key, text, companies).join(facts, key)
    hit, named = (F.col("words") > 0) | (F.col("cash") > 0), F.col("named") > 0
    return met.select(
        *key, "company", "words", "cash", "named", "tokens",
        news_score(hit, F.col("finance_hits"), named, F.col("tokens")).alias("news_relevance"),
        post_score(F.col("words"), F.col("cash"), F.col("named") * 2 + F.col("tokens"), F.col("finance_hits"), F.col("linked")).alias("post_relevance"),
        (hit | named | ((F.col("tokens") >= 2) & (F.col("finance_hits") >= 1))).alias("related"),
    )


def is_related(title: Column, body: Column, symbol: str, company: str | None = None, finance: tuple[str, ...] = FINANCE) -> Column:
    """A post names the symbol or the company, or two of the company's words and a word of finance."""
    text = F.lower(F.concat_ws(" ", title, body))
    named = mentions(text, symbol)
    if company:
        named = named | F.contains(text, F.lit(company.lower().strip())) | ((_hits(text, company_tokens(company)) >= 2) & (_hits(text, finance) >= 1))
    return named


def within_lookback(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last days; rows of unknown time stay."""
    return rows.where(F.coalesce(F.col(at) >= as_of - F.expr(f"INTERVAL {max(days, 1)} DAYS"), F.lit(True)))


def ladder(rows: DataFrame, keys: list[str], score: str, steps: list[tuple[float, int]]) -> DataFrame:
    """The strictest tier with enough rows, per key.

    ``steps`` are (least score, rows it must give). Each gate looks at what was chosen so far: with fewer rows than the gate asks
    for, the next step is taken, after the last one all rows. Counts are summed map-side; the tiers, one row a key, are stored, so that
    their size is known and the rows are not moved to meet them.
    """
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col(score) >= t).alias(f"__n{k}") for k, (t, _) in enumerate(steps)], F.count(F.lit(1)).alias(f"__n{len(steps)}"))
    tier, n = F.lit(0), F.col("__n0")
    for k, (_, must) in enumerate(steps):
        tier, n = F.when(n < must, k + 1).otherwise(tier), F.when(n < must, F.col(f"__n{k + 1}")).otherwise(n)
    least = reduce(lambda c, k: c.when(F.col("__tier") == k, F.lit(steps[k][0])), range(1, len(steps)), F.when(F.col("__tier") == 0, F.lit(steps[0][0])))
    picked = store(counts.select(*keys, tier.alias("__tier")))
    return rows.join(picked, keys).where((F.col("__tier") == len(steps)) | (F.col(score) >= least)).drop("__tier")


def news_steps(limit: int) -> list[tuple[float, int]]:
    return [(1.2, max(4, limit // 2)), (0.75, max(3, limit // 3))]


def post_steps(source: str, limit: int) -> list[tuple[float, int]]:
    """The ladder of a post provider; its second gate may be the higher one."""
    high, low = {"reddit": (2.6, 1.8), "stocktwits": (2.1, 1.0)}[source]
    return [(high, max(3, min(limit, 5))), (low, max(2, limit // 3))]


def top(rows: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


#: Share of recency in a post's score, by provider.
FRESH = {"reddit": 2.4, "stocktwits": 1.8}


def provider_news(rows: DataFrame, symbol: str, as_of: Column, *, days: int = 30, limit: int = 200, company: str | None = None, finance: tuple[str, ...] = FINANCE, keys: tuple[str, ...] = ("symbol",)) -> tuple[DataFrame, DataFrame]:
    """(fetched, kept) of providers' rows: lookback, relevance, ladder; then first wins, best first, ``limit`` per ``keys``.

    With the provider among ``keys``, each provider's rows are treated apart from the others', in the same jobs. Texts are read once, where relevance is
    stored with them, before anything filters by it; first wins moves keys and marks only, and few rows fetch their texts.
    """
    facts = _news_facts(F.col("title"), F.col("summary"), symbol, company, finance)
    r = within_lookback(rows, "published_ts", as_of, days).withColumns({f"__{k}": c for k, c in facts.items()})
    r = r.withColumn("relevance", news_score(**{k: F.col(f"__{k}") for k in facts}, tagged=F.col("tagged"), related=F.col("related"))).drop(*[f"__{k}" for k in facts])
    r = r.withColumn("rank_score", F.round(F.col("relevance") * 0.72 + S.recency(F.col("published_ts"), as_of, days) * 1.28, 4))
    r = store(r.withColumn("key", title_key(F.col("title"))).withColumn("place", F.struct((-F.col("rank_score")).alias("score"), "ord"))).where("relevance > 0")
    fetched = ladder(r, list(keys), "rank_score", news_steps(limit))
    once = greedy_distinct(fetched.select(*keys, "place", "url", "key"), list(keys), "place", ["url", "key"])
    best = top(once, list(keys), [F.col("place")], limit).select(F.struct(*keys).alias("__scope"), "place").distinct()
    kept = fetched.withColumn("__scope", F.struct(*keys)).join(store(best), ["__scope", "place"], "left_semi").select(*fetched.columns)
    return fetched, store(top(kept, list(keys), [F.col("place")], limit))


def combined_news(providers: list[tuple[DataFrame, DataFrame]], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fetched, deduped, shown) of several providers' (fetched, kept): united in their order, first wins, then by relevance and time."""
    fetched = reduce(DataFrame.unionByName, [f for f, _ in providers])
    union = reduce(DataFrame.unionByName, [k.withColumn("place", F.struct(F.lit(n).alias("provider"), F.col("rank").alias("rank"))) for n, (_, k) in enumerate(providers)])
    deduped = store(greedy_distinct(union, ["symbol"], "place", ["url", "key"]))
    order = [F.desc("relevance"), F.desc(F.coalesce("published_ts", F.timestamp_seconds(F.lit(0)))), F.col("place")]
    return fetched, deduped, top(deduped.drop("rank"), ["symbol"], order, limit)


def provider_posts(rows: DataFrame, symbol: str, as_of: Column, *, days: int = 30, limit: int = 200, company: str | None = None, finance: tuple[str, ...] = FINANCE) -> tuple[DataFrame, DataFrame]:
    """(fetched, kept) of one provider's posts: lookback, related ones, scored; then without near copies, the ladder, ``limit`` per symbol."""
    rows = store(rows)
    source = rows.select("source").first()
    source = "reddit" if source is None else source[0]
    r = within_lookback(rows, "created_ts", as_of, days).where(is_related(F.col("title"), F.col("body"), symbol, company, finance))
    r = r.withColumn("relevance", post_relevance(F.col("title"), F.col("body"), symbol, F.col("forum"), company, finance)).where("relevance > 0")
    fetched = store(r.withColumn("score", F.round(F.col("relevance") + S.recency(F.col("created_ts"), as_of, days) * FRESH[source], 3)))
    kept = ladder(distinct_posts(fetched, ["symbol"]), ["symbol"], "score", post_steps(source, limit))
    return fetched, top(kept, ["symbol"], post_order(), limit)


def post_order() -> list[Column]:
    return [F.desc("score"), F.desc(F.coalesce("created_ts", F.timestamp_seconds(F.lit(0)))), F.col("ord")]


def combined_posts(providers: list[tuple[DataFrame, DataFrame]], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fetched, deduped, shown): united, without near copies, dealt round robin by provider."""
    fetched = reduce(DataFrame.unionByName, [f for f, _ in providers])
    deduped = store(distinct_posts(store(reduce(DataFrame.unionByName, [k.drop("rank") for _, k in providers])), ["symbol"]))
    return fetched, deduped, interleave(deduped, ["symbol"], "source", post_order(), limit)


def pool_audit(fetched: DataFrame, deduped: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per key: rows fetched, left after deduplication, displayed, and the percent that repeated others."""
    a = fetched.groupBy(*keys).agg(F.count(F.lit(1)).alias("fetched"))
    b = deduped.groupBy(*keys).agg(F.count(F.lit(1)).alias("deduped"))
    out = a.join(b, keys, "left").withColumn("deduped", F.coalesce("deduped", F.lit(0).cast("bigint"))).withColumn("displayed", F.least("deduped", F.lit(limit).cast("bigint")))
    return out.withColumn("repeat_pct", (F.col("fetched") - F.col("deduped")) * 100.0 / F.col("fetched"))


def interleave(rows: DataFrame, keys: list[str], source: str, order: list[Column], limit: int) -> DataFrame:
    """Round robin over sources by name: each source's first row, then each one's second, up to ``limit`` per key."""
    w = Window.partitionBy(*keys, source).orderBy(*order)
    turn = rows.withColumn("__turn", F.row_number().over(w)).where(F.col("__turn") <= limit)
    return top(turn, keys, [F.col("__turn"), F.col(source)], limit, "position").drop("__turn")


def day_sentiment(news: DataFrame, posts: DataFrame) -> DataFrame:
    """day, news and post means (0 if none), and the mean of those there are, from (at, score) rows."""
    both = news.select(F.to_date("at").alias("day"), F.col("score").alias("n"), F.lit(None).cast("double").alias("p")).unionByName(
        posts.select(F.to_date("at").alias("day"), F.lit(None).cast("double").alias("n"), F.col("score").alias("p"))
    )
    days = both.where("day IS NOT NULL").groupBy("day").agg(F.avg("n").alias("n"), F.avg("p").alias("p"))
    blend = F.coalesce((F.col("n") + F.col("p")) / 2, "n", "p", F.lit(0.0))
    return days.select("day", F.coalesce("n", F.lit(0.0)).alias("news_avg"), F.coalesce("p", F.lit(0.0)).alias("social_avg"), blend.alias("blended"))


def sentiment_shares(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Items, mean, stance, and percent bullish, bearish and neutral per key."""
    s = S.stance(F.col(score))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.avg(score).alias("mean"), F.count_if(s == "bullish").alias("bullish"), F.count_if(s == "bearish").alias("bearish"))
    share = lambda c: F.col(c) * 100.0 / F.col("items")
    return out.withColumns({"stance": S.stance(F.col("mean")), "bullish_pct": share("bullish"), "bearish_pct": share("bearish")}).withColumn("neutral_pct", F.lit(100.0) - F.col("bullish_pct") - F.col("bearish_pct"))


def rerank(rows: DataFrame, order: DataFrame, keys: list[str], key: str, limit: int) -> DataFrame:
    """Rows in the order that another ranker gave (keys, key, place); rows it left out follow in their own order (ord)."""
    placed = rows.join(order.groupBy(*keys, key).agg(F.min("place").alias("place")), [*keys, key], "left")
    return top(placed, keys, [F.col("place").isNull(), F.col("place"), F.col("ord")], limit)

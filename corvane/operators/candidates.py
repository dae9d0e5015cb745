"""Transcript candidates: URL forms, match scores, selection of links to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, company_tokens, compact

#: Words of candidate titles and slugs that name no company.
MARKERS = ("earnings call transcript", "earnings transcript")
SLUG_STOPS = ("earnings", "call", "transcript", "conference")


def clean_url(url: Column, host: str) -> Column:
    """https, no query or fragment, single slashes, a slash at the end; empty if it has no host."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit(f"https://{host}"), raw)).otherwise(F.regexp_replace(raw, "^http://", "https://"))
    bare = F.regexp_replace(full, r"[?#].*$", "")
    site = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]+)", 1)
    path = F.regexp_replace(F.concat(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]+(.*)$", 1), F.lit("/")), "/{2,}", "/")
    return F.when(site == "", "").otherwise(F.concat(site, path))


def slug(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(\.aspx)?/*$", ""), "/"), -1)


def _word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?U)(?<!\w)\Q{word}\E(?!\w)")


def names_ticker(title: Column, url: Column, ticker: str) -> Column:
    """The ticker as a word of the title, or between hyphens of the URL."""
    return _word(F.upper(title), ticker.upper()) | F.contains(F.lower(url), F.lit(f"-{ticker.lower()}-"))


def names_company(title: Column, url: Column, tokens: list[str]) -> Column:
    """Any of the company's words in the title, or as a part of the URL."""
    found = F.lit(False)
    for t in tokens:
        found = found | _word(F.lower(title), t) | F.lower(url).rlike(rf"(^|[-/])\Q{t}\E($|[-/.])")
    return found


def match_score(title: Column, url: Column, ticker: str, company: str | None = None) -> Column:
    """How well a candidate fits a company: brackets 100, word 60, company's name 35, its words 6 each (3 at most), kind of title 12 or 8."""
    up, low = F.upper(title), F.lower(title)
    score = F.when(F.contains(up, F.lit(f"({ticker.upper()})")), 100.0).otherwise(0.0) + F.when(_word(up, ticker.upper()), 60.0).otherwise(0.0)
    if company:
        score = score + F.when(F.contains(low, F.lit(company.lower().strip())), 35.0).otherwise(0.0)
        hits = sum((F.contains(low, F.lit(t)).cast("int") for t in company_tokens(company)), F.lit(0))
        score = score + F.least(hits, F.lit(3)) * 6.0
    return score + F.when(F.contains(low, F.lit(MARKERS[0])), 12.0).when(F.contains(low, F.lit(MARKERS[1])), 8.0).otherwise(0.0)


def quality(title: Column, url: Column, ticker: str, tokens: list[str], source: Column) -> Column:
    """Score of a discovered link, with a boost for where it was found."""
    up, low = F.upper(title), F.lower(title)
    base = (
        F.when(F.contains(up, F.lit(f"({ticker.upper()})")), 8.0).otherwise(0.0) + F.when(_word(up, ticker.upper()), 4.0).otherwise(0.0)
        + F.when(F.contains(F.lower(url), F.lit(f"-{ticker.lower()}-")), 4.0).otherwise(0.0) + F.when(F.contains(low, F.lit(MARKERS[0])), 2.0).when(F.contains(low, F.lit(MARKERS[1])), 1.0).otherwise(0.0)
    )
    alias = F.when(names_company(title, url, tokens) & ~names_ticker(title, url, ticker), 6.0).otherwise(0.0)
    boost = F.when(source.startswith("sitemap_month:"), 20.0).when(source.startswith("author_page:"), 14.0).when(source.startswith("openai_"), 4.0).otherwise(0.0)
    return base + alias + boost


def relevant(candidates: DataFrame, ticker: str, tokens: list[str]) -> DataFrame:
    """Candidates that name the ticker or the company; all, if the company's words are unknown."""
    return candidates.where(names_ticker(F.col("title"), F.col("url"), ticker) | names_company(F.col("title"), F.col("url"), tokens)) if tokens else candidates


#: Title markers of a transcript, and words of slugs and titles that tell no company.
TRANSCRIPT_TITLES = ("earnings transcript", "earnings call transcript", "conference call transcript")
COMPANY_STOPS = (
    "inc", "incorporated", "corp", "corporation", "company", "co", "class", "common", "stock", "holding", "holdings", "group", "global", "limited", "ltd", "plc", "sa", "nv", "the", "and", "of",
)


def is_transcript_title(title: Column) -> Column:
    return any_of(title, TRANSCRIPT_TITLES)


def is_transcript_url(url: Column, host: str) -> Column:
    """A page of the host under a dated path that names a transcript."""
    return F.lower(F.coalesce(url, F.lit(""))).rlike(rf"^https?://(www\.)?\Q{host}\E/earnings/call-transcripts/[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/[a-z0-9-]+/?$")


def url_date(url: Column) -> Column:
    """The date in a path /YYYY/MM/DD/."""
    return F.try_to_timestamp(F.regexp_extract(F.coalesce(url, F.lit("")), r"/(20[0-9]{2}/[0-9]{2}/[0-9]{2})/", 1), F.lit("yyyy/MM/dd")).cast("date")


def slug_title(url: Column, ticker: str) -> Column:
    """A title from a URL's last step: words capitalised, the ticker and quarters in capitals, named a transcript."""
    words = F.filter(F.split(slug(url), "-"), lambda w: w != "")
    shown = F.transform(words, lambda w: F.when(w.rlike("(?i)^q[1-4]$") | (F.lower(w) == ticker.lower()), F.upper(w)).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))))
    title = F.when(F.size(words) == 0, ticker).otherwise(F.array_join(shown, " "))
    return F.when(F.contains(F.lower(title), F.lit(MARKERS[0])), title).otherwise(F.concat(title, F.lit(" Earnings Call Transcript")))


def slug_tokens(url: Column, title: Column, ticker: str, most: int = 8) -> Column:
    """array<string>: words of the slug before its first general word, quarter or year, then of the title, that may name the company; ``most`` of them."""
    parts = F.split(F.lower(slug(url)), "-")
    end = F.array_min(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i).isin(*SLUG_STOPS) | F.element_at(parts, i).rlike("^(q[1-4]|20[0-9]{2})$")))
    head = F.slice(parts, F.lit(1), F.coalesce(end - 1, F.size(parts)))
    said = F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{3,}"), 0), lambda w: ~w.isin(*SLUG_STOPS))
    names = F.filter(F.concat(head, said), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*COMPANY_STOPS, ticker.lower()))
    return F.slice(F.array_distinct(names), 1, most)


def cache_key(*parts: Column) -> Column:
    """The first 12 hex digits of the parts' SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12)


def safe_name(text: Column) -> Column:
    """A part of a file's name: letters, digits, dots, dashes and underscores, 80 at most; item if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(kept == "", "item").otherwise(F.substring(kept, 1, 80))


def anchors(html: Column) -> Column:
    """array<struct<url, title>> of a page's links with an address, tags inside the link taken out."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[^>]*>.*?</a>"), 0)
    href = lambda a: F.regexp_extract(a, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1)
    said = lambda a: compact(F.regexp_replace(a, r"(?s)<[^>]*>", " "))
    return F.filter(F.transform(whole, lambda a: F.struct(href(a).alias("url"), said(a).alias("title"))), lambda x: x.url != "")


def sitemap_months(urls: DataFrame) -> DataFrame:
    """Sitemap addresses with a path /sitemap/YYYY/MM, with their month."""
    path = r"^https?://[^/]+/sitemap/(20[0-9]{2})/(0[1-9]|1[0-2])/?$"
    month = F.try_to_timestamp(F.concat_ws("-", F.regexp_extract("url", path, 1), F.regexp_extract("url", path, 2)), F.lit("yyyy-MM")).cast("date")
    return urls.withColumn("month", month).where("month IS NOT NULL")


def scan_months(months: DataFrame, found: DataFrame, wanted: int) -> DataFrame:
    """Months (symbol, month) read newest first until ``wanted`` quarters are covered; found: symbol, month, quarter (a label)."""
    first = found.groupBy("symbol", "quarter").agg(F.max("month").alias("month")).groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("new"))
    m = months.join(first, ["symbol", "month"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    before = F.coalesce(F.sum("new").over(Window.partitionBy("symbol").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.withColumn("covered", before).where(F.col("covered") < wanted)


def in_targets(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates (symbol, year, quarter) of the quarters wanted."""
    return candidates.join(targets.select("symbol", "year", "quarter"), ["symbol", "year", "quarter"], "left_semi")


def near_matches(titled: DataFrame, matched: DataFrame, keys: list[str], most: int = 25) -> DataFrame:
    """Transcript-like candidates that were not matched, the first ``most`` of each key."""
    rest = titled.join(matched.select(*keys, "url"), [*keys, "url"], "left_anti")
    return rest.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("n") <= most)


def first_per_url(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first candidate (ord) of each URL; empty URLs go."""
    w = Window.partitionBy(*keys, "url").orderBy("ord")
    return candidates.where("url != ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def select_links(found: DataFrame, pool: DataFrame, keys: list[str], n: int, least: float = 8.0) -> DataFrame:
    """Per key the first n found links; keys without any take the pool's first n of enough quality (unknown counts as enough)."""
    a = first_per_url(found, keys).withColumn("origin", F.lit("found"))
    b = first_per_url(pool.where(F.coalesce(F.col("quality") >= least, F.lit(True))), keys).withColumn("origin", F.lit("pool"))
    both = a.unionByName(b.join(a.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ord")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sitemap_urls(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def quarter_in(text: Column) -> Column:
    """struct<year, quarter> named in a title or slug (Q3 2024, q3-2024, 2024 Q3), nulls if none."""
    pattern = r"(?i)q([1-4])[\s\-]*(?:fy)?(20[0-9]{2})"
    swapped = r"(?i)(20[0-9]{2})[\s\-]*q([1-4])"
    as_int = lambda c: F.expr("cast(null as int)") if c is None else F.when(c != "", c).cast("int")
    q, y = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    q2, y2 = F.regexp_extract(text, swapped, 2), F.regexp_extract(text, swapped, 1)
    return F.struct(F.coalesce(as_int(y), as_int(y2)).alias("year"), F.coalesce(as_int(q), as_int(q2)).alias("quarter"))

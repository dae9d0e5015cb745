"""Queries on reports: their tables, nested reports, stored reports, scores computed again, and sections as text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as T
from .operators import feeds, metrics, people, quarters, segments, transcripts, views
from .plans import report
from .queries import (
    ALL_SIGNALS, BLOCK, CAND, CL, LABEL, LINEAR, METRIC, QKEY, all_signals, candidates, corpus_metrics, merged_quarters, query, shaped, sql_density, sql_overall,
)
from .queries_calls import _TIERS, URLED, urled
from .sources import domain, reports
from .sources.store import base_path, store

COVER = """last AS (SELECT symbol, max(year * 4 + quarter - 1) AS last FROM best GROUP BY symbol), need AS (SELECT symbol, unnest(range(last - 3, last + 1)) AS q FROM last),
cover AS (SELECT w.symbol, count(url) AS found, count(*) AS wanted, string_agg('Q' || (q % 4 + 1) || ' ' || q // 4, ',' ORDER BY 'Q' || (q % 4 + 1) || ' ' || q // 4) FILTER (url IS NOT NULL) AS labels
  FROM need w LEFT JOIN best b ON b.symbol = w.symbol AND b.year = q // 4 AND b.quarter = q % 4 + 1 GROUP BY w.symbol)"""
_PCT = "CASE WHEN {0} IS NULL THEN 'n/a' ELSE printf('%+.1f%%', {0} * 100) END"


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = transcripts.quarter_coverage(candidates(spark, sf_dir))
    labels = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == "found", F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"))))), ",")
    return transcripts.availability(c).join(c.groupBy("symbol").agg(labels.alias("labels")), "symbol")


SPEAKERS = f"""sp AS (SELECT 'SYM' || doc_id % 5 AS symbol, speaker, count(*) AS n, avg(direction) AS direction FROM metric WHERE speaker_role <> 'operator' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, speaker) AS rank FROM sp)"""


@query(f"""WITH {ALL_SIGNALS}, {SPEAKERS}, {CAND}, {COVER}, oo AS (SELECT *, {sql_overall(S.WEIGHTS)} AS s FROM allsig),
  nn AS (SELECT symbol, count(*) AS n FROM news GROUP BY symbol), pp AS (SELECT symbol, count(*) AS n FROM post GROUP BY symbol)
  SELECT symbol, 'overview' AS tab, 0 AS place, unnest(['Overall score', 'Label', 'News', 'Social']) AS label, unnest([printf('%.2f', s), array_to_string(list_transform(string_split({LABEL}, '_'), lambda x: upper(x[1]) || x[2:]), ' '), {_PCT.format("news")}, {_PCT.format("social")}]) AS value FROM oo
  UNION ALL SELECT symbol, 'transcript', 0, unnest(['coverage', 'availability']), unnest([found || '/' || wanted, CASE WHEN found = 0 THEN 'missing' WHEN found < wanted THEN 'partial' ELSE 'available' END]) FROM cover
  UNION ALL SELECT symbol, 'speakers', rank, unnest(['speaker', 'mentions']), unnest([speaker, CAST(n AS VARCHAR)]) FROM top WHERE rank <= 30
  UNION ALL SELECT symbol, 'market_reaction', 0, unnest(['news', 'social']), unnest([CAST(nn.n AS VARCHAR), CAST(coalesce(pp.n, 0) AS VARCHAR)]) FROM nn LEFT JOIN pp USING (symbol)
  UNION ALL SELECT symbol, 'fundamentals', 0, unnest(['signal', 'revenue growth']), unnest([{_PCT.format("fundamentals")}, {_PCT.format("revenue_growth / 100")}]) FROM oo
  UNION ALL SELECT symbol, 'data_audit', 0, unnest(['found', 'missing']), unnest([CAST(found AS VARCHAR), CAST(wanted - found AS VARCHAR)]) FROM cover""")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tabs of a report as rows of text."""
    scores = report.company_scores(all_signals(spark, sf_dir))
    m = corpus_metrics(spark, sf_dir).withColumn("symbol", F.concat(F.lit("SYM"), (F.col("doc_id") % domain.SYMBOLS).cast("string")))
    top = feeds.top(metrics.speaker_rollup(m, ("symbol", "speaker")), ["symbol"], [F.desc("mention_count"), F.col("speaker")], 30, "place")
    cover = coverage(spark, sf_dir)
    counts = domain.news(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).join(domain.posts(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("p")), "symbol", "left")
    text = lambda c: c.cast("string")
    c = F.col
    tabs = (
        ("overview", scores, {"Overall score": T.fixed(c("overall_score"), "%.2f"), "Label": F.initcap(F.replace(c("label"), F.lit("_"), F.lit(" "))), "News": report.percent_text(c("news")), "Social": report.percent_text(c("social"))}),
        ("transcript", cover, {"coverage": F.concat(text(c("found")), F.lit("/"), text(c("wanted"))), "availability": c("availability")}),
        ("speakers", top, {"speaker": c("speaker"), "mentions": text(c("mention_count"))}),
        ("market_reaction", counts, {"news": text(c("n")), "social": text(F.coalesce("p", F.lit(0)))}),
        ("fundamentals", scores, {"signal": report.percent_text(c("fundamentals")), "revenue growth": report.percent_text(c("revenue_growth") / 100)}),
        ("data_audit", cover, {"found": text(c("found")), "missing": text(c("wanted") - c("found"))}),
    )
    out = None
    for tab, rows, labels in tabs:
        part = report.tab_rows(tab, rows, labels)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {ALL_SIGNALS}, {SPEAKERS}, mq AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY year DESC, quarter DESC, revenue) AS r FROM (SELECT *, 'SYM' || length(symbol) % 5 AS sym FROM merged)),
  q AS (SELECT *, sents[pos] AS quote FROM (SELECT *, 'SYM' || doc_id % 5 AS symbol, unnest(range(1, least(len(sents), 2) + 1)) AS pos FROM metric)),
  k AS (SELECT *, {QKEY} AS key FROM q), f AS (SELECT *, row_number() OVER (PARTITION BY symbol, key ORDER BY doc_id, order_index, pos) AS first FROM k WHERE length(quote) >= 45 AND len(list_filter(string_split(key, ' '), lambda w: w <> '')) >= 6),
  s AS (SELECT *, abs(direction) * 34 + confidence * 0.28::DOUBLE + evasiveness * 0.24::DOUBLE + specificity * 0.2::DOUBLE + outlook * 0.18::DOUBLE + least(18.0, length(quote) / 8) AS score FROM f WHERE first = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, length(quote) DESC, doc_id, order_index, pos) AS rank FROM s),
  sa AS (SELECT symbol, string_agg(speaker || ':' || n, ',' ORDER BY rank) AS speakers FROM top WHERE rank <= 5 GROUP BY symbol), qa AS (SELECT sym AS symbol, string_agg(year || '-Q' || quarter, ',' ORDER BY r) AS quarters FROM mq WHERE r <= 4 GROUP BY sym),
  ba AS (SELECT symbol, string_agg(quote, '|' ORDER BY rank) AS quotes FROM b WHERE rank <= 10 GROUP BY symbol)
  SELECT symbol, round(s, 4) AS overall_score, label, CASE WHEN snap >= 0.12 THEN 'bullish' WHEN snap <= -0.12 THEN 'bearish' ELSE 'mixed' END AS stance, speakers, quarters, quotes FROM (
    SELECT *, {LABEL} AS label FROM (SELECT *, {sql_overall(S.WEIGHTS)} AS s, {CL.format('0.35::DOUBLE / 0.6 * coalesce(fundamentals, 0) + 0.15::DOUBLE / 0.6 * coalesce(news, 0) + 0.1::DOUBLE / 0.6 * coalesce(social, 0)')} AS snap FROM allsig))
  LEFT JOIN sa USING (symbol) LEFT JOIN qa USING (symbol) LEFT JOIN ba USING (symbol)""")
def snapshot_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested report per symbol, its lists joined to text here."""
    blocks = store(corpus_metrics(spark, sf_dir).select("doc_id", "order_index", "speaker", "speaker_role", "text", "topic", "direction", *metrics.METRIC_COLUMNS))
    merged = store(merged_quarters(spark, sf_dir))
    m = blocks.withColumn("symbol", F.concat(F.lit("SYM"), (F.col("doc_id") % domain.SYMBOLS).cast("string")))
    speakers = feeds.top(metrics.speaker_rollup(m, ("symbol", "speaker")), ["symbol"], [F.desc("mention_count"), F.col("speaker")], 5).select("symbol", "rank", "speaker", "mention_count")
    q = merged.withColumn("symbol", F.concat(F.lit("SYM"), (F.length("symbol") % domain.SYMBOLS).cast("string")))
    q = feeds.top(q.drop("rank"), ["symbol"], [F.desc("year"), F.desc("quarter"), F.col("revenue")], 4).select("symbol", "rank", "year", "quarter")
    quotes = metrics.key_quotes(m, ("symbol",)).select("symbol", "rank", "quote")
    scores = report.snapshot_scores(report.company_scores(all_signals(spark, sf_dir, blocks, merged))).select("symbol", "overall_score", "label", "stance")
    nested = report.company_reports(scores, speakers, q, quotes)
    joined = lambda c, f, by: F.array_join(F.transform(c, f), by).alias(c)
    text = lambda x: x.cast("string")
    return shaped(nested.select(
        "symbol", "overall_score", "label", "stance", joined("speakers", lambda x: F.concat(x["speaker"], F.lit(":"), text(x["mention_count"])), ","),
        joined("quarters", lambda x: quarters.quarter_label(x["year"], x["quarter"]), ","), joined("quotes", lambda x: x["quote"], "|"),
    ))


def stored_reports(spark: SparkSession, sf_dir: str) -> str:
    """Reports of all symbols in a store; returns its path."""
    scores = report.company_scores(all_signals(spark, sf_dir)).join(coverage(spark, sf_dir), "symbol", "left")
    rows = scores.select(
        T.ticker(F.col("symbol")).alias("ticker"), F.concat(F.lit("2024-01-3"), F.length("label") % 2, F.lit("T00:00:00Z")).alias("updated_at"), F.lit("1").alias("analysis_version"), F.create_map(F.lit("weight_news"), F.lit(15.0)).alias("runtime_overrides"),
        F.struct(F.split(F.coalesce("labels", F.lit("")), ",").alias("quarters"), F.round("overall_score", 4).alias("overall_score")).alias("result"),
    )
    path = f"{base_path(spark)}/reports-{uuid.uuid4().hex}"
    reports.write_reports(rows, path)
    return path


@query(f"""WITH {ALL_SIGNALS}, {CAND}, {COVER} SELECT symbol AS ticker, '2024-01-3' || length({LABEL}) % 2 || 'T00:00:00Z' AS updated_at, labels AS quarters, round(s, 4) AS overall_score FROM (SELECT *, {sql_overall(S.WEIGHTS)} AS s FROM allsig) LEFT JOIN cover USING (symbol)""")
def cache_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written to the store and scanned again."""
    return reports.summaries(reports.scan_reports(spark, stored_reports(spark, sf_dir))).withColumn("quarters", F.array_join("quarters", ","))


@query(f"""WITH {ALL_SIGNALS} SELECT 'left' AS asked, symbol AS ticker, round({sql_overall(S.WEIGHTS)}, 4) AS overall_score FROM allsig WHERE symbol <> 'SYM2' UNION ALL SELECT 'read', symbol, round({sql_overall(S.WEIGHTS)}, 4) FROM allsig WHERE symbol = 'SYM1'""")
def cache_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored report deleted (what is left), one read by its ticker, a deleted one asked for in vain."""
    path = stored_reports(spark, sf_dir)
    if reports.delete_report(spark, path, "zzz"):
        raise ValueError("deleted what isn't there")
    reports.delete_report(spark, path, " sym2 ")
    one = reports.point_read(spark, path, " sym1 ").unionByName(reports.point_read(spark, path, "SYM2")).select(F.lit("read").alias("asked"), "ticker", "result.overall_score")
    return reports.scan_reports(spark, path).select(F.lit("left").alias("asked"), "ticker", "result.overall_score").unionByName(one)


GIVEN = {"weight_transcript": 10.0, "weight_fundamentals": -5.0, "weight_news": 500.0, "weight_social": 30.0}


@query(f"""WITH {ALL_SIGNALS}, {URLED.replace(BLOCK + ", ", "")}, tiers AS ({_TIERS.format(two="t2.r,", tier="WHEN t2.r IS NOT NULL THEN 2").replace(f"WITH {URLED}, k AS", "WITH k AS")}),
  rows AS (SELECT m.* EXCLUDE (speaker_role), t.hydrated_role = 'management' AS m FROM metric m JOIN tiers t USING (doc_id, order_index) WHERE confidence BETWEEN 0 AND 100 AND direction BETWEEN -1 AND 1),
  mm AS (SELECT doc_id, count(*) FILTER (m) AS n, coalesce(avg(direction) FILTER (m), 0.0) AS direction, coalesce(avg(confidence) FILTER (m), 45.0) AS confidence, coalesce(avg(evasiveness) FILTER (m), 40.0) AS evasiveness, coalesce(avg(outlook) FILTER (m), 45.0) AS outlook,
    coalesce(avg(specificity) FILTER (m), 50.0) AS specificity, coalesce(avg(risk) FILTER (m), 50.0) AS risk FROM rows GROUP BY doc_id),
  cc AS (SELECT 'SYM' || doc_id % 5 AS symbol, avg(CASE WHEN n = 0 THEN 0.0 ELSE 2 * (1.0::DOUBLE / (1.0 + exp(-greatest(-35.0, least(35.0, {LINEAR}))))) - 1 END) AS transcript2 FROM mm GROUP BY ALL),
  oo AS (SELECT symbol, {sql_overall({"transcript": 10.0, "fundamentals": 0.0, "news": 100.0, "social": 30.0}).replace("coalesce(transcript, 0)", "coalesce(transcript2, 0)")} AS s FROM allsig LEFT JOIN cc USING (symbol))
  SELECT symbol, round(s, 4) AS overall_score, {LABEL} AS label FROM oo""")
def recompute_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report scored again: roles filled in four tiers, rows out of range dropped, means, component and score with overridden weights."""
    known = urled(spark, sf_dir)
    m = corpus_metrics(spark, sf_dir).drop("speaker_role").join(known.select("doc_id", "order_index", "url", "speaker_role"), ["doc_id", "order_index"])
    kept = store(views.role_tiers(m, known).withColumn("speaker_role", F.col("hydrated_role")))
    valid = kept.where("confidence BETWEEN 0 AND 100 AND direction BETWEEN -1 AND 1")
    part = report.transcript_component(metrics.management_means(valid, outlook_default=45.0))
    part = part.groupBy(F.concat(F.lit("SYM"), (F.col("doc_id") % domain.SYMBOLS).cast("string")).alias("symbol")).agg(F.avg("component").alias("transcript"))
    signals = all_signals(spark, sf_dir).drop("transcript").join(part, "symbol", "left")
    weights = {k.removeprefix("weight_"): v for k, v in report.overrides(GIVEN).items()}
    return shaped(report.company_scores(signals, weights), "symbol", "overall_score", "label")


@query(f"""WITH {ALL_SIGNALS}, w AS (SELECT *, 0.4::DOUBLE * coalesce(transcript, 0) + 0.35::DOUBLE * coalesce(fundamentals, 0) + 0.15::DOUBLE * coalesce(news, 0) + 0.1::DOUBLE * coalesce(social, 0) AS c FROM allsig),
  n AS (SELECT symbol, count(*) AS items FROM news GROUP BY symbol), p AS (SELECT symbol, count(*) AS items FROM post GROUP BY symbol)
  SELECT symbol, round(c, 4) AS composite, round(greatest(0.0, least(100.0, 50 + c * 35)), 4) AS buy, round(greatest(0.0, least(100.0, 50 - c * 35)), 4) AS sell, round(greatest(0.0, least(100.0, abs(c) * 100)), 4) AS conviction,
  least(100.0, 30 + 4 * coalesce(n.items, 0))::DOUBLE AS news_confidence, least(100.0, 30 + 4 * coalesce(p.items, 0))::DOUBLE AS social_confidence, 90.0::DOUBLE AS fundamentals_confidence FROM w LEFT JOIN n USING (symbol) LEFT JOIN p USING (symbol)""")
def legacy_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = all_signals(spark, sf_dir)
    count = lambda df, name: df.groupBy("symbol").agg(F.count(F.lit(1)).alias(name))
    s = s.join(count(domain.news(spark, sf_dir), "n"), "symbol", "left").join(count(domain.posts(spark, sf_dir), "p"), "symbol", "left")
    parts = S.composite({k: F.col(k) for k in S.WEIGHTS}, S.WEIGHTS)
    return shaped(s.select("symbol", *[c.alias(k) for k, c in parts.items()], S.feed_confidence("news", F.col("n")).alias("news_confidence"), S.feed_confidence("social", F.col("p")).alias("social_confidence"), S.feed_confidence("fundamentals", F.lit(4)).alias("fundamentals_confidence")))


_DIR = "greatest(-1.0, least(1.0, ({} - {}) * 2))".format(*(sql_density(domain.CORPUS_LEXICON[k], r"regexp_replace(lower(piece), '([^\p{L}\p{N}_])', '\1\1', 'g')") for k in ("forward", "hedge")))


@query(f"""WITH {METRIC}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY order_index, pos) - 1 AS i, s[pos] AS piece FROM (SELECT doc_id, order_index, sents AS s, unnest(range(1, len(sents) + 1)) AS pos FROM metric)),
  v AS (SELECT doc_id, i, {_DIR} AS v, least(2.5, sqrt(greatest(1.0, length(piece) / 100.0))) AS w FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v, i) AS up, count(*) OVER (PARTITION BY doc_id) AS n FROM v),
  k AS (SELECT *, CASE WHEN n >= 8 THEN greatest(1, floor(n * 0.1)) ELSE 0 END AS cut FROM r)
  SELECT doc_id, any_value(n) AS n, count(*) AS n_kept, round(sum(v * w) / sum(w), 4) AS mean, arg_max(i, (v, -i)) AS best, arg_min(i, (v, i)) AS worst FROM k WHERE up > cut AND up <= n - cut GROUP BY doc_id""")
def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trimmed weighted mean of a call's sentences."""
    m = corpus_metrics(spark, sf_dir).select("doc_id", "order_index", F.posexplode(T.sentences(F.col("text"))).alias("pos", "piece"))
    lex = domain.CORPUS_LEXICON
    rows = m.withColumn("v", segments.lexical_direction("piece", lex["forward"], lex["hedge"])).withColumn("w", segments.weight(F.col("piece")))
    rows = rows.selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY order_index, pos) - 1 AS i", "v", "w")
    return shaped(segments.trimmed_mean(rows, ["doc_id"], "v", "i", "w"))


@query(f"""WITH RECURSIVE {BLOCK}, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY order_index) AS i, speaker || ': ' || trim(text) AS line FROM block WHERE trim(coalesce(text, '')) <> ''),
  walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chars, CAST(0 AS BIGINT) AS chunk, CAST(NULL AS VARCHAR) AS line FROM (SELECT DISTINCT doc_id FROM l)
    UNION ALL SELECT l.doc_id, l.i, CASE WHEN w.i > 0 AND w.chars + length(l.line) + 2 > 400 THEN length(l.line) ELSE w.chars + length(l.line) + 2 END, CASE WHEN w.i > 0 AND w.chars + length(l.line) + 2 > 400 THEN w.chunk + 1 ELSE w.chunk END, l.line
    FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
  SELECT doc_id, chunk, string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM walk WHERE i > 0 GROUP BY doc_id, chunk""")
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole blocks packed into chunks; the chunks are small here, as calls are."""
    return shaped(transcripts.packed_blocks(domain.blocks(spark, sf_dir), 400, 100), "doc_id", "chunk", "text")


@query(f"""WITH {BLOCK}, r AS (SELECT doc_id, order_index AS ord, CASE WHEN order_index % 3 = 0 THEN NULL ELSE 7 - order_index END AS place, CASE WHEN order_index % 4 = 1 THEN 'unknown' ELSE speaker END AS speaker,
  CASE WHEN order_index % 2 = 0 THEN speaker_role END AS role, CASE WHEN section_type = 'qa' THEN 'qa' ELSE 'other' END AS section_type, trim(text) AS text FROM block WHERE trim(coalesce(text, '')) <> '')
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(place, ord), ord) - 1 AS order_index, speaker, role, section_type, text FROM r""")
def normalised_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as a model may give them, brought to one form."""
    b, i = domain.blocks(spark, sf_dir), F.col("order_index")
    raw = b.select(
        "doc_id", i.alias("ord"), F.when(i % 3 != 0, F.lit(7) - i).alias("order_index"), F.when(i % 4 == 1, " ").otherwise(F.col("speaker")).alias("speaker"), F.when(i % 2 == 0, F.upper("speaker_role")).otherwise("boss").alias("role"),
        F.when(F.col("section_type") == "qa", "QA ").otherwise("intro").alias("section_type"), "text",
    )
    return shaped(transcripts.normalised_sections(raw), "doc_id", "order_index", "speaker", "role", "section_type", "text")


@query(f"""WITH {BLOCK} SELECT doc_id, string_agg(speaker || ': ' || trim(text), chr(10) ORDER BY order_index) AS text, 'Low-confidence section parse (single_unknown_section).|Section parse method: regex' AS warnings FROM block WHERE trim(coalesce(text, '')) <> '' GROUP BY doc_id""")
def sections_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections back to lines, with what a reader is warned of."""
    t = transcripts.sections_text(domain.blocks(spark, sf_dir))
    none = F.lit(None).cast("string")
    w = transcripts.section_warnings(t.withColumns({"low": F.lit(True), "low_reason": F.lit("single_unknown_section"), "error": none, "method": F.lit(" regex"), "reason": F.lit("")}))
    return w.select("doc_id", "text", F.array_join("warnings", "|").alias("warnings"))


@query(f"""WITH {BLOCK}, b AS (SELECT doc_id, 0 AS src, order_index AS ord, upper(speaker) AS name, '' AS role FROM block WHERE order_index % 2 = 1 UNION ALL SELECT doc_id, 1, order_index, speaker, CASE WHEN order_index >= 2 THEN speaker_role ELSE '' END FROM block)
  SELECT doc_id, lower(name) AS key, arg_min(name, (src, ord)) AS name, coalesce(arg_min(role, (src, ord)) FILTER (role <> ''), '') AS role FROM b GROUP BY doc_id, lower(name)""")
def participants_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed people, then who spoke: the first name and the first role that is one."""
    b = domain.blocks(spark, sf_dir)
    listed = b.where("order_index % 2 = 1").select("doc_id", F.col("order_index").alias("ord"), F.upper("speaker").alias("name"), F.lit("").alias("role"))
    spoke = b.select("doc_id", F.col("order_index").alias("ord"), F.col("speaker").alias("name"), F.when(F.col("order_index") >= 2, F.col("speaker_role")).otherwise("").alias("role"))
    return people.upsert_participants(listed, spoke)


@query("""SELECT * FROM (VALUES (' aapl ', 'AAPL', TRUE), ('brk.b', 'BRK.B', TRUE), ('a$b-c', 'AB-C', TRUE), ('$$', '', FALSE)) t(text, ticker, valid)
  UNION ALL SELECT text, ticker, ticker <> '' FROM (SELECT text, regexp_replace(upper(text), '[^A-Z0-9.-]', '', 'g') AS ticker FROM (SELECT ' $' || CASE WHEN c_custkey % 9 <> 0 THEN lower(c_name) || '.' || left(c_mktsegment, 2) ELSE '' END || ' ' AS text FROM customer))""")
def ticker_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.ticker(F.col("text"))
    said = F.concat(F.lit(" $"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lower("c_name"), F.lit("."), F.substring("c_mktsegment", 1, 2))).otherwise(""), F.lit(" "))
    rows = spark.createDataFrame([(" aapl ",), ("brk.b",), ("a$b-c",), ("$$",)], "text string").unionByName(domain.read(spark, sf_dir, "customer").select(said.alias("text")))
    return rows.select("text", t.alias("ticker"), (t != "").alias("valid"))


@query("""SELECT * FROM (VALUES (NULL, 'n/a', 'n/a', 'neutral', 'n/a'), ('strong_buy', '1.50x', '1.5K', 'bullish', 'Strong Buy'), ('hold', '-0.25x', '-3.2M', 'neutral', 'Hold'), ('underperform', '12.00x', '4.8B', 'bearish', 'Underperform'), ('none_given', '0.00x', '17', 'muted', 'None Given')) t(key, ratio, compact, tone, shown)
  UNION ALL SELECT key, printf('%.2fx', b), CASE WHEN abs(n) >= 1e9 THEN printf('%.1fB', n / 1e9) WHEN abs(n) >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN abs(n) >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE printf('%.0f', n) END,
  ['muted', 'bullish', 'bearish', 'neutral', 'neutral', 'bullish'][k + 1], CASE k WHEN 0 THEN upper(key[1]) || lower(key[2:]) WHEN 1 THEN 'Outperform' WHEN 2 THEN 'Strong Sell' WHEN 3 THEN 'n/a' WHEN 4 THEN 'Neutral' ELSE 'Buy' END
  FROM (SELECT c_custkey % 6 AS k, [c_mktsegment, 'OUTPERFORM', 'strong_sell', '', ' neutral ', 'Buy'][c_custkey % 6 + 1] AS key, c_acctbal AS b, c_acctbal * 1000 * (CASE WHEN c_custkey % 4 = 0 THEN 1000 ELSE 1 END) + 7.3::DOUBLE AS n FROM customer)""")
def report_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and recommendations as a report shows them."""
    rows = spark.createDataFrame([(None, None, None), ("strong_buy", 1.5, 1500.0), ("hold", -0.25, -3.2e6), ("underperform", 12.0, 4.8e9), ("none_given", 0.0, 17.0)], "key string, r double, n double")
    i, b = F.col("c_custkey"), F.col("c_acctbal")
    key = F.get(F.array(F.col("c_mktsegment"), *[F.lit(x) for x in ("OUTPERFORM", "strong_sell", "", " neutral ", "Buy")]), (i % 6).cast("int"))
    rows = rows.unionByName(domain.read(spark, sf_dir, "customer").select(key.alias("key"), b.alias("r"), (b * 1000 * F.when(i % 4 == 0, 1000).otherwise(1) + 7.3).alias("n")))
    return rows.select("key", report.ratio_text(F.col("r")).alias("ratio"), report.compact_text(F.col("n")).alias("compact"), views.analyst_tone(F.col("key")).alias("tone"), views.shown_recommendation(F.col("key")).alias("shown"))


"""Queries on sources, candidates, audits, people and pages; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as T
from .operators import audit, candidates, metrics, neardup, pages, people, transcripts
from .plans import report
from .queries import BLOCK, LINES, MEANS, METRIC, ROLES, corpus_metrics, corpus_posts, query, shaped
from .sources import domain

TICKER, COMPANY = "fr", "Tionsh Example Inc"

CANDS = r"""c AS (SELECT page_id AS ord, url, CASE WHEN page_id % 3 = 0 THEN 'Q' || (page_id % 4 + 1) || ' 202' || (page_id % 5) || ' (FR) Earnings Call Transcript' WHEN page_id % 3 = 1 THEN 'Tionsh results fr earnings transcript' ELSE 'Other news' END AS title,
  ['sitemap_month:2024-01', 'author_page:2', 'openai_web', 'listing'][page_id % 4 + 1] AS source FROM pages),
k AS (SELECT *, regexp_matches(upper(title), '(?:^|[^\p{L}\p{N}_])FR(?:$|[^\p{L}\p{N}_])') AS word, contains(upper(title), '(FR)') AS bracket, contains(lower(url), '-fr-') AS hyphen,
  regexp_matches(lower(title), '(?:^|[^\p{L}\p{N}_])tionsh(?:$|[^\p{L}\p{N}_])') OR regexp_matches(lower(url), '(^|[-/])tionsh($|[-/.])')
  OR regexp_matches(lower(title), '(?:^|[^\p{L}\p{N}_])example(?:$|[^\p{L}\p{N}_])') OR regexp_matches(lower(url), '(^|[-/])example($|[-/.])') AS company FROM c)"""
URL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(trim(url), '^http://', 'https://'), '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/]+).*$', '\1')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^http://', 'https://'), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]+', '') || '/', '/{2,}', '/', 'g')"""
QUALITY = """CASE WHEN bracket THEN 8.0 ELSE 0.0 END + CASE WHEN word THEN 4.0 ELSE 0.0 END + CASE WHEN hyphen THEN 4.0 ELSE 0.0 END
  + CASE WHEN contains(lower(title), 'earnings call transcript') THEN 2.0 WHEN contains(lower(title), 'earnings transcript') THEN 1.0 ELSE 0.0 END
  + CASE WHEN company AND NOT (word OR hyphen) THEN 6.0 ELSE 0.0 END
  + CASE WHEN starts_with(source, 'sitemap_month:') THEN 20.0 WHEN starts_with(source, 'author_page:') THEN 14.0 WHEN starts_with(source, 'openai_') THEN 4.0 ELSE 0.0 END"""


def corpus_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    title = (
        F.when(i % 3 == 0, F.concat(F.lit("Q"), (i % 4 + 1).cast("string"), F.lit(" 202"), (i % 5).cast("string"), F.lit(" (FR) Earnings Call Transcript")))
        .when(i % 3 == 1, "Tionsh results fr earnings transcript").otherwise("Other news")
    )
    source = F.element_at(F.array(*[F.lit(x) for x in ("sitemap_month:2024-01", "author_page:2", "openai_web", "listing")]), (i % 4 + 1).cast("int"))
    return domain.read(spark, sf_dir, "pages").select(i.alias("ord"), "url", title.alias("title"), source.alias("source"))


@query(rf"""WITH {CANDS} SELECT ord, {URL_SQL} AS clean, CAST({QUALITY} AS DOUBLE) AS quality,
  CAST(CASE WHEN bracket THEN 100.0 ELSE 0.0 END + CASE WHEN word THEN 60.0 ELSE 0.0 END + least(CASE WHEN contains(lower(title), 'tionsh') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'example') THEN 1 ELSE 0 END, 3) * 6.0
  + CASE WHEN contains(lower(title), 'earnings call transcript') THEN 12.0 WHEN contains(lower(title), 'earnings transcript') THEN 8.0 ELSE 0.0 END AS DOUBLE) AS score,
  CASE WHEN ord % 3 = 0 THEN CASE WHEN ord % 5 < 10 THEN CAST('202' || (ord % 5) AS BIGINT) END END AS year, CASE WHEN ord % 3 = 0 THEN CAST(ord % 4 + 1 AS BIGINT) END AS quarter FROM k WHERE word OR hyphen OR company""")
def candidate_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.company_tokens(COMPANY)
    c = candidates.relevant(corpus_candidates(spark, sf_dir), TICKER, tokens)
    t, u = F.col("title"), F.col("url")
    c = c.withColumn("clean", candidates.clean_url(u, "example.com")).withColumn("quality", candidates.quality(t, u, TICKER, tokens, F.col("source"))).withColumn("score", candidates.match_score(t, u, TICKER, COMPANY))
    return shaped(c.withColumn("yq", candidates.quarter_in(t)).select("ord", "clean", "quality", "score", "yq.year", "yq.quarter"))


@query(rf"""WITH {CANDS}, u AS (SELECT 'g' || ord % 7 AS g, ord, {URL_SQL} AS url, CAST({QUALITY} AS DOUBLE) AS quality FROM k),
  a AS (SELECT *, row_number() OVER (PARTITION BY g, url ORDER BY ord) AS n, 'found' AS origin FROM u WHERE ord % 7 < 4 AND ord % 2 = 0), f AS (SELECT * FROM a WHERE n = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY g, url ORDER BY ord) AS n, 'pool' AS origin FROM u WHERE quality >= 8), p AS (SELECT * FROM b WHERE n = 1 AND g NOT IN (SELECT g FROM f)),
  both_ AS (SELECT * FROM f UNION ALL SELECT * FROM p) SELECT g, ord, url, origin, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord) AS rank FROM both_) WHERE rank <= 4""")
def link_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus_candidates(spark, sf_dir)
    c = c.withColumn("quality", candidates.quality(F.col("title"), F.col("url"), TICKER, T.company_tokens(COMPANY), F.col("source"))).withColumn("g", F.concat(F.lit("g"), (F.col("ord") % 7).cast("string")))
    c = c.select("g", "ord", candidates.clean_url(F.col("url"), "example.com").alias("url"), "quality")
    return shaped(candidates.select_links(c.where("ord % 7 < 4 AND ord % 2 = 0"), c, ["g"], 4), "g", "ord", "url", "origin", "rank")


SEED_MESSAGES = (
    "Section parse method: regex", " used json-ld fallback extraction ", "No Reddit posts found for X", "OpenAI normalization failed: timeout", "Fundamentals validation: ok", "something else", "something else", "", "x regex_from_page_text",
    "No Yahoo Finance news items returned for X",
)
MESSAGES = ", ".join(f"({k}, '{m}')" for k, m in enumerate(SEED_MESSAGES))


@query(f"""WITH s AS (SELECT unnest([1, 2]) AS run_id), t AS (SELECT CAST(ord AS BIGINT) AS ord, message FROM (VALUES {MESSAGES}) t(ord, message)),
  m AS (SELECT run_id, ord, trim(message) AS message FROM s, t UNION ALL SELECT 10 + user_id % 9, event_id, trim(event_type || ' ' || message) FROM events JOIN t ON ord = event_id % 10 WHERE event_id % 10 <> 8 UNION ALL SELECT 10 + user_id % 9, event_id, '' FROM events WHERE event_id % 10 = 8),
  f AS (SELECT 1 AS run_id, TRUE AS read, TRUE AS found UNION ALL SELECT 2, FALSE, FALSE UNION ALL SELECT 10 + user_id % 9, count(*) FILTER (event_type = 'error') >= 3, count(*) FILTER (event_type = 'signup') >= 3 FROM events GROUP BY ALL),
  v AS (SELECT m.* FROM m JOIN f USING (run_id) WHERE message <> '' AND NOT (read AND contains(lower(message), 'openai normalization failed:') OR found AND contains(lower(message), 'no yahoo finance news items returned'))),
  k AS (SELECT *, CASE WHEN regexp_matches(lower(message), '\\bsection parse (method|reason):') OR contains(lower(message), 'regex_from_page_text') THEN 'diagnostic'
    WHEN contains(lower(message), 'fundamentals validation:') OR contains(lower(message), 'no yahoo finance news items returned') OR contains(lower(message), 'no reddit posts found') OR contains(lower(message), 'used json-ld fallback extraction') THEN 'notice' ELSE 'warning' END AS kind FROM v)
  SELECT CAST(run_id AS BIGINT) AS run_id, kind, message, CAST(min(ord) AS BIGINT) AS ord FROM k GROUP BY ALL""")
def audit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the events' runs by kind, those that came to nothing left out: a run has documents and items if its events are many enough. Runs 1 and 2 are a seed."""
    m = spark.sql(f"SELECT run_id, ord, message FROM VALUES (1), (2) AS s(run_id), LATERAL (SELECT * FROM VALUES {MESSAGES} AS t(ord, message))")
    facts = spark.sql("SELECT * FROM VALUES (1, 3, 5), (2, 0, 0) AS t(run_id, documents, items)")
    e = domain.read(spark, sf_dir, "events").withColumn("run_id", F.col("user_id") % 9 + 10)
    k = F.col("event_id") % len(SEED_MESSAGES)
    said = F.when(k == 8, " ").otherwise(F.concat_ws(" ", "event_type", F.get(F.array(*[F.lit(t) for t in SEED_MESSAGES]), k.cast("int"))))
    many = lambda kind: F.greatest(F.count_if(F.col("event_type") == kind) - 2, F.lit(0))
    m = m.unionByName(e.select("run_id", F.col("event_id").alias("ord"), said.alias("message")))
    facts = facts.unionByName(e.groupBy("run_id").agg(many("error").alias("documents"), many("signup").alias("items")))
    return shaped(audit.classify_messages(audit.suppress(m, facts, ["run_id"]), ["run_id"]))


@query("""WITH t AS (SELECT user_id % 9 AS run_id, event_type AS name, CAST(round(sum(value)) AS BIGINT) AS duration_ms, CASE WHEN count(*) % 4 = 0 THEN 'error' ELSE 'done' END AS status, count(*) AS n FROM events GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms DESC, name) AS rank FROM t)
  SELECT run_id, count(*) AS tasks, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) FILTER (status = 'error') AS failed, string_agg(CASE WHEN rank <= 4 THEN name END, ',' ORDER BY rank) AS slowest,
  round(sum(n * (CASE WHEN status = 'done' THEN 1.0 ELSE 0.5 END)::DOUBLE) / sum(n) * 100, 4) AS percent FROM r GROUP BY run_id""")
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 9).alias("run_id"), F.col("event_type").alias("name"))
    # a cast in SQL engines rounds or truncates: rounded first
    t = e.agg(F.round(F.sum("value")).cast("bigint").alias("duration_ms"), F.when(F.count(F.lit(1)) % 4 == 0, "error").otherwise("done").alias("status"), F.count(F.lit(1)).alias("weight"))
    t = t.withColumn("part", F.when(F.col("status") == "done", 1.0).otherwise(0.5))
    return shaped(audit.task_totals(t, ["run_id"]).join(audit.progress(t, ["run_id"]), "run_id"))


PLAUSIBLE = r"""CASE WHEN speaker = '' THEN FALSE WHEN lower(speaker) IN ('operator', 'analyst', 'management', 'unknown', 'unidentified speaker', 'unidentified analyst', 'participant') THEN TRUE
  WHEN lower(speaker) IN ('greetings', 'hello', 'hi', 'thanks', 'thank you', 'good afternoon', 'good morning', 'duration', 'prepared', 'prepared remarks', 'other', 'questions and answers', 'q&a', 'call participants') OR regexp_matches(speaker, '[0-9]')
  OR length(speaker) > 80 OR contains(speaker, ':') THEN FALSE ELSE regexp_matches(speaker, '^[A-Z][A-Za-z.''\-]+(?: [A-Z][A-Za-z.''\-]+){0,5}$') END"""


@query(f"""WITH {ROLES}, b AS (SELECT t.*, r.role FROM typed t JOIN resolved r USING (doc_id, speaker)), q AS (SELECT doc_id, count(*) AS sections, count(*) FILTER (lower(speaker) IN ('', 'unknown')) AS unknown,
  count(*) FILTER (NOT {PLAUSIBLE}) AS implausible, count(*) FILTER (contains(text, 'self.__next_f.push') OR contains(text, '\\u003c')) AS script,
  avg(CASE WHEN section_type = 'other' THEN 1.0 ELSE 0.0 END) AS other_share, avg(CASE WHEN role = 'unknown' THEN 1.0 ELSE 0.0 END) AS no_role_share FROM b GROUP BY doc_id),
  d AS (SELECT DISTINCT doc_id FROM line), f AS (SELECT doc_id, 0.5 + abs(doc_id) % 5 * 0.1::DOUBLE AS confidence, abs(doc_id) % 7 = 0 AS sparse FROM d),
  j AS (SELECT doc_id, confidence, sparse, coalesce(sections, 0) AS sections, coalesce(unknown, 0) AS unknown, coalesce(implausible, 0) AS implausible, coalesce(script, 0) AS script, coalesce(other_share, 0) AS other_share, coalesce(no_role_share, 0) AS no_role_share FROM f LEFT JOIN q USING (doc_id))
  SELECT doc_id, sections, unknown, implausible, round(other_share, 4) AS other_share, round(no_role_share, 4) AS no_role_share,
  CASE WHEN sections = 0 THEN 'no_sections' WHEN script > 0 THEN 'script_wrapped_text' WHEN sections = 1 AND unknown = 1 THEN 'single_unknown_section' WHEN unknown = sections THEN 'all_unknown_speakers' WHEN implausible / sections > 0.25 THEN 'implausible_speaker_labels' END AS reason,
  CASE WHEN sections = 0 THEN 'no_sections' WHEN sections < 2 THEN 'too_few_sections' WHEN unknown = sections THEN 'all_unknown_speakers' WHEN unknown / sections > 0.9 THEN 'mostly_unknown_speakers' WHEN implausible / sections > 0.25 THEN 'implausible_speaker_labels' END AS structured_reason,
  sections <= 2 OR confidence < 0.55 OR sparse OR unknown / sections >= 0.35 OR no_role_share >= 0.5 OR other_share >= 0.75 AS normalise_again FROM j""")
def transcript_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = domain.transcript_lines(spark, sf_dir)
    b = transcripts.enriched(transcripts.speaker_blocks(lines)).withColumn("speaker_role", F.when(F.col("role") != "unknown", F.col("role")))
    d = F.abs("doc_id")
    facts = lines.select("doc_id").distinct().withColumns({"confidence": d % 5 * 0.1 + 0.5, "warnings": F.when(d % 7 == 0, F.array(F.lit("Sparse text"))).otherwise(F.array().cast("array<string>"))})
    return shaped(audit.parse_quality(b, facts), "doc_id", "sections", "unknown", "implausible", "other_share", "no_role_share", "reason", "structured_reason", "normalise_again")


@query("""SELECT o_orderkey, printf('%.2f', o_totalprice) AS amount, printf('%+.1f%%', greatest(-1.0, least(1.0, (o_totalprice - 200000) / 400000)) * 100) AS signed_pct,
  CASE WHEN (o_totalprice * 1000 + 123.4567) >= 1e9 THEN printf('%.2fB', (o_totalprice * 1000 + 123.4567) / 1e9) WHEN (o_totalprice * 1000 + 123.4567) >= 1e6 THEN printf('%.2fM', (o_totalprice * 1000 + 123.4567) / 1e6) ELSE printf('%.2f', o_totalprice * 1000 + 123.4567) END AS money,
  year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS shown FROM orders""")
def number_and_label_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.read(spark, sf_dir, "orders")
    p, y, q = F.col("o_totalprice"), F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    return o.select(
        "o_orderkey", T.fixed(p, "%.2f").alias("amount"), report.percent_text(S.clamp((p - 200000) / 400000, -1, 1)).alias("signed_pct"), report.money_text(p * 1000 + 123.4567).alias("money"),
        F.concat(y, F.lit("-Q"), q).alias("label"), F.concat(F.lit("Q"), q, F.lit(" "), y).alias("shown"),
    )


@query(rf"""WITH {LINES} SELECT doc_id, line_no, regexp_extract(line, '^([A-Za-z][A-Za-z .,''&()\-/]{{1,80}}):', 1) AS speaker, trim(regexp_replace(line, '^[A-Za-z][A-Za-z .,''&()\-/]{{1,80}}:\s*', '')) AS spoken FROM line
  WHERE regexp_matches(line, '^[A-Za-z][A-Za-z .,''&()\-/]{{1,80}}:\s*.{{2,}}$')""")
def speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = domain.transcript_lines(spark, sf_dir).withColumn("s", T.speaker_line(F.col("line"))).where("s IS NOT NULL")  # noqa: E741
    return shaped(l.select("doc_id", "line_no", "s.speaker", "s.spoken"))


WHO = r"CASE WHEN regexp_matches(line, '^[a-z]+: .{2,}') THEN regexp_extract(line, '^([^:]+):', 1) END"


@query(f"""WITH {LINES}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, line FROM line), w AS (SELECT *, {WHO} AS who FROM n)
  SELECT doc_id, (SELECT min(a.line_no) FROM w a WHERE a.doc_id = d.doc_id AND a.who IS NOT NULL AND (SELECT count(DISTINCT b.who) FROM w b WHERE b.doc_id = a.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + 25) >= 2) AS start
  FROM (SELECT DISTINCT doc_id FROM n) d""")
def speaker_start_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = domain.transcript_lines(spark, sf_dir).selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no", "trim(line) AS line")  # noqa: E741
    return shaped(pages.speaker_start(l, r"^[a-z]+: .{2,}", ["doc_id"]))


@query(f"""WITH {METRIC}, {MEANS}, r AS (SELECT doc_id, order_index, direction, evasiveness, sents[1] AS said FROM metric WHERE speaker_role = 'management' AND len(sents) > 0),
  pick AS (SELECT doc_id, array_to_string(list(said ORDER BY order_index) FILTER (direction >= 0.12)[1:4], '|') AS bullish, array_to_string(list(said ORDER BY order_index) FILTER (direction <= -0.12)[1:4], '|') AS bearish,
    array_to_string(list(said ORDER BY order_index) FILTER (evasiveness >= 55)[1:4], '|') AS evasive FROM r GROUP BY doc_id)
  SELECT m.doc_id, round(m.direction, 4) AS direction, CASE WHEN m.direction >= 0.12 THEN 'bullish' WHEN m.direction <= -0.12 THEN 'bearish' ELSE 'mixed' END AS label, round(m.confidence, 4) AS confidence,
  coalesce(bullish, '') AS bullish, coalesce(bearish, '') AS bearish, coalesce(evasive, '') AS evasive FROM means m LEFT JOIN pick USING (doc_id)""")
def legacy_transcript_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpus_metrics(spark, sf_dir)
    rows = metrics.management_only(m).withColumn("said", F.get(T.sentences(F.col("text")), F.lit(0)))
    first = lambda c: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(c, F.struct("order_index", "said")))), 1, 4), lambda x: x["said"]), "|")
    picks = rows.groupBy("doc_id").agg(first(F.col("direction") >= 0.12).alias("bullish"), first(F.col("direction") <= -0.12).alias("bearish"), first(F.col("evasiveness") >= 55).alias("evasive"))
    out = metrics.management_means(m).join(picks, "doc_id", "left").withColumn("label", S.stance(F.col("direction")))
    return shaped(out.fillna("", ["bullish", "bearish", "evasive"]), "doc_id", "direction", "label", "confidence", "bullish", "bearish", "evasive")


@query()
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(pages.page_lines(domain.read(spark, sf_dir, "pages")))


CALL_PAGE = (
    "<html><nav><li>Home</li></nav><article><h2>Call Participants</h2><p>Jane Roe -- Chief Executive Officer</p><p>Max Lee -- Analyst</p><h2>Prepared Remarks</h2><p>Operator: Welcome to the call.</p><p>Jane Roe: We grew &amp; hired.</p>"
    "<p>More to come.</p><h2>Questions and Answers</h2><p>Operator: The first question comes from Max Lee.</p><p>Max Lee: Could you comment on margins?</p><p>Jane Roe: They rose.</p><p>Stocks Mentioned</p><p>Max Lee: not said.</p></article></html>"
)


def pages_and_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.read(spark, sf_dir, "pages").select("page_id", "html")
    return p.unionByName(spark.createDataFrame([(-1, CALL_PAGE)], p.schema))


@query()
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page that are most like a transcript."""
    return shaped(pages.best_source(pages.page_lines(pages_and_seed(spark, sf_dir))))


@query("""SELECT * FROM (VALUES (-1, 0, 'Operator', 'operator', 'prepared_remarks', 'Welcome to the call.'), (-1, 1, 'Jane Roe', 'management', 'prepared_remarks', 'We grew & hired. More to come.'), (-1, 2, 'Operator', 'operator', 'qa', 'The first question comes from Max Lee.'),
  (-1, 3, 'Max Lee', 'analyst', 'qa', 'Could you comment on margins?'), (-1, 4, 'Jane Roe', 'management', 'qa', 'They rose.')) t(doc_id, order_index, speaker, role, section, text)""")
def page_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the transcripts on all pages; in these tables only the seed is one."""
    return shaped(pages.page_transcripts(pages_and_seed(spark, sf_dir))[0], "doc_id", "order_index", "speaker", "role", "section", "text")


@query("SELECT -1 AS doc_id, 0.86::DOUBLE AS confidence, 'marker' AS reason, 5 AS sections, 3 AS speakers, 2 AS participants UNION ALL SELECT page_id, 0.32::DOUBLE, 'not_found', 0, 0, 0 FROM pages")
def page_parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page's transcript is to be trusted."""
    return shaped(pages.page_transcripts(pages_and_seed(spark, sf_dir))[1], "doc_id", "confidence", "reason", "sections", "speakers", "participants")


@query()
def social_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = corpus_posts(spark, sf_dir).select("symbol", "provider", "ord", "title", "url", "score")
    return shaped(neardup.distinct_posts(posts, ["symbol"]))


FIRST, LAST = ("Ann", "Bob", "Carol", "Dan"), ("Lee", "Smith", "Jones")


SQL_NAMES = """named AS (SELECT doc_id, i, i % 3 + 1 AS priority, order_index AS ord, trim(CASE WHEN i % 4 = 0 THEN 'Dr. ' ELSE '' END || ['Ann', 'Bob', 'Carol', 'Dan'][i % 4 + 1] || CASE WHEN i % 3 = 0 THEN ' Q.' ELSE '' END || ' ' || ['Lee', 'Smith', 'Jones'][i % 3 + 1]
  || CASE WHEN i % 5 = 0 THEN ' CFA' ELSE '' END) AS name, lower(['Ann', 'Bob', 'Carol', 'Dan'][i % 4 + 1]) || ' ' || lower(['Lee', 'Smith', 'Jones'][i % 3 + 1]) AS who, 2 + CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS parts
  FROM (SELECT *, doc_id + order_index AS i FROM block))"""


@query(f"""WITH {BLOCK}, {SQL_NAMES}, best AS (SELECT doc_id, who, arg_max(name, (priority, parts, length(name), -ord)) AS canonical FROM named GROUP BY ALL)
  SELECT DISTINCT doc_id, alias, canonical FROM (SELECT doc_id, who, who AS alias FROM named UNION SELECT doc_id, who, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) FROM named) JOIN best USING (doc_id, who)""")
def speaker_canonicalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented names with variants, by conversation: there a person is told by first and last name."""
    b = domain.blocks(spark, sf_dir)
    i = F.col("doc_id") + F.col("order_index")
    name = F.concat_ws(
        " ", F.when(i % 4 == 0, "Dr."), F.element_at(F.array(*[F.lit(x) for x in FIRST]), (i % 4 + 1).cast("int")), F.when(i % 3 == 0, "Q."),
        F.element_at(F.array(*[F.lit(x) for x in LAST]), (i % 3 + 1).cast("int")), F.when(i % 5 == 0, "CFA"),
    )
    return people.canonical_names(b.select("doc_id", (i % 3 + 1).alias("priority"), F.col("order_index").alias("ord"), name.alias("name")))


@query(f"""WITH {BLOCK}, p AS (SELECT doc_id, lower(trim(speaker)) AS key, speaker AS name, speaker_role AS role FROM block UNION ALL SELECT doc_id, lower(trim(speaker)), upper(speaker), speaker_role || ' of the call' FROM block WHERE order_index % 2 = 0)
  SELECT doc_id, key, min(name) AS name, arg_max(role, length(role)) AS role FROM p GROUP BY doc_id, key""")
def participants_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = domain.blocks(spark, sf_dir)
    a = b.select("doc_id", F.col("speaker").alias("name"), F.col("speaker_role").alias("role"))
    other = b.where("order_index % 2 = 0").select("doc_id", F.upper("speaker").alias("name"), F.concat("speaker_role", F.lit(" of the call")).alias("role"))
    return people.merge_participants(a, other)


@query("SELECT page_id, 'https://x.org/p/' || page_id || '?a=1&b=2' AS url FROM pages")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<urlset><url><loc> https://x.org/p/"), "page_id", F.lit("?a=1&amp;b=2</loc></url></urlset>"))
    return domain.read(spark, sf_dir, "pages").select("page_id", F.explode(candidates.sitemap_urls(xml)).alias("url"))


SLICED = f"""{LINES}, pl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, CASE WHEN doc_id % 4 = 3 AND regexp_matches(line, '^(Prepared|Questions)') THEN 'x' WHEN doc_id % 5 = 1 AND line_no % 1000000 = 3 THEN 'Stocks Mentioned here' ELSE line END AS line FROM line),
st AS (SELECT doc_id, min(CASE WHEN regexp_matches(lower(line), '^(prepared remarks|questions and answers|call participants)') THEN line_no END) AS h, min(CASE WHEN regexp_matches(line, '^[A-Za-z][A-Za-z .,''&()\\-/]{{1,80}}:\\s*.{{2,}}$') THEN line_no END) AS s, max(line_no) AS last FROM pl GROUP BY doc_id)"""


@query(f"""WITH {SLICED} SELECT doc_id, coalesce(h, s) AS start, CASE WHEN coalesce(h, s) IS NOT NULL THEN coalesce((SELECT min(line_no) FROM pl WHERE pl.doc_id = st.doc_id AND pl.line_no > coalesce(h, s) AND contains(lower(line), 'stocks mentioned')), last + 1) END AS stop,
  CASE WHEN h IS NOT NULL THEN 'marker' WHEN s IS NOT NULL THEN 'speaker' ELSE 'not_found' END AS reason FROM st""")
def transcript_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = domain.transcript_lines(spark, sf_dir)  # noqa: E741
    line = F.when((F.col("doc_id") % 4 == 3) & F.col("line").rlike("^(Prepared|Questions)"), "x").when((F.col("doc_id") % 5 == 1) & (F.col("line_no") % 1_000_000 == 3), "Stocks Mentioned here").otherwise(F.trim("line"))
    l = l.withColumn("line", line).selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no", "line")  # noqa: E741
    return shaped(transcripts.transcript_slice(l, ["doc_id"]))


@query(f"WITH {ROLES} SELECT doc_id, CAST(order_index AS BIGINT) AS order_index, speaker, section_type, role FROM typed JOIN resolved USING (doc_id, speaker)")
def speaker_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.enriched(transcripts.speaker_blocks(domain.transcript_lines(spark, sf_dir))), "doc_id", "order_index", "speaker", "section_type", "role")


QK = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH {METRIC}, q AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN 'not said by anyone at all' ELSE sents[1] END AS quote FROM metric WHERE len(sents) > 0),
  h AS (SELECT q.doc_id, q.quote, b.speaker, row_number() OVER (PARTITION BY q.doc_id, q.quote ORDER BY {QK.format("b.text")} <> {QK.format("q.quote")}, b.order_index) AS n FROM q JOIN metric b ON b.doc_id = q.doc_id
    AND (contains({QK.format("b.text")}, {QK.format("q.quote")}) OR (length({QK.format("b.text")}) >= 24 AND contains({QK.format("q.quote")}, {QK.format("b.text")}))))
  SELECT q.doc_id, q.quote, coalesce(h.speaker, 'Management') AS speaker FROM q LEFT JOIN h ON h.doc_id = q.doc_id AND h.quote = q.quote AND h.n = 1""")
def quote_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpus_metrics(spark, sf_dir)
    first = F.get(T.sentences(F.col("text")), F.lit(0))
    q = m.where(first.isNotNull()).select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, "not said by anyone at all").otherwise(first).alias("quote")
    )
    return transcripts.attribute_quotes(q.distinct(), m).select("doc_id", "quote", "speaker")


AI = {"forward": 3, "risk": 5, "hedge": 7, "specificity": 11}
TOWARDS = {"forward": "forward", "forward_counter": "risk", "risk": "risk", "hedge": "hedge", "specificity": "specificity", "confidence": "specificity", "confidence_counter": "hedge", "specificity_counter": "hedge", "directness": "specificity"}


@query(f"WITH {METRIC}, w AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 0.3::DOUBLE * (order_index % 5) / 4.0::DOUBLE ELSE 0 END AS w FROM metric) SELECT doc_id, order_index, " + ", ".join(f"round(CASE WHEN doc_id % 3 <> 0 THEN d_{k} * (1 - w) + ((doc_id * {AI[m]} % 10) / 10.0::DOUBLE) * w ELSE d_{k} END, 4) AS d_{k}" for k, m in TOWARDS.items()) + " FROM w")
def block_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities moved towards a feature model's, where it has a row."""
    m = corpus_metrics(spark, sf_dir)
    ai = m.where("doc_id % 3 != 0").select("doc_id", "order_index", (F.col("order_index") % 5 / 4.0).alias("sure"), *[(F.col("doc_id") * k % 10 / 10.0).alias(f"ai_{n}") for n, k in AI.items()])
    rows = m.join(ai, ["doc_id", "order_index"], "left")
    out = S.blended({n: F.col(f"d_{n}") for n in domain.CORPUS_LEXICON}, {n: F.col(f"ai_{n}") for n in AI}, F.col("sure"), 0.3)
    return shaped(rows.select("doc_id", "order_index", *[c.alias(f"d_{n}") for n, c in out.items()]))

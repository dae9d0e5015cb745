"""The library's queries over the provided tables, each with the DuckDB SQL that checks it.

Doubles are rounded to four places and whole numbers are bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as T
from .functions.lexicons import METRICS, TOPICS
from .functions.times import months
from .operators import feeds, fundamentals, metrics, segments, transcripts
from .operators.scorers import lexical_scorer, score_text
from .plans import report
from .sources import domain
from .sources.store import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def shaped(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all if none are named), whole numbers as bigint, doubles rounded."""
    out = df.select(*columns) if columns else df
    kinds = dict(out.dtypes)
    as_long = ("int", "smallint", "tinyint")
    return out.select(*[F.col(c).cast("bigint").alias(c) if kinds[c] in as_long else F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


# --- the same tables in SQL -----------------------------------------------------------------------

BLOCK = """block AS (SELECT conv_id AS doc_id, turn AS order_index,
  CASE role WHEN 'system' THEN 'Operator' WHEN 'user' THEN 'Analyst ' || conv_id % 7 ELSE 'Exec ' || conv_id % 11 END AS speaker,
  CASE role WHEN 'system' THEN 'operator' WHEN 'user' THEN 'analyst' ELSE 'management' END AS speaker_role,
  CASE WHEN turn < 2 THEN 'prepared_remarks' ELSE 'qa' END AS section_type, text FROM conversations)"""
NEWS = """news AS (SELECT 'SYM' || d.doc_id % 5 AS symbol, d.source AS provider, d.doc_id AS ord, substr(d.text, 1, 80) AS title, substr(d.text, 81) AS summary,
  'doc://' || (d.doc_id - d.doc_id % 2) AS url, e.ts AS published_ts FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""
POST = """post AS (SELECT 'SYM' || c.conv_id % 5 AS symbol, ['reddit', 'stocktwits', 'forum'][c.turn % 3 + 1] AS provider, c.conv_id * 1000 + c.turn AS ord,
  substr(c.text, 1, 96) AS title, c.text AS body, 'post://' || c.conv_id || '/' || c.turn AS url, e.ts AS created_ts
  FROM conversations c LEFT JOIN events e ON e.event_id = c.conv_id WHERE c.role = 'user')"""
FUND = """o AS (SELECT o_orderkey, o_totalprice, c_mktsegment AS symbol, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter
  FROM orders JOIN customer ON o_custkey = c_custkey),
fa AS (SELECT symbol, year, quarter, sum(o_totalprice) AS revenue, sum(o_totalprice) * 0.1::DOUBLE AS net_income,
  CASE WHEN (year + quarter) % 3 <> 0 THEN avg(o_totalprice) / 1000 END AS reported_eps, avg(o_totalprice) / 1000 * 0.97::DOUBLE AS eps_estimate FROM o GROUP BY symbol, year, quarter),
fb AS (SELECT symbol, year, quarter, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_extendedprice * (1 - l_discount)) / 250 AS reported_eps
  FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY symbol, year, quarter)"""
SEEDED = BLOCK + ", seeded AS (SELECT * FROM block UNION ALL SELECT -1, k, 'Seed ' || (k % 3), ['management', 'analyst'][k % 2 + 1], 'qa', t FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(domain.SEED_BLOCKS)) + ") v(k, t))"
MERGED = """merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year DESC, quarter DESC) AS rank FROM (
  SELECT symbol, year, quarter, fa.revenue, fa.net_income, coalesce(fa.reported_eps, fb.reported_eps) AS reported_eps, fa.eps_estimate
  FROM fa FULL OUTER JOIN fb USING (symbol, year, quarter))) WHERE rank <= 4)"""


def sql_phrase(term: str) -> str:
    """RE2 has no look-around: characters that are no letters are doubled in text and term instead."""
    out = "".join(c if c.isalnum() or c == "_" else ("\\" + c if c != " " else c) * 2 for c in term.lower()).replace("'", "''")
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){out}(?:$|[^\p{{L}}\p{{N}}_])"


def sql_hits(term: str, text: str = "dbl") -> str:
    return f"least(len(regexp_extract_all({text}, '{sql_phrase(term)}')), 3)"


def sql_density(terms: dict[str, float], text: str = "dbl") -> str:
    total = sum(float(w) for w in terms.values()) * S.MAX_HITS
    return "greatest(0.0, least(1.0, (" + " + ".join(f"{float(w)!r}::DOUBLE * {sql_hits(t, text)}" for t, w in terms.items()) + f") / {total!r}::DOUBLE))"


DOUBLED = r"regexp_replace(lower(text), '([^\p{L}\p{N}_])', '\1\1', 'g')"
COMPACT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SENTENCES = rf"list_filter(string_split(regexp_replace({COMPACT}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')"
WORDS = r"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'))"
SCORABLE = rf"({COMPACT} <> '' AND NOT ({WORDS.format(t=COMPACT)} < 7 AND contains(lower({COMPACT}), 'operator')))"


def sql_topic(topics: dict[str, dict[str, float]]) -> str:
    """Columns topic and topic_density from a row with dbl."""
    best = f"greatest({', '.join(sql_density(t) for t in topics.values())})"
    pick = " ".join(f"WHEN {sql_density(t)} = best THEN '{name}'" for name, t in topics.items())
    return f"SELECT *, CASE WHEN best < 0.03 THEN 'general' {pick} END AS topic FROM (SELECT *, {best} AS best FROM base)"


def sql_metrics(lexicons: dict[str, dict[str, float]], topics: dict[str, dict[str, float]], counter_weight: float = 0.65, smoothing: float = 0.35) -> str:
    cl = lambda x, a, b: f"greatest({a}::DOUBLE, least({b}::DOUBLE, {x}))"
    net = lambda p, c, w: cl(f"({p}) - {w!r}::DOUBLE * ({c})", 0, 1)
    pct = lambda x: cl(f"(0.5::DOUBLE + 0.5::DOUBLE * tanh({x} * {1.9 + smoothing * 2.6!r}::DOUBLE)) * 100", 0, 100)
    return f"""{BLOCK},
base AS (SELECT *, {DOUBLED} AS dbl, {SENTENCES} AS sents FROM block WHERE {SCORABLE}),
topical AS ({sql_topic(topics)}),
dens AS (SELECT *, {", ".join(f"{sql_density(t)} AS d_{n}" for n, t in lexicons.items())},
  CASE WHEN len(sents) > 0 THEN len(list_filter(sents, lambda s: regexp_matches(s, '[0-9]')))::DOUBLE / len(sents) ELSE 0.0 END AS numeric_density FROM topical),
mixed AS (SELECT *, {cl("numeric_density * 0.65::DOUBLE + d_specificity * 0.35::DOUBLE", 0, 1)} AS n FROM dens),
parts AS (SELECT *, {pct(net("d_forward", "d_forward_counter", counter_weight))} AS c_out,
  {pct(net("d_confidence + d_specificity * 0.25::DOUBLE + d_forward * 0.15::DOUBLE", "d_confidence_counter + d_hedge * 0.35::DOUBLE + d_risk * 0.2::DOUBLE", counter_weight))} AS c_conf,
  {pct(net("d_specificity + n * 0.25::DOUBLE", "d_specificity_counter", counter_weight))} AS c_spec,
  {pct(net("d_hedge + d_risk * 0.25::DOUBLE", "d_directness + d_specificity * 0.15::DOUBLE", counter_weight))} AS c_evas,
  {pct(net("d_risk", "d_directness * 0.3::DOUBLE", max(0.25, counter_weight * 0.45)))} AS c_risk FROM mixed),
metric AS (SELECT doc_id, order_index, speaker, speaker_role, section_type, text, sents, topic, best AS topic_density, numeric_density,
  {", ".join(f"d_{n}" for n in lexicons)},
  {cl("14.0::DOUBLE + c_conf * 0.68::DOUBLE + c_spec * 0.14::DOUBLE + n * 14 - c_evas * 0.10::DOUBLE", 0, 100)} AS confidence,
  {cl("10.0::DOUBLE + c_evas * 0.72::DOUBLE + (1 - n) * 14 + c_risk * 0.08::DOUBLE - c_spec * 0.10::DOUBLE", 0, 100)} AS evasiveness,
  {cl("14.0::DOUBLE + c_spec * 0.72::DOUBLE + n * 18 - c_evas * 0.12::DOUBLE", 0, 100)} AS specificity,
  {cl("12.0::DOUBLE + c_out * 0.78::DOUBLE - c_evas * 0.10::DOUBLE", 0, 100)} AS outlook,
  {cl("10.0::DOUBLE + c_risk * 0.80::DOUBLE + c_evas * 0.08::DOUBLE", 0, 100)} AS risk,
  {cl("(d_confidence + d_forward - d_hedge - d_risk) * 2", -1, 1)} AS direction FROM parts)"""


METRIC = sql_metrics(domain.CORPUS_LEXICON, domain.CORPUS_TOPICS)
FIVE = ", ".join(f"round({c}, 4) AS {c}" for c in metrics.METRIC_COLUMNS)


def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.block_metrics(domain.blocks(spark, sf_dir), domain.CORPUS_LEXICON, domain.CORPUS_TOPICS)


# --- text -----------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, {COMPACT} AS compact,
  regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g') AS title_key,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS quote_key, len({SENTENCES}) AS n_sentences,
  CASE WHEN length({SENTENCES}[1]) BETWEEN 1 AND 160 THEN {SENTENCES}[1] WHEN length({COMPACT}) <= 160 THEN {COMPACT} ELSE rtrim(substr({COMPACT}, 1, 159)) || '…' END AS excerpt,
  CASE WHEN length({COMPACT}) <= 700 THEN {COMPACT} ELSE rtrim(substr({COMPACT}, 1, 525)) || ' ... ' || ltrim(right({COMPACT}, 170)) END AS shortened
  FROM documents""")
def text_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return shaped(
        domain.read(spark, sf_dir, "documents").select(
            "doc_id", T.compact(t).alias("compact"), T.title_key(t).alias("title_key"), T.quote_key(t).alias("quote_key"), F.size(T.sentences(t)).alias("n_sentences"),
            T.excerpt(t).alias("excerpt"), T.head_and_tail(t).alias("shortened"),
        )
    )


@query(f"WITH {SEEDED}, b AS (SELECT doc_id, order_index, {SENTENCES} AS s FROM seeded) SELECT doc_id, order_index, round(CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: regexp_matches(x, '[0-9]')))::DOUBLE / len(s) ELSE 0.0 END, 4) AS numeric_density FROM b")
def block_numeric_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(domain.seeded_blocks(spark, sf_dir).select("doc_id", "order_index", S.numeric_density(F.col("text")).alias("numeric_density")))


@query(f"WITH {SEEDED}, b AS (SELECT doc_id, order_index, {DOUBLED} AS dbl FROM seeded) SELECT doc_id, order_index, " + ", ".join(f"round({sql_density(t)}, 4) AS d_{n}" for n, t in METRICS.items()) + " FROM b")
def block_lexicon_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default lexicons."""
    counted = domain.seeded_blocks(spark, sf_dir).select("doc_id", "order_index", S.term_counts("text", *METRICS.values()).alias("hits"))
    return shaped(counted.select("doc_id", "order_index", *[S.counted_density("hits", t).alias(f"d_{n}") for n, t in METRICS.items()]))


@query(f"WITH {SEEDED}, base AS (SELECT doc_id, order_index, {DOUBLED} AS dbl FROM seeded) SELECT doc_id, order_index, topic, round(best, 4) AS density FROM ({sql_topic(TOPICS)})")
def block_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default topics."""
    return shaped(domain.seeded_blocks(spark, sf_dir).withColumn("hits", S.term_counts("text", *TOPICS.values())).withColumn("t", S.counted_topic("hits", TOPICS)).select("doc_id", "order_index", "t.topic", "t.density"))


#: The default lexicons, which the seed meets, and the corpus's.
BOTH = METRICS | {f"corpus_{name}": terms for name, terms in domain.CORPUS_LEXICON.items()}


def sql_matched(terms: dict[str, float]) -> str:
    held = ", ".join(f"CASE WHEN {sql_hits(t)} > 0 THEN '{t.replace(chr(39), chr(39) * 2)}' END" for t in terms)
    return f"array_to_string(list_filter([{held}], lambda x: x IS NOT NULL)[1:8], '|')"


@query(f"WITH {SEEDED}, b AS (SELECT doc_id, order_index, {DOUBLED} AS dbl FROM seeded WHERE {SCORABLE}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, order_index, '{n}' AS lexicon, {sql_matched(t)} AS terms FROM b" for n, t in BOTH.items()) + ") WHERE terms <> ''")
def block_matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each lexicon that a block holds."""
    m = metrics.matched_terms(domain.seeded_blocks(spark, sf_dir), BOTH)
    return shaped(m.select("doc_id", "order_index", "lexicon", F.array_join("terms", "|").alias("terms")))


# --- blocks ---------------------------------------------------------------------------------------


@query(f"WITH {METRIC} SELECT doc_id, order_index, topic, round(topic_density, 4) AS topic_density, round(direction, 4) AS direction, {FIVE} FROM metric")
def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(corpus_metrics(spark, sf_dir), "doc_id", "order_index", "topic", "topic_density", "direction", *metrics.METRIC_COLUMNS)


@query(f"""WITH {METRIC}, t AS (SELECT speaker, topic, count(*) AS n FROM metric WHERE speaker_role <> 'operator' GROUP BY ALL)
  SELECT m.speaker, count(*) AS mention_count, round(avg(direction), 4) AS avg_direction, round(avg(confidence), 4) AS avg_confidence, round(avg(evasiveness), 4) AS avg_evasiveness,
  (SELECT topic FROM t WHERE t.speaker = m.speaker ORDER BY n DESC, topic LIMIT 1) AS dominant_topic FROM metric m WHERE speaker_role <> 'operator' GROUP BY m.speaker""")
def speaker_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(metrics.speaker_rollup(corpus_metrics(spark, sf_dir)))


@query(f"WITH {BLOCK} SELECT doc_id, count(*) FILTER (section_type = 'prepared_remarks') AS prepared, count(*) FILTER (section_type = 'qa') AS qa FROM block GROUP BY doc_id")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(metrics.section_counts(domain.blocks(spark, sf_dir)))


MEANS = """means AS (SELECT doc_id, count(*) FILTER (m) AS n, coalesce(avg(direction) FILTER (m), 0.0) AS direction, coalesce(avg(confidence) FILTER (m), 45.0) AS confidence,
  coalesce(avg(evasiveness) FILTER (m), 40.0) AS evasiveness, coalesce(avg(outlook) FILTER (m), 50.0) AS outlook, coalesce(avg(specificity) FILTER (m), 50.0) AS specificity,
  coalesce(avg(risk) FILTER (m), 50.0) AS risk FROM (SELECT *, speaker_role = 'management' AS m FROM metric) GROUP BY doc_id)"""


@query(f"WITH {METRIC}, {MEANS} SELECT doc_id, n, round(direction, 4) AS direction, {FIVE} FROM means")
def management_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(metrics.management_means(corpus_metrics(spark, sf_dir)))


GUARD = rf"""CASE WHEN c = '' THEN 'missing_text' WHEN length(c) < 24 THEN 'text_too_short' WHEN len(string_split(c, ' ')) < 6 THEN 'too_few_tokens'
  WHEN length(c) < 180 AND regexp_matches(c, '{S.ADMIN}') THEN 'short_admin_or_operator_like' END"""
BAND = "CASE " + " ".join(f"WHEN abs({v} - x) = near THEN '{b}'" for b, v in S.BANDS.items()) + " END"


@query(f"""WITH {METRIC}, p AS (SELECT doc_id, doc_id % 4 AS order_index, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS p_band, CASE WHEN quality = 1 THEN 70.0 ELSE 30.0 END::DOUBLE AS p_score,
  CASE WHEN toxic = 1 THEN 0.4 ELSE 0.8 END::DOUBLE AS p_conf FROM labels),
  r AS (SELECT doc_id, order_index, confidence, p_band, p_score, p_conf, {COMPACT} AS c FROM metric LEFT JOIN p USING (doc_id, order_index)),
  s AS (SELECT *, {GUARD} AS guard FROM r),
  u AS (SELECT *, CASE WHEN guard IS NOT NULL THEN 'guard_fallback' WHEN p_score IS NULL THEN 'missing_fallback' WHEN p_conf < 0.6 THEN 'blend' ELSE 'model' END AS source FROM s),
  v AS (SELECT *, CASE source WHEN 'model' THEN p_score WHEN 'blend' THEN p_score * 0.5 + confidence * 0.5 ELSE confidence END AS x FROM u),
  w AS (SELECT *, least({", ".join(f"abs({v} - x)" for v in S.BANDS.values())}) AS near FROM v)
  SELECT doc_id, order_index, guard, source, round(x, 4) AS value, CASE WHEN source = 'model' THEN p_band ELSE {BAND} END AS band FROM w""")
def metric_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.select_metric(corpus_metrics(spark, sf_dir), domain.predictions(spark, sf_dir))
    return shaped(rows, "doc_id", "order_index", "guard", "source", "value", "band")


@query(f"""WITH {METRIC} SELECT doc_id, rank, order_index, round(evasiveness, 4) AS evasiveness FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY evasiveness DESC, order_index) AS rank FROM metric WHERE speaker_role = 'management') WHERE rank <= 4""")
def pressure_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(metrics.pressure_points(corpus_metrics(spark, sf_dir)), "doc_id", "rank", "order_index", "evasiveness")


QKEY = r"trim(regexp_replace(regexp_replace(lower(quote), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH {METRIC}, q AS (SELECT *, sents[pos] AS quote FROM (SELECT *, unnest(range(1, least(len(sents), 2) + 1)) AS pos FROM metric)),
  k AS (SELECT *, {QKEY} AS key FROM q), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY order_index, pos) AS first FROM k
    WHERE length(quote) >= 45 AND len(list_filter(string_split(key, ' '), lambda w: w <> '')) >= 6),
  s AS (SELECT *, abs(direction) * 34 + confidence * 0.28::DOUBLE + evasiveness * 0.24::DOUBLE + specificity * 0.2::DOUBLE + outlook * 0.18::DOUBLE + least(18.0, length(quote) / 8) AS score FROM f WHERE first = 1)
  SELECT doc_id, quote, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(quote) DESC, order_index, pos) AS rank FROM s) WHERE rank <= 10""")
def key_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(metrics.key_quotes(corpus_metrics(spark, sf_dir)), "doc_id", "quote", "score")


# --- transcripts ----------------------------------------------------------------------------------


@query(f"WITH {BLOCK} SELECT speaker, count(*) FILTER (speaker_role = 'analyst') AS analyst_blocks, count(*) FILTER (speaker_role = 'management') AS management_blocks, CASE WHEN analyst_blocks > management_blocks THEN 'analyst' ELSE 'management' END AS dominant_role FROM block GROUP BY speaker")
def dominant_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.dominant_roles(domain.blocks(spark, sf_dir)))


@query(f"""WITH {BLOCK}, holed AS (SELECT * REPLACE (CASE WHEN (doc_id + order_index) % 3 <> 0 THEN speaker_role END AS speaker_role) FROM block),
  k AS (SELECT doc_id, lower(trim(speaker)) AS who, section_type, order_index, speaker_role FROM holed WHERE speaker_role IS NOT NULL),
  r2 AS (SELECT doc_id, who, section_type, arg_max(speaker_role, order_index) AS r FROM k GROUP BY ALL),
  r3 AS (SELECT doc_id, who, CASE WHEN count(*) FILTER (speaker_role = 'analyst') > count(*) FILTER (speaker_role = 'management') THEN 'analyst' ELSE 'management' END AS r
    FROM k GROUP BY ALL HAVING count(*) FILTER (speaker_role IN ('analyst', 'management')) > 0)
  SELECT h.doc_id, h.order_index, h.speaker_role, coalesce(h.speaker_role, r2.r, r3.r) AS hydrated_role FROM holed h
  LEFT JOIN r2 ON r2.doc_id = h.doc_id AND r2.who = lower(trim(h.speaker)) AND r2.section_type = h.section_type LEFT JOIN r3 ON r3.doc_id = h.doc_id AND r3.who = lower(trim(h.speaker))""")
def role_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = domain.blocks(spark, sf_dir)
    holed = b.withColumn("speaker_role", F.when((F.col("doc_id") + F.col("order_index")) % 3 != 0, F.col("speaker_role")))
    return shaped(transcripts.hydrate_roles(holed, holed), "doc_id", "order_index", "speaker_role", "hydrated_role")


CALLS = ", ".join("({}, {}, '{}')".format(-k, n, t.replace("'", "''")) for k, call in ((1, domain.SEED_CALL), (2, domain.SEED_BAD_CALL), (3, domain.SEED_PLAIN)) for n, t in enumerate(call))
LINES = """line AS (
  SELECT * FROM (VALUES """ + CALLS + """) seed(doc_id, line_no, line) UNION ALL
  SELECT conv_id AS doc_id, turn * 1000000 + part AS line_no, trim(l[part]) AS line FROM (SELECT conv_id, turn, string_split(role || ': ' || text, chr(10)) AS l,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS part FROM conversations)
  UNION ALL SELECT conv_id, turn * 1000000, CASE turn WHEN 0 THEN 'Prepared Remarks' ELSE 'Questions and Answers' END FROM conversations WHERE turn IN (0, 2)),
spoken AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS state FROM (
  SELECT *, CASE lower(line) WHEN 'prepared remarks' THEN 'prepared_remarks' WHEN 'questions and answers' THEN 'qa' WHEN 'closing remarks' THEN 'other' END AS h FROM line WHERE line <> '')),
numbered AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM (
  SELECT *, regexp_matches(line, '^[A-Za-z][A-Za-z .,''&()\\-/]{1,80}:\\s*.{2,}$') AS starts FROM spoken WHERE h IS NULL)),
tblock AS (SELECT doc_id, block - 1 AS order_index, arg_min(regexp_extract(line, '^([A-Za-z][A-Za-z .,''&()\\-/]{1,80}):', 1), line_no) AS speaker,
  coalesce(arg_min(state, line_no), 'prepared_remarks') AS base_section,
  trim(string_agg(CASE WHEN starts THEN trim(regexp_replace(line, '^[A-Za-z][A-Za-z .,''&()\\-/]{1,80}:\\s*', '')) ELSE line END, ' ' ORDER BY line_no)) AS text
  FROM numbered WHERE block > 0 GROUP BY doc_id, block)"""


@query(f"WITH {LINES} SELECT doc_id, CAST(order_index AS BIGINT) AS order_index, speaker, base_section, text FROM tblock")
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.speaker_blocks(domain.transcript_lines(spark, sf_dir)))


def sql_any(text: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(text, m.replace("'", "''")) for m in markers) + ")"


TRAILING = "coalesce(greatest(" + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN length(text) - (strpos(reverse(lower(text)), '{m[::-1]}') - 1) - {len(m)} END" for m in transcripts.QA_OPENERS) + rf""") >= floor(length(text) * 0.6)
  AND {WORDS.format(t="text")} >= 80 AND len(regexp_extract_all(text, '[.!?]')) >= 4, FALSE)"""
ASKS = f"(contains(text, '?') OR {sql_any('text', transcripts.QUESTIONS)})"
QA = f"""{LINES}, marked AS (SELECT *, base_section = 'qa' OR ({sql_any("text", transcripts.QA_OPENERS)} AND NOT {TRAILING}) AS opens, {ASKS} AS asks, {sql_any("text", transcripts.QA_OPENERS)} AS routes,
  {sql_any("text", transcripts.QA_CLOSERS)} AS closes FROM tblock),
start AS (SELECT doc_id, coalesce(min(order_index) FILTER (opens), min(order_index) FILTER (asks AND NOT regexp_matches(lower(speaker), 'operator|moderator|investor relations|ceo|cfo|chief|president'))) AS qa_start FROM marked GROUP BY doc_id),
bound AS (SELECT s.doc_id, s.qa_start, (SELECT min(order_index) FROM marked m WHERE m.doc_id = s.doc_id AND m.order_index >= s.qa_start AND m.closes) AS qa_end FROM start s),
typed AS (SELECT m.*, CASE WHEN qa_start IS NULL OR order_index < qa_start THEN CASE WHEN {sql_any("text", ("forward-looking statements", "safe harbor", "copyright", "transcript by"))} OR (qa_start IS NULL AND base_section = 'other') THEN 'other' ELSE 'prepared_remarks' END
  WHEN order_index > qa_end OR closes THEN 'other' ELSE 'qa' END AS section_type FROM marked m JOIN bound USING (doc_id))"""


@query(f"WITH {QA} SELECT doc_id, CAST(qa_start AS BIGINT) AS qa_start, CAST(qa_end AS BIGINT) AS qa_end FROM bound")
def qa_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.qa_bounds(transcripts.speaker_blocks(domain.transcript_lines(spark, sf_dir))))


STATS = f"""{QA}, prev AS (SELECT *, lag(section_type) OVER w AS ps, lag(asks) OVER w AS pa, lag(speaker) OVER w AS pp FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY order_index)),
stat AS (SELECT doc_id, speaker, count(*) FILTER (section_type = 'prepared_remarks') AS prepared, count(*) FILTER (section_type = 'qa') AS qa, count(*) FILTER (asks) AS questions, count(*) FILTER (routes) AS routing,
  count(*) FILTER (section_type = 'qa' AND NOT asks AND ps = 'qa' AND pa AND pp <> speaker) AS answers FROM prev GROUP BY doc_id, speaker)"""


@query(f"WITH {STATS} SELECT * FROM stat")
def speaker_role_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = transcripts.typed_sections(transcripts.speaker_blocks(domain.transcript_lines(spark, sf_dir)))
    return shaped(transcripts.speaker_stats(blocks))


NAMED = """CASE WHEN contains(lower(speaker), 'operator') OR contains(lower(speaker), 'moderator') THEN 'operator' WHEN contains(lower(speaker), 'investor relations') THEN 'host_ir' WHEN contains(lower(speaker), 'analyst') THEN 'analyst'
  WHEN contains(lower(speaker), 'ceo') OR contains(lower(speaker), 'cfo') OR contains(lower(speaker), 'chief') OR contains(lower(speaker), 'president') THEN 'management' ELSE '' END"""
ROLES = f"""{STATS}, hs AS (SELECT *, {NAMED} AS hint FROM stat),
pt AS (SELECT *, CASE WHEN hint = 'host_ir' THEN 5 ELSE 0 END + CASE WHEN routing > 0 AND NOT (hint = 'management' AND answers > 0) THEN 3.5 ELSE 0 END AS h,
  CASE WHEN hint = 'management' THEN 5 ELSE 0 END + CASE WHEN routing > 0 AND hint = 'management' AND answers > 0 THEN 1 ELSE 0 END + CASE WHEN answers > 0 THEN 2.5 ELSE 0 END + CASE WHEN prepared > 0 AND questions = 0 THEN 1.5 ELSE 0 END AS m,
  CASE WHEN hint = 'analyst' THEN 5 ELSE 0 END + CASE WHEN questions > 0 THEN 2.5 ELSE 0 END + CASE WHEN qa > 0 AND questions = qa THEN 1 ELSE 0 END AS a FROM hs),
resolved AS (SELECT doc_id, speaker, CASE WHEN hint = 'operator' THEN 'operator' WHEN greatest(h, m, a) < 2 THEN 'unknown' WHEN h >= m AND h >= a THEN 'host_ir' WHEN m >= a THEN 'management' ELSE 'analyst' END AS role FROM pt)"""


@query(f"WITH {ROLES} SELECT * FROM resolved")
def speaker_role_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names give hints in the seeds; other speakers here are called user, assistant and system."""
    blocks = transcripts.typed_sections(transcripts.speaker_blocks(domain.transcript_lines(spark, sf_dir)))
    return shaped(transcripts.resolve_roles(transcripts.speaker_stats(blocks)))


@query("""WITH l AS (SELECT doc_id, i - 1 AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  a AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p, line_no = 0 AS first FROM l)
  SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS n FROM a WHERE first OR line <> p) WHERE n = 1""")
def line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = domain.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return shaped(transcripts.without_repeats(lines))


# --- feeds ----------------------------------------------------------------------------------------

#: Words of the corpus in the place of finance words, and a name in that of a symbol's.
WORDS_FIN = ("the", "and", "est", "der", "que", "ing", "ion")
NAME = "that"


def corpus_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = domain.news(spark, sf_dir)
    rel = feeds.news_relevance(F.col("title"), F.col("summary"), NAME, finance=WORDS_FIN)
    n = n.withColumn("relevance", rel).withColumn("recency", S.recency(F.col("published_ts"), domain.as_of(), 30))
    return n.withColumn("rank_score", F.round(F.col("relevance") * 0.72 + F.col("recency") * 1.28, 4))


def sql_contains(text: str, words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words)


AS_OF = f"TIMESTAMP '{domain.AS_OF}'"
RECENCY = "CASE WHEN {at} IS NULL THEN 0.35 WHEN age >= 30 THEN 0.0 ELSE round(1 - age / 30, 4) END::DOUBLE"
AGE = "greatest(0.0, (epoch_us(" + AS_OF + ") - epoch_us({at})) / 86400e6)"
RANKED = f"""{NEWS}, nlow AS (SELECT *, lower(concat_ws(' ', title, summary)) AS t, {AGE.format(at="published_ts")} AS age FROM news),
nrel AS (SELECT *, CASE WHEN {sql_hits(NAME, DOUBLED.replace("lower(text)", "t"))} > 0 OR contains(t, '${NAME}') THEN 2.5 ELSE 0.0 END::DOUBLE + least({sql_contains("t", WORDS_FIN)}, 5) * 0.18::DOUBLE AS raw FROM nlow),
nscore AS (SELECT *, CASE WHEN raw < 0.9 THEN 0.0 ELSE round(raw, 4) END AS relevance, {RECENCY.format(at="published_ts")} AS recency FROM nrel),
nrank AS (SELECT *, round(relevance * 0.72::DOUBLE + recency * 1.28::DOUBLE, 4) AS rank_score FROM nscore)"""


@query(f"WITH {RANKED} SELECT ord, symbol, round(relevance, 4) AS relevance, round(recency, 4) AS recency, round(rank_score, 4) AS rank_score FROM nrank")
def news_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(corpus_news(spark, sf_dir), "ord", "symbol", "relevance", "recency", "rank_score")


def ladder_sql(rows: str, score: str, steps: list[tuple[float, int]]) -> str:
    tier = " ".join(f"WHEN count(*) FILTER ({score} >= {t}) OVER (PARTITION BY symbol) >= {n} THEN {t}" for t, n in steps)
    return f"SELECT * FROM (SELECT *, CASE {tier} ELSE -1e9 END AS least_score FROM {rows}) WHERE {score} >= least_score"


@query(f"""WITH {RANKED} SELECT symbol, rank, ord, rank_score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rank_score DESC, ord) AS rank
  FROM ({ladder_sql("nrank", "rank_score", feeds.news_steps(50))})) WHERE rank <= 50""")
def news_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.ladder(corpus_news(spark, sf_dir), ["symbol"], "rank_score", feeds.news_steps(50))
    return shaped(feeds.top(rows, ["symbol"], [F.desc("rank_score"), F.col("ord")], 50), "symbol", "rank", "ord", "rank_score")


@query(f"WITH {NEWS} SELECT ord, symbol, published_ts FROM news WHERE coalesce(published_ts >= {AS_OF} - INTERVAL 29 DAYS, TRUE)")
def feed_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.within_lookback(domain.news(spark, sf_dir), "published_ts", domain.as_of(), 29).select("ord", "symbol", "published_ts")


#: First-wins removal as a recursion over a symbol's rows; small enough for SQL on a seed only.
DEDUPE_SEED = (
    ("A", 1, "u1", "t1"), ("A", 2, "u2", "t1"), ("A", 3, "u2", "t2"), ("A", 4, None, "t2"), ("A", 5, None, "t3"), ("A", 6, "u9", None), ("A", 7, "u9", None), ("B", 1, "u1", "t1"), ("B", 2, None, None), ("B", 3, None, None),
    *(("C", k, f"c{k // 2}", f"d{(k + 1) // 2}") for k in range(1, 400)),
)
TITLE_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower({}), '^\s+|\s+$', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')"


def first_wins(rows: str, order: str = "ord", name: str = "") -> str:
    """SQL for the rows (symbol, ord, url, key) that stay: one step of the recursion decides each symbol's next row."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS step FROM {rows}),
walk AS (SELECT symbol, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS BIGINT) AS ord, FALSE AS stays FROM (SELECT DISTINCT symbol FROM ordered)
  UNION ALL SELECT o.symbol, o.step, CASE WHEN ok AND o.url IS NOT NULL THEN list_append(urls, o.url) ELSE urls END, CASE WHEN ok AND o.key IS NOT NULL THEN list_append(keys, o.key) ELSE keys END, o.ord, ok
  FROM (SELECT o.*, w.urls, w.keys, NOT coalesce(list_contains(w.urls, o.url), FALSE) AND NOT coalesce(list_contains(w.keys, o.key), FALSE) AS ok FROM walk w JOIN ordered o ON o.symbol IS NOT DISTINCT FROM w.symbol AND o.step = w.step + 1) o)""".replace("ordered", f"ordered{name}").replace("walk", f"walk{name}")


SEED_ROWS = ", ".join("('{}', {}, {}, {})".format(s, o, *("NULL" if x is None else f"'{x}'" for x in (u, k))) for s, o, u, k in DEDUPE_SEED)


@query(f"""WITH RECURSIVE seed AS (SELECT symbol, CAST(ord AS BIGINT) AS ord, url, key FROM (VALUES {SEED_ROWS}) t(symbol, ord, url, key)
  UNION ALL SELECT p_brand, p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_type || ' ' || p_size END, CASE WHEN p_partkey % 13 <> 0 THEN p_name || ' ' || p_partkey % 3 END FROM part), {first_wins('seed')} SELECT symbol, ord FROM walk WHERE stays""")
def news_dedupe_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand by two marks, either of which may be null; and a seed: null marks, a row that only a dropped row repeats, a chain of 400 rows."""
    rows = spark.createDataFrame(DEDUPE_SEED, "symbol string, ord bigint, url string, key string")
    k = F.col("p_partkey")
    parts = domain.read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"), k.alias("ord"), F.when(k % 11 != 0, F.concat_ws(" ", "p_type", "p_size")).alias("url"), F.when(k % 13 != 0, F.concat_ws(" ", "p_name", k % 3)).alias("key")
    )
    return feeds.greedy_distinct(rows.unionByName(parts), ["symbol"], "ord", ["url", "key"]).select("symbol", "ord")


@query(f"WITH RECURSIVE {NEWS}, keyed AS (SELECT symbol, ord, url, title, {TITLE_KEY.format('title')} AS key FROM news), {first_wins('keyed')} SELECT k.symbol, k.ord, k.url, k.title FROM walk w JOIN keyed k USING (symbol, ord) WHERE w.stays")
def news_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = domain.news(spark, sf_dir).withColumn("key", T.title_key(F.col("title")))
    return feeds.greedy_distinct(n, ["symbol"], "ord", ["url", "key"]).select("symbol", "ord", "url", "title")


PREL = f"""{POST}, plow AS (SELECT *, lower(concat_ws(' ', title, body)) AS t, {AGE.format(at="created_ts")} AS age FROM post),
phit AS (SELECT *, len(regexp_extract_all({DOUBLED.replace("lower(text)", "t")}, '{sql_phrase(NAME)}')) AS hits FROM plow),
prel AS (SELECT *, CASE WHEN hits = 0 THEN 0.0 ELSE greatest(hits * 3.2::DOUBLE + ({sql_contains("t", WORDS_FIN)}) * 0.32::DOUBLE - CASE WHEN hits <= 1 THEN 0.7 ELSE 0.0 END::DOUBLE, 0.0) END AS relevance FROM phit),
pscore AS (SELECT *, {RECENCY.format(at="created_ts")} AS recency FROM prel),
prank AS (SELECT *, relevance + 2.4::DOUBLE * recency AS score FROM pscore)"""


def corpus_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.posts(spark, sf_dir).withColumn("relevance", feeds.post_relevance(F.col("title"), F.col("body"), NAME, finance=WORDS_FIN))
    return p.withColumn("recency", S.recency(F.col("created_ts"), domain.as_of(), 30)).withColumn("score", F.col("relevance") + F.lit(2.4) * F.col("recency"))


@query(f"WITH {PREL} SELECT ord, symbol, round(relevance, 4) AS relevance, round(recency, 4) AS recency, round(score, 4) AS score FROM prank")
def social_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(corpus_posts(spark, sf_dir), "ord", "symbol", "relevance", "recency", "score")


@query(f"""WITH {PREL}, turns AS (SELECT *, row_number() OVER (PARTITION BY symbol, provider ORDER BY score DESC, ord) AS turn FROM prank)
  SELECT symbol, position, provider, ord FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY turn, provider) AS position FROM turns) WHERE position <= 24""")
def social_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(feeds.interleave(corpus_posts(spark, sf_dir), ["symbol"], "provider", [F.desc("score"), F.col("ord")], 24), "symbol", "position", "provider", "ord")


@query(f"""WITH RECURSIVE {RANKED}, l AS ({ladder_sql("nrank", "rank_score", feeds.news_steps(200))}), keyed AS (SELECT symbol, ord, url, {TITLE_KEY.format("title")} AS key FROM l), {first_wins("keyed")},
  u AS (SELECT symbol, count(*) AS deduped FROM walk WHERE stays GROUP BY symbol), a AS (SELECT symbol, count(*) AS fetched FROM l GROUP BY symbol)
  SELECT symbol, 'news' AS feed, fetched, deduped, least(deduped, 50) AS displayed, round((fetched - deduped) * 100.0::DOUBLE / fetched, 4) AS repeat_pct FROM a JOIN u USING (symbol)
  UNION ALL SELECT symbol, 'social', count(*), count(DISTINCT (url, ord)), least(count(DISTINCT (url, ord)), 50), 0.0 FROM post GROUP BY symbol""".replace("WITH RECURSIVE", f"WITH RECURSIVE {POST},", 1))
def feed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched (news: those the ladder gives), left after first-wins removal, and displayed. Posts have a URL each; their titles aren't compared here."""
    n = feeds.ladder(corpus_news(spark, sf_dir), ["symbol"], "rank_score", feeds.news_steps(200)).withColumn("key", T.title_key(F.col("title")))
    p = domain.posts(spark, sf_dir)
    news = feeds.pool_audit(n, feeds.greedy_distinct(n, ["symbol"], "ord", ["url", "key"]), ["symbol"], 50).withColumn("feed", F.lit("news"))
    social = feeds.pool_audit(p, feeds.greedy_distinct(p, ["symbol"], "ord", ["url"]), ["symbol"], 50).withColumn("feed", F.lit("social"))
    return shaped(news.unionByName(social), "symbol", "feed", "fetched", "deduped", "displayed", "repeat_pct")


def sql_direction(text: str) -> str:
    """A feed item's score: the positive density less the negative one, twice, -1 to 1."""
    dbl = DOUBLED.replace("lower(text)", f"lower({text})")
    pos, neg = (sql_density(domain.CORPUS_LEXICON[k], dbl) for k in ("forward", "hedge"))
    return f"greatest(-1.0, least(1.0, ({pos} - {neg}) * 2))::DOUBLE"


SENT = f"""nsent AS (SELECT published_ts AS at_ts, symbol, coalesce({sql_direction("concat_ws('. ', title, summary)")}, 0.0) AS score FROM news),
psent AS (SELECT created_ts AS at_ts, symbol, coalesce({sql_direction("concat_ws('. ', title, body)")}, 0.0) AS score FROM post)"""


def scored(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str, body: str) -> DataFrame:
    """Items scored by what they say (title. body) and then given their times (of the event ``key``), so that no text is moved; what can't be scored is neutral."""
    said = rows.select(key, "symbol", F.concat_ws(". ", "title", body).alias("said"))
    scores = score_text(said, lexical_scorer(domain.CORPUS_LEXICON["forward"], domain.CORPUS_LEXICON["hedge"]), "said").select(key, "symbol", "score")
    return domain.timed(scores, spark, sf_dir, key, "at").select("at", "symbol", "score")


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, domain.untimed_news(spark, sf_dir), "ord", "summary")


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, domain.untimed_posts(spark, sf_dir), "conv_id", "body")


@query(f"""WITH {NEWS}, {POST}, {SENT}, d AS (SELECT CAST(at_ts AS DATE) AS day, score AS n, NULL::DOUBLE AS p FROM nsent UNION ALL SELECT CAST(at_ts AS DATE), NULL, score FROM psent)
  SELECT day, round(coalesce(avg(n), 0.0), 4) AS news_avg, round(coalesce(avg(p), 0.0), 4) AS social_avg, round(coalesce((avg(n) + avg(p)) / 2, avg(n), avg(p), 0.0), 4) AS blended FROM d WHERE day IS NOT NULL GROUP BY day""")
def sentiment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(feeds.day_sentiment(scored_news(spark, sf_dir), scored_posts(spark, sf_dir)))


@query(f"""WITH {NEWS}, {POST}, {SENT}, c AS (SELECT symbol, count(*) AS items, avg(score) AS mean, count(*) FILTER (score >= 0.12) AS bullish, count(*) FILTER (score <= -0.12) AS bearish FROM nsent GROUP BY symbol)
  SELECT symbol, items, round(mean, 4) AS mean, bullish, bearish, CASE WHEN mean >= 0.12 THEN 'bullish' WHEN mean <= -0.12 THEN 'bearish' ELSE 'mixed' END AS stance,
  round(bullish * 100.0::DOUBLE / items, 4) AS bullish_pct, round(bearish * 100.0::DOUBLE / items, 4) AS bearish_pct, round(100.0 - bullish * 100.0::DOUBLE / items - bearish * 100.0::DOUBLE / items, 4) AS neutral_pct FROM c""")
def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(feeds.sentiment_shares(scored_news(spark, sf_dir), ["symbol"]))


@query(f"""WITH {NEWS}, p AS (SELECT * FROM (SELECT symbol, ord, row_number() OVER (PARTITION BY symbol ORDER BY ord DESC) AS place FROM news) WHERE place <= 30)
  SELECT symbol, rank, ord FROM (SELECT n.symbol, n.ord, row_number() OVER (PARTITION BY n.symbol ORDER BY p.place IS NULL, p.place, n.ord) AS rank FROM news n LEFT JOIN p USING (symbol, ord)) WHERE rank <= 80""")
def rerank_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = domain.news(spark, sf_dir)
    order = feeds.top(n, ["symbol"], [F.desc("ord")], 30, "place").select("symbol", "ord", "place")
    return shaped(feeds.rerank(n, order, ["symbol"], "ord", 80), "symbol", "rank", "ord")


# --- fundamentals ---------------------------------------------------------------------------------


def provider(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return domain.fundamentals(spark, sf_dir).where(F.col("provider") == name)


def merged_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals.merge_providers(provider(spark, sf_dir, "A"), provider(spark, sf_dir, "B"))


@query(f"""WITH {FUND} SELECT symbol, year, quarter, year || '-Q' || quarter AS label, round(fa.revenue + 0.001, 1) AS revenue, round(fa.net_income / 1000 + 1e-7, 3) AS net_income, round(fb.reported_eps + 1e-7, 4) AS eps FROM fa FULL OUTER JOIN fb USING (symbol, year, quarter)""")
def fundamentals_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = provider(spark, sf_dir, "A"), provider(spark, sf_dir, "B")
    rows = fundamentals.outer_quarters(a.select(*fundamentals.KEYS, "revenue"), a.select(*fundamentals.KEYS, "net_income"), b.select(*fundamentals.KEYS, F.col("reported_eps").alias("eps")))
    rows = rows.withColumn("label", fundamentals.label())
    # a little is added on both sides, as sums of cents often lie on a tie
    rows = rows.withColumns({"revenue": F.round(F.col("revenue") + 0.001, 1), "net_income": F.round(F.col("net_income") / 1000 + 1e-7, 3), "eps": F.col("eps") + 1e-7})
    return shaped(rows, "symbol", "year", "quarter", "label", "revenue", "net_income", "eps")


@query(f"WITH {FUND}, {MERGED} SELECT symbol, year, quarter, rank, round(revenue, 2) AS revenue, round(reported_eps, 4) AS reported_eps, round(eps_estimate, 4) AS eps_estimate FROM merged")
def fundamentals_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged_quarters(spark, sf_dir).withColumn("revenue", F.round("revenue", 2))
    return shaped(rows, "symbol", "year", "quarter", "rank", "revenue", "reported_eps", "eps_estimate")


GROWTH = f"""{FUND}, {MERGED}, pair AS (SELECT symbol, max(revenue) FILTER (rank = 1) AS r1, max(revenue) FILTER (rank = 2) AS r2, max(reported_eps) FILTER (rank = 1) AS e1, max(reported_eps) FILTER (rank = 2) AS e2 FROM merged GROUP BY symbol),
growth AS (SELECT symbol, CASE WHEN r2 <> 0 THEN (r1 - r2) / abs(r2) * 100 END AS revenue_growth_pct, CASE WHEN e2 <> 0 THEN (e1 - e2) / abs(e2) * 100 END AS reported_eps_growth_pct FROM pair)"""


@query(f"WITH {GROWTH} SELECT symbol, round(revenue_growth_pct, 4) AS revenue_growth_pct, round(reported_eps_growth_pct, 4) AS reported_eps_growth_pct FROM growth")
def fundamentals_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(fundamentals.growth(merged_quarters(spark, sf_dir)))


@query(f"WITH {FUND}, {MERGED} SELECT symbol, year, quarter, round(CASE WHEN eps_estimate <> 0 THEN (reported_eps - eps_estimate) / abs(eps_estimate) * 100 END, 4) AS surprise_pct, reported_eps > eps_estimate AS beat FROM merged")
def eps_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(fundamentals.surprise(merged_quarters(spark, sf_dir)), "symbol", "year", "quarter", "surprise_pct", "beat")


INFO = """ia AS (SELECT symbol, sum(revenue) AS market_cap, CASE WHEN symbol <> 'BUILDING' THEN avg(reported_eps) END AS trailing_pe, count(*)::DOUBLE AS beta FROM fa GROUP BY symbol),
ib AS (SELECT symbol, sum(revenue) AS market_cap, avg(reported_eps) AS trailing_pe, count(*)::DOUBLE AS beta FROM fb GROUP BY symbol)"""
VALID = f"""{FUND}, {INFO}, tall AS (SELECT symbol, key, a.v AS a_value, b.v AS b_value FROM (UNPIVOT (SELECT * FROM ia) ON market_cap, trailing_pe, beta INTO NAME key VALUE v) a
  FULL OUTER JOIN (UNPIVOT (SELECT * FROM ib) ON market_cap, trailing_pe, beta INTO NAME key VALUE v) b USING (symbol, key)),
valid AS (SELECT *, coalesce(a_value, b_value) AS merged, a_value IS NULL AS filled, CASE WHEN abs(b_value) > 1e-8 THEN abs((a_value - b_value) / b_value) * 100 END AS diff_pct FROM tall),
judged AS (SELECT *, coalesce(diff_pct >= 10, FALSE) AS mismatch, CASE WHEN diff_pct >= 25 THEN 'high' WHEN diff_pct >= 12 THEN 'medium' WHEN diff_pct >= 10 THEN 'low' END AS severity FROM valid)"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = lambda name: provider(spark, sf_dir, name).groupBy("symbol").agg(F.sum("revenue").alias("market_cap"), F.avg("reported_eps").alias("trailing_pe"), F.count(F.lit(1)).cast("double").alias("beta"))
    a = info("A").withColumn("trailing_pe", F.when(F.col("symbol") != "BUILDING", F.col("trailing_pe")))
    return fundamentals.validate(a, info("B"), ("market_cap", "trailing_pe", "beta"))


@query(f"WITH {VALID} SELECT symbol, key, round(merged, 2) AS merged, filled, round(diff_pct, 4) AS diff_pct, mismatch, severity FROM judged")
def fundamentals_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(validated(spark, sf_dir).withColumn("merged", F.round("merged", 2)), "symbol", "key", "merged", "filled", "diff_pct", "mismatch", "severity")


@query(f"WITH {VALID} SELECT symbol, count(*) AS compared, count(*) FILTER (filled) AS filled, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM judged GROUP BY symbol")
def validation_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(fundamentals.severity_counts(validated(spark, sf_dir)))


@query("SELECT 'SYM' || user_id % 5 AS symbol, CAST(ts AS DATE) AS day, round(avg(value) + 1e-7, 4) AS close, count(*) AS volume FROM events GROUP BY ALL")
def price_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(domain.prices(spark, sf_dir).withColumn("close", F.col("close") + 1e-7))


CL = "greatest(-1.0, least(1.0, {}))"
SIGNAL = f"""{GROWTH}, sig AS (SELECT symbol, {CL.format("(coalesce(revenue_growth_pct, 0) * 0.55::DOUBLE + coalesce(reported_eps_growth_pct, 0) * 0.45::DOUBLE) / 50")} AS growth_signal,
  CASE WHEN symbol <> 'BUILDING' THEN {CL.format("(3.0 - (1.0 + length(symbol) % 4)) / 2")} END AS rec, CASE WHEN symbol <> 'MACHINERY' THEN {CL.format("coalesce(revenue_growth_pct, 0) / 30")} END AS up, revenue_growth_pct, reported_eps_growth_pct FROM growth),
sig2 AS (SELECT *, CASE WHEN rec IS NULL THEN up WHEN up IS NULL THEN rec ELSE {CL.format("rec * 0.65::DOUBLE + up * 0.35::DOUBLE")} END AS analyst FROM sig),
signal AS (SELECT *, CASE WHEN analyst IS NULL THEN growth_signal ELSE {CL.format("growth_signal * 0.8::DOUBLE + analyst * 0.2::DOUBLE")} END AS fundamentals FROM sig2)"""


def corpus_signals(spark: SparkSession, sf_dir: str, merged: DataFrame | None = None) -> DataFrame:
    """Signals of ``merged`` quarters, where the caller has them."""
    g = fundamentals.growth(merged_quarters(spark, sf_dir) if merged is None else merged)
    rec = F.when(F.col("symbol") != "BUILDING", (F.length("symbol") % 4 + 1).cast("double"))
    up = F.when(F.col("symbol") != "MACHINERY", F.coalesce("revenue_growth_pct", F.lit(0.0)))
    g = g.withColumn("growth_signal", S.growth_signal(F.col("revenue_growth_pct"), F.col("reported_eps_growth_pct"))).withColumn("analyst", S.analyst_signal(rec, up))
    return g.withColumn("fundamentals", S.fundamentals_signal(F.col("growth_signal"), F.col("analyst")))


@query(f"WITH {SIGNAL} SELECT symbol, round(growth_signal, 4) AS growth_signal, round(analyst, 4) AS analyst, round(fundamentals, 4) AS fundamentals FROM signal")
def fundamentals_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(corpus_signals(spark, sf_dir), "symbol", "growth_signal", "analyst", "fundamentals")


# --- scores ---------------------------------------------------------------------------------------

LINEAR = f"{S.INTERCEPT!r}::DOUBLE + " + " + ".join(
    f"({w!r}::DOUBLE) * (({'100.0 - evasiveness' if n == 'directness' else 'direction' if n == 'sentiment' else n}) - {m!r}::DOUBLE) / {d!r}::DOUBLE" for n, (w, m, d) in S.CALIBRATION.items()
)
COMPONENT = f"""{METRIC}, {MEANS}, comp AS (SELECT *, 1.0::DOUBLE / (1.0 + exp(-greatest(-35.0, least(35.0, {LINEAR})))) AS p FROM means)"""


@query(f"WITH {COMPONENT} SELECT doc_id, CASE WHEN n = 0 THEN 'no_management_rows' ELSE 'calibrated_internal_logistic' END AS mode, round(CASE WHEN n > 0 THEN p END, 4) AS probability, round(CASE WHEN n = 0 THEN 0.0 ELSE 2 * p - 1 END, 4) AS component FROM comp")
def transcript_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = metrics.management_means(corpus_metrics(spark, sf_dir))
    return shaped(report.transcript_component(means), "doc_id", "mode", "probability", "component")


ALL_SIGNALS = f"""{COMPONENT}, {NEWS}, {POST}, {SENT},
tr AS (SELECT 'SYM' || doc_id % 5 AS symbol, avg(CASE WHEN n = 0 THEN 0.0 ELSE 2 * p - 1 END) AS transcript FROM comp GROUP BY ALL),
ns AS (SELECT symbol, avg(score) AS news FROM nsent GROUP BY symbol), ps AS (SELECT symbol, avg(CASE WHEN symbol <> 'SYM3' THEN score END) AS social FROM psent GROUP BY symbol),
{SIGNAL.replace("WITH ", "")}, fu AS (SELECT 'SYM' || length(symbol) % 5 AS symbol, avg(fundamentals) AS fundamentals, avg(revenue_growth_pct) AS revenue_growth, avg(reported_eps_growth_pct) AS eps_growth FROM signal GROUP BY ALL),
allsig AS (SELECT tr.symbol, transcript, news, social, fundamentals, revenue_growth, eps_growth FROM tr LEFT JOIN ns USING (symbol) LEFT JOIN ps USING (symbol) LEFT JOIN fu USING (symbol))"""


def all_signals(spark: SparkSession, sf_dir: str, scored_blocks: DataFrame | None = None, merged: DataFrame | None = None) -> DataFrame:
    """All signals per symbol; a caller that reads the blocks' metrics or the merged quarters itself stores them and gives them."""
    means = metrics.management_means(corpus_metrics(spark, sf_dir) if scored_blocks is None else scored_blocks)
    tr = report.transcript_component(means).groupBy(F.concat(F.lit("SYM"), (F.col("doc_id") % domain.SYMBOLS).cast("string")).alias("symbol")).agg(F.avg("component").alias("transcript"))
    ns = scored_news(spark, sf_dir).groupBy("symbol").agg(F.avg("score").alias("news"))
    ps = scored_posts(spark, sf_dir).groupBy("symbol").agg(F.avg(F.when(F.col("symbol") != "SYM3", F.col("score"))).alias("social"))
    fu = corpus_signals(spark, sf_dir, merged).groupBy(F.concat(F.lit("SYM"), (F.length("symbol") % domain.SYMBOLS).cast("string")).alias("symbol"))
    fu = fu.agg(F.avg("fundamentals").alias("fundamentals"), F.avg("revenue_growth_pct").alias("revenue_growth"), F.avg("reported_eps_growth_pct").alias("eps_growth"))
    return tr.join(ns, "symbol", "left").join(ps, "symbol", "left").join(fu, "symbol", "left")


def sql_overall(weights: dict[str, float]) -> str:
    return CL.format(" + ".join(f"{w!r}::DOUBLE * coalesce({k}, 0)" for k, w in S.shares(weights).items()))


LABEL = "CASE WHEN s >= 0.5 THEN 'strongly_bullish' WHEN s >= 0.15 THEN 'cautiously_bullish' WHEN s <= -0.5 THEN 'strongly_bearish' WHEN s <= -0.15 THEN 'cautiously_bearish' ELSE 'mixed' END"


@query(f"WITH {ALL_SIGNALS} SELECT symbol, round(s, 4) AS overall_score, {LABEL} AS label, round(snap, 4) AS snapshot_score, CASE WHEN snap >= 0.12 THEN 'bullish' WHEN snap <= -0.12 THEN 'bearish' ELSE 'mixed' END AS stance FROM (SELECT *, {sql_overall(S.WEIGHTS)} AS s, {CL.format('0.35::DOUBLE / 0.6 * coalesce(fundamentals, 0) + 0.15::DOUBLE / 0.6 * coalesce(news, 0) + 0.1::DOUBLE / 0.6 * coalesce(social, 0)')} AS snap FROM allsig)")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.snapshot_scores(report.company_scores(all_signals(spark, sf_dir)))
    return shaped(rows, "symbol", "overall_score", "label", "snapshot_score", "stance")


OTHER_WEIGHTS = {"transcript": 10.0, "fundamentals": -5.0, "news": 60.0, "social": 30.0}


@query(f"WITH {ALL_SIGNALS} SELECT symbol, round(s, 4) AS overall_score, {LABEL} AS label FROM (SELECT *, {sql_overall(OTHER_WEIGHTS)} AS s FROM allsig)")
def recompute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored signals scored again with other weights."""
    kept = store(all_signals(spark, sf_dir))
    return shaped(report.company_scores(kept, OTHER_WEIGHTS), "symbol", "overall_score", "label")


@query(f"WITH {ALL_SIGNALS} SELECT symbol, round(greatest(0.0, least(100.0, 52.0 + transcript * 32 + coalesce(news, 0) * 10 + coalesce(social, 0) * 6 + coalesce(revenue_growth, 0) * 0.18::DOUBLE + coalesce(eps_growth, 0) * 0.20::DOUBLE)), 4) AS strength FROM allsig")
def company_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = report.strength(F.col("transcript"), F.coalesce("news", F.lit(0.0)), F.coalesce("social", F.lit(0.0)), F.col("revenue_growth"), F.col("eps_growth"))
    return shaped(all_signals(spark, sf_dir).withColumn("strength", s), "symbol", "strength")


# --- segments, coverage, reports ------------------------------------------------------------------


@query()
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(domain.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(segments.segments(F.col("text"))).alias("i", "segment")))


@query()
def segmented_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = domain.CORPUS_LEXICON
    return shaped(segments.segmented_scores(domain.read(spark, sf_dir, "documents"), lex["forward"], lex["hedge"]))


CAND = """cand AS (SELECT 'SYM' || page_id % 5 AS symbol, 2020 + page_id % 3 AS year, CASE WHEN page_id % 5 = 2 THEN page_id % 2 * 2 + 1 ELSE page_id % 4 + 1 END AS quarter, (page_id * 31 % 17)::DOUBLE AS quality, DATE '2020-01-01' + CAST(page_id % 900 AS INTEGER) AS date, url FROM pages),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year, quarter ORDER BY quality DESC, date DESC, url) AS n FROM cand) WHERE n = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.read(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        F.concat(F.lit("SYM"), (i % 5).cast("string")).alias("symbol"), (i % 3 + 2020).alias("year"), F.when(i % 5 == 2, i % 2 * 2 + 1).otherwise(i % 4 + 1).alias("quarter"), (i * 31 % 17).cast("double").alias("quality"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 900).cast("int")).alias("date"), "url",
    )


@query(f"WITH {CAND} SELECT symbol, year, quarter, quality, date, url FROM best")
def best_candidate_per_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.best_per_quarter(candidates(spark, sf_dir)), "symbol", "year", "quarter", "quality", "date", "url")


@query(f"""WITH {CAND}, last AS (SELECT symbol, max(year * 4 + quarter - 1) AS last FROM best GROUP BY symbol), want AS (SELECT symbol, unnest(range(last - 3, last + 1)) AS q FROM last)
  SELECT w.symbol, q // 4 AS year, q % 4 + 1 AS quarter, url, CASE WHEN url IS NULL THEN 'missing' ELSE 'found' END AS status FROM want w LEFT JOIN best b ON b.symbol = w.symbol AND b.year = q // 4 AND b.quarter = q % 4 + 1""")
def quarter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.quarter_coverage(candidates(spark, sf_dir)), "symbol", "year", "quarter", "url", "status")


@query(f"""WITH {CAND}, last AS (SELECT symbol, max(year * 4 + quarter - 1) AS last FROM best GROUP BY symbol), want AS (SELECT symbol, unnest(range(last - 3, last + 1)) AS q FROM last),
  c AS (SELECT w.symbol, count(url) AS found, count(*) AS wanted FROM want w LEFT JOIN best b ON b.symbol = w.symbol AND b.year = q // 4 AND b.quarter = q % 4 + 1 GROUP BY w.symbol)
  SELECT *, CASE WHEN found = 0 THEN 'missing' WHEN found < wanted THEN 'partial' ELSE 'available' END AS availability FROM c""")
def transcript_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(transcripts.availability(transcripts.quarter_coverage(candidates(spark, sf_dir))))


@query("""WITH b AS (SELECT c_mktsegment AS symbol, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
  UNION ALL SELECT * FROM (VALUES ('seed', TIMESTAMP '2022-03-01', TIMESTAMP '2024-01-01'), ('back', TIMESTAMP '2022-03-01', TIMESTAMP '2022-02-01')))
  SELECT symbol, CAST(unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS DATE) AS month FROM b""")
def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months from each segment's first order to its last; none where the last comes before the first."""
    o = domain.read(spark, sf_dir, "orders").join(domain.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    bounds = o.groupBy(F.col("c_mktsegment").alias("symbol")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    seed = spark.sql("SELECT * FROM VALUES ('seed', DATE '2022-03-01', DATE '2024-01-01'), ('back', DATE '2022-03-01', DATE '2022-02-01') AS t(symbol, first, last)")
    return bounds.unionByName(seed).select("symbol", F.explode(months(F.col("first"), F.col("last"))).alias("month"))

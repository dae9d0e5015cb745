"""Queries on whole calls: assembled documents, roles, metrics with predictions, findings, candidates, quarters, audits."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as T
from .operators import audit, candidates, metrics, people, quarters, scorers, transcripts, views
from .queries import AS_OF, BAND, BLOCK, COMPACT, GUARD, LINES, METRIC, ROLES, SENTENCES, corpus_metrics, query, shaped, sql_any
from .sources import cache, domain
from .sources.store import base_path, store
from .streaming import jobs

ROSTER = ((-1, "Jane Roe", "Chief Executive Officer"), (-1, "Ann Kim", "Research Analyst"))
ALL_SECTIONS = f"""{ROLES}, part AS (SELECT doc_id, order_index, section_type, speaker, CASE WHEN role <> 'unknown' THEN role END AS role, text FROM typed JOIN resolved USING (doc_id, speaker)
  UNION ALL SELECT doc_id, 0, 'other', 'unknown', NULL, string_agg(trim(line), ' ' ORDER BY line_no) FROM line WHERE trim(line) <> '' AND doc_id NOT IN (SELECT doc_id FROM tblock) GROUP BY doc_id),
said AS (SELECT doc_id, order_index, unnest(range(1, len(s) + 1)) AS pos, s FROM (SELECT *, {SENTENCES} AS s FROM part)), long_ AS (SELECT doc_id, order_index, pos, s[pos] AS quote FROM said WHERE length(s[pos]) >= 70),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY order_index, pos) AS rank FROM long_) WHERE rank <= 6)"""


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.assembled(domain.transcript_lines(spark, sf_dir), spark.createDataFrame(ROSTER, "doc_id bigint, name string, title string"))


@query(f"""WITH {ALL_SECTIONS} SELECT doc_id, CAST(order_index AS BIGINT) AS order_index, section_type, speaker, role, array_to_string(list_slice({SENTENCES}, 1, 2), '|') AS evidence FROM part""")
def assembled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to sections: blocks, canonical speakers, section types, roles with a roster, evidence."""
    out = assembled(spark, sf_dir).withColumn("evidence", F.array_join("evidence", "|"))
    return shaped(out, "doc_id", "order_index", "section_type", "speaker", "role", "evidence")


@query(f"""WITH {ALL_SECTIONS}, q AS (SELECT doc_id, string_agg(quote, '|' ORDER BY rank) AS quotes FROM own GROUP BY doc_id)
  SELECT doc_id, count(*) AS sections, count(DISTINCT speaker) AS speakers, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) >= 2 AS full_transcript, any_value(quotes) AS quotes FROM part LEFT JOIN q USING (doc_id) GROUP BY doc_id""")
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = store(assembled(spark, sf_dir))
    quotes = transcripts.document_quotes(sections).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda x: x["quote"]), "|").alias("quotes"))
    return shaped(transcripts.document_records(sections).join(quotes, "doc_id", "left"))


_ASK2 = f"(contains(text, '?') OR {sql_any('text', transcripts.PAGE_QUESTIONS)})"


@query(f"""WITH {LINES}, b AS (SELECT *, lower(trim(speaker)) AS who, {_ASK2} AS asks, {sql_any("text", transcripts.PAGE_TRANSITIONS)} AS turns FROM tblock),
  s AS (SELECT doc_id, coalesce(min(order_index) FILTER (turns), min(order_index - 1) FILTER (asks AND who NOT IN ('', 'unknown', 'operator') AND order_index >= 2)) AS qa_start FROM b GROUP BY doc_id),
  j AS (SELECT b.*, qa_start, lag(who) OVER (PARTITION BY b.doc_id ORDER BY order_index) AS before FROM b JOIN s USING (doc_id)),
  m AS (SELECT DISTINCT doc_id, who FROM j WHERE who NOT IN ('', 'unknown', 'operator') AND (qa_start IS NULL OR order_index < qa_start) UNION SELECT -1, 'jane roe'),
  two AS (SELECT doc_id, who FROM (SELECT doc_id, who, row_number() OVER (PARTITION BY doc_id ORDER BY min(order_index)) AS n FROM j WHERE who NOT IN ('', 'unknown', 'operator') GROUP BY doc_id, who) WHERE n <= 2 AND doc_id NOT IN (SELECT doc_id FROM m)),
  mm AS (SELECT *, TRUE AS manager FROM (SELECT * FROM m UNION SELECT * FROM two))
  SELECT doc_id, CAST(order_index AS BIGINT) AS order_index, speaker, CASE WHEN contains(who, 'operator') THEN 'operator' WHEN manager THEN 'management' WHEN coalesce(order_index >= qa_start, FALSE) THEN CASE WHEN asks OR before = 'operator' THEN 'analyst' END
    WHEN who NOT IN ('', 'unknown') THEN 'management' END AS role, CASE WHEN coalesce(order_index >= qa_start, FALSE) THEN 'qa' ELSE 'prepared_remarks' END AS section FROM j LEFT JOIN mm USING (doc_id, who)""")
def page_section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page parser's reading of roles: by place in the call and wording."""
    roster = spark.createDataFrame([(d, n, t) for d, n, t in ROSTER], "doc_id bigint, name string, role string")
    return shaped(transcripts.page_roles(transcripts.speaker_blocks(domain.transcript_lines(spark, sf_dir)), roster), "doc_id", "order_index", "speaker", "role", "section")


LABELS = ("Jane  Roe -- CEO", "Tom Fox (Chief Financial Officer)", " Max Lee - ", "Ann (Boston)", "", "operator")
PEOPLE = ("Jane Roe -- Chief Executive Officer", "Tom Fox, CFO", "Max Lee", "Ann Kim - Analyst, Some Bank", "Bo–Li — Host")


LABELS_READ = "('Jane  Roe -- CEO', 'Jane Roe', 'Jane  Roe', 'CEO'), ('Tom Fox (Chief Financial Officer)', 'Tom Fox', 'Tom Fox (Chief Financial Officer)', ''), (' Max Lee - ', 'Max Lee', 'Max Lee', ''), ('Ann (Boston)', 'Ann (Boston)', 'Ann (Boston)', ''), ('', '', '', ''), ('operator', 'operator', 'operator', ''), ('Jane Roe -- Chief Executive Officer', 'Jane Roe', 'Jane Roe', 'Chief Executive Officer'), ('Tom Fox, CFO', 'Tom Fox, CFO', 'Tom Fox', 'CFO'), ('Max Lee', 'Max Lee', 'Max Lee', ''), ('Ann Kim - Analyst, Some Bank', 'Ann Kim - Analyst, Some Bank', 'Ann Kim', 'Analyst, Some Bank'), ('Bo–Li — Host', 'Bo–Li — Host', 'Bo–Li', 'Host')"


@query(f"""WITH {BLOCK}, s AS (SELECT speaker AS who, replace(speaker, ' ', '  ') AS wide, order_index % 5 AS k, upper(speaker_role) AS r FROM block) SELECT * FROM (VALUES {LABELS_READ}) t(text, label, name, role)
  UNION ALL SELECT wide || ' -- ' || r, who, wide, r FROM s WHERE k = 0 UNION ALL SELECT who || ' (Chief ' || r || ' Officer)', who, who || ' (Chief ' || r || ' Officer)', '' FROM s WHERE k = 1
  UNION ALL SELECT ' ' || who || ' - ', who, who, '' FROM s WHERE k = 2 UNION ALL SELECT who || ', ' || r, who || ', ' || r, who, r FROM s WHERE k = 3 UNION ALL SELECT who || ' — ' || r, who || ' — ' || r, who, r FROM s WHERE k = 4""")
def speaker_label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers of all blocks in five spellings with a role, taken apart, and a seed of others."""
    who, k, r = F.col("speaker"), F.col("order_index") % 5, F.upper("speaker_role")
    said = (
        F.when(k == 0, F.concat(F.replace(who, F.lit(" "), F.lit("  ")), F.lit(" -- "), r)).when(k == 1, F.concat(who, F.lit(" (Chief "), r, F.lit(" Officer)"))).when(k == 2, F.concat(F.lit(" "), who, F.lit(" - ")))
        .when(k == 3, F.concat(who, F.lit(", "), r)).otherwise(F.concat(who, F.lit(" — "), r))
    )
    rows = spark.createDataFrame([(t,) for t in (*LABELS, *PEOPLE)], "text string").unionByName(domain.blocks(spark, sf_dir).select(said.alias("text")))
    return rows.withColumn("p", T.name_and_role(F.col("text"))).select("text", T.speaker_label(F.col("text")).alias("label"), "p.name", "p.role")


@query(f"""WITH {BLOCK}, p AS (SELECT doc_id, order_index AS ord, speaker AS name, speaker_role AS role FROM block), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name), lower(role) ORDER BY ord) AS n FROM p)
  SELECT doc_id, name, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rank FROM k WHERE n = 1) WHERE rank <= 30""")
def participants_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = domain.blocks(spark, sf_dir)
    return shaped(people.distinct_participants(b.select("doc_id", F.col("order_index").alias("ord"), F.col("speaker").alias("name"), F.col("speaker_role").alias("role"))), "doc_id", "name", "role", "rank")


@query(f"""WITH {LINES}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, trim(line) AS line FROM line), h AS (SELECT doc_id, min(i) AS head FROM n WHERE contains(lower(line), 'call participants') GROUP BY doc_id),
  e AS (SELECT h.doc_id, head, coalesce((SELECT min(i) FROM n WHERE n.doc_id = h.doc_id AND i > head AND (contains(lower(line), 'prepared remarks') OR contains(lower(line), 'questions and answers'))), head + 41) AS stop FROM h)
  SELECT n.doc_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY i) AS rank, trim(split_part(line, ' -- ', 1)) AS name, trim(split_part(line, ' -- ', 2)) AS role FROM n JOIN e USING (doc_id) WHERE i > head AND i < stop AND i <= head + 40""")
def participants_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under a participants heading."""
    lines = domain.transcript_lines(spark, sf_dir).selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no", "trim(line) AS line")
    return shaped(transcripts.listed_participants(lines), "doc_id", "rank", "name", "role")


# --- metrics --------------------------------------------------------------------------------------

#: A stand-in classifier: a block's length decides, so that SQL can say the same.
BANDS = ("low", "medium", "high", "very high", "odd")


def by_length(texts: list[str]) -> tuple[list[str], np.ndarray]:
    p = np.full((len(texts), len(BANDS)), 0.05)
    for k, t in enumerate(texts):
        p[k, len(t) % len(BANDS)] = 0.8
    return list(BANDS), p


def predictions(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    b = domain.blocks(spark, sf_dir)
    read = scorers.prompt(F.col("speaker_role"), F.col("section_type"), F.col("text"))
    return scorers.predict_bands(b.withColumn("prompt", read), metric, by_length)


_PROMPT = "'[ROLE=' || speaker_role || '] [SECTION=' || section_type || '] ' || trim(text)"
PRED = f"""pred AS (SELECT doc_id, order_index, ['low', 'medium', 'high', 'very_high', NULL][length({_PROMPT}) % 5 + 1] AS p_band, [30.0, 50.0, 70.0, 90.0, NULL][length({_PROMPT}) % 5 + 1]::DOUBLE AS p_score FROM block)"""


@query(f"WITH {BLOCK}, {PRED} SELECT doc_id, order_index, 'confidence' AS metric, p_band AS band, p_score AS score, 0.8::DOUBLE AS predicted_confidence FROM pred WHERE p_band IS NOT NULL")
def metric_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's verdicts on all blocks, batch by batch inside the tasks."""
    return shaped(predictions(spark, sf_dir, "confidence").drop("probabilities"))


@query(f"""WITH {BLOCK}, {PRED} SELECT doc_id, order_index, length({_PROMPT}) % 7 = 0 AS failed, CASE WHEN length({_PROMPT}) % 7 <> 0 THEN p_band END AS band
  FROM block JOIN pred USING (doc_id, order_index) WHERE p_band IS NOT NULL OR length({_PROMPT}) % 7 = 0""")
def failed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier that gives up a whole batch for each prompt of a length divisible by 7: only these prompts are lost."""

    def brittle(texts: list[str]) -> tuple[list[str], np.ndarray]:
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("no answer")
        return by_length(texts)

    read = scorers.prompt(F.col("speaker_role"), F.col("section_type"), F.col("text"))
    p = scorers.predict_bands(domain.blocks(spark, sf_dir).withColumn("prompt", read), "confidence", brittle)
    return shaped(p.select("doc_id", "order_index", F.col("score").isNull().alias("failed"), "band"))


_NEAR3 = "CASE WHEN abs(30 - value) <= least(abs(50 - value), abs(70 - value)) THEN 'low' WHEN abs(50 - value) <= abs(70 - value) THEN 'medium' ELSE 'high' END"
RESOLVED = f"""{METRIC}, {PRED}, tall AS (SELECT doc_id, order_index, text, evasiveness, metric, lexical FROM (SELECT *, unnest(['confidence', 'directness', 'outlook_strength', 'specificity', 'risk_intensity']) AS metric,
  unnest([confidence, 100.0 - evasiveness, outlook, specificity, risk]) AS lexical FROM metric)),
guarded AS (SELECT *, {GUARD} AS guard FROM (SELECT t.*, {COMPACT} AS c, CASE WHEN metric IN ('confidence', 'directness', 'specificity') THEN p_band END AS p_band, CASE WHEN metric IN ('confidence', 'directness', 'specificity') THEN p_score END AS p_score FROM tall t LEFT JOIN pred USING (doc_id, order_index))),
why AS (SELECT *, CASE WHEN metric = 'outlook_strength' THEN 'forced_lexical_fallback' WHEN guard IS NOT NULL THEN guard WHEN p_score IS NULL THEN 'student_prediction_missing' END AS reason FROM guarded),
val AS (SELECT *, CASE WHEN reason IS NULL AND metric = 'specificity' THEN lexical * 0.65::DOUBLE + p_score * 0.35::DOUBLE WHEN reason IS NULL AND metric IN ('confidence', 'directness') THEN p_score ELSE lexical END AS value,
  CASE WHEN reason IS NULL AND metric IN ('confidence', 'directness') THEN 'student_primary' WHEN reason IS NOT NULL AND metric IN ('confidence', 'directness') THEN 'lexical_fallback' ELSE 'lexical_primary' END AS source FROM why),
judged AS (SELECT doc_id, order_index, metric, lexical, value, source, reason, CASE WHEN source = 'student_primary' THEN p_band END AS p_band, evasiveness FROM val),
every AS (SELECT doc_id, order_index, metric, lexical, value, source, reason, p_band FROM judged
  UNION ALL SELECT doc_id, order_index, 'evasiveness', evasiveness, CASE WHEN source = 'student_primary' THEN 100 - value ELSE evasiveness END, source, reason, NULL FROM judged WHERE metric = 'directness')"""


@query(f"""WITH {RESOLVED} SELECT doc_id, order_index, metric, round(lexical, 4) AS lexical, round(value, 4) AS value, source, reason,
  coalesce(p_band, CASE WHEN metric IN ('confidence', 'directness') THEN {_NEAR3} ELSE {BAND.replace(" x)", " value)").replace("= near", "= least(" + ", ".join(f"abs({v} - value)" for v in S.BANDS.values()) + ")")} END) AS band FROM every""")
def metric_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all blocks: forced, guarded, missing, blended and taken predictions; evasiveness from directness."""
    p = predictions(spark, sf_dir, "x").select("doc_id", "order_index", "band", "score", F.explode(F.array(*[F.lit(m) for m in ("confidence", "directness", "specificity")])).alias("metric"))
    return shaped(metrics.resolve_metrics(corpus_metrics(spark, sf_dir), p, forced=("outlook_strength",), blended=("specificity",)))


@query(f"""WITH {METRIC}, s AS (SELECT *, CASE WHEN order_index % 3 = 0 THEN 'general' ELSE 'model' END AS ai_topic, order_index % 5 / 4.0::DOUBLE AS sure FROM metric), n AS (SELECT *, least(1.0, greatest(0.0, numeric_density * 0.65::DOUBLE + d_specificity * 0.35::DOUBLE)) AS nn FROM s)
  SELECT doc_id, order_index, CASE WHEN ai_topic <> 'general' AND doc_id % 3 <> 0 AND sure * 0.5 >= 0.2 THEN ai_topic ELSE topic END AS topic, array_to_string(list_slice(list_distinct_in_order, 1, 2), '|') AS evidence,
  round(greatest(0.0, least(1.0, d_forward - 0.65::DOUBLE * d_forward_counter)), 4) AS outlook_net, round(greatest(0.0, least(1.0, d_specificity + nn * 0.25::DOUBLE - 0.65::DOUBLE * d_specificity_counter)), 4) AS specificity_net FROM (
    SELECT *, list_filter([sents[len(sents)], sents[1], CASE WHEN len(sents) >= 2 THEN sents[2] END], lambda x, i: x IS NOT NULL AND x <> '' AND list_position([sents[len(sents)], sents[1], CASE WHEN len(sents) >= 2 THEN sents[2] END], x) = i) AS list_distinct_in_order FROM n)""")
def block_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's topic where it weighs enough, evidence from the strongest segment and the first sentences, net densities."""
    m = corpus_metrics(spark, sf_dir)
    i = F.col("order_index")
    ai = m.where("doc_id % 3 != 0").select("doc_id", "order_index", F.when(i % 3 == 0, "general").otherwise("model").alias("ai_topic"), (i % 5 / 4.0).alias("sure"))
    s = T.sentences(F.col("text"))
    out = metrics.with_model_topic(m, ai, 0.5).withColumn("evidence", F.array_join(metrics.evidence(F.get(s, F.size(s) - 1), F.lit(None).cast("string"), F.col("text")), "|"))
    d = metrics.diagnostics(m).select("doc_id", "order_index", F.col("diagnostics.outlook_net_density").alias("outlook_net"), F.col("diagnostics.specificity_net_density").alias("specificity_net"))
    return shaped(out.select("doc_id", "order_index", "topic", "evidence").join(d, ["doc_id", "order_index"]))


@query(f"""WITH {METRIC}, m AS (SELECT * FROM metric WHERE speaker_role = 'management'), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY evasiveness DESC, order_index) AS rank FROM m)
  SELECT doc_id, count(*) AS blocks, round(avg(confidence), 1) AS confidence, arg_max(speaker || ' (' || topic || ')', (outlook, -order_index)) AS lead, string_agg(speaker || ' in ' || topic, '|' ORDER BY rank) FILTER (rank <= 4) AS points FROM r GROUP BY doc_id""")
def call_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in words; numbers are cut out of them here, as engines round halves differently."""
    m = corpus_metrics(spark, sf_dir)
    f = metrics.findings(m)
    lead = F.regexp_extract(F.element_at("takeaways", 3), r"in (.*)\.$", 1)
    points = F.array_join(F.transform("pressure_points", lambda p: F.regexp_replace(p, r": evasiveness [0-9.]+ in (.*)\.$", " in $1")), "|")
    n = metrics.management_only(m).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("confidence"), 1).alias("confidence"))
    return shaped(n.join(f, "doc_id").select("doc_id", "blocks", "confidence", lead.alias("lead"), points.alias("points")))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
  p AS (SELECT doc_id, array_to_string(w[lo + 1:lo + 510], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w), 510)) AS lo FROM w)),
  s AS (SELECT doc_id, avg(least(1.0, (length(t) - length(replace(t, 'e', ''))) / 5000.0))::DOUBLE AS positive, avg(least(1.0, (length(t) - length(replace(t, 'n', ''))) / 5000.0))::DOUBLE AS negative FROM p GROUP BY doc_id)
  SELECT doc_id, round(coalesce(positive, 0.0), 4) AS positive, round(coalesce(negative, 0.0), 4) AS negative, CASE WHEN positive - negative >= 0.25 THEN 'bullish' WHEN positive - negative <= -0.25 THEN 'bearish' ELSE 'neutral' END AS label FROM w LEFT JOIN s USING (doc_id)""")
def model_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts in windows of a model's length, the windows' triples averaged; the model here counts letters."""

    def count(texts: list[str]) -> list[tuple[float, float, float]]:
        return [(min(1.0, t.count("e") / 5000.0), min(1.0, t.count("n") / 5000.0), 0.0) for t in texts]

    d = scorers.windowed_scores(domain.read(spark, sf_dir, "documents").select("doc_id", "text"), count, "text")
    p, n = F.col("triple.positive"), F.col("triple.negative")
    return shaped(d.select("doc_id", p.alias("positive"), n.alias("negative"), scorers.direction_label(p, n).alias("label")))


# --- views ----------------------------------------------------------------------------------------

URLED = BLOCK + ", urled AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'call://' || doc_id END AS url, CASE WHEN (doc_id + order_index) % 3 <> 0 THEN speaker_role END AS known_role FROM block)"


def urled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return domain.blocks(spark, sf_dir).withColumns({"url": F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("call://"), d.cast("string"))), "speaker_role": F.when((d + F.col("order_index")) % 3 != 0, F.col("speaker_role"))})


_TIERS = f"""WITH {URLED}, k AS (SELECT url AS u, lower(trim(speaker)) AS w, section_type, order_index, known_role AS r FROM urled WHERE known_role IS NOT NULL),
  t1 AS (SELECT u, w, section_type, order_index, max(r) AS r FROM k GROUP BY ALL), t2 AS (SELECT w, section_type, order_index, max(r) AS r FROM k WHERE u = '' GROUP BY ALL), t3 AS (SELECT w, section_type, arg_max(r, (order_index, r)) AS r FROM k GROUP BY ALL),
  t4 AS (SELECT w, CASE WHEN count(*) FILTER (r = 'analyst') > count(*) FILTER (r = 'management') THEN 'analyst' ELSE 'management' END AS r FROM k WHERE r IN ('analyst', 'management') GROUP BY w)
  SELECT b.doc_id, b.order_index, coalesce(b.known_role, t1.r, {{two}} t3.r, t4.r) AS hydrated_role, CASE WHEN b.known_role IS NOT NULL THEN 0 WHEN t1.r IS NOT NULL THEN 1 {{tier}} WHEN t3.r IS NOT NULL THEN 3 WHEN t4.r IS NOT NULL THEN 4 END AS tier
  FROM urled b LEFT JOIN t1 ON t1.u = b.url AND t1.w = lower(trim(b.speaker)) AND t1.section_type = b.section_type AND t1.order_index = b.order_index LEFT JOIN t2 ON t2.w = lower(trim(b.speaker)) AND t2.section_type = b.section_type AND t2.order_index = b.order_index
  LEFT JOIN t3 ON t3.w = lower(trim(b.speaker)) AND t3.section_type = b.section_type LEFT JOIN t4 ON t4.w = lower(trim(b.speaker))"""


@query(_TIERS.format(two="t2.r,", tier="WHEN t2.r IS NOT NULL THEN 2"))
def role_hydration_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing roles from stored rows, in four tiers."""
    b = urled(spark, sf_dir)
    return shaped(views.role_tiers(b, b), "doc_id", "order_index", "hydrated_role", "tier")


@query(_TIERS.format(two="", tier=""))
def role_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's three tiers: without that of rows that lack an address."""
    b = urled(spark, sf_dir)
    return shaped(views.role_tiers(b, b, blank_url=False), "doc_id", "order_index", "hydrated_role", "tier")


@query(f"""WITH {URLED}, {METRIC.replace(BLOCK + ",", "")}, m AS (SELECT m.*, CASE WHEN m.doc_id % 2 = 0 THEN u.url ELSE 'other://' || m.doc_id END AS url FROM metric m JOIN urled u USING (doc_id, order_index)),
  a AS (SELECT url, speaker, section_type, order_index, min(confidence) AS c FROM m GROUP BY ALL), f AS (SELECT speaker, section_type, order_index, arg_min(confidence, (url, doc_id)) AS c FROM m GROUP BY ALL)
  SELECT b.doc_id, b.order_index, a.c IS NOT NULL AS exact, coalesce(a.c, f.c) IS NOT NULL AS found FROM urled b LEFT JOIN a ON a.url = b.url AND a.speaker = b.speaker AND a.section_type = b.section_type AND a.order_index = b.order_index
  LEFT JOIN f ON f.speaker = b.speaker AND f.section_type = b.section_type AND f.order_index = b.order_index""")
def blocks_with_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks find metrics under their own address, and which at all."""
    b = urled(spark, sf_dir)
    m = corpus_metrics(spark, sf_dir).join(b.select("doc_id", "order_index", F.col("url").alias("own")), ["doc_id", "order_index"])
    m = m.withColumn("url", F.when(F.col("doc_id") % 2 == 0, F.col("own")).otherwise(F.concat(F.lit("other://"), F.col("doc_id").cast("string"))))
    got = views.with_metrics(b, m, ["confidence"])
    exact = m.select("url", "speaker", "section_type", "order_index", F.lit(True).alias("exact")).distinct()
    return shaped(got.join(exact, ["url", "speaker", "section_type", "order_index"], "left").select("doc_id", "order_index", F.coalesce("exact", F.lit(False)).alias("exact"), F.col("confidence").isNotNull().alias("found")))


@query(f"""WITH {METRIC}, v AS (SELECT doc_id, speaker, section_type, sum(greatest(1, floor(length(text) / 220.0 + 0.5)))::BIGINT AS mentions, count(*) AS blocks, avg(confidence) AS c, avg(evasiveness) AS e FROM metric WHERE section_type = 'qa' GROUP BY ALL)
  SELECT doc_id, speaker, mentions, blocks, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC NULLS LAST, speaker) AS rank,
  CASE WHEN c >= 82 THEN 'very high' WHEN c >= 65 THEN 'high' WHEN c >= 48 THEN 'medium' WHEN c >= 30 THEN 'low' ELSE 'very low' END AS confidence, CASE WHEN e <= 22 THEN 'very low' WHEN e <= 35 THEN 'low' WHEN e <= 52 THEN 'medium' WHEN e <= 70 THEN 'high' ELSE 'very high' END AS evasiveness FROM v""")
def speaker_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's table: one section, all speakers, how much and how they spoke, most first."""
    m = views.filtered(corpus_metrics(spark, sf_dir), section_type="qa", speaker="all")
    t = views.mention_totals(m, ["doc_id", "speaker"]).join(m.groupBy("doc_id", "speaker").agg(F.avg("confidence").alias("c"), F.avg("evasiveness").alias("e")), ["doc_id", "speaker"])
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("mentions").desc_nulls_last(), "speaker"))
    return shaped(t.select("doc_id", "speaker", "mentions", "blocks", rank.alias("rank"), views.confidence_band(F.col("c")).alias("confidence"), views.evasiveness_band(F.col("e")).alias("evasiveness")))


@query(r"""WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN '2021-Q' || (o_orderkey % 6 + 1) END AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'Some q' || (o_orderkey % 4 + 1) || ' 2022 call' END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS date FROM orders),
  k AS (SELECT doc_id, coalesce(CASE WHEN regexp_matches(label, '^[0-9]+-Q[1-4]$') THEN label END, CASE WHEN title IS NOT NULL THEN '2022-Q' || (doc_id % 4 + 1) END, year(date) || '-Q' || quarter(date)) AS quarter FROM d)
  SELECT quarter, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM k WHERE quarter IS NOT NULL GROUP BY quarter""")
def documents_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = domain.read(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.when(k % 4 == 0, F.concat(F.lit("2021-Q"), (k % 6 + 1).cast("string"))).alias("label"), F.when(k % 3 == 0, F.concat(F.lit("Some q"), (k % 4 + 1).cast("string"), F.lit(" 2022 call"))).alias("title"),
        F.when(k % 5 != 0, F.col("o_orderdate")).alias("date"),
    )
    return shaped(views.documents_by_quarter(d))


# --- quarters and discovery -----------------------------------------------------------------------

WANTED = """want AS (SELECT 'SYM' || s AS symbol, '2022-Q' || (4 - p) AS quarter, p AS place FROM range(0, 5) a(s), range(0, 4) b(p)),
cq AS (SELECT 'SYM' || page_id % 5 AS symbol, (2020 + page_id % 3) || '-Q' || (CASE WHEN page_id % 5 = 2 THEN page_id % 2 * 2 + 1 ELSE page_id % 4 + 1 END) AS quarter, page_id AS ord, url FROM pages),
good AS (SELECT symbol, quarter, min(ord) AS ord FROM cq WHERE symbol <> 'SYM4' GROUP BY ALL), bad AS (SELECT symbol, quarter, ord, CASE WHEN ord % 2 = 0 THEN 'timed out' ELSE '' END AS error FROM cq WHERE symbol = 'SYM4')"""


def wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(requested, found, errors, discovery): pages of four symbols are transcripts, those of the fifth fail; nothing was discovered for Q2."""
    s = F.concat(F.lit("SYM"), F.col("id").cast("string"))
    req = spark.range(5).select(s.alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place")).withColumn("quarter", F.concat(F.lit("2022-Q"), (F.lit(4) - F.col("place")).cast("string")))
    i = F.col("page_id")
    q = F.when(i % 5 == 2, i % 2 * 2 + 1).otherwise(i % 4 + 1)
    c = domain.read(spark, sf_dir, "pages").select(F.concat(F.lit("SYM"), (i % 5).cast("string")).alias("symbol"), quarters.quarter_label(i % 3 + 2020, q).alias("quarter"), i.alias("ord"), "url")
    found = c.where("symbol != 'SYM4'").groupBy("symbol", "quarter").agg(F.min("ord").alias("ord"))
    errors = c.where("symbol = 'SYM4'").select("symbol", "quarter", "ord", F.when(F.col("ord") % 2 == 0, "timed out").otherwise("").alias("error"))
    disc = req.select("symbol", "quarter", F.when(F.col("quarter") == "2022-Q2", "not_found").otherwise("found").alias("status"))
    return req, found, errors, disc


OUT = f"""{WANTED}, last AS (SELECT symbol, quarter, arg_max(error, ord) AS error, min(ord) AS ord FROM bad GROUP BY ALL),
outcome AS (SELECT w.symbol, w.quarter, w.place, CASE WHEN g.ord IS NOT NULL THEN 'found' WHEN l.ord IS NOT NULL THEN 'error' ELSE 'not_found' END AS status,
  CASE WHEN g.ord IS NOT NULL THEN NULL WHEN l.ord IS NOT NULL THEN CASE WHEN l.error = '' THEN 'Scrape error.' ELSE l.error END WHEN w.quarter = '2022-Q2' THEN 'No transcript URL resolved during discovery.' ELSE 'Transcript was not available after discovery and scrape.' END AS detail
  FROM want w LEFT JOIN good g USING (symbol, quarter) LEFT JOIN last l USING (symbol, quarter)
  UNION ALL SELECT symbol, quarter, ord + 1000000, 'error', CASE WHEN error = '' THEN 'Scrape error.' ELSE error END FROM last l WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.symbol = l.symbol AND w.quarter = l.quarter))"""


@query(f"WITH {OUT} SELECT * FROM outcome")
def quarter_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every quarter asked for, and errors beyond the request."""
    return shaped(quarters.outcomes(*wanted(spark, sf_dir)))


@query(f"""WITH {OUT} SELECT symbol, coalesce(string_agg(quarter, ',' ORDER BY place) FILTER (status = 'found'), '') AS found, coalesce(string_agg(quarter, ',' ORDER BY place) FILTER (status = 'not_found'), '') AS missing,
  coalesce(string_agg(quarter || ': ' || detail, ',' ORDER BY place) FILTER (status = 'error'), '') AS errors, count(*) AS selected FROM outcome GROUP BY symbol""")
def quarter_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(quarters.diagnostics(quarters.outcomes(*wanted(spark, sf_dir))))


@query(f"WITH {WANTED} SELECT symbol, quarter, ord, rank FROM (SELECT g.*, row_number() OVER (PARTITION BY g.symbol ORDER BY w.place IS NULL, w.place, g.ord) AS rank FROM good g LEFT JOIN want w USING (symbol, quarter)) WHERE rank <= 6")
def requested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    req, found, _, _ = wanted(spark, sf_dir)
    return shaped(quarters.in_requested_order(found, req, 6), "symbol", "quarter", "ord", "rank")


@query(f"""WITH {WANTED}, a AS (SELECT symbol, ord, ord % 3 <> 1 AS parsed, row_number() OVER (PARTITION BY symbol ORDER BY ord) AS attempt FROM cq), b AS (SELECT *, coalesce(count(*) FILTER (parsed) OVER (PARTITION BY symbol ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a WHERE attempt <= 32)
  SELECT symbol, ord, attempt, parsed AS taken FROM b WHERE before < 4""")
def fetch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates tried in order until four bodies are parsed."""
    p = domain.read(spark, sf_dir, "pages").select(F.concat(F.lit("SYM"), (F.col("page_id") % 5).cast("string")).alias("symbol"), F.col("page_id").alias("ord"), (F.col("page_id") % 3 != 1).alias("parsed"))
    return shaped(quarters.first_parsed(p, 4), "symbol", "ord", "attempt", "taken")


@query(f"""WITH {WANTED}, c AS (SELECT *, ord % 7 AS quality, CASE WHEN ord % 4 = 0 THEN 'sitemap' WHEN ord % 4 = 1 THEN 'author' ELSE 'search' END AS phase FROM cq), o AS (SELECT w.symbol, w.quarter, c.url, c.phase, row_number() OVER (PARTITION BY w.symbol, w.quarter
  ORDER BY CASE c.phase WHEN 'sitemap' THEN 0 WHEN 'author' THEN 1 ELSE 2 END, c.quality DESC, c.ord) AS n FROM want w LEFT JOIN c USING (symbol, quarter)) SELECT symbol, quarter, url, phase, CASE WHEN url IS NULL THEN 'not_found' ELSE 'found' END AS status FROM o WHERE n = 1""")
def discovery_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters filled by the sitemap first, by author pages next, by a search last."""
    req = wanted(spark, sf_dir)[0]
    i = F.col("page_id")
    q = F.when(i % 5 == 2, i % 2 * 2 + 1).otherwise(i % 4 + 1)
    c = domain.read(spark, sf_dir, "pages").select(F.concat(F.lit("SYM"), (i % 5).cast("string")).alias("symbol"), quarters.quarter_label(i % 3 + 2020, q).alias("quarter"), i.alias("ord"), "url", (i % 7).alias("quality"), (i % 4).alias("kind"))
    return shaped(quarters.discovery_phases([("sitemap", c.where("kind = 0")), ("author", c.where("kind = 1")), ("search", c.where("kind > 1"))], req))


@query("""WITH p AS (SELECT page_id % 11 AS author, page_id // 11 AS page, CASE WHEN page_id % 11 < 6 AND page_id // 11 % 5 IN (3, 4) THEN 0 ELSE 1 END AS hits FROM pages),
  s AS (SELECT *, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY author ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AND page >= 3 AS stop FROM p), l AS (SELECT *, min(CASE WHEN stop THEN page END) OVER (PARTITION BY author) AS last FROM s)
  SELECT author, page, hits FROM l WHERE last IS NULL OR page <= last""")
def author_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages read until two in a row bring nothing."""
    i = F.col("page_id")
    page = F.expr("page_id div 11")
    p = domain.read(spark, sf_dir, "pages").select((i % 11).alias("author"), page.alias("page"), F.when((i % 11 < 6) & (page % 5).isin(3, 4), 0).otherwise(1).alias("hits"))
    return shaped(quarters.page_scan(p, ["author"]), "author", "page", "hits")


_LINKS = r"list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*[^>]*>.*?</a>'), lambda a: {'url': regexp_extract(a, '(?is)\bhref\s*=\s*[\"'']?([^\"''\s>]*)', 1), 'title': trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))}), lambda x: x.url <> '')"


@query(f"SELECT page_id, CAST(i AS BIGINT) AS place, l[i].url AS url, l[i].title AS title FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, {_LINKS} AS l FROM pages))")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all pages."""
    p = domain.read(spark, sf_dir, "pages").select("page_id", F.posexplode(candidates.anchors(F.col("html"))).alias("i", "x"))
    return p.select("page_id", (F.col("i") + 1).cast("bigint").alias("place"), "x.url", "x.title")


MONTHS = """mo AS (SELECT 'SYM' || s AS symbol, DATE '2022-01-01' + to_months(CAST(k AS INTEGER)) AS month FROM range(0, 5) a(s), range(0, 24) b(k)),
hit AS (SELECT 'SYM' || page_id % 5 AS symbol, CAST(DATE '2022-01-01' + to_months(CAST(page_id % 24 AS INTEGER)) AS DATE) AS month, '2022-Q' || (page_id * 7 % 12) AS quarter FROM pages),
fresh AS (SELECT symbol, month, count(*) AS new FROM (SELECT symbol, quarter, max(month) AS month FROM hit GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {MONTHS}, c AS (SELECT m.symbol, CAST(m.month AS DATE) AS month, coalesce(new, 0) AS new, coalesce(sum(coalesce(new, 0)) OVER (PARTITION BY m.symbol ORDER BY m.month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS covered
  FROM mo m LEFT JOIN fresh f ON f.symbol = m.symbol AND f.month = CAST(m.month AS DATE)) SELECT symbol, month, new, covered FROM c WHERE covered < 4""")
def sitemap_month_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sitemaps read from the newest until four quarters are covered; the months come from the sitemaps' addresses."""
    urls = spark.range(24).select(F.format_string("https://x.org/sitemap/%d/%02d/", F.expr("2022 + id div 12"), F.col("id") % 12 + 1).alias("url")).unionByName(spark.createDataFrame([("https://x.org/sitemap/2022/13/",), ("https://x.org/about/",)], "url string"))
    months = candidates.sitemap_months(urls).select("month").join(spark.range(5).select(F.concat(F.lit("SYM"), F.col("id").cast("string")).alias("symbol")).hint("broadcast"), F.lit(True))
    i = F.col("page_id")
    found = domain.read(spark, sf_dir, "pages").select(F.concat(F.lit("SYM"), (i % 5).cast("string")).alias("symbol"), F.add_months(F.lit("2022-01-01").cast("date"), (i % 24).cast("int")).alias("month"), F.concat(F.lit("2022-Q"), (i * 7 % 12).cast("string")).alias("quarter"))
    return shaped(candidates.scan_months(months, found, 4), "symbol", "month", "new", "covered")


SLUGS = (
    ("https://www.fool.com/earnings/call-transcripts/2024/02/01/apple-aapl-q1-2024-earnings-call-transcript/", "Apple (AAPL) Q1 2024 Earnings Call Transcript"), ("https://www.fool.com/earnings/2024/big-retail-group-results.aspx", "Big Retail Group news"),
    ("https://x.org/", ""), ("http://fool.com/earnings/call-transcripts/2023/11/30/acme-corp-acm-q4-2023-earnings-call-transcript", "Conference Call Transcript of Acme"),
)


SLUGS_READ = """('https://www.fool.com/earnings/call-transcripts/2024/02/01/apple-aapl-q1-2024-earnings-call-transcript/', TRUE, TRUE, DATE '2024-02-01', 'Apple AAPL Q1 2024 Earnings Call Transcript', 'apple', 'Apple-AAPL-Q1-2024-Earnings-Call-Transcript'),
  ('https://www.fool.com/earnings/2024/big-retail-group-results.aspx', FALSE, FALSE, NULL, 'Big Retail Group Results Earnings Call Transcript', 'big,retail,results,news', 'Big-Retail-Group-news'), ('https://x.org/', FALSE, FALSE, NULL, 'X.org Earnings Call Transcript', '', 'item'),
  ('http://fool.com/earnings/call-transcripts/2023/11/30/acme-corp-acm-q4-2023-earnings-call-transcript', TRUE, TRUE, DATE '2023-11-30', 'Acme Corp Acm Q4 2023 Earnings Call Transcript', 'acme,acm', 'Conference-Call-Transcript-of-Acme')"""


@query(f"""WITH p AS (SELECT page_id AS i, regexp_extract(lower(url), '//(?:[a-z]+[.])?([a-z]+)[.]example', 1) AS w, 2020 + page_id % 5 AS y, page_id % 13 + 1 AS m, page_id % 28 + 1 AS d, page_id % 4 + 1 AS q FROM pages)
  SELECT * FROM (VALUES {SLUGS_READ}) t(url, is_title, is_url, date, title, tokens, file)
  UNION ALL SELECT 'https://www.fool.com/earnings/call-transcripts/' || y || '/' || lpad(m::VARCHAR, 2, '0') || '/' || lpad(d::VARCHAR, 2, '0') || '/' || w || '-sym-q' || q || '-' || y || '-earnings-call-transcript' || CASE WHEN i % 2 = 0 THEN '/' ELSE '' END, TRUE, TRUE,
  CASE WHEN m <= 12 THEN make_date(y, m, d) END, CASE WHEN w = '' THEN '' ELSE upper(left(w, 1)) || substr(w, 2) || ' ' END || 'Sym Q' || q || ' ' || y || ' Earnings Call Transcript',
  CASE WHEN length(w) >= 3 AND w NOT IN ('earnings', 'call', 'transcript', 'conference', 'inc', 'incorporated', 'corp', 'corporation', 'company', 'class', 'common', 'stock', 'holding', 'holdings', 'group', 'global', 'limited', 'ltd', 'plc', 'the', 'and') THEN w || ',' ELSE '' END || 'sym',
  CASE WHEN w = '' THEN '' ELSE w || '-' END || 'SYM-Q' || q || '-' || y || '-Earnings-Call-Transcript' FROM p""")
def slug_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an address tells: whether it is a transcript, its date, a title, the company's words. Addresses are made of the pages' hosts and ids, every thirteenth with a month that there is not."""
    u, t = F.col("url"), F.col("t")
    i, host = F.col("page_id"), F.regexp_extract(F.lower("url"), "//(?:[a-z]+[.])?([a-z]+)[.]example", 1)
    at = F.format_string("https://www.fool.com/earnings/call-transcripts/%d/%02d/%02d/%s-sym-q%d-%d-earnings-call-transcript%s", i % 5 + 2020, i % 13 + 1, i % 28 + 1, host, i % 4 + 1, i % 5 + 2020, F.when(i % 2 == 0, "/").otherwise(""))
    made = domain.read(spark, sf_dir, "pages").select(at.alias("url"), F.format_string("%s (SYM) Q%d %d Earnings Call Transcript", host, i % 4 + 1, i % 5 + 2020).alias("t"))
    rows = spark.createDataFrame(SLUGS, "url string, t string").unionByName(made)
    return rows.select(
        "url", candidates.is_transcript_title(t).alias("is_title"), candidates.is_transcript_url(u, "fool.com").alias("is_url"), candidates.url_date(u).alias("date"), candidates.slug_title(u, "AAPL").alias("title"),
        F.array_join(candidates.slug_tokens(u, t, "AAPL"), ",").alias("tokens"), candidates.safe_name(F.regexp_replace(t, r"[()]", "")).alias("file"),
    )


@query("SELECT page_id, url, 'FR::2024-Q1::' || substr(sha1(coalesce(url, '')), 1, 12) AS cache_key FROM pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.read(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("FR::2024-Q1::"), candidates.cache_key(F.col("url"))).alias("cache_key"))


@query(f"""WITH r AS (SELECT page_id, substr(sha1('SYM' || page_id % 5 || '|2024-Q1|' || coalesce(url, '')), 1, 12) AS key, html FROM pages),
  e AS (SELECT key, page_id, {AS_OF} - to_hours(page_id * 7 % 60) AS seen, 'first ' || page_id AS payload FROM r WHERE page_id % 3 <> 0 UNION ALL SELECT key, page_id, {AS_OF} - to_hours(page_id * 5 % 30 - 2), 'second ' || page_id FROM r WHERE page_id % 4 = 0),
  n AS (SELECT key, max(seen) AS seen, arg_max(payload, (seen, payload)) AS payload FROM e WHERE seen <= {AS_OF} GROUP BY key),
  s AS (SELECT r.*, n.seen, payload, CASE WHEN seen IS NULL THEN 'miss' WHEN {AS_OF} - seen >= INTERVAL 24 HOUR THEN 'stale' ELSE 'hit' END AS status FROM r LEFT JOIN n USING (key)),
  f AS (SELECT key, max(length(html)) AS chars FROM s WHERE status <> 'hit' GROUP BY key)
  SELECT page_id, key, status, CASE WHEN status = 'hit' THEN payload ELSE 'fetched ' || chars END AS payload, 'hit' AS again FROM s LEFT JOIN f USING (key)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what a store of two appends, then compacted, holds of them: hit, stale or miss, the payload after fetching what is not a hit, and the status of a second run."""
    path, at, i = f"{base_path(spark)}/{uuid.uuid4().hex}", domain.as_of(), F.col("page_id")
    key = candidates.cache_key(F.concat(F.lit("SYM"), (i % 5).cast("string")), F.lit("2024-Q1"), F.col("url"))
    # of pages with one key the longest is fetched
    r = domain.read(spark, sf_dir, "pages").select(F.length("html").alias("chars"), key.alias("key"), "page_id")
    before = lambda hours: F.timestamp_seconds(F.unix_timestamp(at) - hours * 3600)
    cache.append(r.where(i % 3 != 0).select("key", before(i * 7 % 60).alias("at"), F.concat(F.lit("first "), i).alias("payload")), path)
    late = i * 5 % 30 - 2
    second = r.where(i % 4 == 0).select("key", before(late).alias("at"), F.concat(F.lit("second "), i).alias("payload"))
    cache.append(second, path)
    first = store(cache.lookup(r, cache.entries(spark, path), at, 86_400).select("page_id", "key", "status"))
    done = cache.through(r, path, lambda open_: open_.select("key", F.concat(F.lit("fetched "), "chars").alias("payload")), at, 86_400).select("page_id", "payload")
    done = store(done)
    cache.vacuum(spark, path, cache.compact(spark, path, at))
    again = cache.lookup(r, cache.entries(spark, path), at, 86_400).select("page_id", F.col("status").alias("again"))
    return first.join(done, "page_id").join(again, "page_id")


@query(f"""WITH {WANTED}, t AS (SELECT symbol, ord, url, ord % 2 = 0 AS titled, ord % 6 = 0 AS matched FROM cq) SELECT symbol, ord, n FROM (SELECT symbol, ord, row_number() OVER (PARTITION BY symbol ORDER BY ord) AS n FROM t WHERE titled AND (symbol, url) NOT IN (SELECT (symbol, url) FROM t WHERE titled AND matched)) WHERE n <= 25""")
def near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript-like candidates that another company's name was on."""
    p = domain.read(spark, sf_dir, "pages").select(F.concat(F.lit("SYM"), (F.col("page_id") % 5).cast("string")).alias("symbol"), F.col("page_id").alias("ord"), "url")
    titled = p.where("ord % 2 = 0")
    return shaped(candidates.near_matches(titled, titled.where("ord % 6 = 0"), ["symbol"]), "symbol", "ord", "n")


# --- audits ---------------------------------------------------------------------------------------

ERRORS = ("Read timeout after 30 s", "nodename nor servname provided", "Expecting value: line 1", "No source URLs in answer", "HTTP 500", "", "No route to host")


ERRORS_READ = "('Read timeout after 30 s', 'timeout', TRUE), ('nodename nor servname provided', 'dns_error', FALSE), ('Expecting value: line 1', 'parse_error', FALSE), ('No source URLs in answer', 'empty_source_set', TRUE), ('HTTP 500', 'unknown_error', TRUE), ('', 'unknown_error', TRUE), ('No route to host', 'unknown_error', FALSE)"


@query(f"""WITH seed AS (SELECT row_number() OVER () - 1 AS k, error, kind, retry FROM (VALUES {ERRORS_READ}) t(error, kind, retry))
  SELECT error, kind, retry FROM seed UNION ALL SELECT event_type || ' ' || event_id || ': ' || upper(error), kind, retry FROM events JOIN seed ON k = event_id % 7""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the events' runs, a message with each, and the messages alone."""
    seed = F.array(*[F.lit(e) for e in ERRORS])
    said = F.concat("event_type", F.lit(" "), "event_id", F.lit(": "), F.upper(F.get(seed, (F.col("event_id") % len(ERRORS)).cast("int"))))
    rows = spark.createDataFrame([(e,) for e in ERRORS], "error string").unionByName(domain.read(spark, sf_dir, "events").select(said.alias("error")))
    return rows.withColumn("k", audit.retry_kind(F.col("error"))).select("error", "k.kind", "k.retry")


_JOB_STAGES = {"news": 3.0, "social": 2.0, "scores": 5.0}
_JOB_EVENTS = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
  e AS (SELECT user_id * 1000000 + n // 12 AS job_id, ts, event_id, ['news', 'social', 'scores'][event_id % 3 + 1] AS stage, value / 200 AS progress, CASE WHEN event_id % 10 > 0 THEN 'm' || event_id END AS message,
    CASE WHEN n % 12 = 0 THEN 'queued' WHEN n % 12 = 1 THEN 'running' WHEN n % 12 = 11 THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END WHEN n % 12 = 9 AND n // 12 % 2 = 0 THEN 'completed'
      ELSE ['stage_started', 'stage_progress', 'stage_completed', 'stage_failed'][event_id // 3 % 4 + 1] END AS event FROM n)"""
_JOB_STATE = """max_by(CASE event WHEN 'stage_completed' THEN 'done' WHEN 'stage_failed' THEN 'error' ELSE 'loading' END, (ts, event_id)) FILTER (stage = '{0}' AND event LIKE 'stage%')"""
_JOB_PART = """coalesce(max(CASE event WHEN 'stage_started' THEN 0.02 WHEN 'stage_progress' THEN greatest(0.0, least(0.99, progress)) WHEN 'stage_completed' THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (stage = '{0}'), 0.0)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve events of a user in a row as a job: queued, running, stages, an end; every other job ends three events early."""
    n = domain.read(spark, sf_dir, "events").selectExpr("*", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n")
    return n.selectExpr(
        "user_id * 1000000 + n DIV 12 AS job_id", "ts", "event_id AS seq", "element_at(array('news', 'social', 'scores'), int(event_id % 3) + 1) AS stage", "value / 200 AS progress", "CASE WHEN event_id % 10 > 0 THEN 'm' || event_id END AS message",
        "CASE WHEN n % 12 = 0 THEN 'queued' WHEN n % 12 = 1 THEN 'running' WHEN n % 12 = 11 THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END WHEN n % 12 = 9 AND n DIV 12 % 2 = 0 THEN 'completed' "
        "ELSE element_at(array('stage_started', 'stage_progress', 'stage_completed', 'stage_failed'), int(event_id DIV 3 % 4) + 1) END AS event",
    )


@query(f"""WITH {_JOB_EVENTS}, s AS (SELECT *, CASE WHEN event NOT LIKE 'stage%' THEN event END AS status FROM e WHERE ts <= TIMESTAMP '2024-01-25 12:00:00'),
  p AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS last_ts FROM s),
  k AS (SELECT * FROM (SELECT *, max(coalesce(was IN ('completed', 'failed') AND ts - last_ts > INTERVAL 18 HOUR, false)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS late FROM p) WHERE NOT late),
  g AS (SELECT job_id, max_by(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status, max(ts) AS updated_ts, list(message ORDER BY ts DESC, event_id DESC)[:5] AS m,
    {", ".join(_JOB_PART.format(s) + f" AS p{k}, coalesce({_JOB_STATE.format(s)}, 'pending') AS s{k}" for k, s in enumerate(_JOB_STAGES))} FROM k GROUP BY job_id)
  SELECT job_id, status, round((p0 * 3 + p1 * 2 + p2 * 5) * 10, 4) AS percent, strftime(updated_ts, '%Y-%m-%d %H:%M:%S') AS updated, array_to_string(list_reverse(list_filter(m, lambda x: x IS NOT NULL)), ',') AS messages,
    CASE WHEN s0 = 'loading' THEN 'news' WHEN s1 = 'loading' THEN 'social' WHEN s2 = 'loading' THEN 'scores' WHEN s0 <> 'done' THEN 'news' WHEN s1 <> 'done' THEN 'social' WHEN s2 <> 'done' THEN 'scores' END AS active_stage
  FROM g WHERE status NOT IN ('completed', 'failed') OR TIMESTAMP '2024-01-25 12:00:00' - updated_ts <= INTERVAL 18 HOUR""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and progress of the jobs held at a moment; finished ones are kept for 18 hours here."""
    j = jobs.job_snapshots(job_events(spark, sf_dir), F.lit("2024-01-25 12:00:00").cast("timestamp"), _JOB_STAGES, ttl_seconds=18 * 3600, most=5)
    return shaped(j.withColumns({"messages": F.array_join("messages", ","), "updated": F.date_format("updated_ts", "yyyy-MM-dd HH:mm:ss")}).drop("updated_ts"))


@query("""WITH e AS (SELECT user_id % 9 AS run_id, event_id, event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'sitemap' ELSE 'author' END AS phase FROM events),
  p AS (SELECT run_id, count(*)::BIGINT AS pages FROM e GROUP BY run_id), f AS (SELECT run_id, phase || ':' || event_type || ': failed ' || event_id AS said, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM e)
  SELECT p.run_id, pages, count(*) AS failures, max(said) FILTER (n = 1) AS first FROM p JOIN f USING (run_id) WHERE n <= 50 GROUP BY ALL""")
def discovery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages scanned by all phases and the first failures of each run."""
    e = domain.read(spark, sf_dir, "events")
    least = e.agg(F.min("event_type")).first()[0]
    e = e.select((F.col("user_id") % 9).alias("run_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("category"), F.when(F.col("event_type") == least, "sitemap").otherwise("author").alias("phase"), F.concat(F.lit("failed "), "event_id").alias("error"))
    phases = e.groupBy("run_id", "phase").agg(F.count(F.lit(1)).alias("n")).select("run_id", "phase", F.when(F.col("phase") == "sitemap", F.col("n")).alias("months_scanned"), F.when(F.col("phase") != "sitemap", F.col("n")).alias("pages_scanned"))
    out = audit.discovery_totals(phases, e, ["run_id"])
    return shaped(out.select("run_id", "pages", F.size("failures").alias("failures"), F.get("failures", F.lit(0)).alias("first")))


@query("""WITH d AS (SELECT conv_id % 7 AS run_id, conv_id, CASE WHEN conv_id % 7 < 3 OR conv_id % 2 = 0 THEN 'openai' ELSE 'regex' END AS mode, CASE WHEN conv_id % 7 < 3 OR conv_id % 2 = 0 THEN 0.92 WHEN conv_id % 3 = 0 THEN 0.52 WHEN conv_id % 5 = 0 THEN 0.70 ELSE 0.78 END::DOUBLE AS confidence FROM (SELECT DISTINCT conv_id FROM conversations))
  SELECT run_id, count(*) AS documents, round(avg(confidence) + 1e-7, 4) AS confidence, CASE WHEN bool_and(mode = 'openai') THEN 'openai' ELSE 'deterministic_degraded' END AS mode FROM d GROUP BY run_id""")
def document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the documents of a run are trusted and how they were normalised."""
    c = F.col("conv_id")
    ai = (c % 7 < 3) | (c % 2 == 0)
    d = domain.read(spark, sf_dir, "conversations").select("conv_id").distinct()
    method = F.when(ai, "openai").when(c % 5 == 0, F.when(c % 3 == 0, "regex").otherwise("other")).otherwise("regex_from_page_text")
    d = d.select((c % 7).alias("run_id"), F.when(ai, "openai").otherwise("regex").alias("mode"), audit.parse_confidence(method, c % 3 == 0).alias("confidence"))
    return shaped(audit.document_totals(d, ["run_id"]).withColumn("confidence", F.col("confidence") + 1e-7))


@query("""WITH j AS (SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'error' ELSE 'done' END AS status, CASE WHEN event_id % 4 <> 0 THEN ts END AS finished_ts FROM events)
  SELECT job_id, status FROM j WHERE status = 'running' OR finished_ts IS NULL OR epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(finished_ts)) <= 900""")
def held_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a store with a time to live still holds."""
    k = F.col("event_id")
    j = domain.read(spark, sf_dir, "events").select(k.alias("job_id"), F.when(k % 4 == 0, "running").when(k % 4 == 1, "error").otherwise("done").alias("status"), F.when(k % 4 != 0, F.col("ts")).alias("finished_ts"))
    return audit.job_states(j, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("job_id", "status")


@query("""SELECT run_id, place, event_id FROM (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS place FROM (SELECT user_id % 9 AS run_id, event_id, row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id DESC) AS n FROM events) WHERE n <= 80)""")
def progress_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.read(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("run_id"), "event_id", F.col("event_id").alias("ord"))
    return shaped(audit.last_messages(e, ["run_id"]), "run_id", "place", "event_id")

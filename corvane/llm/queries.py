"""The subpackage's queries, each an operator on a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, htmlextract, langid, linededup, mixing, negatives, periodic, pii, quality, simhash, suffixdedup, urls
from .common import SPACE_WORD, table

#: Pseudonyms are only as secret as this key: production passes its own.
PII_KEY = "corvane pseudonym key 1"
#: The dated list of op4: fixed values (kind, pattern, action, day).
URL_LIST = (
    ("domain", "example.org", "add", "2024-01-10"),
    ("domain", "example.org", "remove", "2024-02-20"),
    ("domain", "example.org", "add", "2024-05-01"),
    ("domain", "tionsh.example.net", "add", "2024-03-01"),
    ("host", "blog.tionsh.example.net", "remove", "2024-03-15"),
    ("host", "blog.tiontion.example.com", "add", "2024-02-01"),
    ("host", "blog.tiontion.example.com", "add", "2024-03-01"),
    ("host", "blog.tiontion.example.com", "remove", "2024-04-01"),
    ("prefix", "m.ththth.example.net/en", "add", "2024-01-20"),
    ("prefix", "ththre.example.com/fr", "add", "2024-02-10"),
    ("prefix", "ththre.example.com/fr", "remove", "2024-06-01"),
    ("host", "thther.example.org", "add", "2024-01-01"),
)
URL_ROWS = ", ".join(f"('{k}', '{p}', '{a}', TIMESTAMP '{d} 00:00:00')" for k, p, a, d in URL_LIST)
#: Captures have no fetch time in the table: one is spread over 180 days by page_id.
FETCHED = "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, CAST(page_id * 7919 % 15552000 AS DECIMAL(18,6)))"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = chat.format_chats(rows.unionByName(extra.withColumn("turn", F.col("turn").cast(rows.schema["turn"].dataType))))
    read = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.STATS, "base_failed", "host_ok", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    entries = spark.sql(f"SELECT * FROM VALUES {URL_ROWS} AS t(kind, pattern, action, at)")
    out = urls.filter_urls(captures, entries)
    return out.select("page_id", "url", "fetched_at", "blocked", F.size("matched").cast("bigint").alias("n_matched"), F.array_join("matched", ",").alias("matched"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, detail=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonyms(docs, key=PII_KEY)
    return out.select("doc_id", "text", *[F.col(f"n_pii.{k}").alias(f"n_{k}") for k in pii.COUNTED])


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # a document without an id has no remainder: it is never learned from, so it counts as held out
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return negatives.hard_negatives(rows, anchor=F.col("vec_id") % 100 == 0)


#: The text of a document, in which a tenth of the documents repeat their words from one on with a period.
PLANTED = f"""CASE WHEN h % 10 = 0 AND size(w) > 0 THEN array_join(transform(w, (x, i) -> IF(i < h div 10 % size(w), x,
  w[CAST(h div 10 % size(w) + (i - h div 10 % size(w)) % (1 + (size(w) - h div 10 % size(w)) div (3 + h div 10 % 8)) AS INT)])), ' ') ELSE text END"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    # words are cut only where they are moved
    moved = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0))))
    return periodic.find_runs(moved.select("doc_id", F.expr(PLANTED).alias("text")), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_quality_rules, op3_decontamination, op4_url_filters, op5_line_dedup,
        op6_pii, op7_html_extraction, op8_simhash, op9_mixing, op10_language_id,
        op11_suffix_dedup, op12_hard_negatives, op13_periodic_runs,
    )
}


def _escape_sql(text: str) -> str:
    out = rf"replace({text}, '\', '\e')"
    for word in chat.CONTROL:
        out = f"replace({out}, '{word}', '{chat.OPENERS[word[0]]}{word[1:]}')"
    return out


OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER w AS before, {_escape_sql("text")} AS safe_text, replace({_escape_sql("role")}, chr(10), '\\n') AS safe_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe_text) + CASE WHEN before IS NOT DISTINCT FROM role THEN {len(chat.NEXT)}
    ELSE {len(chat.START)} + length(safe_role) + 1 + {len(chat.END)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_RATE = "({f} + m.{r}_m * s.{r}_s) / (h.n_docs + s.{r}_s)"
OP2_SQL = f"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
stats AS (
  SELECT doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN reps USING (doc_id)),
hosts AS (SELECT source, count(*) AS n_docs, {", ".join(f"sum(CASE WHEN {sql} THEN 1 ELSE 0 END) AS {r}_f" for r, sql in quality.RULES.items())} FROM stats GROUP BY source),
m AS (SELECT {", ".join(f"avg({r}_f / n_docs) AS {r}_m, var_pop({r}_f / n_docs) AS {r}_v" for r in quality.RULES)} FROM hosts),
s AS (SELECT {", ".join(f"CASE WHEN {r}_v > 0 THEN least(greatest({r}_m * (1 - {r}_m) / {r}_v - 1, 1.0), 1e6) ELSE 1.0 END AS {r}_s" for r in quality.RULES)} FROM m),
verdicts AS (SELECT h.source, greatest({", ".join(_RATE.format(f=f"h.{r}_f", r=r) for r in quality.RULES)}) <= 0.5 AS host_ok FROM hosts h, m, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({quality.RULES["base"]}) AS base_failed, host_ok, NOT ({quality.RULES["base"]}) AND host_ok AS kept
FROM stats JOIN verdicts ON stats.source IS NOT DISTINCT FROM verdicts.source"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NWORDS = rf"list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_NWORDS} AS w FROM documents),
b AS (SELECT item_id, {_NWORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN g USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

_SQL_HOST = rf"rtrim(lower(regexp_extract(coalesce(url, ''), '{urls.HOST}', 1)), '.')"
_SQL_KEY = "substr(kind, 1, 1) || ':' || CASE WHEN kind = 'prefix' THEN lower(string_split(p, '/')[1]) || substr(p, length(string_split(p, '/')[1]) + 1) ELSE lower(p) END"
OP4_SQL = f"""
WITH e AS (SELECT {_SQL_KEY} AS key, action, ts FROM (SELECT kind, rtrim(trim(pattern), './') AS p, action, ts FROM (VALUES {URL_ROWS}) t(kind, pattern, action, ts))),
one AS (SELECT key, ts, max(action) AS action FROM e GROUP BY key, ts),
iv AS (SELECT * FROM (SELECT key, action, ts AS a, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS b FROM one) WHERE action = 'add'),
c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 7919 % 15552000) AS fetched_at, {_SQL_HOST} AS host,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '{urls.PATH}', 1), '/'), lambda x: x <> '') AS steps FROM pages),
k AS (
  SELECT page_id, 'h:' || host AS key FROM c WHERE host <> ''
  UNION SELECT page_id, 'd:' || array_to_string(l[i:], '.') FROM (SELECT page_id, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')
  UNION SELECT page_id, 'p:' || host || '/' || array_to_string(steps[1:i], '/') FROM (SELECT page_id, host, steps, unnest(range(1, len(steps) + 1)) AS i FROM c WHERE host <> '')),
f AS (SELECT c.page_id, string_agg(DISTINCT k.key, ',' ORDER BY k.key) AS matched, count(DISTINCT k.key) AS n
  FROM c JOIN k USING (page_id) JOIN iv ON iv.key = k.key AND iv.a <= c.fetched_at AND (iv.b IS NULL OR c.fetched_at < iv.b) GROUP BY c.page_id)
SELECT c.page_id, c.url, c.fetched_at, f.n IS NOT NULL AS blocked, coalesce(f.n, 0) AS n_matched, coalesce(f.matched, '') AS matched FROM c LEFT JOIN f USING (page_id)"""

OP5_SQL = rf"""
WITH l AS (SELECT doc_id, i - 1 AS line, list_filter(string_split_regex(raw[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, raw[i] AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, line, t, len(w) AS n, w, array_to_string(w, ' ') AS form, row_number() OVER (ORDER BY doc_id, line) AS o FROM l),
first AS (SELECT form, min(o) AS o, any_value(n) AS n, any_value(w) AS w FROM f WHERE n > 0 GROUP BY form),
v AS (SELECT o, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT o, n, w, unnest(range(1, n + 1)) AS i FROM first WHERE n >= {linededup.MIN_EDIT_WORDS})),
near AS (
  SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY v, i) AS a FROM v) WHERE a < o
  UNION SELECT v.o FROM v JOIN first ON first.form = v.v AND first.o < v.o
  UNION SELECT first.o FROM v JOIN first ON first.form = v.v AND v.o < first.o),
gone AS (SELECT f.o FROM f JOIN first ON f.form = first.form WHERE f.n > 0 AND (f.o <> first.o OR first.o IN (SELECT o FROM near))),
r AS (SELECT doc_id, string_agg(CASE WHEN g.o IS NULL THEN t END, chr(10) ORDER BY line) AS text, count(*) AS n_lines, count(g.o) AS n_removed,
    count(g.o) > 0 AND count(*) FILTER (WHERE g.o IS NULL AND n > 0) = 0 AS emptied
  FROM f LEFT JOIN gone g ON f.o = g.o GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(emptied, FALSE) AS emptied
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""

#: CRC32 of the decimal digits of doc_id, by bits.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
CRC_SQL = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_CRC_STEP})))"""
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {CRC_SQL} AS h, {WORDS_SQL} AS w FROM documents),
g AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS k FROM d),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) ELSE w END AS w FROM g),
tri AS (SELECT doc_id, i, n, hash(w[i + 1], w[i + 2], w[i + 3]) AS v FROM (SELECT doc_id, n, w, unnest(range(0, n - 2)) AS i FROM t WHERE n >= 6)),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM tri x JOIN tri y ON x.doc_id = y.doc_id AND x.v = y.v AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, q, min(i) AS s, max(i) + 3 - min(i) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM isl WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
drops AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) AS r FROM runs),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id),
dl AS (SELECT doc_id, list(i) AS gone FROM drops GROUP BY doc_id),
kept AS (SELECT k.doc_id, string_agg(k.x, ' ' ORDER BY k.i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM t JOIN dl USING (doc_id)) k
  LEFT JOIN drops ON drops.doc_id = k.doc_id AND drops.i = k.i WHERE drops.i IS NULL GROUP BY k.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(CASE WHEN dl.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM t LEFT JOIN said ON said.doc_id = t.doc_id LEFT JOIN best ON best.doc_id = t.doc_id AND r = 1 LEFT JOIN dl ON dl.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id"""

#: Texts as hex digits, cut into pieces so that no long string is searched again for each window.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT r, k * 512 AS o, substr(x, k * 1024 + 1, 1024 + 398) AS x FROM (SELECT r, x, unnest(range(0, (length(x) // 2 - 200) // 512 + 1)) AS k FROM d WHERE length(x) >= 400)),
w AS (SELECT r, o + i AS s, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, o, x, unnest(range(0, least(512, length(x) // 2 - 199))) AS i FROM p)),
again AS (SELECT w.r, w.s FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
edge AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > 200, TRUE) AS fresh FROM again),
span AS (SELECT r, min(s) AS s, max(s) + 200 AS e FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g FROM edge) GROUP BY r, g),
stay AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS b FROM span),
kept AS (SELECT d.r, count(*) AS n, sum(e - s) AS gone, string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS x FROM stay JOIN d USING (r) GROUP BY d.r)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label = x.label AS same, x.vec_id AS x, CAST(list_inner_product(a.vec, x.vec) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, x) <= 5)
SELECT p.a AS anchor_id, p.x AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.x AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.a, p.x ORDER BY s.score DESC, s.x) QUALIFY row_number() OVER w <= 5"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}

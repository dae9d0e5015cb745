"""Queries of feeds against many companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import feeds
from .queries import WORDS_FIN, query, shaped, sql_contains
from .sources.domain import read

#: A company for each benchmark passage: its longest word as the symbol (the first of equals), its first three words as the name.
COMPANIES = """WITH w AS (SELECT item_id AS company, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
company AS (SELECT company, w[list_position(list_transform(w, lambda x: length(x)), list_max(list_transform(w, lambda x: length(x))))] AS symbol, array_to_string(w[1:3], ' ') AS name, w[1:3] AS parts FROM w),
doc AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
word AS (SELECT doc_id, x AS symbol, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS x FROM doc) GROUP BY ALL)"""
HITS = """hit AS (SELECT doc.doc_id, company, t, coalesce(word.n, 0) AS words,
    (length(t) - length(replace(t, '$' || company.symbol, ''))) // (length(company.symbol) + 1) AS cash, CASE WHEN contains(t, name) THEN 1 ELSE 0 END AS named,
    len(list_filter(parts, lambda x: length(x) >= 4 AND x NOT IN ('inc', 'corp', 'ltd', 'plc', 'group', 'company', 'holdings') AND contains(t, x))) AS tokens
  FROM doc CROSS JOIN company LEFT JOIN word ON word.doc_id = doc.doc_id AND word.symbol = company.symbol WHERE company.symbol <> ''),
fact AS (SELECT *, """ + sql_contains("t", WORDS_FIN) + """ AS fin, CASE WHEN contains(t, 'http://') OR contains(t, 'https://') THEN 0.15 ELSE 0.0 END::DOUBLE AS link, named * 2 + tokens AS n FROM hit WHERE words + cash + named + tokens > 0)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("company"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    longest = F.array_max(F.transform("w", F.length))
    return words.select("company", F.get(F.filter("w", lambda x: F.length(x) == longest), F.lit(0)).alias("symbol"), F.array_join(F.slice("w", 1, 3), " ").alias("name"))


@query(f"""{COMPANIES}, {HITS} SELECT doc_id, company, words, cash, named, tokens,
  round(CASE WHEN raw < 0.9 THEN 0.0 ELSE round(raw, 4) END, 4) AS news_relevance, round(post, 4) AS post_relevance, words + cash > 0 OR named > 0 OR (tokens >= 2 AND fin >= 1) AS related
  FROM (SELECT *, CASE WHEN words + cash > 0 THEN 2.5 ELSE 0.0 END::DOUBLE + least(fin, 5) * 0.18::DOUBLE + named * 2.0::DOUBLE + least(tokens, 4) * 0.45::DOUBLE AS raw,
    greatest(words * 3.2::DOUBLE + cash * 4.0::DOUBLE + least(n, 5) * 1.1::DOUBLE + fin * 0.32::DOUBLE - CASE WHEN words + cash <= 1 AND n = 0 THEN 0.7 ELSE 0.0 END::DOUBLE - link, 0.0) AS post FROM fact)""")
def company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every company that it names."""
    docs = read(spark, sf_dir, "documents")
    return shaped(feeds.company_scores(docs, ["doc_id"], F.col("text"), companies(spark, sf_dir), WORDS_FIN))


@query(f"""{COMPANIES}, {HITS}, d AS (SELECT doc_id, count(*) AS docs FROM fact WHERE words + cash > 0 OR named > 0 GROUP BY doc_id)
SELECT f.company, count(*) AS n_docs, sum(words + cash) AS mentions, sum(named) AS named, sum(CASE WHEN docs = 1 THEN 1 ELSE 0 END) AS alone FROM fact f JOIN d USING (doc_id) WHERE words + cash > 0 OR named > 0 GROUP BY f.company""")
def company_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each company the documents that name it, and those that name no other."""
    met = feeds.company_mentions(read(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), companies(spark, sf_dir)).where("words + cash > 0 OR named > 0")
    alone = met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("company").alias("company")).where("n = 1").groupBy("company").agg(F.count(F.lit(1)).alias("alone"))
    sums = met.groupBy("company").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("words") + F.col("cash")).alias("mentions"), F.sum("named").alias("named"))
    return shaped(sums.join(alone, "company", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("bigint"))))

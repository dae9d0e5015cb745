"""The library's tables, derived from general Parquet tables, and its sources' schemas.

The feeds of a deployment (news, posts, transcripts, prices, fundamentals) arrive as tables with these
columns; here they are derived from the star schema and text tables of the test data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms of the test corpus that stand in for the metric lexicons, which its invented words lack.
CORPUS_LEXICON = {
    "forward": {"the": 0.8, "les": 1.0, "die": 0.9}, "risk": {"of": 0.8, "un": 1.0}, "hedge": {"and": 0.7, "en": 0.9, "von": 1.0},
    "specificity": {"in": 0.9, "de": 0.6}, "forward_counter": {"was": 1.0, "ist": 1.0}, "confidence": {"is": 1.0, "est": 1.0, "la": 0.5},
    "confidence_counter": {"with": 1.0, "avec": 1.0}, "specificity_counter": {"that": 1.0, "que": 0.7}, "directness": {"to": 0.8, "zu": 1.0, "of the": 1.2},
}
CORPUS_TOPICS = {"english": {"the": 1.0, "of": 1.0, "and": 0.9}, "french": {"les": 1.0, "la": 1.0, "que": 0.9}, "german": {"die": 1.0, "der": 1.0, "und": 0.9}, "spanish": {"los": 1.0, "el": 1.0, "por": 0.9}}
SYMBOLS = 5
# Blocks and transcripts whose words meet every rule, which the invented words of the test corpus don't.
SEED_BLOCKS = (
    "We expect guidance of 12% growth next quarter. Our outlook and pipeline are strong, with momentum and visibility in the back half.",
    "Risk and uncertainty remain: a recession, tariff pressure and inflation. Litigation could delay the roadmap.",
    "It depends. We may, subject to approval, potentially see it. It is too early and remains to be seen.",
    "Gross margin was 40 percent. Revenue of 3 billion beat by 20 basis points. Backlog, bookings and capex grew. We delivered, executed and are on track.",
    "Various customers, several orders, roughly speaking. To be clear, the number is 5. We will commit specifically.",
    "Demand and orders were robust. Pricing and discount pressure continued. Free cash flow and buyback stay. AI and GPU inference training.",
    "Operator here.",
    "",
)
SEED_CALL = (
    "Call Participants", "Jane Roe -- Chief Executive Officer", "Prepared Remarks", "Operator: Good day and welcome. Today's call is being recorded.", "Jane Roe: Thank you for joining. We delivered a record quarter.",
    "Revenue rose 12%.", "Sam Poe, Investor Relations: Forward-looking statements apply.", "Questions and Answers", "Operator: Our first question comes from Max Lee. Please go ahead.",
    "Max Lee: Thanks for taking my question. How should we think about margins?", "Jane Roe: We expect expansion.", "Ann Kim, Analyst: Could you quantify that?", "Jane Roe: About 50 basis points.",
    "Operator: The line is open, next question.", "Max Lee: Why now?", "CFO Tom Fox: Because demand is there.", "Jane Roe: That is all the time we have for questions.", "Operator: This concludes today.", "Jane Roe: Goodbye.",
)
SEED_PLAIN = ("Just a line that no one speaks.", "And another one.")
SEED_BAD_CALL = ("Unknown: one", "Unknown: two", "Unknown: three and more of it", "self.__next_f.push: x y z")


def seeded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``blocks`` and, as document -1, SEED_BLOCKS."""
    b = blocks(spark, sf_dir)
    seed = spark.createDataFrame([(-1, k, f"Seed {k % 3}", ("management", "analyst")[k % 2], "qa", t) for k, t in enumerate(SEED_BLOCKS)], b.schema)
    return b.unionByName(seed)
AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> object:
    return F.lit(AS_OF).cast("timestamp")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, order_index, speaker, speaker_role, section_type, text: what was said in a call."""
    c = read(spark, sf_dir, "conversations")
    number = lambda k: (F.col("conv_id") % k).cast("string")
    return c.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("order_index"),
        F.when(F.col("role") == "system", "Operator").when(F.col("role") == "user", F.concat(F.lit("Analyst "), number(7))).otherwise(F.concat(F.lit("Exec "), number(11))).alias("speaker"),
        F.when(F.col("role") == "system", "operator").when(F.col("role") == "user", "analyst").otherwise("management").alias("speaker_role"),
        F.when(F.col("turn") < 2, "prepared_remarks").otherwise("qa").alias("section_type"),
        "text",
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: transcripts as lines, a speaker's first one as ``Name: text``; the seeds are documents -1 to -3."""
    c = read(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split(F.concat("role", F.lit(": "), "text"), "\n")).alias("part", "line"))
    heads = c.where("turn IN (0, 2)").select(
        F.col("conv_id").alias("doc_id"), "turn", F.lit(-1).alias("part"), F.when(F.col("turn") == 0, "Prepared Remarks").otherwise("Questions and Answers").alias("line")
    )
    lines = turns.unionByName(heads).select("doc_id", (F.col("turn") * 1_000_000 + F.col("part") + 1).alias("line_no"), "line")
    seeds = spark.createDataFrame([(-k, n, t) for k, call in ((1, SEED_CALL), (2, SEED_BAD_CALL), (3, SEED_PLAIN)) for n, t in enumerate(call)], "doc_id bigint, line_no bigint, line string")
    return lines.unionByName(seeds)


def timed(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str, at: str) -> DataFrame:
    """``rows`` with the time (``at``) of the event of that number; rows without one stay."""
    return rows.join(read(spark, sf_dir, "events").select(F.col("event_id").alias(key), F.col("ts").alias(at)), key, "left")


def untimed_news(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """symbol, provider, ord, title, summary, url, and ``more`` columns of the documents."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("SYM"), (F.col("doc_id") % SYMBOLS).cast("string")).alias("symbol"),
        F.col("source").alias("provider"),
        F.col("doc_id").alias("ord"),
        F.substring("text", 1, 80).alias("title"),
        F.expr("substring(text, 81)").alias("summary"),
        F.concat(F.lit("doc://"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("url"),
        *more,
    )


def news(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """symbol, provider, ord, title, summary, url, published_ts, and ``more`` columns of the documents.

    Texts are cut before the join, so that a query moves only the parts it reads.
    """
    return timed(untimed_news(spark, sf_dir, *more), spark, sf_dir, "ord", "published_ts").select("symbol", "provider", "ord", "title", "summary", "url", "published_ts", *more)


def untimed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, symbol, provider, ord, title, body, url: social posts and the conversations they are from."""
    return read(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id",
        F.concat(F.lit("SYM"), (F.col("conv_id") % SYMBOLS).cast("string")).alias("symbol"),
        F.element_at(F.array(F.lit("reddit"), F.lit("stocktwits"), F.lit("forum")), (F.col("turn") % 3 + 1).cast("int")).alias("provider"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        F.substring("text", 1, 96).alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit("post://"), "conv_id", F.lit("/"), "turn").alias("url"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, provider, ord, title, body, url, created_ts: social posts."""
    return timed(untimed_posts(spark, sf_dir), spark, sf_dir, "conv_id", "created_ts").drop("conv_id")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, provider, year, quarter, revenue, net_income, reported_eps, eps_estimate of two providers."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "o_totalprice", F.col("c_mktsegment").alias("symbol"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    keys = ["symbol", "year", "quarter"]
    a = o.groupBy(*keys).agg(F.sum("o_totalprice").alias("revenue"), (F.sum("o_totalprice") * 0.1).alias("net_income"), (F.avg("o_totalprice") / 1000).alias("eps"))
    a = a.select(
        "symbol", F.lit("A").alias("provider"), "year", "quarter", "revenue", "net_income",
        F.when((F.col("year") + F.col("quarter")) % 3 != 0, F.col("eps")).alias("reported_eps"), (F.col("eps") * 0.97).alias("eps_estimate"),
    )
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    # an order is one row: those of a partition are held, and the many lines pass by unsorted
    b = lines.join(o.hint("shuffle_hash"), lines["l_orderkey"] == o["o_orderkey"]).groupBy(*keys).agg(F.sum("paid").alias("revenue"), (F.avg("paid") / 250).alias("reported_eps"))
    none = F.lit(None).cast("double")
    b = b.select("symbol", F.lit("B").alias("provider"), "year", "quarter", "revenue", none.alias("net_income"), "reported_eps", none.alias("eps_estimate"))
    return a.unionByName(b)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, close, volume."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("SYM"), (F.col("user_id") % SYMBOLS).cast("string")).alias("symbol"), F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("close"), F.count(F.lit(1)).alias("volume")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, order_index, metric, band, score, predicted_confidence: a model's verdicts on blocks."""
    l = read(spark, sf_dir, "labels")  # noqa: E741
    q = F.when(F.col("quality") == 1, "high").otherwise("low")
    return l.select(
        F.col("doc_id"),
        (F.col("doc_id") % 4).alias("order_index"),
        F.lit("confidence").alias("metric"),
        q.alias("band"),
        F.when(F.col("quality") == 1, 70.0).otherwise(30.0).alias("score"),
        F.when(F.col("toxic") == 1, 0.4).otherwise(0.8).alias("predicted_confidence"),
    )

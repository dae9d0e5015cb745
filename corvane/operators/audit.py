"""Run audits: messages by kind, tasks, feeds, parse quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, compact

# Phrases that make a message a diagnostic or a notice.
DIAGNOSTICS = ("openai feature classification batch diagnostics:", "openai not needed parser high confidence", "openai_not_needed_parser_high_confidence", "regex_from_page_text")
NOTICES = (
    "fundamentals validation:", "fundamentals validation found low/medium provider drift", "no yahoo finance news items returned", "no reddit posts found", "no stocktwits posts found",
    "used json-ld fallback extraction",
)


def message_kind(message: Column) -> Column:
    parse = F.lower(message).rlike(r"(?U)\bsection parse (method|reason):")
    return F.when(parse | any_of(message, DIAGNOSTICS), "diagnostic").when(any_of(message, NOTICES), "notice").otherwise("warning")


def classify_messages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, message, ord: each message once, where it came first; blank ones go."""
    m = messages.withColumn("message", F.trim("message")).where("message != ''").withColumn("kind", message_kind(F.col("message")))
    return m.groupBy(*keys, "kind", "message").agg(F.min("ord").alias("ord"))


def suppress(messages: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Without warnings that came to nothing: failed normalisation where there are documents, no news of one provider where there are items."""
    m = messages.join(facts.select(*keys, "documents", "items"), keys, "left")
    low = F.lower("message")
    void = (F.contains(low, F.lit("openai normalization failed:")) & (F.coalesce("documents", F.lit(0)) > 0)) | (F.contains(low, F.lit("no yahoo finance news items returned")) & (F.coalesce("items", F.lit(0)) > 0))
    return m.where(~void).drop("documents", "items")


def task_totals(tasks: DataFrame, keys: list[str], slowest: int = 4) -> DataFrame:
    """Per run: tasks, total milliseconds, failures and the names of the slowest tasks, slowest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("duration_ms"), "name")
    ranked = tasks.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("duration_ms").alias("total_ms"), F.count_if(F.col("status") == "error").alias("failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= slowest, F.struct("rank", "name")))), lambda x: x["name"]), ",").alias("slowest"),
    )


def progress(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted percent done (weight, part 0 to 1)."""
    return stages.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("part")) / F.sum("weight") * 100).alias("percent"))


# Labels that stand for a speaker without naming one, and words that are no speaker.
GENERIC_LABELS = ("operator", "analyst", "management", "unknown", "unidentified speaker", "unidentified analyst", "participant")
BAD_LABELS = (
    "greetings", "hello", "hi", "thanks", "thank you", "good afternoon", "good morning", "duration", "prepared", "prepared remarks", "other", "questions and answers", "q&a", "call participants",
)
PERSON = r"^[A-Z][A-Za-z.'\-]+(?: [A-Z][A-Za-z.'\-]+){0,5}$"


def plausible_label(label: Column) -> Column:
    """Whether a label may be a speaker's: a generic one, or up to six capitalised words."""
    c = compact(F.coalesce(label, F.lit("")))
    low = F.lower(c)
    return F.when(c == "", False).when(low.isin(*GENERIC_LABELS), True).when(low.isin(*BAD_LABELS) | c.rlike("[0-9]") | (F.length(c) > 80) | F.contains(c, F.lit(":")), False).otherwise(c.rlike(PERSON))


def parse_quality(blocks: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per document: ratios of a speaker parse, the first reason to distrust it, that of a structured one, and whether to normalise it again.

    ``facts`` (doc_id, confidence, warnings array<string>) add their gates; documents there without any block have no_sections.
    """
    who = F.lower(F.trim(F.coalesce("speaker", F.lit(""))))
    unknown = who.isin("", "unknown")
    plausible = plausible_label(F.col("speaker"))
    script = F.contains("text", F.lit("self.__next_f.push")) | F.contains("text", F.lit('\\"children\\":')) | F.contains("text", F.lit("\\u003c"))
    q = blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(unknown).alias("unknown"), F.count_if(~F.coalesce(plausible, F.lit(False))).alias("implausible"), F.count_if(script).alias("script"),
        F.avg(F.when(F.col("section_type") == "other", 1.0).otherwise(0.0)).alias("other_share"), F.avg(F.when(F.coalesce(F.trim("speaker_role"), F.lit("")) == "", 1.0).otherwise(0.0)).alias("no_role_share"),
    )
    if facts is not None:
        q = facts.select("doc_id", "confidence", "warnings").join(q, "doc_id", "left").fillna(0, ["sections", "unknown", "implausible", "script"]).fillna(0.0, ["other_share", "no_role_share"])
    else:
        q = q.withColumns({"confidence": F.lit(1.0), "warnings": F.array().cast("array<string>")})
    reason = (
        F.when(F.col("sections") == 0, "no_sections").when(F.col("script") > 0, "script_wrapped_text").when((F.col("sections") == 1) & (F.col("unknown") == 1), "single_unknown_section").when(F.col("unknown") == F.col("sections"), "all_unknown_speakers")
        .when(F.col("implausible") / F.col("sections") > 0.25, "implausible_speaker_labels")
    )
    structured = (
        F.when(F.col("sections") == 0, "no_sections").when(F.col("sections") < 2, "too_few_sections").when(F.col("unknown") == F.col("sections"), "all_unknown_speakers")
        .when(F.col("unknown") / F.col("sections") > 0.9, "mostly_unknown_speakers").when(F.col("implausible") / F.col("sections") > 0.25, "implausible_speaker_labels")
    )
    sparse = F.exists("warnings", lambda w: any_of(w, ("sparse", "empty", "could not")))
    retry = (F.col("sections") <= 2) | (F.col("confidence") < 0.55) | sparse | (F.col("unknown") / F.col("sections") >= 0.35) | (F.col("no_role_share") >= 0.5) | (F.col("other_share") >= 0.75)
    return q.withColumns({"reason": reason, "structured_reason": structured, "normalise_again": retry})


def parse_confidence(method: Column, low: Column) -> Column:
    """How far a parse is trusted, by how it was made."""
    return F.when(method.isin("openai", "openai_page_text"), 0.92).when(low, 0.52).when(method.startswith("regex"), 0.78).otherwise(0.70)


def retry_kind(error: Column) -> Column:
    """What an error was and, with it, whether a retry may help."""
    low = F.lower(F.coalesce(error, F.lit("")))
    kind = (
        F.when(any_of(low, ("nodename nor servname", "name or service not known")), "dns_error").when(any_of(low, ("timed out", "read timeout")), "timeout").when(any_of(low, BROKEN_JSON), "parse_error")
        .when(any_of(low, ("no source urls", "no parseable source urls")), "empty_source_set").otherwise("unknown_error")
    )
    return F.struct(kind.alias("kind"), (~any_of(low, (*UNREACHABLE, *BROKEN_JSON))).alias("retry"))


# What errors say that no retry mends.
UNREACHABLE = ("failed to establish a new connection", "nodename nor servname provided", "name or service not known", "temporary failure in name resolution", "no route to host")
BROKEN_JSON = ("unterminated string", "expecting value", "expecting property name enclosed in double quotes", "extra data", "parseable structured json output")


def discovery_totals(phases: DataFrame, failures: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """Per key the pages scanned over all phases (a sitemap's months count as pages), and its first failures as phase:category: error."""
    pages = phases.groupBy(*keys).agg(F.sum(F.when(F.col("phase") == "sitemap", F.coalesce("months_scanned", F.lit(0))).otherwise(F.coalesce("pages_scanned", F.lit(0)))).alias("pages"))
    f = failures.where(F.trim(F.coalesce("error", F.lit(""))) != "").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("n") <= most)
    said = F.concat(F.coalesce("phase", F.lit("unknown")), F.lit(":"), F.coalesce("category", F.lit("unknown_error")), F.lit(": "), F.trim("error"))
    lists = f.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("said")))), lambda x: x["said"]).alias("failures"))
    return pages.join(lists, keys, "left").withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))


def document_totals(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: documents, mean confidence, and the mode (openai only if all documents are)."""
    return documents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"), F.avg("confidence").alias("confidence"),
        F.when(F.bool_and(F.col("mode") == "openai"), "openai").otherwise("deterministic_degraded").alias("mode"),
    )


def job_states(jobs: DataFrame, as_of: Column, ttl_seconds: int = 900) -> DataFrame:
    """Jobs (job_id, status, finished_ts) still held at ``as_of``: finished ones leave after ``ttl_seconds``."""
    done = F.col("status").isin("done", "error")
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("finished_ts")
    return jobs.where(~done | F.col("finished_ts").isNull() | (age <= ttl_seconds))


def last_messages(messages: DataFrame, keys: list[str], most: int = 80) -> DataFrame:
    """The newest ``most`` progress messages of each key, oldest first."""
    w = Window.partitionBy(*keys)
    newest = messages.withColumn("__n", F.row_number().over(w.orderBy(F.desc("ord")))).where(F.col("__n") <= most)
    return newest.withColumn("place", F.row_number().over(w.orderBy("ord"))).drop("__n")

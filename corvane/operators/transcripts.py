"""Transcripts: lines to speaker blocks, question-and-answer bounds, speakers' roles, coverage of quarters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, name_and_role, name_key, quote_key, sentences, speaker_line, word_count
from ..sources.store import release, store
from .people import canonical_names, with_canonical

# What marks the parts of a call and who speaks.
QA_OPENERS = (
    "first question", "next question", "our next question", "final question", "line is open", "please go ahead", "we will now take questions",
    "we are now ready for questions", "open the line", "open it up for questions", "poll for questions", "unmute yourself",
)
QA_CLOSERS = (
    "all the time we have for q&a", "all the time we have for questions", "this concludes the question-and-answer session", "this concludes today",
    "before we conclude", "closing remarks", "thank you for joining", "that concludes today's conference call",
)
QUESTIONS = (
    "thanks for taking my question", "my question is", "quick follow-up", "quick follow up", "can you", "could you", "how should we think about",
    "what is", "what are", "do you expect", "would you", "why", "when",
)
TITLES = {
    "operator": ("operator", "moderator"),
    "host_ir": ("investor relations", "investor relation", "ir", "head of ir", "vp, ir", "vp ir"),
    "analyst": ("analyst", "research", "equity research"),
    "management": (
        "chief", "ceo", "cfo", "coo", "cao", "cto", "chairman", "chairwoman", "president", "executive", "founder", "vice president", "svp", "evp", "treasurer", "director",
    ),
}
BOILERPLATE = ("forward-looking statements", "safe harbor", "copyright", "transcript by")
HEADINGS = {
    "prepared_remarks": r"(?i)^\s*prepared remarks\s*$",
    "qa": r"(?i)^\s*(q\s*&\s*a|question(?:s)?\s*(?:and|&)\s*answer(?:s)?)\s*$",
    "other": r"(?i)^\s*closing remarks?\s*$",
}


def heading(line: Column) -> Column:
    """The section that a heading line opens; null for other lines."""
    return reduce(lambda c, kv: c.when(line.rlike(kv[1]), F.lit(kv[0])), list(HEADINGS.items())[1:], F.when(line.rlike(HEADINGS["prepared_remarks"]), F.lit("prepared_remarks")))


def is_question(text: Column) -> Column:
    return F.contains(text, F.lit("?")) | any_of(text, QUESTIONS)


def boilerplate(text: Column) -> Column:
    return any_of(text, BOILERPLATE)


def ends_in_transition(text: Column, markers: tuple[str, ...] = QA_OPENERS) -> Column:
    """A long remark (80 words, four sentence ends) that only its last two fifths turn to the questions."""
    low = F.lower(text)
    last = lambda m: F.when(F.contains(low, F.lit(m)), F.length(low) - (F.locate(m[::-1], F.reverse(low)) - 1) - len(m))
    place = F.greatest(*[last(m) for m in markers])
    return F.coalesce((place >= F.floor(F.length(low) * 0.6)) & (word_count(text) >= 80) & (F.regexp_count(text, F.lit("[.!?]")) >= 4), F.lit(False))


def title_role(title: Column) -> Column:
    """Role by title words, operator first, then investor relations, analyst, management (plain substrings)."""
    return reduce(lambda c, kv: c.when(any_of(title, kv[1]), F.lit(kv[0])), list(TITLES.items())[1:], F.when(any_of(title, TITLES["operator"]), F.lit("operator")))


def name_role(name: Column) -> Column:
    return (
        F.when(any_of(name, TITLES["operator"]), "operator").when(any_of(name, ("investor relations",)), "host_ir").when(any_of(name, ("analyst",)), "analyst")
        .when(any_of(name, ("ceo", "cfo", "chief", "president")), "management")
    )


def speaker_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, order_index, speaker, base_section, text from (doc_id, line_no, line).

    A ``Name: text`` line opens a block, what follows joins it, and lines before the first speaker and headings are left out. A
    block's section is the last heading's before its first line.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("line", F.trim("line")).where("line != ''").withColumn("h", heading(F.col("line")))
    rows = rows.withColumn("state", F.coalesce(F.last("h", ignorenulls=True).over(w), F.lit("prepared_remarks"))).where("h IS NULL")
    rows = rows.withColumn("s", speaker_line(F.col("line"))).withColumn("block", F.count("s").over(w)).where("block > 0")
    blocks = rows.groupBy("doc_id", "block").agg(
        F.min_by("s.speaker", "line_no").alias("speaker"),
        F.min_by("state", "line_no").alias("base_section"),
        F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("s.spoken", "line").alias("t")))).alias("parts"),
    )
    text = F.trim(F.array_join(F.transform("parts", lambda p: p.t), " "))
    return blocks.select("doc_id", (F.col("block") - 1).alias("order_index"), "speaker", "base_section", text.alias("text"))


def qa_bounds(blocks: DataFrame) -> DataFrame:
    """doc_id, qa_start, qa_end: the first block that is or opens questions (else the first question by no known manager), and the first close after it.

    A long remark that only ends in a transition opens nothing.
    """
    t = F.col("text")
    opens = (F.col("base_section") == "qa") | (any_of(t, QA_OPENERS) & ~ends_in_transition(t))
    asks = is_question(t) & ~F.coalesce(name_role(F.col("speaker")).isin("management", "operator", "host_ir"), F.lit(False))
    closes = F.collect_list(F.when(any_of(t, QA_CLOSERS), F.col("order_index")))  # places only, few in a document
    each = blocks.groupBy("doc_id").agg(F.coalesce(F.min(F.when(opens, F.col("order_index"))), F.min(F.when(asks, F.col("order_index")))).alias("qa_start"), closes.alias("closes"))
    return each.select("doc_id", "qa_start", F.array_min(F.filter("closes", lambda at: at >= F.col("qa_start"))).alias("qa_end"))


def typed_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with section_type by their document's bounds.

    Before the start (everywhere, if there is none) boilerplate is other and the rest prepared; from it on all are questions, but
    closing words and what follows the end are other. Without a start, blocks under a closing heading are other as well.
    """
    b = blocks.join(qa_bounds(blocks), "doc_id")
    at, legal = F.col("order_index"), boilerplate(F.col("text"))
    before = F.when(legal | (F.col("qa_start").isNull() & (F.col("base_section") == "other")), "other").otherwise("prepared_remarks")
    section = F.when(F.col("qa_start").isNull() | (at < F.col("qa_start")), before).when((at > F.col("qa_end")) | any_of(F.col("text"), QA_CLOSERS), "other").otherwise("qa")
    return b.withColumn("section_type", section)


def speaker_stats(blocks: DataFrame) -> DataFrame:
    """Per document and speaker: prepared, qa, question, routing and answer blocks.

    An answer is a block of the questions part that is no question and follows another speaker's question.
    """
    w = Window.partitionBy("doc_id").orderBy("order_index")
    b = blocks.withColumn("q", is_question(F.col("text"))).withColumn("r", any_of(F.col("text"), QA_OPENERS))
    b = b.withColumn("before", F.lag(F.struct("section_type", "q", "speaker")).over(w))
    answer = (F.col("section_type") == "qa") & ~F.col("q") & (F.col("before.section_type") == "qa") & F.col("before.q") & (F.col("before.speaker") != F.col("speaker"))
    return b.groupBy("doc_id", "speaker").agg(
        F.count_if(F.col("section_type") == "prepared_remarks").alias("prepared"), F.count_if(F.col("section_type") == "qa").alias("qa"), F.count_if("q").alias("questions"),
        F.count_if("r").alias("routing"), F.count_if(F.coalesce(answer, F.lit(False))).alias("answers"),
    )


def resolve_roles(stats: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """doc_id, speaker, role from the evidence in ``speaker_stats`` and a roster (doc_id, name, title).

    Points: hint 5, roster of managers 4, routing 3.5 for the host (1 for a manager who also answers), a question 2.5,
    an answer 2.5, prepared remarks without questions 1.5, only questions 1. Under 2 the role is unknown; ties go to the host, then
    management, then the analyst. Operators are known by name or title.
    """
    s = stats.withColumn("key", name_key(F.col("speaker")))
    if roster is not None:
        titles = roster.select("doc_id", name_key(F.col("name")).alias("key"), title_role(F.col("title")).alias("title_role")).dropna().groupBy("doc_id", "key").agg(F.min("title_role").alias("title_role"))
        s = s.join(titles, ["doc_id", "key"], "left")
    else:
        s = s.withColumn("title_role", F.lit(None).cast("string"))
    hint = F.coalesce("title_role", name_role(F.col("speaker")))
    s = s.withColumn("hint", hint)
    on = lambda c, points: F.when(c, F.lit(float(points))).otherwise(0.0)
    managing = F.coalesce(F.col("hint") == "management", F.lit(False)) & (F.col("answers") > 0)
    points = {
        "host_ir": on(F.col("hint") == "host_ir", 5) + on((F.col("routing") > 0) & ~managing, 3.5),
        "management": on(F.col("hint") == "management", 5) + on(F.col("title_role") == "management", 4) + on((F.col("routing") > 0) & managing, 1) + on(F.col("answers") > 0, 2.5)
        + on((F.col("prepared") > 0) & (F.col("questions") == 0), 1.5),
        "analyst": on(F.col("hint") == "analyst", 5) + on(F.col("questions") > 0, 2.5) + on((F.col("qa") > 0) & (F.col("questions") == F.col("qa")), 1),
    }
    best = F.array_max(F.array(*[F.struct(p.alias("points"), F.lit(-k).alias("k"), F.lit(r).alias("role")) for k, (r, p) in enumerate(points.items())]))
    role = F.when(F.coalesce(F.col("hint") == "operator", F.lit(False)), "operator").when(best["points"] < 2, "unknown").otherwise(best["role"])
    return s.select("doc_id", "speaker", role.alias("role"))


def hydrate_roles(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Fills null speaker_role: by (document, speaker, section, place), then (document, speaker, section), then the speaker's commonest role.

    Among several known values the one placed last wins; between equally common roles management.
    """
    who = F.lower(F.trim(F.col("speaker")))
    k = known.where("speaker_role IS NOT NULL").select("doc_id", who.alias("who"), "section_type", "order_index", "speaker_role")
    exact = k.groupBy("doc_id", "who", "section_type", "order_index").agg(F.max("speaker_role").alias("r1"))
    section = k.groupBy("doc_id", "who", "section_type").agg(F.max_by("speaker_role", "order_index").alias("r2"))
    common = k.groupBy("doc_id", "who").agg(F.count_if(F.col("speaker_role") == "analyst").alias("a"), F.count_if(F.col("speaker_role") == "management").alias("m"))
    common = common.where("a > 0 OR m > 0").select("doc_id", "who", F.when(F.col("a") > F.col("m"), "analyst").otherwise("management").alias("r3"))
    out = rows.withColumn("who", who).join(exact, ["doc_id", "who", "section_type", "order_index"], "left").join(section, ["doc_id", "who", "section_type"], "left").join(common, ["doc_id", "who"], "left")
    return out.withColumn("hydrated_role", F.coalesce("speaker_role", "r1", "r2", "r3")).drop("who", "r1", "r2", "r3")


def dominant_roles(blocks: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("speaker_role") == r)
    return blocks.groupBy("speaker").agg(n("analyst").alias("analyst_blocks"), n("management").alias("management_blocks")).withColumn(
        "dominant_role", F.when(F.col("analyst_blocks") > F.col("management_blocks"), "analyst").otherwise("management")
    )


def without_repeats(lines: DataFrame) -> DataFrame:
    """Drops a line equal to the one before it, then every line already seen in its document (doc_id, line_no, line)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    once = lines.withColumn("last", F.lag("line").over(w)).where(~F.col("line").eqNullSafe(F.col("last")) | F.col("last").isNull()).drop("last")
    firsts = Window.partitionBy("doc_id", "line").orderBy("line_no")
    return once.withColumn("n", F.row_number().over(firsts)).where("n = 1").drop("n")


def best_per_quarter(candidates: DataFrame) -> DataFrame:
    """The best candidate (quality, then date, both high first) of each symbol and quarter."""
    w = Window.partitionBy("symbol", "year", "quarter").orderBy(F.desc("quality"), F.desc("date"), "url")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def quarter_coverage(candidates: DataFrame, n: int = 4) -> DataFrame:
    """For each symbol its newest quarter and the n-1 before it, found or missing."""
    best = best_per_quarter(candidates)
    newest = best.groupBy("symbol").agg(F.max(F.col("year") * 4 + F.col("quarter") - 1).alias("last"))
    want = newest.select("symbol", F.explode(F.sequence(F.col("last") - (n - 1), F.col("last"))).alias("q")).select("symbol", F.expr("int(q div 4)").alias("year"), (F.col("q") % 4 + 1).cast("int").alias("quarter"))
    out = want.join(best, ["symbol", "year", "quarter"], "left")
    return out.withColumn("status", F.when(F.col("url").isNull(), "missing").otherwise("found"))


def availability(coverage: DataFrame) -> DataFrame:
    c = coverage.groupBy("symbol").agg(F.count_if(F.col("status") == "found").alias("found"), F.count(F.lit(1)).alias("wanted"))
    return c.withColumn("availability", F.when(F.col("found") == 0, "missing").when(F.col("found") < F.col("wanted"), "partial").otherwise("available"))


# Headings that open a transcript on a page and phrases that end it.
PAGE_STARTS = r"(?i)^(prepared remarks|questions and answers|q&a|call participants|full conference call transcript)\b.*$"
PAGE_STOPS = ("read next", "stocks mentioned", "motley fool returns", "our analyst disclosure policy", "related articles", "join stock advisor")


def transcript_slice(lines: DataFrame, keys: list[str], stops: tuple[str, ...] = PAGE_STOPS) -> DataFrame:
    """keys, start, stop, reason: the lines of a page that are transcript (start included, stop not).

    It starts at the first heading (after it, if that is the whole transcript's), else at the first speaker, and ends before the first
    line with a stop phrase or after the last line. Pages without either have null bounds.
    """
    low = F.lower(F.trim("line"))
    head = F.when(low.rlike(PAGE_STARTS), F.col("line_no") + F.when(low.startswith("full conference call transcript"), 1).otherwise(0))
    who = F.when(speaker_line(F.col("line")).isNotNull(), F.col("line_no"))
    starts = lines.groupBy(*keys).agg(F.min(head).alias("h"), F.min(who).alias("s"), F.max("line_no").alias("last"))
    starts = starts.withColumn("start", F.coalesce("h", "s")).withColumn("reason", F.when(F.col("h").isNotNull(), "marker").when(F.col("s").isNotNull(), "speaker").otherwise("not_found"))
    ends = lines.join(starts.select(*keys, "start"), keys).where(F.col("line_no") > F.col("start")).groupBy(*keys).agg(F.min(F.when(any_of(F.col("line"), stops), F.col("line_no"))).alias("e"))
    out = starts.join(ends, keys, "left").withColumn("stop", F.when(F.col("start").isNotNull(), F.coalesce(F.col("e"), F.col("last") + 1)))
    return out.select(*keys, "start", "stop", "reason")


def with_unparsed(lines: DataFrame, blocks: DataFrame, most: int = 300) -> DataFrame:
    """``blocks`` and, for documents whose lines name no speaker, one block of their first lines by nobody."""
    rest = lines.withColumn("line", F.trim("line")).where("line != ''").join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    first = rest.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where(F.col("n") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ")
    one = first.groupBy("doc_id").agg(text.alias("text"))
    return blocks.unionByName(one.select("doc_id", F.lit(0).cast("bigint").alias("order_index"), F.lit("unknown").alias("speaker"), F.lit("other").alias("base_section"), "text"))


def assembled(lines: DataFrame, roster: DataFrame) -> DataFrame:
    """Transcript sections of (doc_id, line_no, line) with a roster (doc_id, name, title).

    doc_id, order_index, section_type, speaker (canonical), role (null if unknown), text, evidence (its first two sentences).
    Blocks and what names and types them are read several times, so each step is written once instead of planned anew in every branch.
    """
    parsed = store(speaker_blocks(lines))
    blocks = store(with_unparsed(lines, parsed))
    release(parsed)
    said = blocks.groupBy("doc_id", F.col("speaker").alias("name")).agg(F.min("order_index").alias("ord")).withColumn("priority", F.lit(1))
    listed = roster.select("doc_id", "name", F.lit(0).cast("bigint").alias("ord"), F.lit(3).alias("priority"))
    aliases = store(canonical_names(listed.unionByName(said.select("doc_id", "name", "ord", "priority"))))
    named = store(with_canonical(blocks, aliases))
    release(blocks)
    known = roster.withColumnRenamed("name", "speaker")
    titled = with_canonical(known, aliases).select("doc_id", F.col("speaker").alias("name"), "title")
    out = enriched(named, titled)
    role = F.when(F.col("role") != "unknown", F.col("role"))
    return out.select("doc_id", "order_index", "section_type", "speaker", role.alias("role"), "text", F.slice(sentences(F.col("text")), 1, 2).alias("evidence"))


def document_quotes(sections: DataFrame, most: int = 6, chars: int = 70) -> DataFrame:
    """doc_id, rank, quote: the first sentences of enough characters, in order."""
    s = sections.select("doc_id", "order_index", F.posexplode(sentences(F.col("text"))).alias("pos", "quote")).where(F.length("quote") >= chars)
    w = Window.partitionBy("doc_id").orderBy("order_index", "pos")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc_id", "rank", "quote")


def document_records(sections: DataFrame) -> DataFrame:
    """Per document: sections, speakers, characters, whether it is a full transcript (two sections or more)."""
    return sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.count_distinct("speaker").alias("speakers"), F.sum(F.length("text")).alias("chars"), (F.count(F.lit(1)) >= 2).alias("full_transcript")
    )


# What the page parser takes as a turn to questions, as a question, and as a manager's title.
PAGE_TRANSITIONS = (
    "questions and answers", "q&a", "we'll now move over to q and a", "we'll now move to q and a", "let's open the call to questions", "let's open the line for questions", "open the call to questions",
    "open the line for questions", "may we have the first question", "we ask that you limit yourself", "first question", "next question", "our next question", "question comes from",
)
PAGE_QUESTIONS = ("i have two", "i have one", "i have a question", "my question", "thanks for taking", "thank you for taking", "can you comment", "could you comment", "help us understand")
PAGE_MANAGERS = ("chief", "ceo", "cfo", "president", "investor relations", "director", "vice president", "vp")


def page_roles(sections: DataFrame, participants: DataFrame) -> DataFrame:
    """Adds role and section to a page's sections (doc_id, order_index, speaker, text; dense order) by place and wording.

    Questions start at the first transition, else one block before the first question from the third block on. Participants with
    a manager's title and everyone who speaks before the start are management, and if there is nobody, the first two
    speakers; after the start askers and who follows the operator are analysts; without a start all are management.
    """
    t, who = F.col("text"), F.lower(F.trim("speaker"))
    nobody = who.isin("", "unknown", "operator")
    asks = F.contains(t, F.lit("?")) | any_of(t, PAGE_QUESTIONS)
    turns = any_of(t, PAGE_TRANSITIONS) & ~(ends_in_transition(t, PAGE_TRANSITIONS) & ~any_of(t, ("questions and answers", "q&a")))
    b = sections.withColumns({"who": who, "asks": asks})
    first = F.min(F.when(turns, F.col("order_index")))
    second = F.min(F.when(asks & ~nobody & (F.col("order_index") >= 2), F.col("order_index") - 1))
    start = b.groupBy("doc_id").agg(F.coalesce(first, second).alias("qa_start"))
    titled = participants.where(any_of(F.col("role"), PAGE_MANAGERS)).select("doc_id", F.lower(F.trim("name")).alias("who"))
    b = b.join(start, "doc_id")
    early = b.where(~nobody & (F.col("qa_start").isNull() | (F.col("order_index") < F.col("qa_start")))).select("doc_id", "who")
    managers = titled.unionByName(early).distinct()
    places = b.where(~nobody).groupBy("doc_id", "who").agg(F.min("order_index").alias("at"))
    two = places.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).where("n <= 2")
    managers = managers.unionByName(two.join(managers.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "who")).withColumn("manager", F.lit(True))
    w = Window.partitionBy("doc_id").orderBy("order_index")
    b = b.withColumn("before", F.lag("who").over(w)).join(managers, ["doc_id", "who"], "left")
    after = F.col("qa_start").isNotNull() & (F.col("order_index") >= F.col("qa_start"))
    role = (
        F.when(F.contains("who", F.lit("operator")), "operator").when(F.col("manager"), "management").when(after & (F.col("asks") | (F.col("before") == "operator")), "analyst")
        .when(~after & ~F.col("who").isin("", "unknown"), "management")
    )
    return b.withColumns({"role": role, "section": F.when(after, "qa").otherwise("prepared_remarks")}).drop("who", "asks", "before", "manager")


def normalised_sections(raw: DataFrame) -> DataFrame:
    """Sections (doc_id, ord, order_index, speaker, role, section_type, text) in one form: texts required, unknown speakers named so, roles and
    types that are none left out, places from the list where they are missing, then numbered anew."""
    c = lambda n: F.lower(F.trim(F.coalesce(n, F.lit(""))))
    rows = raw.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "doc_id", F.coalesce("order_index", "ord").alias("at"), "ord", F.when(c("speaker") == "", "unknown").otherwise(F.trim("speaker")).alias("speaker"),
        F.when(c("role").isin("operator", "analyst", "management"), c("role")).alias("role"), F.when(c("section_type").isin("prepared_remarks", "qa"), c("section_type")).otherwise("other").alias("section_type"), F.trim("text").alias("text"),
    )
    return rows.withColumn("order_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "ord")) - 1).drop("at", "ord")


def sections_text(sections: DataFrame) -> DataFrame:
    """doc_id, text: sections as lines ``Speaker: text`` in order."""
    line = F.concat(F.when(F.trim(F.coalesce("speaker", F.lit(""))) == "", "Unknown").otherwise(F.trim("speaker")), F.lit(": "), F.trim("text"))
    rows = sections.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.struct("order_index", line.alias("line")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def section_warnings(parses: DataFrame) -> DataFrame:
    """Adds ``warnings`` array<string> from (low, low_reason, error, method, reason) of a parse."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    low = F.when(F.col("low"), F.concat(F.lit("Low-confidence section parse"), F.when(said("low_reason") != "", F.concat(F.lit(" ("), said("low_reason"), F.lit(")"))).otherwise(""), F.lit(".")))
    part = lambda name, c: F.when(said(c) != "", F.concat(F.lit(f"{name}: "), said(c)))
    return parses.withColumn("warnings", F.array_compact(F.array(low, part("OpenAI structuring fallback error", "error"), part("Section parse method", "method"), part("Section parse reason", "reason"))))


def packed_blocks(blocks: DataFrame, most: int = 12_000, least: int = 4_000) -> DataFrame:
    """doc_id, chunk, text: whole ``Speaker: text`` blocks in order, packed into chunks of ``most`` characters (``least`` at least); a longer block is a chunk."""
    most = max(least, most)
    line = F.concat(F.when(F.trim(F.coalesce("speaker", F.lit(""))) == "", "unknown").otherwise(F.trim("speaker")), F.lit(": "), F.trim("text"))
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.struct("order_index", line.alias("line")).alias("x"))
    each = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    # which chunk each block goes to: a running size that starts again when a block doesn't fit
    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("chars"), F.lit(0).alias("chunk"))

    def step(acc: Column, x: Column) -> Column:
        new = (F.size(acc["at"]) > 0) & (acc["chars"] + F.length(x) + 2 > most)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(F.concat(acc["at"], F.array(chunk)).alias("at"), F.when(new, F.length(x)).otherwise(acc["chars"] + F.length(x) + 2).alias("chars"), chunk.alias("chunk"))

    dealt = each.withColumn("at", F.aggregate("lines", zero, step)["at"]).select("doc_id", F.posexplode(F.arrays_zip("lines", "at")).alias("i", "x"))
    parts = dealt.groupBy("doc_id", F.col("x.at").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", "x.lines"))).alias("p"))
    return parts.select("doc_id", "chunk", F.array_join(F.transform("p", lambda p: p["lines"]), "\n\n").alias("text"))


def listed_participants(lines: DataFrame, span: int = 40, most: int = 20) -> DataFrame:
    """doc_id, rank, name, role: the lines (dense line_no) under a participants heading, to the next heading or ``span`` lines on."""
    low = F.lower("line")
    w = Window.partitionBy("doc_id")
    n = lines.withColumn("at", F.min(F.when(F.contains(low, F.lit("call participants")), F.col("line_no"))).over(w)).where(F.col("line_no") > F.col("at"))
    n = n.withColumn("stop", F.min(F.when(any_of(F.col("line"), ("prepared remarks", "questions and answers")), F.col("line_no"))).over(w))
    n = n.where((F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))) & (F.col("line_no") <= F.col("at") + span) & (F.length("line") >= 3))
    n = n.withColumn("p", name_and_role(F.col("line"))).where("p.name != ''").withColumn("rank", F.row_number().over(w.orderBy("line_no")))
    return n.where(F.col("rank") <= most).select("doc_id", "rank", "p.name", "p.role")


def enriched(blocks: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Blocks with section_type and the speaker's resolved role; typed blocks are written once, as both sides of the join read them."""
    typed = store(typed_sections(blocks))
    return typed.join(resolve_roles(speaker_stats(typed), roster), ["doc_id", "speaker"], "left")


def attribute_quotes(quotes: DataFrame, blocks: DataFrame, least: int = 24) -> DataFrame:
    """Who said a quote (doc_id, quote): the first block equal to it, else the first that holds it or (from ``least`` characters on) is held by it, else Management."""
    q = quotes.select("doc_id", "quote", quote_key(F.col("quote")).alias("q")).distinct()
    b = blocks.select("doc_id", "order_index", "speaker", quote_key(F.col("text")).alias("b"))
    near = (F.col("b") == F.col("q")) | F.contains("b", F.col("q")) | ((F.length("b") >= least) & F.contains("q", F.col("b")))
    hit = q.join(b, "doc_id").where(near).groupBy("doc_id", "quote").agg(F.min_by("speaker", F.struct(F.col("b") != F.col("q"), "order_index")).alias("speaker"))
    return quotes.join(hit, ["doc_id", "quote"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("Management")))

"""Web pages to lines of text, and the best source of a transcript among them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import store
from .transcripts import document_records, listed_participants, page_roles, speaker_blocks, transcript_slice

LINE_TAGS = {"h1", "h2", "h3", "h4", "p", "li"}
SKIPPED = {"script", "style", "noscript"}
#: Characters of lines that a worker gathers before it hands them on.
OUT_CHARS = 1_000_000
FIELDS = "page_id bigint, kind string, line_no int, line string"


#: Escapes of script payloads and what they stand for, in the order in which they are resolved.
ESCAPES = (("\\\\", "\\"), ("\\n", "\n"), ("\\t", " "), ("\\/", "/"), ('\\"', '"'), ("\\u003c", "<"), ("\\u003e", ">"), ("\\u0026", "&"), ("&amp;", "&"))


def payload_lines(data: str) -> list[str]:
    """Lines of text in a script's payload: escapes resolved, tags taken for line ends."""
    for code, char in ESCAPES:
        data = data.replace(code, char)
    parts = re.split(r"<[^>]*>|\n", data)
    return [x for p in parts if len(x := " ".join(unescape(p).split())) > 1]


class _Lines(HTMLParser):
    """Text of line tags (kind ``semantic``), all text (``relaxed``), JSON-LD article bodies (``jsonld``) and script payloads (``script``)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict[str, list[str]] = {"semantic": [], "relaxed": [], "jsonld": [], "script": []}
        self.parts: list[str] | None = None
        self.skip = ""
        self.ld = False

    def _close(self) -> None:
        if self.parts is not None:
            line = " ".join(" ".join(self.parts).split())
            if line:
                self.out["semantic"].append(line)
        self.parts = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip, self.ld = tag, ("type", "application/ld+json") in attrs
        elif tag in LINE_TAGS:
            self._close()
            self.parts = []

    def handle_endtag(self, tag: str) -> None:
        if tag == self.skip:
            self.skip, self.ld = "", False
        elif tag in LINE_TAGS:
            self._close()

    def handle_data(self, data: str) -> None:
        if self.ld:
            self._json(data)
        elif self.skip == "script" and "self.__next_f.push" in data:
            self.out["script"] += payload_lines(data)
        if self.skip:
            return
        text = " ".join(data.split())
        if text:
            self.out["relaxed"].append(text)
            if self.parts is not None:
                self.parts.append(text)

    def _json(self, data: str) -> None:
        try:
            items = json.loads(data)
        except ValueError:
            return
        for x in items if isinstance(items, list) else [items]:
            body = x.get("articleBody") if isinstance(x, dict) else None
            if isinstance(body, str):
                self.out["jsonld"] += [" ".join(b.split()) for b in unescape(body).splitlines() if b.strip()]


def lines_of(html: str) -> dict[str, list[str]]:
    """Lines by kind: semantic ones without repeats of the line before, relaxed ones each once."""
    p = _Lines()
    p.feed(html)
    p.close()
    p._close()
    s = p.out["semantic"]
    return {"semantic": [x for k, x in enumerate(s) if k == 0 or x != s[k - 1]], "relaxed": list(dict.fromkeys(p.out["relaxed"])), "jsonld": p.out["jsonld"], "script": p.out["script"]}


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, kind, line_no, line of (page_id, html); malformed pages give what can be read. A worker holds the lines of some OUT_CHARS characters, or of one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, chars = [[], [], [], []], 0
        for b in batches:
            for row in range(b.num_rows):
                i, h = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                for kind, lines in lines_of(h or "").items():
                    for part, more in zip(cols, ([i] * len(lines), [kind] * len(lines), range(len(lines)), lines), strict=True):
                        part.extend(more)
                    chars += sum(map(len, lines))
                if chars >= OUT_CHARS:
                    yield _line_batch(cols)
                    cols, chars = [[], [], [], []], 0
        yield _line_batch(cols)

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(run, FIELDS)


def _line_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "kind", "line_no", "line"])


# What marks a transcript on a page, and what marks the site around it.
SOURCE_MARKS = ("prepared remarks", "questions and answers", "q&a", "call participants", "full conference call transcript")
SITE_WORDS = ("all services", "best stocks to buy", "stock advisor", "retirement news", "best credit cards", "premium investing services")
SPEAKER = r"^[A-Za-z][A-Za-z .,'&()\-/]{1,90}:\s*.+"


def best_source(lines: DataFrame, speaker: str = SPEAKER) -> DataFrame:
    """Per page the kind of lines most like a transcript: kind, score, lines.

    10 points for each speaker line, 25 for each mark that occurs, one per 5,000 of the first 50,000 characters, 35 if a slice of eight
    lines or more can be cut out; 40 less for script calls, 20 for escaped tags, 8 for each word of the site around.
    """
    low = F.lower("line")
    has = lambda word: F.max(F.contains(low, F.lit(word)).cast("int"))
    marks = reduce(lambda x, w: x + has(w), SOURCE_MARKS, F.lit(0))
    site = reduce(lambda x, w: x + has(w), SITE_WORDS, F.lit(0))
    start = F.min(F.when(low.rlike(r"^(prepared remarks|questions and answers|q&a|call participants|full conference call transcript)\b") | F.col("line").rlike(speaker), F.col("line_no")))
    chars = F.sum(F.length("line") + 1) - 1
    score = F.count_if(F.col("line").rlike(speaker)) * 10 + marks * 25 + F.least(chars, F.lit(50_000)) / 5000.0 - has("self.__next_f.push") * 40 - has("\\u003c") * 20 - site * 8
    sliced = F.when(F.max("line_no") - start + 1 >= 8, 35).otherwise(0)
    scored = lines.groupBy("page_id", "kind").agg((score + sliced).alias("score"), F.count(F.lit(1)).alias("lines"))
    return scored.groupBy("page_id").agg(F.max_by(F.struct("kind", "score", "lines"), F.struct(F.col("score"), F.col("kind"))).alias("x")).select("page_id", "x.*")


def page_transcripts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, facts) of pages: the best lines, the transcript among them, its blocks with roles and types, and how far to trust it.

    sections: doc_id (the page), order_index, speaker, text, role, section. facts: doc_id, kind, sections, speakers, chars,
    participants, reason (what the slice starts at) and confidence: 0.32, more for a start and a stop, for prepared
    remarks, for questions, and for thirty lines.
    """
    lines = store(page_lines(pages))
    best = lines.join(best_source(lines).select("page_id", "kind"), ["page_id", "kind"]).select(F.col("page_id").alias("doc_id"), "kind", "line_no", "line")
    best = store(best.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))))
    cut = store(transcript_slice(best, ["doc_id"]))
    inside = best.join(cut, "doc_id").where(F.col("start").isNull() | ((F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("stop"))))
    people = listed_participants(best)
    blocks = store(speaker_blocks(inside.select("doc_id", "line_no", "line")))  # read in every branch of the roles
    sections = store(page_roles(blocks, people.select("doc_id", "name", "role")).select("doc_id", "order_index", "speaker", "text", "role", "section"))
    low = F.lower("line")
    seen = best.join(cut, "doc_id").groupBy("doc_id").agg(
        F.first("kind").alias("kind"), F.first("reason").alias("reason"), F.max(low.startswith("prepared remarks")).alias("prepared"), F.max(low.startswith("questions and answers")).alias("qa"),
        F.count_if((F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("stop"))).alias("cut"), (F.first("start") > 1).alias("late"), (F.first("stop") <= F.max("line_no")).alias("stopped"),
    )
    plus = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0.0)
    sure = F.lit(0.32) + plus(F.col("late"), 0.08) + plus(F.col("stopped"), 0.10) + plus(F.col("prepared"), 0.18) + plus(F.col("qa"), 0.18) + plus(F.col("cut") >= 30, 0.14)
    facts = seen.select("doc_id", "kind", "reason", F.least(F.lit(1.0), F.round(sure, 3)).alias("confidence"))
    facts = facts.join(document_records(sections), "doc_id", "left").join(people.groupBy("doc_id").agg(F.count(F.lit(1)).alias("participants")), "doc_id", "left")
    return sections, facts.fillna(0, ["sections", "speakers", "chars", "participants"])


def speaker_start(lines: DataFrame, speaker: str, keys: list[str], span: int = 25) -> DataFrame:
    """Per key the first speaker line within whose next ``span`` lines two different people speak."""
    who = F.when(F.col("line").rlike(speaker), F.regexp_extract("line", r"^([^:]+):", 1))
    w = Window.partitionBy(*keys).orderBy("line_no").rangeBetween(0, span)
    two = F.size(F.collect_set("who").over(w)) >= 2
    return lines.withColumn("who", who).withColumn("two", two).groupBy(*keys).agg(F.min(F.when(F.col("who").isNotNull() & F.col("two"), F.col("line_no"))).alias("start"))

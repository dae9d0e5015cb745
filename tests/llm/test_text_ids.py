"""Ids that are text are kept as they are."""

from __future__ import annotations

from corvane.llm import htmlextract, langid, linededup, mixing, quality, simhash

from helpers import GOOD, empty
from pyspark.sql import functions as F

ROWS = [("doc-b", GOOD, "en", "a"), ("doc-a", GOOD, "en", "a"), ("0017", GOOD + " and one more line of words here", "en", "b"), (None, "a text without an id but with words", "de", None), ("", None, "de", "b")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string, lang string, source string")


def test_text_ids(spark):
    d = docs(spark)
    ids = {r[0] for r in ROWS}
    assert {r.doc_id for r in quality.judge(d).collect()} == ids
    assert {r.doc_id for r in langid.identify(d, langid.Model()).collect()} == ids
    assert {r.doc_id: r.size for r in mixing.mix_summary(d).collect()} == {r[0]: len((r[1] or "").split()) for r in ROWS}
    classes = {r.doc_id: r.component_id for r in simhash.near_classes(d).collect()}
    assert classes["doc-b"] == classes["doc-a"] == "doc-a" and classes[""] == ""
    assert {r.doc_id for r in simhash.drop_near_copies(d).collect()} == ids - {"doc-b"}


def test_text_ids_in_lines(spark):
    left = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark)).collect()}
    # the least id by code point comes first: "0017" keeps its first line, the others lose it
    first, second = GOOD.split("\n")
    assert left["0017"] == GOOD + " and one more line of words here"
    assert left["doc-a"] == second and left["doc-b"] == "" and left[""] is None
    assert left[None] == "a text without an id but with words"


def test_text_ids_of_pages(spark):
    pages = spark.createDataFrame([("p-1", "http://a/1", None)], "page_id string, url string, html string")
    assert [(r.page_id, r.text) for r in htmlextract.extract(pages, model=htmlextract.Labeller()).collect()] == [("p-1", "")]


def test_integer_ids_stay_bigint(spark):
    d = empty(spark).withColumn("doc_id", F.col("doc_id").cast("int"))
    for out in (quality.judge(d), simhash.near_classes(d), mixing.mix_summary(d), langid.identify(d, langid.Model())):
        assert out.schema["doc_id"].dataType.simpleString() == "bigint"

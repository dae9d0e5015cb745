from __future__ import annotations

import zlib

import numpy as np
from helpers import DOCS, awkward, empty
from support import SMALL, database

from corvane.llm import langid as L
from corvane.llm import queries


def test_held_out_accuracy(spark):
    lang = dict(database(SMALL).execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op10_language_id(spark, SMALL).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = L.fit_svm(x, y)
    assert (np.sign(np.hstack([x, np.ones((200, 1))]) @ w) == y).mean() > 0.95


def test_awkward_rows(spark):
    model = L.train(awkward(spark))
    got = {r.doc_id: r for r in L.identify(awkward(spark), model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert got[1].lang_pred in ("en", "de", "fr")
    assert L.identify(empty(spark), model).count() == 0
    nothing = L.train(empty(spark))
    assert {r.lang_pred for r in L.identify(awkward(spark), nothing).collect()} == {"und"}


def test_unknown_languages_and_one_language(spark):
    docs = spark.createDataFrame([(i, t * 5, lang, "s", 1) for i, (t, lang) in enumerate([("abc def ", "xx"), ("ghi jkl ", "yy"), ("abd deg ", "xx"), ("ghj jkm ", "yy")])], DOCS)
    model = L.train(docs)
    assert [r.lang_pred for r in L.identify(docs, model).orderBy("doc_id").collect()] == ["xx", "yy", "xx", "yy"]
    alone = L.train(docs.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in L.identify(docs, alone).collect()} == {("xx", 1.0)}

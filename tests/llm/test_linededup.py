from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import awkward, empty

from corvane.llm import linededup as L


def brute(docs):
    """Each line against all earlier ones."""
    lines = [(d, i, line.encode().split()) for d, t in sorted(docs) if t is not None for i, line in enumerate(t.split("\n"))]
    gone = set()
    for k, (d, i, w) in enumerate(lines):
        for _, _, v in lines[:k]:
            if w and v and (w == v or L.within_one_edit(w, v)):
                gone.add((d, i))
                break
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def edit(rng, w):
    w = list(w)
    k = rng.randrange(len(w) + 1)
    kind = rng.randrange(4)
    if kind == 0:
        w.insert(k, "new")
    elif kind == 1 and k < len(w):
        w[k] = "other"
    elif kind == 2 and k < len(w):
        del w[k]
    return w


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12))] for _ in range(12)]
    docs = [(d, "\n".join(" ".join(edit(rng, edit(rng, rng.choice(base)) if rng.random() < 0.4 else rng.choice(base))) for _ in range(rng.randrange(1, 6)))) for d in range(60)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute(docs)


def test_variant_hashes_are_those_of_the_shorter_line():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    whole, variants = L.variant_hashes(h)
    for i in range(40):
        assert L.variant_hashes(np.delete(h, i))[0] == variants[i]
    assert L.variant_hashes(h)[0] == whole


def test_awkward_rows(spark):
    df = awkward(spark)
    out = L.dedup_lines(df)
    assert out.columns == df.columns and out.count() == 10
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[2] == ["", ""] and by[3] == [None] and by[4] == [""] and by[8] == ["one\n\n\ntwo"] and len(by[6][0]) > 100_000
    assert L.dedup_lines(empty(spark)).count() == 0
    detail = {r.doc_id: r for r in L.dedup_lines(df.select("doc_id", "text"), detail=True).collect()}
    assert detail[2].emptied and not detail[4].emptied and detail[2].n_removed == 2


def test_a_document_given_twice_keeps_its_lines(spark):
    rows = [(1, "a b c d e f\nx y"), (1, "a b c d e f\nx y")]
    got = [r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert got == ["a b c d e f\nx y"] * 2


def test_bound_and_clashes(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five seven\none two three four five six")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = lambda edits: {r.doc_id: r.text for r in L.dedup_lines(df, edits=edits).collect()}
    assert text(0)[2] == "one two three four five seven" and text(1)[2] == ""
    with pytest.raises(ValueError):
        L.dedup_lines(df, edits=2)
    with pytest.raises(ValueError):
        L.dedup_lines(df.withColumn("emptied", df.doc_id), detail=True)

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from helpers import awkward, empty
from support import SMALL, database

from corvane.llm import decontam

BENCH = "item_id bigint, text string"
DOC = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench):
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for i, b in bench:
            bw = words(b)
            n = min(13, len(bw))
            for k in range(len(bw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == bw[k : k + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(i))
        out.append((d, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(rng):
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "é", "x1"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 20])))) for i in range(8)] + [(99, None), (100, "!!"), (101, "")]
    docs = []
    for d in range(25):
        t = [word() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            t += (rng.choice(bench)[1] or "").split()
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(t)))
    return docs + [docs[0], (50, None)], bench


@pytest.mark.parametrize("bounds", [{}, {"max_broadcast": 0}])
def test_against_brute_force(spark, bounds):
    rng = random.Random(7)
    docs, bench = case(rng)
    bench = [(i, t if t is None else t) for i, t in bench]
    got = decontam.find_hits(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH), **bounds).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got), key=str) == brute(docs, bench)


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "some words here"), (2, None)], BENCH)
    got = decontam.find_hits(awkward(spark), bench).collect()
    assert len(got) == 10 and sum(r.contaminated for r in got) == 1
    assert decontam.find_hits(empty(spark), bench).count() == 0
    assert decontam.find_hits(awkward(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    clean = decontam.decontaminate(awkward(spark), bench)
    assert clean.count() == 9 and clean.columns == awkward(spark).columns


def test_spans_are_cut_out(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"Keep This, {passage.upper()}! and that."), (2, "nothing"), (3, passage), (4, None)], DOC)
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, spark.createDataFrame([(1, passage)], BENCH), mode="spans").collect()}
    assert got == {1: "Keep This, and that.", 2: "nothing", 3: "", 4: None}


def test_a_set_of_many_windows(spark):
    """Every third text is an item itself, so there are as many windows as words; both ways give the plain version's rows."""
    con = database(SMALL)
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    bench = con.execute("SELECT item_id, text FROM benchmark").fetchall() + [(10_000 + d, t) for d, t in docs if d % 3 == 0]
    where = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            where[tuple(w[k : k + n])].add(str(i))
    lens, want = {len(g) for g in where}, {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in lens:
            for p in range(len(w) - n + 1):
                if (found := where.get(tuple(w[p : p + n]))) and n:
                    hit |= set(range(p, p + n))
                    items |= found
        want[d] = (len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w))
    for bounds in ({}, {"max_broadcast": 0}):
        got = decontam.find_hits(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH), **bounds).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got} == want

"""The whole pipeline against a plain version of it."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import pytest
from corvane.llm import linededup
from helpers import awkward, empty, table
from support import SMALL, database
from test_decontam import brute as brute_hits
from test_linededup import brute as brute_lines
from test_mixing import targets
from test_quality import brute_repeats
from test_simhash import classes, near, plain_fingerprint


def failures(text):
    """Which rules a text breaks, counted word by word and line by line."""
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(w) < 20 or 100 * brute_repeats(w) > 30 * len(w),
        10 * sum((text or "").count(c) for c in "#*$%&|<>") > 3 * len(w),
        10 * (len(lines) - len(set(lines))) > 3 * len(lines),
        sum(len(x.decode()) for x in w) < 2 * len(w) or sum(len(x.decode()) for x in w) > 15 * len(w),
    )


def bad_hosts(docs):
    """Hosts of which some rule's shrunk failure rate is over a half."""
    by = defaultdict(list)
    for _, t, s in docs:
        by[s].append(failures(t))
    bad = set()
    for k in range(4):
        rates = [sum(f[k] for f in fs) / len(fs) for fs in by.values()]
        m = sum(rates) / len(rates)
        v = sum((r - m) ** 2 for r in rates) / len(rates)
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1.0
        bad |= {s for s, fs in by.items() if (sum(f[k] for f in fs) + m * strength) / (len(fs) + strength) > 0.5}
    return bad


def plain(con):
    docs = con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    bad = bad_hosts(docs)
    keep = {d for d, t, s in docs if not failures(t)[0] and s not in bad}
    docs = [x for x in docs if x[0] in keep]
    texts = brute_lines([(d, t) for d, t, _ in docs])
    docs = [(d, texts[d], s) for d, t, s in docs if texts[d] == t or texts[d].encode().split()]
    fp = {d: plain_fingerprint(t) for d, t, _ in docs}
    same = classes(near(sorted(set(fp.values()))), set(fp.values()))
    first: dict[int, int] = {}
    for d, f in fp.items():
        first[same[f]] = min(d, first.get(same[f], d))
    docs = [x for x in docs if first[same[fp[x[0]]]] == x[0]]
    bad = {r[0] for r in brute_hits([(d, t) for d, t, _ in docs], con.execute("SELECT item_id, text FROM benchmark").fetchall()) if r[4]}
    return [x for x in docs if x[0] not in bad]


def test_run_against_plain_version(spark):
    assert linededup.MIN_EDIT_WORDS == 5
    docs = plain(database(SMALL))
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r["size"] for r in rows} == {d: len(t.encode().split()) for d, t, _ in docs}
    sizes: dict[str, int] = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(t.encode().split())
    want, source, taken = targets(sizes), {d: s for d, _, s in docs}, defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 1 for s in sizes)


def test_awkward_and_empty_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, "nothing of this kind")], "item_id bigint, text string")
    for df, n in ((awkward(spark), 1), (empty(spark), 0)):
        table(spark, tmp_path, "documents", df)
        sf_dir = table(spark, tmp_path, "benchmark", bench)
        assert corpus_pipeline.run(spark, sf_dir).count() == n
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes

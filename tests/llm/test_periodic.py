from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from helpers import awkward, empty, table

from corvane.llm import queries
from corvane.llm.periodic import find_runs, runs


def brute(w) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        k, n, w = rng.choice([1, 2, 3, 6, 30]), rng.randrange(120), []
        while len(w) < n:
            block = [rng.randrange(k) for _ in range(rng.randrange(1, 12))]
            w += (block * rng.choice([1, 1, 3, 4, 6]))[: rng.randrange(1, 80)]
        assert runs(np.array(w, np.int64)) == brute(w), w


def test_long_runs_take_little_time():
    for w in ([1] * 200_000, [1, 2] * 100_000, list(range(5000)) * 30, sum(([1] * (30 + i % 7) + [2] for i in range(3000)), [])):
        found = runs(np.array(w, np.int64))
        assert found
        for s, n, q in found[:20]:
            assert w[s : s + n - q] == w[s + q : s + n]


def expected(doc_id, text):
    words = [] if text is None else text.encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    said = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(found), *best, 1000 * best[1] // best[2] if found else None, sha256(said.encode()).hexdigest(), sha256(kept).hexdigest()


def test_query_and_awkward_rows(spark, tmp_path):
    rng = random.Random(3)
    made = [(i, " ".join([rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(1, 9))] * rng.choice([1, 2, 4, 7]))) for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string").unionByName(awkward(spark, extra=False).where("doc_id != 6 OR doc_id IS NULL").select("doc_id", "text"))
    out = queries.op13_periodic_runs(spark, table(spark, tmp_path, "documents", docs)).collect()
    want = sorted(((r.doc_id, *expected(r.doc_id, r.text)) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert sum(r.n_runs > 0 for r in out) > 20


def test_columns_and_empty(spark):
    out = find_runs(awkward(spark).drop("start"), collapsed=True)
    assert out.count() == 10
    one = {r.doc_id: r for r in out.collect()}[6]
    assert one.n_runs == 1 and one.period == 977 and one.length == 30_000
    assert len(one.collapsed.split()) == 977
    assert find_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="length"):
        find_runs(spark.sql("SELECT 'x' AS text, 1 AS length"))
    assert find_runs(spark.sql("SELECT 'x x x x x x' AS text, 1 AS length"), keep=["text"]).first().n_runs == 1

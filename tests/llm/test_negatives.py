from __future__ import annotations

import math
import random

import pytest
from helpers import table
from pyspark.sql import functions as F

from corvane.llm import negatives, queries

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchor, k=5):
    """rows of (id, label, integer vector)."""
    out = []
    for a in [r for r in rows if anchor(r[0])]:
        score = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in rows if r[0] != a[0]))
        positives = [(-s, i) for s, i, lab in score if lab == a[1]][:k]
        for ps, pid in positives:
            inside = [(-s, i) for s, i, lab in score if lab != a[1] and 80 * ps <= -100 * s <= 100 * ps][:k]
            out += [(a[0], pid, rank, nid, ps, ns) for rank, (ns, nid) in enumerate(inside, 1)]
    return sorted(out)


def whole(rows, shift=True):
    kept = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i, (lab + 1) % 10 if shift and i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)] = 1
    return list(kept)


def made(n, seed=1, dim=6):
    """Clusters, loose rows, very many copies of one vector, ties, and rows that take no part."""
    rng = random.Random(seed)
    f = lambda x: float(round(x * 64) / 64)  # noqa: E731  whole in floats
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, [f(c + rng.gauss(0, 0.1)) for c in rng.choice(centres)] if i % 3 else [f(rng.gauss(0, 1)) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, [1.0] * dim, i % 3) for i in range(n // 2)]
    odd = 3 * n
    return rows + [(odd, None, 1), (odd + 1, [1.0] * dim, None), (odd + 2, [float("nan")] * dim, 1), (odd + 3, [1.0, None] + [0.0] * (dim - 2), 1), (odd + 4, [float("inf")] * dim, 2), (None, [1.0] * dim, 1), rows[0], rows[100]]


def test_query_equals_brute_force(spark, tmp_path):
    rows = made(900)
    got = queries.op12_hard_negatives(spark, table(spark, tmp_path, "embeddings", spark.createDataFrame(rows, ROWS).repartition(5)))
    want = brute(whole(rows), lambda i: i % 100 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert len(want) > 100


@pytest.mark.parametrize("lists", [1, 40])
def test_any_lists_give_the_same(spark, lists):
    rows = made(300, seed=2)
    df = spark.createDataFrame(rows, ROWS).withColumnRenamed("label", "kind").withColumns({c: F.lit("x") for c in ("id", "vec", "list", "score", "rank", "block", "label")})
    got = negatives.hard_negatives(df, anchor=F.col("vec_id") % 10 == 3, label="kind", lists=lists)
    assert sorted(map(tuple, got.collect())) == sorted((a, p, r, n, ps, ns) for a, p, r, n, ps, ns in brute(whole(rows, shift=False), lambda i: i % 10 == 3))


def test_blocks_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rows = made(200, seed=3)
    got = negatives.hard_negatives(spark.createDataFrame(rows, ROWS), anchor=F.col("vec_id") % 5 == 0, lists=3)
    assert sorted(map(tuple, got.collect())) == brute(whole(rows, shift=False), lambda i: i % 5 == 0)


def test_lengths_and_empty(spark):
    rows = [(0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0], 1), (2, [1.0], 2), (3, [], 2), (4, [1.0, 1.0, 1.0], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(map(tuple, got)) == brute(whole(rows, shift=False), lambda i: True)
    assert negatives.hard_negatives(spark.createDataFrame([], ROWS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, None, 1), (2, [], 1)], ROWS)).count() == 0


def test_bounds_hold_and_large_products():
    import numpy as np

    rng = np.random.default_rng(1)
    x, a = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (20, 16))
    c = rng.normal(0, 100, (5, 16))
    own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    radius = np.array([np.sqrt(((x[own == i] - c[i]) ** 2).sum(axis=1)).max(initial=0) for i in range(5)])
    low, high = negatives.bounds(a, c, radius)
    s = negatives.products(a, x)
    assert ((low[:, own] <= s) & (s <= high[:, own])).all()
    big = np.array([[2**30, 3]])
    assert negatives.products(big, big)[0, 0] == 2**60 + 9
    with pytest.raises(ArithmeticError):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))

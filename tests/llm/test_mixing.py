from __future__ import annotations

import math
from collections import defaultdict

import pytest
from helpers import DOCS, awkward, empty
from pyspark.sql import functions as F
from support import SMALL, database

from corvane.llm import mixing as M
from corvane.llm import queries


def targets(sizes):
    """Shares by weight, stopped at three times the size, the excess dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * left / w > 3 * sizes[s]} if w else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * left / w for s in names}
        capped |= over


def corpus(spark, shape):
    rows = [(len_ * 1000 + i + 100_000 * k, " ".join(["w"] * len_), "en", s, 1) for k, (s, n, len_) in enumerate(shape) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("shape", [[("a", 50, 40), ("b", 5, 30), ("c", 3, 20), (None, 10, 100)], [("a", 200, 50), ("b", 1, 3), ("c", 2, 1)], [("only", 7, 11)]])
def test_targets_and_taken(spark, shape):
    docs = corpus(spark, shape)
    sizes = {s: n * k for s, n, k in shape}
    want = targets(sizes)
    rows = M.mix_summary(docs).collect()
    of = {r.doc_id: r.source for r in docs.collect()}
    taken = defaultdict(int)
    for r in rows:
        s = of[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 1)
    assert sorted(map(tuple, M.mix_summary(docs.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_blocks_are_equal_and_every_stretch_holds_the_shares(spark):
    docs = corpus(spark, [("a", 300, 40), ("b", 100, 40), ("c", 40, 50)])
    sources, _, mix = M.schedule(docs, block_tokens=16)
    per_slot = mix.groupBy("source_no", "slot").agg(F.sum("tokens").alias("n")).groupBy("source_no").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    assert all(r.hi - r.lo <= 1 for r in per_slot)
    share = {r.source_no: r.slots for r in sources.collect()}
    m = sum(share.values())
    slots = {r.slot: r.source_no for r in mix.select("slot", "source_no").distinct().collect()}
    assert sorted(slots) == list(range(m))
    for first in (0, m // 3, m // 2):
        for n in (40, 100):
            for s, k in share.items():
                got = sum(slots[i] == s for i in range(first, min(first + n, m)))
                assert abs(got - k * min(n, m - first) / m) <= 4


def test_stride_is_prime_to_m():
    assert all(math.gcd(M.stride(m), m) == 1 for m in range(1, 400))


def test_awkward_rows(spark):
    rows = M.mix_summary(awkward(spark)).collect()
    assert len(rows) == 10 and {r.doc_id: r.taken for r in rows}[3] == 0
    assert M.mix_summary(empty(spark)).count() == 0
    assert [r.taken for r in M.mix_summary(spark.createDataFrame([(1, None, "en", "a", 1), (2, "", "en", None, 1)], DOCS)).collect()] == [0, 0]


def test_query_against_plain_schedule(spark):
    """Slot by slot: the point, its source among the cumulative shares, the source's next block, the block's words."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sources, placed, _ = M.schedule(docs)
    src = sorted(sources.collect(), key=lambda r: (r.source is None, r.source or ""))
    m = sum(r.slots for r in src)
    g = M.stride(m)
    streams, taken, upto, ranks = defaultdict(list), defaultdict(int), [], defaultdict(int)
    for r in placed.collect():
        streams[r.source_no].append((r.before, r["size"], r.doc_id))
    for r in src:
        upto.append((upto[-1] if upto else 0) + r.slots)
    assert all(sum(s for _, s, _ in streams[r.source_no]) == r.source_size for r in src)
    for k in range(m):
        at = next(n for n, u in enumerate(upto) if k * g % m < u)
        r = src[at]
        b = ranks[at] % r.blocks
        ranks[at] += 1
        lo, hi = -(-b * r.source_size // r.blocks), -(-(b + 1) * r.source_size // r.blocks)
        for before, size, doc in streams[r.source_no]:
            taken[doc] += max(0, min(hi, before + size) - max(lo, before))
    words = {d: len((t or "").encode().split()) for d, t in database(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()}
    got = queries.op9_mixing(spark, SMALL).collect()
    assert {r.doc_id: r["size"] for r in got} == words and {r.doc_id: r.taken for r in got} == {d: taken[d] for d in words}


def test_sources_are_numbered_over_ranges(spark):
    names = [f"s{k:04d}" for k in range(500)] + ["", "Z", "é", "😀", None]
    rows = spark.createDataFrame([(n, 10 + k) for k, n in enumerate(names)], "source string, source_size bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = M.with_targets(rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["range"] for r in got}) > 1
    order = sorted((n for n in names if n is not None), key=str.encode) + [None]
    assert {r["source"]: (r["source_no"], r["weight"]) for r in got} == {n: (k + 1, float(k % 3 + 1)) for k, n in enumerate(order)}


@pytest.mark.parametrize("sizes", [[2**k for k in range(40)], [5] * 7, [0, 0, 0], [0, 9, 1], [10**6, *range(1, 200)], [1, 10**15, 3, 70_000, 70_001, 65_536]])
def test_level_of_many_saturations(spark, sizes):
    named = {f"s{k:04d}": v for k, v in enumerate(sizes)}
    rows = spark.createDataFrame(list(named.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.with_targets(rows).collect()}
    want = targets(named)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes))

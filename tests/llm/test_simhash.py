from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from helpers import DOCS, GOOD, awkward, empty
from support import SMALL, database

from corvane.llm import queries
from corvane.llm import simhash as S
from corvane.operators import graph as C


def plain_fingerprint(text):
    """A vote on each bit, one shingle after another."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in nodes}


def near(fps, bits=3):
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= bits]


def clustered(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            out.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


def test_trie_join_finds_all_pairs():
    rng = random.Random(4)
    groups = [clustered(rng, rng.choice([1, 2, 50, 120])) for _ in range(6)]
    fps, bounds = np.array([x for g in groups for x in g], np.uint64), np.cumsum([0, *map(len, groups)])
    i, j = S.trie_join(fps, bounds)
    got = {(int(fps[a]), int(fps[b])) for a, b in zip(i, j, strict=True)}
    assert got == {(min(p), max(p)) for g in groups for p in near(g)} and len(i) == len(got)


def test_links_connect_what_is_near(spark):
    rng = random.Random(9)
    fps = clustered(rng, 600)
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp bigint")
    want = classes(near(fps), fps)
    for bound in (5, 2048):  # a small bound divides subtrees again and again
        links = [(r.a % 2**64, r.b % 2**64) for r in S.near_links(df, max_nodes=bound).collect()]
        assert classes(links, fps) == want and all((a ^ b).bit_count() or a == b for a, b in links)


def test_equal_rows_are_connected():
    x, y, far = 5, 5 ^ (1 << 40) ^ 3, 5 ^ (0xFFFF << 20)
    fps = np.array(sorted([x, x, y, y, y, far, far]), np.uint64)
    i, j = S.trie_join(fps, np.array([0, len(fps)]))
    got = classes(list(zip(i.tolist(), j.tolist(), strict=True)), range(len(fps)))
    assert len({got[k] for k in range(len(fps)) if fps[k] in (x, y)}) == 1 and len(set(got.values())) == 2 and (i < j).all()


def test_hot_subtrees_of_two_parents_keep_their_links(spark):
    rng = random.Random(12)
    x = rng.getrandbits(64)
    for bits in ((0, 12, 24), (63, 51, 39)):  # the second is the mirror case
        low = bits[0] == 0
        fps = [x, x ^ sum(1 << b for b in bits)]
        while len(fps) < 60:  # nothing else is near anything: the pair's link is the only one
            new = x ^ (rng.getrandbits(27) << (0 if low else 37))
            if all((new ^ f).bit_count() > 3 for f in fps):
                fps.append(new)
        df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp bigint")
        links = [(r.a % 2**64, r.b % 2**64) for r in S.near_links(df, max_nodes=16).collect()]
        assert classes(links, fps) == classes(near(fps), fps) and len(near(fps)) == 1


def test_dense_cluster_is_divided_to_the_end(spark):
    rng = random.Random(13)
    x = rng.getrandbits(64)
    fps = sorted({x ^ rng.getrandbits(4) ^ (rng.getrandbits(3) << 30) for _ in range(90)} | set(clustered(rng, 60)))
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp bigint")
    links = [(r.a % 2**64, r.b % 2**64) for r in S.near_links(df, max_nodes=12).collect()]
    assert classes(links, fps) == classes(near(fps), fps)


def test_components_of_a_path_a_star_and_a_ring(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (1, 0)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == classes([p for p in pairs if p[0] != p[1]], nodes)
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_awkward_rows(spark):
    rows = S.near_classes(awkward(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    assert S.near_classes(empty(spark)).count() == 0
    left = S.drop_near_copies(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "6", "7", "8", "None"]


def test_ties_leave_a_bit_unset():
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0
    import xxhash

    assert S.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)


def test_fingerprints_against_plain_votes():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 4, 50):
        for _ in range(20):
            t = "".join(rng.choice(["Alpha", "é", "日本", "x1", "\u00a0b"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
            assert S.fingerprint(t) == plain_fingerprint(t)


def test_query_against_plain_version(spark):
    docs = database(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()
    fps = {d: plain_fingerprint(t) for d, t in docs}
    same = classes(near(sorted(set(fps.values()))), set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[same[f]] = min(d, least.get(same[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, SMALL).collect()}
    assert got == {d: (f"{f:016x}", least[same[f]]) for d, f in fps.items()}


def test_one_row_of_each_class_stays(spark):
    other = "Quite another text of which there is no copy anywhere in this table and that shares nothing with the rest."
    rows = [(5, GOOD), (5, GOOD), (None, GOOD), (None, GOOD), (7, GOOD), (5, other), (None, "alone without an id but with words of its own"), (None, "alone without an id but with words of its own"), (9, None), (8, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).selectExpr("*", "1 AS __d", "2 AS class")
    got = sorted(((r.doc_id, r.text) for r in S.drop_near_copies(df.drop("__d")).collect()), key=str)
    assert got == sorted([(5, GOOD), (5, other), (None, "alone without an id but with words of its own"), (8, "")], key=str)

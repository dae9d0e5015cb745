from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from helpers import LONG, awkward, empty, table

from corvane.llm import queries, suffixdedup
from corvane.llm.suffixdedup import remove_repeats


def brute(texts, k):
    """(n_bytes, n_removed, n_spans, digest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + k] for d in data for i in range(len(d) - k + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - k + 1):
            if seen[d[i : i + k]] > 1:
                gone[i : i + k] = True
        gone[-1] = False
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), sha256(bytes(c for c, g in zip(d, gone, strict=False) if not g)).hexdigest()))
    return out


def made(n, k, seed, letters="abcdef ghij é"):
    """Loose text with shared passages, some at the edge of others, copies, near copies and runs of one letter."""
    rng = random.Random(seed)
    loose = lambda m: "".join(rng.choice(letters) for _ in range(m))
    passages = [loose(rng.randrange(k - 2, 4 * k)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choice([loose(rng.randrange(3 * k)), rng.choice(passages), rng.choice(passages)[: rng.randrange(1, 3 * k)]]) for _ in range(rng.randrange(1, 6)))
        texts += [t] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.2 and t:
            at = rng.randrange(len(t))
            texts.append(t[:at] + "#" + t[at + 1 :])
    return [*texts, "x" * 5 * k, "yz" * 3 * k, None, "", "short"]


def test_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        k = rng.choice([2, 5, 8, 16, 20])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(k, 60))) for _ in range(rng.randrange(1, 20))]
        parts += [p[: rng.randrange(k, len(p) + 1)] for p in parts if len(p) > k][:5]
        if rng.random() < 0.3:
            parts += [b"\xff" * (k + 3), b"a\xff" * k]
        weights = np.array([rng.choice([1, 1, 2]) for _ in parts])
        seen = Counter()
        for p, w in zip(parts, weights, strict=True):
            for i in range(len(p) - k + 1):
                seen[p[i : i + k]] += int(w)
        want = [[i for i in range(len(p) - k + 1) if seen[p[i : i + k]] > 1] for p in parts]
        assert [f.tolist() for f in suffixdedup.repeated_windows(parts, weights, k)] == want


def test_windows_have_one_context_and_equal_windows_equal_anchors():
    rng = random.Random(2)
    k = 40
    texts = [t.encode() for t in made(40, k, 3) if t]
    first, n, anchor, key, _ = suffixdedup.contexts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), k)
    windows = [x for s, m in zip(first, n, strict=True) for x in range(s, s + m)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert windows == [s + i for s, t in zip(starts, texts, strict=False) for i in range(len(t) - k + 1)]
    data, keys = b"".join(texts), {}
    for s, m, a, h in zip(first, n, anchor, key, strict=True):
        for x in range(s, s + m):
            assert keys.setdefault(data[x : x + k], (a - x, h)) == (a - x, h)
    assert rng


@pytest.mark.parametrize(("k", "most"), [(16, 2048), (40, 2), (200, 2048)])
def test_equals_brute_force(spark, k, most):
    texts = made(120 if k < 200 else 60, k, k)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, keep=["doc_id"], min_bytes=k, max_contexts=most).collect()}
    want = brute(texts, k)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_edge_of_a_frequent_passage_is_divided(spark):
    rng = random.Random(9)
    loose = lambda: "".join(rng.choice("abcdefghij") for _ in range(60))
    passage = "".join(rng.choice("klmnop") for _ in range(50))
    texts = [loose() + passage + loose() for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, min_bytes=32, max_contexts=10, keep=["doc_id"], detail=True).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(300)] == brute(texts, 32)
    assert got[0].removed[0].start <= 60 and got[0].removed[-1].end >= 110


def test_query_and_awkward_rows(spark, tmp_path):
    docs = awkward(spark, extra=False)
    got = queries.op11_suffix_dedup(spark, table(spark, tmp_path, "documents", docs)).collect()
    rows = docs.collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([r.text if r.text is None or len(r.text) < 10_000 else None for r in rows], 200), strict=True)), key=str)
    plain = sorted((tuple(r) for r in got if r.n_bytes < 10_000), key=str)
    assert plain == [w for w in want if w[0] != 6]
    long = next(r for r in got if r.n_bytes > 10_000)  # 977 words over and over: all of it repeats
    assert long.n_removed == long.n_bytes == len(LONG) and long.n_spans == 1


def test_columns_segments_and_empty(spark, monkeypatch):
    assert remove_repeats(awkward(spark)).count() == 10
    assert remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="kept"):
        remove_repeats(awkward(spark).withColumnRenamed("th", "kept"))
    with pytest.raises(ValueError, match="16"):
        remove_repeats(empty(spark), min_bytes=8)
    ids = spark.createDataFrame([("a", "q" * 300), ("b", "r" * 100), (None, None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(ids).collect()) == [("None", 0), ("a", 300), ("b", 0)]
    # shuffled joins give what broadcast ones give
    monkeypatch.setattr(suffixdedup, "BROADCAST", 0)
    texts = made(40, 24, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, keep=["doc_id"], min_bytes=24).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 24)


def test_long_text_in_segments():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 2 * suffixdedup.SEGMENT + 5000, dtype=np.uint8)
    data[-3000:] = data[100:3100]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data.tobytes()])], names=["rk", "th", "text"])
    places = np.concatenate([b.column("place").to_numpy() for b in suffixdedup._marks(200)(iter([batch]))])
    n = (places >> 16) & 0xFFFF
    assert n.sum() == len(data) - 199
    x = places >> 32
    assert (np.sort(x)[1:] == np.sort(x + n)[:-1]).all()

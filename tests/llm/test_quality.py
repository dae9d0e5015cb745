from __future__ import annotations

import random

from helpers import GOOD, awkward, empty

from corvane.llm import quality


def brute_repeats(words):
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(8)}
    return len(hit)


def test_repeats_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 60))]
        assert quality.repeat_words(words) == brute_repeats(words)


def test_awkward_rows(spark):
    rows = quality.judge(awkward(spark)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[1].kept and not by[6].kept
    assert quality.judge(empty(spark)).count() == 0
    kept = quality.keep_good(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]


def test_a_host_that_mostly_fails_goes_whole(spark):
    rows = [(i, "junk", "en", "bad", 1) for i in range(40)] + [(100, GOOD, "en", "bad", 1)] + [(200 + i, GOOD, "en", f"ok{i % 5}", 1) for i in range(40)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert not got[100].base_failed and not got[100].kept and all(got[200 + i].kept for i in range(40))

"""Hand-evaluated cases of the library's operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import scoring as S
from corvane.functions import text as T
from corvane.operators import feeds, fundamentals, metrics, neardup, segments, transcripts
from corvane.plans import report
from corvane.streaming.feeds import daily_sentiment


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_density_is_capped_per_term(spark):
    df = spark.sql("SELECT 'we expect growth growth growth growth' AS text")
    r = df.select(S.density("text", {"expect": 0.8, "growth": 0.7}).alias("d"), S.matched_terms("text", {"expect": 0.8, "none": 1.0, "growth": 0.7}).alias("m")).first()
    assert r.d == pytest.approx(2.9 / 4.5) and r.m == ["expect", "growth"]


def test_phrases_end_at_letters_of_any_script(spark):
    r = spark.sql("SELECT 'éai ai we\\'ll see' AS text").select(S.term_hits("text", "ai").alias("a"), S.term_hits("text", "we'll see").alias("b")).first()
    assert tuple(r) == (1, 1)


def test_block_without_hits_or_digits(spark):
    zero = {k: F.lit(0.0) for k in ("forward", "risk", "hedge", "specificity", "forward_counter", "confidence", "confidence_counter", "specificity_counter", "directness")}
    r = one(spark, **S.block_scores(zero, F.lit(0.0)))
    assert (r.confidence, r.evasiveness, r.specificity, r.outlook, r.risk) == pytest.approx((50, 59, 44, 46, 54))
    r = one(spark, **S.block_scores(zero, F.lit(1.0)))
    assert (r.confidence, r.evasiveness, r.specificity) == pytest.approx((62.0913, 47.7634, 71.0839), abs=1e-3)


def test_terms_counted_in_one_pass_equal_one_pattern_each(spark):
    terms = {"free cash flow": 1.0, "cash": 0.7, "cash flow": 0.5, "can't comment": 1.2, "write-down": 1.0, "we": 0.3, "a b a": 0.4, "$5b": 2.0, "r&d": 0.9, "late  gap": 0.6, "Über": 0.2, "flow": 0.8, "none": 0.0}
    other = {"flow": 1.0, "free": 0.1, "b": 0.3, "comment": 0.4}
    texts = [
        None, "", "flow", "Free cash flow, free  cash flow; FREE CASH\nFLOW and free cash flow. cash cash cash cash", "We can't comment: we can\u2019t. write-down writedown write - down", "a b a b a b a", "cost $5b and $5billion, r&d r & d R&D",
        "late  gap late gap", "\u00fcber \u00dcber u\u0308ber we\u0308 \u00e9we we_ we9 we-we 'we'", "flow free cash", "free cash", "x" * 5000 + " cash flow", "cash" * 50, "free cash free cash flow cash flow",
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").withColumn("hits", S.term_counts("text", terms, other))
    both = [(f"{kind}{k}", x, y) for k, lexicon in enumerate((terms, other)) for kind, x, y in (("d", S.counted_density("hits", lexicon), S.density("text", lexicon)), ("m", S.counted_terms("hits", lexicon), F.transform(S.matched_terms("text", lexicon), F.lower)))]
    pairs = {"t": terms, "o": other}
    rows = df.select("id", *[x.alias(f"new_{n}") for n, x, _ in both], *[F.coalesce(y, F.array().cast("array<string>")).alias(f"old_{n}") if n[0] == "m" else y.alias(f"old_{n}") for n, _, y in both], S.counted_topic("hits", pairs).alias("new_p"), S.topic("text", pairs).alias("old_p")).collect()
    for r in rows:
        for n in [n for n, *_ in both] + ["p"]:
            assert r[f"new_{n}"] == r[f"old_{n}"], (texts[r.id], n)


def test_topic_ties_go_to_the_earlier_topic(spark):
    pick = lambda text, topics: spark.sql(f"SELECT '{text}' AS text").select(S.topic("text", topics)["topic"]).first()[0]
    assert pick("a b", {"x": {"a": 1.0}, "y": {"b": 1.0}}) == "x" and pick("c", {"x": {"a": 1.0}}) == "general"


def test_growth_severity_stance_and_bands(spark):
    g = lambda a, b: one(spark, g=S.growth_percent(F.lit(a).cast("double"), F.lit(b).cast("double"))).g
    assert [g(120, 100), g(-1, -2), g(5, 0), g(None, 1)] == [20, 50, None, None]
    r = one(spark, a=S.stance(F.lit(0.12)), b=S.stance(F.lit(-0.12)), c=S.stance(F.lit(0.1199)), d=S.nearest_band(F.lit(40.0)), e=S.severity(F.lit(25.0)), f=S.band_score(F.lit(" High ")))
    assert tuple(r) == ("bullish", "bearish", "mixed", "low", "high", 70.0)


def test_weights(spark):
    assert S.shares({k: 0.0 for k in S.WEIGHTS}) == {"transcript": 0.4, "fundamentals": 0.35, "news": 0.15, "social": 0.1}
    assert S.shares({"transcript": -1, "news": float("nan"), "social": 2})["social"] == 1
    with pytest.raises(ValueError):
        report.overrides({"other": 1})
    assert report.overrides({"weight_news": 500})["weight_news"] == 100


def test_calibrated_probability_at_the_means(spark):
    p = one(spark, p=S.transcript_probability({k: F.lit(m) for k, (_, m, _) in S.CALIBRATION.items()})).p
    assert p == pytest.approx(0.495066, abs=1e-6)


def test_recency(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    at = lambda s: S.recency(F.lit(s).cast("timestamp"), now, 30)
    r = one(spark, a=at(None), b=at("2024-01-16 00:00:00"), c=at("2024-01-01 00:00:00"))
    assert tuple(r) == (0.35, 0.5, 0.0)


def test_greedy_distinct_looks_at_kept_rows_only(spark):
    rows = spark.createDataFrame([("s", 1, "u1", "t1"), ("s", 2, "u2", "t1"), ("s", 3, "u2", "t2")], "symbol string, ord int, url string, key string")
    assert sorted(r.ord for r in feeds.greedy_distinct(rows, ["symbol"], "ord", ["url", "key"]).collect()) == [1, 3]
    assert feeds.greedy_distinct(rows.limit(0), ["symbol"], "ord", ["url", "key"]).count() == 0


def test_greedy_distinct_against_a_loop(spark):
    rng = random.Random(5)
    data = [(f"s{rng.randrange(2)}", i, f"u{rng.randrange(12)}", f"t{rng.randrange(12)}") for i in range(120)]
    urls, keys, want = set(), set(), []
    for s, i, u, t in data:
        if (s, u) not in urls and (s, t) not in keys:
            urls.add((s, u))
            keys.add((s, t))
            want.append(i)
    got = feeds.greedy_distinct(spark.createDataFrame(data, "symbol string, ord int, url string, key string"), ["symbol"], "ord", ["url", "key"])
    assert sorted(r.ord for r in got.collect()) == want


def test_greedy_distinct_keeps_rows_without_marks(spark):
    rows = spark.createDataFrame([("s", 1, "u1", None), ("s", 2, "u1", None), ("s", 3, None, "t"), ("s", 4, None, "t"), (None, 5, "u1", None), (None, 6, "u1", "t"), ("s", 7, None, None)], "symbol string, ord int, url string, key string")
    assert sorted(r.ord for r in feeds.greedy_distinct(rows, ["symbol"], "ord", ["url", "key"]).collect()) == [1, 3, 5, 7]


def test_distinct_posts_looks_at_all_posts(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choices("abcde ", k=rng.randrange(8, 60))).strip() for _ in range(40)]
    data = []
    for i in range(400):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcdexyz")
        data.append(("s", "p", i, " ".join("".join(t).split()), f"u{rng.randrange(900)}", float(rng.randrange(50))))
    kept = []
    for r in sorted(data, key=lambda r: (-r[5], r[2])):
        if not any(r[4] == k[4] or neardup.alike(r[3], k[3]) for k in kept):
            kept.append(r)
    posts = spark.createDataFrame([*data, ("s", "p", 900, None, None, None), ("s", "p", 901, None, None, 1.0)], "symbol string, provider string, ord int, title string, url string, score double")
    got = {r.ord for r in neardup.distinct_posts(posts, ["symbol"]).collect()}
    assert got == {r[2] for r in kept} | {900, 901} and len(kept) < 300
    far = spark.range(300).selectExpr("'s' AS symbol", "'p' AS provider", "id AS ord", "sha2(string(id), 256) AS title", "string(id) AS url", "1.0D AS score")
    assert neardup.distinct_posts(far, ["symbol"]).count() == 300


def test_chains_of_any_length_end(spark, monkeypatch):
    from corvane.operators import distinct

    monkeypatch.setattr(distinct, "COMPONENT_ROWS", 300)
    # each row shares its URL with the one before and its title with the one after: every second one stays
    rows = spark.range(500).selectExpr("'s' AS symbol", "id AS ord").selectExpr("symbol", "ord", "concat('u', (ord + 1) div 2) AS url", "concat('t', ord div 2) AS key")
    assert sorted(r.ord for r in distinct.greedy_distinct(rows, ["symbol"], "ord", ["url", "key"]).collect()) == list(range(0, 500, 2))
    # knots: every row shares marks with several others
    rng = random.Random(4)
    data = [("s", i, f"u{rng.randrange(i // 2, i // 2 + 3)}", f"t{rng.randrange(i // 3, i // 3 + 2)}") for i in range(250)]
    taken, want = set(), []
    for _, i, u, t in data:
        if not {u, t} & taken:
            taken |= {u, t}
            want.append(i)
    got = distinct.greedy_distinct(spark.createDataFrame(data, "symbol string, ord int, url string, key string"), ["symbol"], "ord", ["url", "key"])
    assert sorted(r.ord for r in got.collect()) == want


def test_near_chains_end(spark, monkeypatch):
    from corvane.operators import distinct

    rows = spark.range(400).selectExpr("'s' AS symbol", "id AS ord", "concat('u', id) AS url", "concat('t', id) AS key")
    near = spark.range(399).selectExpr("'s' AS symbol", "concat('t', id + 1) AS key", "concat('t', id) AS near")
    monkeypatch.setattr(distinct, "COMPONENT_ROWS", 300)
    assert sorted(r.ord for r in distinct.greedy_distinct(rows, ["symbol"], "ord", ["url", "key"], near).collect()) == list(range(0, 400, 2))


def test_near_titles_lose_no_pair(spark):
    rng = random.Random(12)
    titles = set()
    for _ in range(60):
        base = "".join(rng.choices("abcdefgh   ", k=rng.choice([2, 5, 8, 14, 20, 33, 60, 90, 230])))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 10)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz", "abc"])
            titles.add("".join(t))
    titles = sorted(t for t in titles if t)
    want = {(a, b) for a in titles for b in titles if a != b and neardup.alike(a, b)}
    df = spark.createDataFrame([(None, t) for t in titles] + [("other", titles[0]), (None, None)], "symbol string, key string")
    got = [(r.key, r.near) for r in neardup.near_titles(df, ["symbol"], "key").collect()]
    assert set(got) == want and len(got) == len(want) > 150


def test_unlike_titles_of_one_vocabulary_are_hardly_compared(spark, monkeypatch):
    """Titles of common syllables share six characters at about the same place with very many others; only those that share nine of a block are compared."""
    rng = random.Random(5)
    titles = sorted({"".join(rng.choices("the |er|ing |on|th|ed |an|re|st|ou|ha|tion|es |in|of |to ".split("|"), k=40))[:96] for _ in range(300)})
    met = spark.sparkContext.accumulator(0)
    verified = neardup._verified

    def counted(names):
        def run(batches):
            def through():
                for b in batches:
                    met.add(b.num_rows)
                    yield b

            yield from verified(names)(through())

        return run

    monkeypatch.setattr(neardup, "_verified", counted)
    df = spark.createDataFrame([("s", t) for t in titles], "symbol string, key string")
    assert neardup.near_titles(df, ["symbol"], "key").count() == 0
    assert met.value < len(titles) * (len(titles) - 1) // 2 // 10


def test_ladder_falls_through(spark):
    rows = spark.createDataFrame([("s", float(x)) for x in (2, 2, 2, 2, 1, 1, 0.5)], "symbol string, rank_score double")
    assert feeds.ladder(rows, ["symbol"], "rank_score", feeds.news_steps(12)).count() == 6
    assert feeds.ladder(rows, ["symbol"], "rank_score", [(3.0, 1), (2.5, 1)]).count() == 7


def test_interleave(spark):
    rows = spark.createDataFrame([("s", "reddit", 1), ("s", "reddit", 2), ("s", "reddit", 3), ("s", "stocktwits", 4)], "symbol string, source string, ord int")
    got = feeds.interleave(rows, ["symbol"], "source", [F.col("ord")], 3).orderBy("position").collect()
    assert [r.ord for r in got] == [1, 4, 2]


def test_relevance(spark):
    text = lambda t: F.lit(t)
    r = one(
        spark,
        a=feeds.news_relevance(text("AAPL earnings"), text("revenue up"), "AAPL", "Apple Inc"),
        b=feeds.news_relevance(text("earnings"), text(""), "AAPL"),
        c=feeds.post_relevance(text("$aapl to the moon"), text("http://x"), "AAPL"),
        d=feeds.post_relevance(text("nothing"), text("here"), "AAPL", F.lit("stocks")),
    )
    assert r.a == pytest.approx(2.5 + 0.36) and r.b == 0 and r.d == 0
    assert r.c == pytest.approx(3.2 + 4.0 - 0.15)


def test_speaker_blocks(spark):
    lines = ["x", "Prepared Remarks", "A B: hello", "more", "Q&A", "tail", "C D: why?"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, line string")
    got = transcripts.speaker_blocks(df).orderBy("order_index").collect()
    assert [(r.speaker, r.text, r.base_section) for r in got] == [("A B", "hello more tail", "prepared_remarks"), ("C D", "why?", "qa")]


def test_roles_by_title_and_ties(spark):
    r = one(spark, a=transcripts.title_role(F.lit("Director of Engineering")), b=transcripts.title_role(F.lit("Equity Research")), c=transcripts.title_role(F.lit("CFO")))
    assert tuple(r) == ("host_ir", "analyst", "management")
    rows = spark.createDataFrame([("p", "analyst"), ("p", "management")], "speaker string, speaker_role string")
    assert transcripts.dominant_roles(rows).first().dominant_role == "management"


def test_rollup_topic_tie(spark):
    rows = spark.createDataFrame([("p", "management", "b", 0.1, 1.0, 2.0), ("p", "management", "a", 0.3, 3.0, 4.0)], "speaker string, speaker_role string, topic string, direction double, confidence double, evasiveness double")
    r = metrics.speaker_rollup(rows).first()
    assert (r.mention_count, r.dominant_topic, r.avg_confidence) == (2, "a", 2.0)


def test_validation_threshold(spark):
    a = spark.createDataFrame([("s", 110.0, 109.0, 125.0, None)], "symbol string, w double, x double, y double, z double")
    b = spark.createDataFrame([("s", 100.0, 100.0, 100.0, 7.0)], "symbol string, w double, x double, y double, z double")
    got = {r.key: (r.mismatch, r.severity, r.merged) for r in fundamentals.validate(a, b, ("w", "x", "y", "z")).collect()}
    assert got == {"w": (True, "low", 110.0), "x": (False, None, 109.0), "y": (True, "high", 125.0), "z": (False, None, 7.0)}


def test_trimmed_mean(spark):
    values = [-0.9, -0.2, 0.0, 0.1, 0.2, 0.3, 0.4, 0.95]
    df = spark.createDataFrame([(1, i, v, 1.0) for i, v in enumerate(values)], "k int, i int, v double, w double")
    r = segments.trimmed_mean(df, ["k"], "v", "i", "w").first()
    assert r["mean"] == pytest.approx(0.133333, abs=1e-6) and (r.n, r.n_kept, r.best, r.worst) == (8, 6, 6, 1)
    w = spark.createDataFrame([("x" * 100,), ("x" * 400,), ("x" * 1000,)], "t string").select(segments.weight(F.col("t")).alias("w")).collect()
    assert [x.w for x in w] == [1.0, 2.0, 2.5]


def test_segments_cover_the_text_and_overlap():
    said = [f"Sentence number {i} of this long text is here." for i in range(80)]
    got = segments.segments_of(" ".join(said))
    assert all(len(s) <= 1000 for s in got) and got[0].startswith(said[0]) and got[-1].endswith(said[-1])
    assert all(b.startswith(a[a.rindex("Sentence") :]) for a, b in zip(got, got[1:], strict=False))
    assert segments.segments_of("short  text") == ["short text"] and segments.segments_of(None) == []
    assert all(len(s) <= 1000 for s in segments.segments_of("word " * 900))


def test_guards_and_quotes(spark):
    r = one(
        spark, a=S.guard_reason(F.lit(None).cast("string")), b=S.guard_reason(F.lit("too short")), c=S.guard_reason(F.lit("abcdefghijk lmnopqrstuvwxyz")),
        d=S.guard_reason(F.lit("our next question comes from the line of somebody")), e=metrics.low_information(F.lit("Thank you")), f=T.excerpt(F.lit("One. Two."), 5),
    )
    assert tuple(r) == ("missing_text", "text_too_short", "too_few_tokens", "short_admin_or_operator_like", True, "One.")


def test_stream_counts_each_url_once(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 10:00:00', 'u', 1.0D), (TIMESTAMP '2024-01-01 11:00:00', 'u', 1.0D), (TIMESTAMP '2024-01-01 12:00:00', 'v', 0.0D), (TIMESTAMP '2024-03-09 00:00:00', 'w', 1.0D) AS t(published_ts, url, score)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = daily_sentiment(stream).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.day): (r["items"], r["mean"]) for r in spark.table("daily").collect()}
    assert got["2024-01-01"] == (2, 0.5)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """(u1, t1), (u1, t2), (u2, t2)...: every other row stays, and the rounds don't follow the length."""
    from corvane.operators import distinct

    stored = []
    monkeypatch.setattr(distinct, "store", lambda df, f=distinct.store: stored.append(1) or f(df))
    rows = spark.createDataFrame([("s", k, f"u{k // 2}", f"t{(k + 1) // 2}") for k in range(1000)], "symbol string, ord int, url string, key string")
    got = sorted(r.ord for r in feeds.greedy_distinct(rows, ["symbol"], "ord", ["url", "key"]).collect())
    assert got == list(range(0, 1000, 2)) and len(stored) < 15


def test_ladder_with_a_second_gate_above_the_first(spark):
    rows = lambda scores: spark.createDataFrame([("s", x) for x in scores], "symbol string, score double")
    steps = feeds.post_steps("reddit", 30)
    assert steps == [(2.6, 5), (1.8, 10)]
    count = lambda scores: feeds.ladder(rows(scores), ["symbol"], "score", steps).count()
    assert count([3.0] * 10 + [1.0] * 4) == 10  # both gates hold
    assert count([3.0] * 6 + [2.0] * 3 + [1.0]) == 10  # enough for the first, not for the second: all
    assert count([3.0] * 2 + [2.0] * 8 + [1.0]) == 10 and count([3.0] * 2 + [2.0] * 3 + [1.0]) == 6


def test_names_of_one_person(spark):
    from corvane.operators import people

    rows = [
        (1, 3, 0, "Jonathan Smith"), (1, 1, 1, "Jonathann Smith"), (1, 1, 2, "Dr. Jonathan Q. Smith, CFA"), (1, 1, 3, "Joan Smith"), (1, 1, 4, "Ann Lee"), (1, 1, 5, "Ann B. Lee"), (1, 1, 6, "Operator"),
        (2, 1, 0, "Ann Lee"), (2, 2, 1, "Ann Lee Jr."), (1, 1, 7, ""), (1, 1, 8, None), (1, 1, 9, "Mr."),
    ]
    got = {(r.doc_id, r.alias): r.canonical for r in people.canonical_names(spark.createDataFrame(rows, "doc_id bigint, priority int, ord bigint, name string")).collect()}
    assert {got[1, a] for a in ("jonathan smith", "jonathann smith", "dr jonathan q smith cfa")} == {"Jonathan Smith"}
    assert got[1, "joan smith"] == "Joan Smith" and got[1, "ann lee"] == got[1, "ann b lee"] == "Ann B. Lee" and got[2, "ann lee"] == "Ann Lee Jr."
    assert not any("operator" in a for _, a in got) and len(got) == 8


def test_a_chain_of_names_does_not_join_its_ends(spark):
    import random
    from difflib import SequenceMatcher

    from corvane.operators import people

    rng = random.Random(7)
    rows, base = [], ["christopher", "alexandrine", "maximiliana"]
    for doc in range(12):
        firsts = [base[doc % 3]]
        for _ in range(14):
            f = list(rng.choice(firsts))
            f[rng.randrange(len(f))] = rng.choice("abcxyz")
            firsts.append("".join(f))
        rng.shuffle(firsts)
        rows += [(doc, rng.randint(1, 3), k, f"{f.capitalize()} {('Lindqvist', 'Oyelaran-Mc')[k % 2]}") for k, f in enumerate(firsts)]

    def ratio(a, b):
        return SequenceMatcher(None, a, b).ratio()

    want = {}
    for doc in range(12):
        leaders, seen, best = [], {}, {}
        for _, p, k, name in sorted((r for r in rows if r[0] == doc), key=lambda r: (-r[1], r[2])):
            key = name.lower().replace("-", " ")
            first, last = key.split()[0], key.split()[-1]
            lead = seen.get((first, last))
            if lead is None:
                scored = [(0.6 * ratio(first, lf) + 0.4 * ratio(key, lk), -i) for i, (lf, ll, lk) in enumerate(leaders) if ll == last and ratio(first, lf) >= 0.88]
                top = max(scored, default=(0, 0))
                if top[0] >= 0.92:
                    lead = -top[1]
                else:
                    leaders.append((first, last, key))
                    lead = len(leaders) - 1
                seen[first, last] = lead
            best[lead] = max(best.get(lead, (0,)), (p, len(key.split()), len(name), -k, name))
            want[doc, key] = lead
        want |= {(doc, key): best[lead][-1] for (d, key), lead in want.items() if d == doc}
    got = {(r.doc_id, r.alias): r.canonical for r in people.canonical_names(spark.createDataFrame(rows, "doc_id bigint, priority int, ord bigint, name string")).collect()}
    assert {k: got[k] for k in want} == want
    three = [(1, 3, 0, "Abcdefghijkl Roe"), (1, 2, 1, "Abcdefghijkx Roe"), (1, 1, 2, "Abcdefghijyx Roe")]
    got = {r.alias: r.canonical for r in people.canonical_names(spark.createDataFrame(three, "doc_id bigint, priority int, ord bigint, name string")).collect()}
    assert got == {"abcdefghijkl roe": "Abcdefghijkl Roe", "abcdefghijkx roe": "Abcdefghijkl Roe", "abcdefghijyx roe": "Abcdefghijyx Roe"}


def test_a_store_of_fetched_payloads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from corvane.sources import cache

    path, at = f"file://{tmp_path}/store", F.lit("2024-01-31 00:00:00").cast("timestamp")
    requests = spark.createDataFrame([("aa1", 1), ("ab2", 2), ("ab2", 3), (None, 4), ("cc3", 5), ("dd4", 6)], "key string, n int")
    status = lambda: {r.n: (r.status, r.payload) for r in cache.lookup(requests, cache.entries(spark, path), at, 3600).collect()}
    assert status() == {n: ("miss", None) for n in range(1, 7)} and cache.compact(spark, path, at) == []
    made = lambda rows: spark.createDataFrame(rows, "key string, at string, payload string").withColumn("at", F.col("at").cast("timestamp"))
    writes = [[("aa1", "2024-01-30 22:59:59", "old"), ("ab2", "2024-01-30 23:00:01", "x")], [("aa1", "2024-01-30 22:00:00", "older"), ("cc3", "2024-01-30 23:00:00", "edge"), ("dd4", "2024-02-01 00:00:00", "later")], [("ab2", "2024-01-30 23:00:01", "y"), (None, "2024-01-30 23:00:01", "no key"), ("dd4", None, "no time")]]
    with ThreadPoolExecutor(3) as pool:  # writers at the same time
        list(pool.map(lambda rows: cache.append(made(rows), path), writes))
    want = {1: ("stale", "old"), 2: ("hit", "y"), 3: ("hit", "y"), 4: ("miss", None), 5: ("stale", "edge"), 6: ("miss", None)}
    assert len(cache.batches(spark, path)) == 3 and status() == want
    asked = []

    def fetch(open_):
        asked.append(sorted(r.key for r in open_.collect()))
        return open_.where("key <> 'cc3'").select("key", F.concat(F.lit("new "), "key").alias("payload"))

    fill = lambda: {r.n: (r.status, r.payload) for r in cache.through(requests, path, fetch, at, 3600).collect()}
    want |= {1: ("hit", "new aa1"), 6: ("hit", "new dd4")}
    assert fill() == want and fill() == want and asked == [["aa1", "cc3", "dd4"], ["cc3"]]
    old = cache.compact(spark, path, at)
    cache.append(made([("cc3", "2024-01-30 23:30:00", "late writer")]), path)
    cache.vacuum(spark, path, old)
    assert len(old) == 5 and len(cache.batches(spark, path)) == 2
    assert status() == want | {5: ("hit", "late writer")}
    assert cache.lookup(requests, cache.entries(spark, path), F.lit("2024-02-01 00:00:01").cast("timestamp"), 3600).where("key = 'dd4'").first().payload == "later"


def test_of_requests_with_one_key_the_greatest_is_fetched(spark, tmp_path):
    from corvane.sources import cache

    path, at = f"file://{tmp_path}/store", F.lit("2024-01-31 00:00:00").cast("timestamp")
    pages = [(k % 17, f"k{k % 3}", k) for k in range(60)]
    r = spark.createDataFrame(pages, "chars int, key string, n int").repartition(4)
    got = {(x.key, x.payload) for x in cache.through(r, path, lambda o: o.select("key", F.concat("chars", F.lit("/"), "n").alias("payload")), at, 3600).collect()}
    want = {k: max((c, n) for c, key, n in pages if key == k) for k in ("k0", "k1", "k2")}
    assert got == {(k, f"{c}/{n}") for k, (c, n) in want.items()}


def test_numbers_are_rounded_by_their_exact_value(spark):
    from corvane.plans import report

    values = [0.0015, 0.0025, -0.0015, 1.005, 1234567.0, 2.675, None, 0.125, 1_005_000.0, -0.0, float("nan"), 8.5, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(1)
    got = [tuple(r) for r in df.select(report.percent_text(F.col("v")), report.money_text(F.col("v")), report.ratio_text(F.col("v"))).collect()]
    money = lambda v: f"{v:.2f}" if not abs(v) >= 1e6 else f"{v / 1e6:.2f}M" if abs(v) < 1e9 else f"{v / 1e12:.2f}T"
    want = [("n/a",) * 3 if v is None else (f"{v * 100:+.1f}%", money(v), f"{v:.2f}x") for v in values]
    assert [g for g, v in zip(got, values, strict=True) if v == v] == [w for w, v in zip(want, values, strict=True) if v == v]
    assert got[0][0] == "+0.1%" and got[7][1] == "0.12"


def test_participants_over_the_cap_are_returned(spark):
    from corvane.operators import people

    who = spark.createDataFrame([(1, f"n{k:02d}", f"N{k}", "r") for k in range(50)], "doc_id int, key string, name string, role string")
    kept, dropped = people.cap_participants(who, spark.createDataFrame([(1, " N45 "), (1, "N49")], "doc_id int, speaker string"))
    assert {r.key for r in kept.collect()} == {f"n{k:02d}" for k in range(20)} | {"n45", "n49"} and dropped.count() == 28


def test_a_failing_model_is_neutral(spark):
    from corvane.operators import scorers

    def score(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [(1.0, 0.0, 0.0)] * len(texts)

    df = spark.createDataFrame([(1, "good " * 25), (2, "bad"), (3, None), (4, "good " * 10 + "bad")], "id int, t string")
    for batch in (1, 3, 16):  # the windows that share a batch with a failing one keep their answers
        got = {r.id: (*r.triple, r.failed) for r in scorers.windowed_scores(df, score, "t", tokens=10, batch=batch).collect()}
        assert got == {1: (1.0, 0.0, 0.0, 0), 2: (0.0, 0.0, 1.0, 1), 3: (0.0, 0.0, 1.0, 0), 4: (0.5, 0.0, 0.5, 1)}
    null = scorers.score_text(df, lambda c: F.when(F.col(c) == "bad", 0.5), "t").collect()
    assert [r.score for r in null] == [0.0, 0.5, 0.0, 0.0]


def test_batches_are_halved_and_come_back_in_order():
    from corvane.operators import scorers

    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    items = [f"{'x' * (37 * k % 23)}{k}" for k in range(64)]
    items[40] = "bad"
    got = scorers.by_size(model, items, 64)
    assert got == [None if t == "bad" else t.upper() for t in items]
    assert len(calls) == 13 and calls[0] == 64  # the whole, then two halves at each of six levels
    assert scorers.by_size(model, [], 8) == [] and scorers.halving(lambda t: [], ["a", "b"]) == [None, None]
    loads = []
    twice = scorers.per_worker("test-model", lambda: loads.append(1) or model)
    assert twice(["a"]) == ["A"] and twice(["b"]) == ["B"] and loads == [1]


def test_lines_are_handed_on_in_small_batches(spark, monkeypatch):
    from corvane.operators import pages

    monkeypatch.setattr(pages, "OUT_CHARS", 100)
    html = [(k, f"<p>{'x' * 40} {k}</p><div>{'y' * 30}</div>" if k % 5 else None) for k in range(50)]
    df = spark.createDataFrame(html, "page_id bigint, html string").coalesce(1)
    sizes = []

    class Spy:
        """Hands the operator's generator its rows as one batch, as Spark would, and keeps what it yields."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            ids, texts = zip(*html, strict=True)
            sizes.extend(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.string())], names=["page_id", "html"])])))

    pages.page_lines(Spy())
    got = sorted((r.page_id, r.kind, r.line_no, r.line) for r in pages.page_lines(df).collect())
    assert got == sorted((k, kind, n, line) for k, h in html for kind, lines in pages.lines_of(h or "").items() for n, line in enumerate(lines))
    assert len(sizes) > 10 and sum(sizes) == len(got) and max(sizes) <= 6


def test_lines_of_a_page():
    from corvane.operators import pages

    html = '<p>One<br>two</p><p>One two</p><li>x &amp; y</li><script type="application/ld+json">[{"articleBody": "A: b\\n\\nc"}]</script><script>self.__next_f.push([1,"\\u003cp\\u003eJane: said\\u003c/p\\u003e\\nmore"])</script><style>no</style>'
    got = pages.lines_of(html)
    assert got["semantic"] == ["One two", "x & y"] and got["relaxed"] == ["One", "two", "One two", "x & y"] and got["jsonld"] == ["A: b", "c"]
    assert "Jane: said" in got["script"] and not any("<" in x for x in got["script"])


def test_long_remarks_that_end_in_a_transition_open_nothing(spark):
    long = "We did well this year. " * 20
    rows = [(1, 0, "Jane", "prepared_remarks", long + "With that, open the line."), (1, 1, "Max", "prepared_remarks", "next question please"), (2, 0, "Jane", "prepared_remarks", "open the line " + long)]
    got = {r.doc_id: r.qa_start for r in transcripts.qa_bounds(spark.createDataFrame(rows, "doc_id int, order_index int, speaker string, base_section string, text string")).collect()}
    assert got == {1: 1, 2: 0}


def test_mentions_equal_the_regex_way(spark):
    import re

    from corvane.functions.text import company_tokens
    from corvane.operators import mentions

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(300)]
    companies = [(i, rng.choice(vocabulary).upper(), " ".join(rng.choices([*vocabulary, "Group", "Data", "data"], k=rng.randrange(1, 4)))) for i in range(10_000)] + [(-1, None, None), (-2, "", " ")]
    joins = [" ", " ", " $", "-", "_", ", ", "²", ""]
    texts = [(i, "".join(rng.choice([w, w.upper()]) + rng.choice(joins) for w in rng.choices(vocabulary, k=rng.randrange(25)))) for i in range(12)] + [(50, None), (51, "")]
    want = {}
    for i, text in texts:
        low = (text or "").lower()
        for c, symbol, name in companies:
            s, n = (symbol or "").lower(), (name or "").lower().strip()
            words = len(re.findall(rf"(?<![^\W²]){re.escape(s)}(?![^\W²])", low)) if s else 0
            hit = (words, low.count(f"${s}") if s else 0, int(bool(n) and n in low), sum(t in low for t in company_tokens(name)))
            if any(hit):
                want[i, c] = hit
    one = lambda: mentions.mentions(spark.createDataFrame(texts, "ord int, text string"), ["ord"], F.col("text"), spark.createDataFrame(companies, "company int, symbol string, name string"))
    assert {(r.ord, r.company): (r.words, r.cash, r.named, r.tokens) for r in one().collect()} == want
    assert len(want) > 5000
    mentions.TERMS, most = 700, mentions.TERMS  # several automata give the same
    try:
        assert {(r.ord, r.company): (r.words, r.cash, r.named, r.tokens) for r in one().collect()} == want
    finally:
        mentions.TERMS = most


def test_company_scores_are_those_of_one_company(spark):
    rows = spark.createDataFrame([(1, "Acme rises, $ACM and acm: earnings of Acme Widgets Inc", "x"), (2, "widgets and guidance http://a", "x"), (3, "nothing", "x"), (4, None, "x")], "ord int, text string, company string")
    companies = spark.createDataFrame([("a", "ACM", "Acme Widgets Inc"), ("b", "ZZZ", "Other Widgets")], "company string, symbol string, name string")
    got = {(r.ord, r.company): r for r in feeds.company_scores(rows.drop("company"), ["ord"], F.col("text"), companies).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    text, none = F.col("text"), F.lit(None).cast("string")
    for c, s, n in (("a", "ACM", "Acme Widgets Inc"), ("b", "ZZZ", "Other Widgets")):
        for r in rows.select("ord", feeds.news_relevance(text, none, s, n).alias("news"), feeds.post_relevance(text, none, s, None, n).alias("post"), feeds.is_related(text, none, s, n).alias("rel")).collect():
            if (r.ord, c) in got:
                g = got[r.ord, c]
                assert (g.news_relevance, round(g.post_relevance, 6), g.related) == (r.news, round(r.post, 6), r.rel)
            else:
                assert r.post == 0 and r.news == 0


def test_payloads_are_parsed_once(spark):
    from corvane.sources import providers

    items = spark.createDataFrame([("S", 1, '{"title": "t", "url": "u", "link": "u"}'), ("S", 2, '{"title": "t"}'), ("S", 3, "no"), ("S", 4, None)], "symbol string, ord bigint, payload string")
    for parse in (providers.news_a, providers.news_b):
        rows = parse(items)
        assert [r.ord for r in rows.collect()] == [1]
        assert rows._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1  # filters on what was parsed would parse again


def test_news_of_two_providers_move_few_texts(spark, monkeypatch):
    """Both at once give what each gives apart; of all tables written one holds all texts, the others none or those shown."""
    from corvane.operators import distinct

    rng, at = random.Random(3), "2024-01-20 00:00:00"
    data = [(f"s{k % 2}", ("alpha", "yahoo")[k % 3 == 0], k, f"Title {rng.randrange(40)}", "that stock" + " the" * (k % 3), f"u{rng.randrange(60)}", "x", at, None, k % 5 == 0) for k in range(120)]
    schema = "symbol string, provider string, ord bigint, title string, summary string, url string, source string, published_ts string, tagged double, related boolean"
    rows = spark.createDataFrame(data, schema).withColumn("published_ts", F.col("published_ts").cast("timestamp"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    apart = []
    for name in ("alpha", "yahoo"):
        f, k = feeds.provider_news(rows.where(F.col("provider") == name), "that", as_of, limit=9)
        apart.append((f.count(), sorted((r.symbol, r.ord, r["rank"], r.summary) for r in k.collect())))
    texts, plain = [], feeds.store

    def stored(df):
        out = plain(df)
        if "summary" in df.columns:
            texts.append(out.count())
        return out

    monkeypatch.setattr(feeds, "store", stored)
    monkeypatch.setattr(distinct, "store", stored)
    fetched, kept = feeds.provider_news(rows, "that", as_of, limit=9, keys=("symbol", "provider"))
    for name, (n, best) in zip(("alpha", "yahoo"), apart, strict=True):
        own = kept.where(F.col("provider") == name)
        assert fetched.where(F.col("provider") == name).count() == n and sorted((r.symbol, r.ord, r["rank"], r.summary) for r in own.collect()) == best
    assert texts == [120, kept.count()] and kept.count() <= 36
    # the tiers come to the rows, not the rows to the tiers
    assert "Exchange hashpartitioning" not in fetched._jdf.queryExecution().executedPlan().toString()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_reads_each_table_once_and_moves_no_text(spark):
    from support import SMALL

    from corvane import queries as library
    from corvane import queries_reports  # noqa: F401 (registers the query)

    plan = plan_of(library.QUERIES["snapshot_and_report"](spark, SMALL))
    assert "/lineitem.parquet" not in plan and r"\w+|\W+" not in plan  # quarters and blocks' metrics are stored, and read by what needs them
    for scored in (library.scored_news(spark, SMALL), library.scored_posts(spark, SMALL)):
        plan = plan_of(scored)
        assert plan.index("Join") < plan.index(r"\Qthe\E")  # scores, not texts, are joined with times


def test_texts_are_cut_once(spark):
    text = "A first sentence of more than six words, which says something. Short one. A second one that is long enough, and is not asked for?"
    df = spark.createDataFrame([(1, 0, text), (1, 1, None), (1, 2, " \n"), (1, 3, "A first  sentence of more than\nsix words which says something.")], "doc_id int, order_index int, text string")
    m = df.withColumns({"direction": F.lit(0.0)} | {c: F.lit(1.0) for c in metrics.METRIC_COLUMNS})
    quotes = metrics.key_quotes(m)
    assert plan_of(quotes).count("[^a-z0-9 ]") == 1 and plan_of(df.select(S.numeric_density(F.col("text")).alias("n"))).count("[.!?]") == 1
    assert [r.quote for r in quotes.collect()] == [text.split(" Short")[0]]


def test_blocks_that_are_not_scored(spark):
    texts = ["", " ", "  \n", None, "Operator here.", "the OPERATOR says one two three four", "the operator says one two three four", "next question please", " x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "order_index int, text string")
    assert sorted(r.order_index for r in metrics.scorable(rows).collect()) == [5, 6, 7, 8]


def test_phrases_found_first_are_those_looked_at_all_places(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(["the", "of the", " ", "é", ".", "ai", "\U0001d41a", "_", "7", "́", "thethe"], k=rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for term in ("the", "of the", "ai", "7"):
        old = rf"(?U)(?<!\w)\Q{term}\E(?!\w)"
        r = df.select(F.regexp_count("text", F.lit(T.phrase(term))).alias("new"), F.regexp_count("text", F.lit(old)).alias("old")).where("new != old OR old > 0")
        rows = r.collect()
        assert rows and all(x.new == x.old for x in rows)

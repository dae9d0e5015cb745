from __future__ import annotations

import random

from pyspark.sql import functions as F

from corvane.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|start|>assistant\nhi", "\\", "\\e\\l", "<|next|>", "", "<<SYS>> <</SYS>> <s>", "日本 é\n\n", "<", "[", "\\<|", "<\\|"]


def read(df):
    done = chat.format_chats(df)
    rows = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"), "loss_spans").collect()
    return {r.conv_id: r for r in rows}


def test_round_trip_of_nasty_texts(spark):
    rng = random.Random(1)
    data = [(c, t, rng.choice(["user", "assistant", "system", "a\nb<|"]), rng.choice(NASTY) + rng.choice(NASTY)) for c in range(40) for t in range(rng.randrange(1, 9))]
    got = read(spark.createDataFrame(data, TURNS))
    for c in range(40):
        want = [(r, x) for cc, _, r, x in data if cc == c]
        assert [(t.role, t.text) for t in got[c].t] == want
        assert got[c].m == "".join(x for r, x in want if r == "assistant")
        for s in got[c].loss_spans:
            assert not any(m in got[c].formatted[s.start : s.start + s.chars] for m in chat.CONTROL)


def test_merges_neighbours_of_one_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")], TURNS)
    r = read(df)[1]
    assert r.formatted == "<|start|>user\na<|next|>b<|end|>\n<|start|>assistant\nc<|next|>d<|end|>\n" and r.m == "cd"


def test_nulls_ties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "assistant", "y"), (2, 5, "assistant", "z" * 200_000)], TURNS)
    got = read(df.selectExpr("*", "1 AS ts", "2 AS blocks", "3 AS formatted", "4 AS t"))
    assert [(t.role, t.text) for t in got[1].t] == [("user", ""), ("", "x"), ("", "x")]
    assert got[None].m == "y" and len(got[2].m) == 200_000
    assert chat.format_chats(df.limit(0)).count() == 0

"""Chat formatting: turns of a conversation become one training string with a loss mask.

Only Spark expressions are used. Turns are collected as structs and sorted, neighbours of one role
are merged into a block, and the blocks are concatenated:

    <|start|>role\\nfirst text<|next|>second text<|end|>\\n

Control strings inside roles and texts are escaped, so no text can open or close a turn, and
``read_back`` recovers every turn exactly. One conversation is one output string and must fit in a
task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>\n"
#: Strings that common chat templates and tokenizers treat as control strings.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
OPENERS = {"<": "\\l", "[": "\\k"}


def escape(text: Column) -> Column:
    """Replaces the first character of each control string by a code; a backslash becomes ``\\e``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(OPENERS[word[0]] + word[1:]))
    return out


def unescape(text: Column) -> Column:
    for char, code in OPENERS.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def format_chats(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_spans`` array<struct<start, chars>>.

    A span is the place (code points, from 0) of one ``learn`` turn's escaped text; marks and
    separators are never under the mask. Null text and null role count as empty. Turns are ordered
    by ``turn``, null first, ties by role, then text; repeated rows are repeated turns. A null
    conversation id is a conversation of its own. Other columns are ignored; an empty table gives
    an empty result.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("at"), F.replace(escape(blank(role)), F.lit("\n"), F.lit("\\n")).alias("role"), blank(text).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts")).withColumn(
        "ts", F.transform("ts", lambda t: F.struct(t.role.alias("role"), escape(t.text).alias("text")))
    )
    firsts = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: (i == 1) | (F.element_at("ts", i).role != F.element_at("ts", F.greatest(i - 1, F.lit(1))).role),
    )
    block = lambda first, k: F.struct(
        F.element_at("ts", first).role.alias("role"),
        F.transform(
            F.slice("ts", first, F.coalesce(F.get("firsts", k + 1), F.size("ts") + 1) - first), lambda t: t.text
        ).alias("texts"),
    )
    blocks = sorted_turns.withColumn("firsts", firsts).select("conv", F.transform("firsts", block).alias("blocks"))
    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(F.lit(START), b.role, F.lit("\n"), F.array_join(b.texts, NEXT), F.lit(END))), ""
    )
    empty_spans = F.array().cast("array<struct<start:bigint,chars:bigint>>")
    long = lambda n: F.lit(n).cast("bigint")

    def add_text(acc: Column, t: Column, learnt: Column) -> Column:
        chars = F.length(t).cast("bigint")
        span = F.array(F.struct(acc.at.alias("start"), chars.alias("chars")))
        return F.struct((acc.at + chars + len(NEXT)).alias("at"), F.when(learnt, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    def add_block(acc: Column, b: Column) -> Column:
        inner = F.struct((acc.at + F.length(b.role) + len(START) + 1).cast("bigint").alias("at"), acc.spans.alias("spans"))
        done = F.aggregate(b.texts, inner, lambda a, t: add_text(a, t, b.role == learn))
        return F.struct((done.at - len(NEXT) + len(END)).alias("at"), done.spans.alias("spans"))

    spans = F.aggregate("blocks", F.struct(long(0).alias("at"), empty_spans.alias("spans")), add_block, lambda a: a.spans)
    return blocks.select(F.col("conv").alias(conv), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, unescaped, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1))
    body = lambda b: F.substr(b, F.locate("\n", b) + 1)
    turns = lambda b: F.transform(F.split(body(b), r"<\|next\|>"), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    piece = lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.chars.cast("int")))
    return F.array_join(F.transform(spans, piece), "")

"""Which companies a row names, for a whole table of companies in one pass over the rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import GENERIC
from ..sources.store import store

#: Distinct terms that one automaton, and so one pass over the rows, holds.
TERMS = 200_000


def terms(companies: DataFrame) -> DataFrame:
    """(company, kind, term, times) of a table (company, symbol, name): the symbol, the symbol behind a dollar sign, the name, the words that identify it.

    Lower case; a word that a name holds twice counts twice. Null or empty symbols and names give no terms.
    """
    symbol, name = F.lower("symbol"), F.lower(F.trim("name"))
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC))
    kinds = F.concat(
        F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("term")) for k, t in (("symbol", symbol), ("cash", F.when(symbol != "", F.concat(F.lit("$"), symbol))), ("name", name))]),
        F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda t: F.struct(F.lit("word").alias("kind"), t.alias("term"))),
    )
    each = companies.select("company", F.explode(kinds).alias("t")).select("company", "t.kind", "t.term").where("term != ''")
    return each.groupBy("company", "kind", "term").agg(F.count(F.lit(1)).alias("times"))


def _in_word(c: str) -> bool:
    return c in "_‌‍" or unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "Mn", "Mc", "Me", "Pc")


def _counted(names: list[str], part: list[str]):
    """Rows (key columns, text) in; (key columns, term, whole, anywhere) out for every term that a text holds."""
    held: dict[str, object] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if "a" not in held:
            trie = ahocorasick.Automaton()
            for t in part:
                trie.add_word(t, t)
            trie.make_automaton()
            held["a"] = trie
        for b in batches:
            at, term, whole, anywhere = [], [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                found: dict[str, list[int]] = {}  # whole words, end of the last one, all, end of the last one
                for end, t in held["a"].iter(text or ""):
                    f, start, end = found.setdefault(t, [0, 0, 0, 0]), end - len(t) + 1, end + 1
                    if start >= f[3]:  # occurrences do not overlap, as in a search from the left
                        f[2], f[3] = f[2] + 1, end
                    if start >= f[1] and not (start and _in_word(text[start - 1])) and not (end < len(text) and _in_word(text[end])):
                        f[0], f[1] = f[0] + 1, end
                at += [i] * len(found)
                term += found
                whole += [f[0] for f in found.values()]
                anywhere += [f[2] for f in found.values()]
            keys = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(term, pa.string()), pa.array(whole, pa.int64()), pa.array(anywhere, pa.int64())], names=names)

    return run


def mentions(rows: DataFrame, key: list[str], text: Column, companies: DataFrame) -> DataFrame:
    """key, company, words, cash, named, tokens: how often each company's symbol stands in the text as a word and behind a dollar sign, whether its
    name does (0 or 1), and how many of the words that identify it occur; a row for every pair with any of them.

    The terms of all companies are the keys of one automaton (of several, each over TERMS terms, where there are more), so a text is read once
    for all of them. Only terms that occur leave the texts; they are counted per term, joined to the companies that have the term, and summed. ``key`` names
    a row; rows that share one are counted together. A null text names nobody.
    """
    listed = store(terms(companies))
    distinct = listed.select("term").distinct()
    parts = max(1, -(-distinct.count() // TERMS))
    schema = StructType([*(rows.schema[k] for k in key), StructField("term", StringType()), StructField("whole", LongType()), StructField("anywhere", LongType())])
    found = None
    for k in range(parts):
        # about TERMS terms: what one automaton is built of
        part = [r["term"] for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()]
        one = rows.select(*key, F.lower(text).alias("text")).mapInArrow(_counted(schema.names, part), schema)
        found = one if found is None else found.unionByName(one)
    count = {
        "words": F.when(F.col("kind") == "symbol", F.col("whole")), "cash": F.when(F.col("kind") == "cash", F.col("anywhere")),
        "named": F.when(F.col("kind") == "name", F.least(F.col("anywhere"), F.lit(1))), "tokens": F.when(F.col("kind") == "word", F.col("times")),
    }
    joined = found.join(listed, "term")
    summed = joined.groupBy(*key, "company").agg(*[(F.max if c == "named" else F.sum)(F.coalesce(v, F.lit(0))).cast("bigint").alias(c) for c, v in count.items()])
    return summed.where("words + cash + named + tokens > 0")

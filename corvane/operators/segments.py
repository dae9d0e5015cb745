"""Long texts: overlapping segments, their scores, and the trimmed weighted mean of them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import compact

SHORT = 700


def _wrapped(text: str, target: int, most: int) -> list[str]:
    """Pieces of ``most`` characters, ended at the last space if that leaves more than half the target."""
    pieces = re.findall(rf".{{1,{most}}}\Z|.{{{max(80, target // 2)},{most - 1}}}(?= )|.{{1,{most}}}", text, re.S)
    return [p for p in map(str.strip, pieces) if p]


def segments_of(text: str | None, target: int = 650, most: int = 1000, least: int = 180, overlap: int = 1) -> list[str]:
    """Sentences packed up to ``target`` characters (never over ``most``), each segment starting with the last one's final sentence.

    ends[k] is where sentence k would end if all stood in one line, so the cut after any start is found by search in it: the last
    sentence within the target, or, if that leaves under ``least`` characters, the first to reach them within ``most``.
    """
    whole = " ".join((text or "").split())
    if len(whole) < SHORT:
        return [whole] * bool(whole)
    target, most = max(250, target), max(target, most, 250)
    least = max(120, min(least, target))
    said = re.split(r"(?<=[.!?])\s+", whole)
    if len(said) == 1 or max(map(len, said)) > most:
        return _wrapped(whole, target, most) or [whole]
    ends = list(accumulate(len(s) + 1 for s in said))
    out, start = [], 0
    while True:
        base = ends[start - 1] if start else 0
        within = lambda size: bisect_right(ends, base + size + 1)  # noqa: B023, E731
        enough = bisect_left(ends, base + least + 1) + 1
        cut = max(start + 1, min(within(most), max(within(target), enough)))
        out.append(" ".join(said[start:cut]))
        if cut >= len(said):
            return out
        start = max(start + 1, cut - overlap)


def segments(text: Column, **sizes: int) -> Column:
    """array<string>; packing depends on what was packed before, so it runs as an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: segments_of(t, **sizes))

    return cut(text)


def weight(text: Column) -> Column:
    return F.least(F.lit(2.5), F.sqrt(F.greatest(F.lit(1.0), F.length(text) / 100.0)))


def trimmed_mean(scored: DataFrame, keys: list[str], value: str, order: str, weight_col: str) -> DataFrame:
    """Weighted mean per key; with eight values or more, a tenth (one at least) is dropped at each end.

    ``best`` and ``worst`` are the kept row's ``order`` with the highest and lowest value, the first among equals. A key's
    values (three numbers a segment of one text) are sorted as one array, so a single exchange does.
    """
    each = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(order).alias("o"), F.col(weight_col).alias("w")))).alias("all"))
    n = F.size("all")
    k = F.when(n >= 8, F.greatest(F.lit(1), F.floor(n * 0.1))).otherwise(0).cast("int")
    total = lambda f: F.aggregate("kept", F.lit(0.0), lambda s, x: s + f(x))
    return each.withColumn("n", n).withColumn("kept", F.slice("all", k + 1, n - 2 * k)).select(
        *keys,
        "n",
        F.size("kept").alias("n_kept"),
        (total(lambda x: x.v * x.w) / total(lambda x: x.w)).alias("mean"),
        (-F.array_max(F.transform("kept", lambda x: F.struct(x.v, -x.o)))["col2"]).alias("best"),
        F.element_at("kept", 1)["o"].alias("worst"),
    )


def lexical_direction(column: str, positive: dict[str, float], negative: dict[str, float]) -> Column:
    """A deterministic scorer in place of a sentiment model."""
    return S.clamp((S.density(column, positive) - S.density(column, negative)) * 2, -1, 1)


def segmented_scores(docs: DataFrame, positive: dict[str, float], negative: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    pieces = docs.select(doc_id, F.posexplode(segments(compact(F.col(text)))).alias("i", "segment"))
    scored = pieces.withColumn("direction", lexical_direction("segment", positive, negative)).withColumn("w", weight(F.col("segment")))
    return trimmed_mean(scored, [doc_id], "direction", "i", "w")

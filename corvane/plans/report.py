"""Company reports: signals joined per symbol into one score, its snapshot and recomputation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import fixed


def transcript_component(means: DataFrame, *, calibrated: bool = True) -> DataFrame:
    """Adds mode, probability and component to management means: 2p - 1 of the calibrated model, or the direction alone."""
    c = {k: F.col(k) for k in ("confidence", "outlook", "specificity", "risk")} | {"sentiment": F.col("direction"), "directness": S.clamp(F.lit(100.0) - F.col("evasiveness"), 0, 100)}
    p = S.transcript_probability(c)
    value = S.clamp(p * 2 - 1, -1, 1) if calibrated else S.clamp(F.col("direction"), -1, 1)
    mode = "calibrated_internal_logistic" if calibrated else "legacy_direction_only"
    none = F.col("n") == 0
    return means.withColumn("mode", F.when(none, "no_management_rows").otherwise(mode)).withColumn("probability", F.when(~none, p)).withColumn("component", F.when(none, 0.0).otherwise(value))


def company_scores(signals: DataFrame, weights: Mapping[str, float] = S.WEIGHTS) -> DataFrame:
    """Overall score and label per symbol from transcript, fundamentals, news and social signals (null: missing)."""
    score = S.overall({k: F.col(k) for k in S.WEIGHTS}, weights)
    return signals.withColumn("overall_score", score).withColumn("label", S.sentiment_label(F.col("overall_score")))


def snapshot_scores(signals: DataFrame, weights: Mapping[str, float] = S.WEIGHTS) -> DataFrame:
    """The score without transcripts: the other shares, scaled to 1."""
    w = S.shares(weights)
    rest = {k: v for k, v in w.items() if k != "transcript"}
    total = sum(rest.values())
    value: Column = F.lit(0.0)
    for k, v in rest.items():
        value = value + F.lit(v / total if total > 0 else 0.0) * F.coalesce(F.col(k), F.lit(0.0))
    return signals.withColumn("snapshot_score", S.clamp(value, -1, 1)).withColumn("stance", S.stance(F.col("snapshot_score")))


def strength(direction: Column, news: Column, social: Column, revenue_growth: Column, eps_growth: Column) -> Column:
    z = F.lit(0.0)
    return S.clamp(F.lit(52.0) + direction * 32 + news * 10 + social * 6 + F.coalesce(revenue_growth, z) * 0.18 + F.coalesce(eps_growth, z) * 0.20, 0, 100)


#: What a caller may override, with its range.
OVERRIDES = {**{f"weight_{k}": (0.0, 100.0) for k in S.WEIGHTS}, "counter_weight": (0.0, 2.0), "smoothing": (0.0, 1.0)}


def overrides(given: Mapping[str, float]) -> dict[str, float]:
    """The allowed overrides, held to their ranges; unknown names are refused."""
    unknown = set(given) - set(OVERRIDES)
    if unknown:
        raise ValueError(f"unknown overrides: {', '.join(sorted(unknown))}")
    return {k: min(max(float(v), OVERRIDES[k][0]), OVERRIDES[k][1]) for k, v in given.items()}


def overview_table(symbols: DataFrame) -> DataFrame:
    """Report rows (symbol, kpi, value) as text."""
    shown = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("Overall score", "Label", "News", "Social")]),
        F.array(fixed(F.col("overall_score"), "%.2f"), F.initcap(F.replace(F.col("label"), F.lit("_"), F.lit(" "))), percent_text(F.col("news")), percent_text(F.col("social"))),
    )
    return symbols.select("symbol", F.explode(shown).alias("kpi", "value"))


def tab_rows(tab: str, rows: DataFrame, labels: Mapping[str, Column], cap: int = 30) -> DataFrame:
    """symbol, tab, place, label, value: a tab's figures as text, the first ``cap`` of a symbol's rows by ``place`` (0 where ``rows`` has none)."""
    r = rows if "place" in rows.columns else rows.withColumn("place", F.lit(0))
    cells = F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(v, F.lit("n/a")).alias("value")) for k, v in labels.items()])
    return r.where(F.col("place") <= cap).select("symbol", F.lit(tab).alias("tab"), F.col("place").cast("bigint").alias("place"), F.explode(cells).alias("c")).select("symbol", "tab", "place", "c.*")


def ratio_text(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(fixed(value, "%.2fx"))


def compact_text(value: Column) -> Column:
    """1.2K, 3.4M, 5.6B, or the whole number."""
    size = F.abs(value)
    scaled = lambda by, unit: fixed(value / by, f"%.1f{unit}")
    return F.when(value.isNull(), "n/a").when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(fixed(value, "%.0f"))


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(fixed(value * 100, "%+.1f%%"))


def money_text(value: Column) -> Column:
    """1.23T, 4.56B, 7.89M, or the number."""
    size = F.abs(value)
    scaled = lambda by, unit: fixed(value / by, f"%.2f{unit}")
    return F.when(value.isNull(), "n/a").when(size >= 1e12, scaled(1e12, "T")).when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).otherwise(fixed(value, "%.2f"))


def company_reports(scores: DataFrame, speakers: DataFrame, quarters: DataFrame, quotes: DataFrame) -> DataFrame:
    """One nested report per symbol: scores, speakers by mentions, latest quarters, best quotes.

    Each part is reduced to its few rows per symbol before the join, so that no list grows with the input.
    """
    def best(df: DataFrame, name: str, n: int) -> DataFrame:
        """Rows ranked 1 to n as an array."""
        cols = [c for c in df.columns if c != "symbol"]
        top = df.where(F.col("rank") <= n).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in cols if c != "rank"]))).alias(name))
        return top

    out = scores
    for part in (best(speakers, "speakers", 5), best(quarters, "quarters", 4), best(quotes, "quotes", 10)):
        out = out.join(part, "symbol", "left")
    return out

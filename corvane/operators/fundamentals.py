"""Quarterly fundamentals: merging providers, growth, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

KEYS = ["symbol", "year", "quarter"]
MEASURES = ("revenue", "net_income", "reported_eps", "eps_estimate")


def label(year: str = "year", quarter: str = "quarter") -> object:
    return F.concat(F.col(year).cast("string"), F.lit("-Q"), F.col(quarter).cast("string"))


def latest(rows: DataFrame, n: int = 4) -> DataFrame:
    """Each company's n latest quarters, ``rank`` 1 the newest."""
    w = Window.partitionBy("symbol").orderBy(F.desc("year"), F.desc("quarter"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def outer_quarters(revenue: DataFrame, income: DataFrame, eps: DataFrame) -> DataFrame:
    """Full outer join of three measures by quarter."""
    return revenue.join(income, KEYS, "full_outer").join(eps, KEYS, "full_outer")


def first_reported(rows: DataFrame, columns: tuple[str, ...] = ("reported_eps", "eps_estimate")) -> DataFrame:
    """Per quarter the newest non-null value of each column, by announced date."""
    return rows.groupBy(*KEYS).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("announced"))).alias(c) for c in columns])


def merge_providers(a: DataFrame, b: DataFrame, n: int = 4) -> DataFrame:
    """A's quarters with missing EPS filled from B, B's other quarters added; the n latest."""
    right = b.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in ("reported_eps", "eps_estimate")])
    both = a.select(*KEYS, *MEASURES).join(right, KEYS, "full_outer")
    filled = both.select(*KEYS, "revenue", "net_income", *[F.coalesce(c, f"b_{c}").alias(c) for c in ("reported_eps", "eps_estimate")])
    return latest(filled, n)


def growth(quarters: DataFrame) -> DataFrame:
    """Per company, growth of revenue and EPS from the second latest to the latest quarter."""
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    pairs = quarters.groupBy("symbol").agg(*[at(c, k).alias(f"{c}_{k}") for c in ("revenue", "reported_eps") for k in (1, 2)])
    return pairs.select("symbol", *[S.growth_percent(F.col(f"{c}_1"), F.col(f"{c}_2")).alias(f"{c}_growth_pct") for c in ("revenue", "reported_eps")])


def surprise(quarters: DataFrame) -> DataFrame:
    """EPS against its estimate."""
    percent = F.when(F.col("eps_estimate") != 0, (F.col("reported_eps") - F.col("eps_estimate")) / F.abs("eps_estimate") * 100)
    return quarters.withColumn("surprise_pct", percent).withColumn("beat", F.col("reported_eps") > F.col("eps_estimate"))


def validate(a: DataFrame, b: DataFrame, fields: tuple[str, ...], threshold: float = 10.0) -> DataFrame:
    """Field by field comparison of two providers' rows (symbol and the fields).

    symbol, key, a_value, b_value, merged, filled, diff_pct, mismatch, severity; fields that neither has are left out.
    """
    tall = lambda df, name: df.unpivot(["symbol"], list(fields), "key", name)
    both = tall(a, "a_value").join(tall(b, "b_value"), ["symbol", "key"], "full_outer").where("a_value IS NOT NULL OR b_value IS NOT NULL")
    diff = F.when(F.abs("b_value") > 1e-8, F.abs((F.col("a_value") - F.col("b_value")) / F.col("b_value")) * 100)
    out = both.withColumn("merged", F.coalesce("a_value", "b_value")).withColumn("filled", F.col("a_value").isNull()).withColumn("diff_pct", diff)
    bad = F.coalesce(F.col("diff_pct") >= threshold, F.lit(False))
    return out.withColumn("mismatch", bad).withColumn("severity", F.when(bad, S.severity(F.col("diff_pct"))))


def severity_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("symbol").agg(F.count(F.lit(1)).alias("compared"), F.count_if("filled").alias("filled"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def eps_calendar(rows: DataFrame, last: int = 12) -> DataFrame:
    """Per company and quarter, of its ``last`` announcements (symbol, announced, ord, reported_eps, eps_estimate) the newest non-null EPS and estimate."""
    w = Window.partitionBy("symbol").orderBy(F.desc("announced"), "ord")
    recent = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    recent = recent.withColumns({"year": F.year("announced"), "quarter": F.quarter("announced"), "announced": -F.col("n")})
    return first_reported(recent)


def series_row(rows: DataFrame, names: tuple[str, ...], columns: int = 4) -> DataFrame:
    """symbol, year, quarter, value: of a statement (symbol, metric, period_end, value) the first of ``names`` it has, its newest columns.

    Of two columns in one quarter the later listed one (the older) counts.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric"))
    known = rows.withColumn("place", place).where("place > 0")
    best = known.withColumn("first", F.min("place").over(Window.partitionBy("symbol"))).where("place = first")
    cols = best.withColumn("col", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end")))).where(F.col("col") <= columns)
    return cols.groupBy("symbol", F.year("period_end").alias("year"), F.quarter("period_end").alias("quarter")).agg(F.max_by("value", "col").alias("value"))


def price_targets(rows: DataFrame) -> DataFrame:
    """Adds upside_pct (mean_target over price), spread_pct (high less low over mean_target) and the spread's kind."""
    of = lambda part, whole: F.try_divide(part, whole) * 100
    out = rows.withColumns({"upside_pct": of(F.col("mean_target") - F.col("price"), F.col("price")), "spread_pct": of(F.col("high") - F.col("low"), F.col("mean_target"))})
    return out.withColumn("spread", F.when(F.col("spread_pct").isNull(), "unknown").when(F.col("spread_pct") < 15, "tight").when(F.col("spread_pct") < 35, "moderate").otherwise("wide"))


def trend(rows: DataFrame, key: str, at: str, last: int, enough: int) -> DataFrame:
    """The newest ``last`` rows of a key, oldest first (position), and whether it has ``enough`` rows for a chart."""
    newest = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return newest.where(F.col("n") <= last).withColumn("position", F.lit(last + 1) - F.col("n")).withColumn("charted", F.col("all") >= enough).drop("n", "all")

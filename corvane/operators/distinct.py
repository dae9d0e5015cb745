"""First-wins removal of rows that share a mark with a row that stays."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import release, store
from .graph import components

#: Rounds of minima before what is left is settled by component, and about how many rows of a component one task settles in a round.
ROUNDS, COMPONENT_ROWS = 3, 100_000
#: Rows of the sample that places the end of a large component's first rows.
PLACES = 64


def _choose(rows: pd.DataFrame, near: pd.DataFrame, marks: list[str]) -> pd.DataFrame:
    """Greedy choice in order; ``near`` has the ids (a, b) of last marks of which b, if taken, rules out a."""
    taken: set[str] = set()
    like: dict[str, list[str]] = {}
    for a, b in zip(near["a"], near["b"], strict=True):
        like.setdefault(a, []).append(b)
    chosen, last = [], f"__id_{marks[-1]}"
    for r in rows.sort_values("__place").to_dict("records"):
        own = {x for m in marks if not pd.isna(x := r[f"__id_{m}"])}
        free = not own & taken and not any(b in taken for b in like.get(r[last], ()))
        chosen.append((r["__row"], free))
        if free:
            taken |= own
    return pd.DataFrame(chosen, columns=["__row", "keep"])


def _settle(left: DataFrame, marks: list[str], near: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(chosen, decided) rows: undecided rows fall into components by the marks they share and the marks that are near, and each component is
    decided in order, as far as its first COMPONENT_ROWS rows or so: whether a row stays depends on earlier rows only.
    """
    number = lambda m, c: F.xxhash64(F.lit(m), "__scope", c)
    ids = {f"__id_{m}": F.when(F.col(m).isNotNull(), number(m, m)) for m in marks}
    tagged = store(left.withColumns({"__row": F.xxhash64(F.lit("row"), "__scope", "__order")} | ids))
    links = [tagged.select(F.col("__row").alias("a"), F.col(f"__id_{m}").alias("b")).dropna() for m in marks]
    pairs = None
    if near is not None:  # those between marks that are still there
        present = tagged.select(F.col(f"__id_{marks[-1]}").alias("a")).dropna().distinct()
        pairs = near.select(number(marks[-1], marks[-1]).alias("a"), number(marks[-1], "near").alias("b")).join(present, "a", "left_semi")
        pairs = store(pairs.join(present.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b").distinct())
        links.append(pairs)
    parts = store(components(reduce(DataFrame.unionByName, links)))
    joined = store(tagged.join(parts.withColumnRenamed("node", "__row"), "__row", "left").withColumn("component", F.coalesce("component", "__row")))
    sizes = joined.groupBy("component").count()
    large = sizes.where(F.col("count") > COMPONENT_ROWS)
    now = joined
    if not large.isEmpty():
        large = store(large)
        # a sample by hash says where three quarters of COMPONENT_ROWS rows end; the first row of a component is always among them
        rate = max(1, COMPONENT_ROWS * 3 // (4 * PLACES))
        sample = joined.where(F.pmod(F.xxhash64("__row"), F.lit(rate)) == 0).join(large, "component")
        place = F.row_number().over(Window.partitionBy("component").orderBy("__order"))
        cut = sample.withColumn("place", place).where(F.col("place") <= PLACES).groupBy("component").agg(F.max("__order").alias("cut"))
        first = joined.join(large.select("component"), "component", "left_semi").groupBy("component").agg(F.min("__order").alias("least"))
        ends = store(first.join(cut, "component", "left").select("component", F.greatest("least", F.coalesce("cut", "least")).alias("end")))
        now = joined.join(ends, "component", "left").where(F.col("end").isNull() | (F.col("__order") <= F.col("end"))).drop("end")
    # places in a component stand for what the order consists of
    placed = F.row_number().over(Window.partitionBy("component").orderBy("__order"))
    rows = now.select("component", "__row", placed.alias("__place"), *[F.col(c).cast("string").alias(c) for c in ids])
    schema = "__row bigint, keep boolean"
    if pairs is None:
        none = pd.DataFrame({"a": [], "b": []})
        verdict = rows.groupBy("component").applyInPandas(lambda pdf: _choose(pdf, none, marks), schema)
    else:
        held = pairs.join(parts.withColumnRenamed("node", "a"), "a").select("component", *[F.col(c).cast("string").alias(c) for c in ("a", "b")])
        held = held.join(rows.select("component").distinct(), "component", "left_semi")
        verdict = rows.groupBy("component").cogroup(held.groupBy("component")).applyInPandas(lambda pdf, p: _choose(pdf, p, marks), schema)
    verdict = store(verdict)
    plain = ["__scope", "__order", *marks]
    chosen = store(tagged.join(verdict.where("keep"), "__row", "left_semi").select(*plain))
    decided = store(tagged.join(verdict, "__row", "left_semi").select("__scope", "__order"))
    for df in (tagged, parts, joined, verdict, *([] if pairs is None else [pairs])):
        release(df)
    return chosen, decided


def greedy_distinct(rows: DataFrame, scope: list[str], order: str, marks: list[str], near: DataFrame | None = None) -> DataFrame:
    """First-wins deduplication by several marks at once: a row stays if no earlier *kept* row shares any mark.

    ``order`` is a unique sort key per scope. A null mark is shared with no row; nulls of a scope are one scope. ``near``
    (scope, the last mark, near) adds values of the last mark by which a row goes as well if an earlier kept row has one.
    In each of the first ROUNDS rounds every undecided row that comes first under all its marks is
    kept, and rows that share a mark with a kept row go. Minima are combined map-side, so a mark that very many rows share is
    no hot spot. What is left then, chains mostly, falls into components, which are decided at once, each in one task; of a component
    over COMPONENT_ROWS rows a round decides the first so many, and what those leave falls apart before the next round. Every round decides a row
    at least of every component. Each round's rows (keys only) are written to shared storage.
    """
    # structs are never null, and equal where their fields are, nulls included
    within, at = F.struct(*scope).alias("__scope"), F.struct(order).alias("__order")
    left = store(rows.select(within, at, *marks))
    if near is not None:
        near = store(near.select(within, marks[-1], "near"))

    def least(of: DataFrame, m: str, name: str) -> DataFrame:
        return of.where(F.col(m).isNotNull()).groupBy("__scope", m).agg(F.min("__order").alias(name))

    def nearest(of: DataFrame, name: str) -> DataFrame:
        """The first row among those near each value."""
        firsts = least(of, marks[-1], name).withColumnRenamed(marks[-1], "near")
        return near.join(firsts, ["__scope", "near"]).groupBy("__scope", marks[-1]).agg(F.min(name).alias(name))

    kept, rounds = None, 0
    while not left.isEmpty():
        rounds += 1
        if rounds > ROUNDS:
            chosen, decided = _settle(left, marks, near)
        else:
            first, free = left, F.lit(True)
            for m in marks:
                first = first.join(least(left, m, f"__{m}"), ["__scope", m], "left")
                free = free & (F.col(m).isNull() | (F.col("__order") == F.col(f"__{m}")))
            if near is not None:
                first = first.join(nearest(left, "__near"), ["__scope", marks[-1]], "left")
                free = free & (F.col("__near").isNull() | (F.col("__order") <= F.col("__near")))
            chosen = decided = store(first.where(free).select("__scope", "__order", *marks))
        kept = chosen if kept is None else kept.unionByName(chosen)
        rest = left.join(decided.select("__scope", "__order"), ["__scope", "__order"], "left_anti")
        for m in marks:
            rest = rest.join(chosen.where(F.col(m).isNotNull()).select("__scope", m).distinct(), ["__scope", m], "left_anti")
        if near is not None:
            rest = rest.join(nearest(chosen, "__near"), ["__scope", marks[-1]], "left").where(F.col("__near").isNull() | (F.col("__order") < F.col("__near"))).drop("__near")
        last, left = left, store(rest.select("__scope", "__order", *marks))
        release(last)
    if kept is None:
        return rows.limit(0)
    if {*rows.columns} <= {*scope, order, *marks}:  # what was kept holds all there is
        held = {order: F.col(f"__order.{order}")} | {c: F.col(f"__scope.{c}") for c in scope} | {m: F.col(m) for m in marks}
        return kept.select(*[held[c].alias(c) for c in rows.columns])
    return rows.withColumns({"__scope": within, "__order": at}).join(kept.select("__scope", "__order"), ["__scope", "__order"], "left_semi").select(*rows.columns)

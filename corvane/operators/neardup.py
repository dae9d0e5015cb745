"""Near-duplicate posts of a feed."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import title_key
from ..sources.store import release, store
from .distinct import greedy_distinct

RATIO = 0.93
#: Characters of a block at most, and at least (of titles that can lose a character).
BLOCK, LEAST_BLOCK = 12, 7


def alike(new: str, kept: str) -> bool:
    if new == kept:
        return True
    short, long = sorted((len(new), len(kept)))
    if 2 * short < RATIO * (short + long):
        return False
    m = SequenceMatcher(a=new, b=kept)
    return m.quick_ratio() >= RATIO and m.ratio() >= RATIO


def _lost(n: Column) -> Column:
    """Characters that a title of n characters and an alike one that is no longer leave unmatched together, at most (a little wider than 1 - RATIO)."""
    return F.floor(n * 2 * (1 - RATIO) + 1e-9).cast("int")


def _size(n: Column) -> Column:
    """Length of the blocks into which a title of n characters is cut: so many blocks that one has at most one of the characters that can be lost."""
    return F.least(F.floor(n / (F.floor(_lost(n) / 2) + 1)), F.lit(BLOCK)).cast("int")


def _shapes(size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(size, off, first, off2, second, gap): what stays of a block that loses or gains one character at most, as two of its stretches (at off and off2, so many
    characters long) and the characters between them in the other title; of a stretch in one piece the second is empty.

    If a half stands whole, the other half's quarters tell: the near one stands as well (one piece), or the far one does, a place nearer or farther.
    """
    left, right = size // 2, size - size // 2
    a, b, c = left // 2, left - left // 2, right // 2
    whole = [(size, 0, left + c, 0, 0, 0), (size, a, b + right, 0, 0, 0)]
    return whole + [(size, 0, left, left + c, right - c, c + e) for e in (-1, 1)] + [(size, 0, a, left, right, b + e) for e in (-1, 1)]


def _verified(names: list[str]):
    """Candidate titles (x, y) in, the pairs that are alike out, each way by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key, near = [], [], []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                for new, kept in ((x, y), (y, x)):
                    if alike(new, kept):
                        at.append(i)
                        key.append(new)
                        near.append(kept)
            scope = [b.column(i).take(pa.array(at, pa.int64())) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*scope, pa.array(key, pa.string()), pa.array(near, pa.string())], names=names)

    return run


def near_titles(titles: DataFrame, scope: list[str], key: str) -> DataFrame:
    """scope, key, near: all pairs of unequal titles where a row with ``key`` is like an earlier one with ``near``.

    A filter without loss comes first. Alike titles leave at most D = 0.07 * (n + m) characters unmatched, n the longer one's length, so D <= 0.14 * n.
    The longer one is cut into more than D / 2 blocks; each unmatched character, on either side, falls into one block at most, so one block has at most one.
    What then stays of it, nine characters of twelve in one of a few shapes (``_shapes``), meets the other title's stretches of these shapes in an equality
    join of hashes and ids; lengths and places are compared in it, and the few pairs that are left get their texts and are verified. So work follows
    the titles, some 400 hashes for each, and those that share nine characters at about the same place; a title of less than eight characters is only like itself.
    """
    spark = titles.sparkSession
    each = titles.where(F.col(key).isNotNull()).select(F.struct(*scope).alias("s"), F.col(key).alias("t")).distinct().withColumn("n", F.length("t")).where("n > 1")
    each = store(each.withColumn("id", F.monotonically_increasing_id()))
    kept = [x for size in range(LEAST_BLOCK, BLOCK + 1) for x in _shapes(size)]
    shapes = F.broadcast(spark.createDataFrame(kept, "size int, off int, first int, off2 int, second int, gap int"))
    sought = F.broadcast(spark.createDataFrame(sorted({(size, first, second, gap) for size, _, first, _, second, gap in kept}), "size int, first int, second int, gap int"))
    n = F.col("n")
    hashed = lambda at, at2: F.xxhash64("s", "size", "first", "second", "gap", F.substring("t", at + 1, F.col("first")), F.substring("t", at2 + 1, F.col("second"))).alias("hash")
    cut = each.where(_lost(n) > 0).withColumn("size", _size(n)).join(shapes, "size").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(n / F.col("size")).cast("int") - 1)))
    at = F.col("i") * F.col("size")
    pieces = cut.select(hashed(at + F.col("off"), at + F.col("off2")), F.col("id").alias("x"), n.alias("nx"), (at + F.col("off")).alias("at"))
    # the sizes that longer titles, up to RATIO / (2 - RATIO) of this one's length, are cut into
    longer = F.filter(F.sequence(n, F.floor(n * (2 - RATIO) / RATIO).cast("int") + 1), lambda k: _lost(k) > 0)
    probes = each.withColumn("size", F.explode(F.array_distinct(F.transform(longer, _size)))).join(sought, "size")
    span = F.col("first") + F.col("gap") + F.col("second")
    probes = probes.where(span <= n).withColumn("place", F.explode(F.sequence(F.lit(0), n - span)))
    probes = probes.select(hashed(F.col("place"), F.col("place") + F.col("first") + F.col("gap")), F.col("id").alias("y"), n.alias("ny"), "place")
    # of D unmatched characters those that only the longer title has are nx - ny more than the other's, and a place moves by no more than either
    both, more, moved = F.floor((F.col("nx") + F.col("ny")) * (1 - RATIO) + 1e-9), F.col("nx") - F.col("ny"), F.col("place") - F.col("at")
    fits = (more >= 0) & (more <= both) & (2 * moved <= both - more) & (-2 * moved <= both + more)
    # a title has some 50 pieces, so that those of a partition are held, and the ten times as many probes pass by unsorted
    met = probes.join(pieces.hint("shuffle_hash"), "hash").where(fits & (F.col("x") != F.col("y")))
    # equal lengths meet from both sides
    pairs = met.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    text = lambda c: each.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"), F.col("t").alias(f"t{c}"))
    pairs = pairs.join(text("x"), "x").join(text("y"), "y").where("sx <=> sy")
    pairs = pairs.select(*[F.col(f"sx.{c}").alias(c) for c in scope], F.col("tx").alias("x"), F.col("ty").alias("y"))
    schema = StructType([*(f for c in scope for f in titles.schema.fields if f.name == c), StructField(key, StringType()), StructField("near", StringType())])
    out = store(pairs.mapInArrow(_verified(schema.names), schema))
    release(each)
    return out


def distinct_posts(posts: DataFrame, keys: list[str]) -> DataFrame:
    """All posts, best first per key, without those like a better one that stays (same URL or title, or titles 0.93 alike).

    A null URL or title is like no other; of rows equal in score, ord, URL and title one stays.
    """
    first = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("score"), "ord", "url", "title")
    rows = posts.withColumns({"__first": first, "__key": title_key(F.col("title"))}).dropDuplicates([*keys, "__first"])
    near = near_titles(rows, keys, "__key")
    return greedy_distinct(rows, keys, "__first", ["url", "__key"], near).select(*posts.columns)

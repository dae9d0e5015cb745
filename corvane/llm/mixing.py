"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled and laid end to end, and that stream is cut into blocks of equal
tokens (as equal as whole tokens allow). The mix is a row of M slots, each for one block. Slot k gets the golden-ratio
point (k * g mod M) / M with g near M / phi and prime to M, and the point's place among the cumulative
shares names the slot's source. These points fill [0, 1) evenly at every length, so any stretch of the mix holds the
sources in proportion, and as g is prime to M each source gets exactly its share of slots. The slots of
a source are ranked, and rank r takes block r modulo the number of its blocks.

Ranks and stream offsets are running counts over a whole source, which may hold most rows: both are
summed in two levels (small ranges counted first, then ranks inside a range), so no task holds a
source. Sources are numbered in the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, id_type, materialize, same

MAX_REPEATS = 3
#: A source is cut into at least so many blocks, if it has the tokens.
MIN_BLOCKS = 64
#: Slots at most, so that k * g stays within 63 bits; block_tokens grows beyond.
MAX_SLOTS = 2_000_000_000
#: Bits of the levels that one pass over the sources settles.
DIGIT = 16
#: Slots or documents in a range of the two-level sums, at least.
RANGE = 1 << 10


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE_WORD)).cast("bigint")


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds source_no (from 1), weight and target to (source, source_size): 1, 2, 3 in turn by code point order, null last.

    Shares of the total by weight stop at MAX_REPEATS times the source's size; what is over goes to the
    others by weight, until none is above.
    Sources are numbered inside ranges of their order and by the ranges' counts (``last`` and ``range`` name the order),
    so that no task holds all of them.
    """
    last = F.col("source").isNull()
    ranged = sources.withColumn("last", last).repartitionByRange("last", "source").withColumn("range", F.spark_partition_id())
    numbered = _running(materialize(ranged, "mix-ranges"), [], "range", ["last", "source"], F.lit(1))
    s = numbered.select("source", "source_size", "last", "range", (F.col("before") + 1).alias("source_no"), (F.col("before") % 3 + 1).cast("double").alias("weight"))
    s = materialize(s, "mix-sources")
    return s.withColumn("target", F.least(F.col("weight") * F.lit(_level(s)), (MAX_REPEATS * F.col("source_size")).cast("double")))


def _level(s: DataFrame) -> float:
    """The level at which weight * level, held at MAX_REPEATS times a source's size, sums to the total.

    Sources fill in the order of size over weight. Weights are 1, 2 and 3, so ``k`` = 6 * size / weight is whole; a source is full
    if the sum is under the total at its own level, MAX_REPEATS * k / 6. The last full k is found by its digits from the top, DIGIT
    bits a pass, from sums by digit (2 ** DIGIT rows at most), so the number of passes doesn't depend on the sources.
    """
    s = s.select((F.col("source_size") * F.expr("int(6 / weight)")).alias("k"), "source_size", F.col("weight").cast("bigint").alias("w"))
    total, left, top = s.agg(F.sum("source_size"), F.sum("w"), F.max("k")).first()
    if not total:
        return 0.0
    # held and left: size of the full sources, weight of the others
    held, lo, bits = 0, 0, top.bit_length()
    under = lambda held, left, k: 6 * MAX_REPEATS * held + left * MAX_REPEATS * k < 6 * total
    while bits > 0:
        here = s.where(F.col("k").between(lo, lo + 2**bits - 1))
        bits = max(0, bits - DIGIT)
        rows = here.groupBy(F.shiftright("k", bits).alias("digit")).agg(F.min("k"), F.max("k"), F.sum("source_size"), F.sum("w")).collect()
        for digit, least, most, size, w in sorted(rows):
            if under(held + size, left - w, most):
                held, left = held + size, left - w
                continue
            if under(held, left, least):  # some of these
                lo = digit << bits
            else:
                bits = 0
            break
    return (total - MAX_REPEATS * held) / left


def stride(m: int) -> int:
    """The number prime to m that is nearest to m divided by the golden ratio."""
    g = max(1, round(m * (math.sqrt(5) - 1) / 2))
    return next(x for d in range(m + 1) for x in (g + d, g - d) if 0 < x and math.gcd(x, m) == 1)


def range_size(n: int) -> int:
    """Of n rows, about as many ranges as rows in a range."""
    return max(RANGE, math.isqrt(n))


def _running(df: DataFrame, part: list[str], bucket: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of ``part`` that come earlier by bucket, then order."""
    sums = df.groupBy(*part, bucket).agg(F.sum(value).alias("__v"))
    over = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__v").over(over), F.lit(0))).drop("__v")
    inner = Window.partitionBy(*part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return same(local, sums, [*part, bucket], "inner").withColumn("before", F.col("__base") + F.col("__local")).drop("__base", "__local")


def _div(a: str, b: str) -> Column:
    """Whole part of a quotient whose dividend may exceed 63 bits."""
    return F.expr(f"CAST(({a}) DIV ({b}) AS BIGINT)")


def _wide(name: str) -> str:
    return f"CAST({name} AS DECIMAL(19,0))"


def schedule(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = 256, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, placed, mix).

    sources: source, source_no, source_size, weight, target, blocks, slots. placed: one row per row of
    ``docs``: doc_id, source_no, size, source_size, target and before (its offset in its source's stream).
    mix: slot, source_no, before, doc_id, start, tokens: slot by slot the pieces of documents that the mix consists of.
    """
    rows = docs.select(F.col(doc_id).cast(id_type(docs, doc_id)).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"))
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    sources = with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total, n_sources = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    per_block = max(block_tokens, -(-2 * total // MAX_SLOTS))
    blocks = F.least(F.col("source_size"), F.greatest(F.lit(MIN_BLOCKS), F.ceil(F.col("source_size") / per_block))).cast("bigint")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = _running(sources.withColumn("blocks", blocks).withColumn("slots", slots), [], "range", ["last", "source"], F.col("slots"))
    sources = materialize(sources.withColumn("upto", F.col("before") + F.col("slots")).drop("last", "range", "before"), "mix-targets")

    m = sources.agg(F.max("upto")).first()[0] or 0
    # the point of slot k in units of 1/M; the share that holds it is found on cells of equal width
    width = max(1, -(-m // max(1, n_sources)))
    point = (F.col("id") * F.lit(stride(m) if m else 1)) % F.lit(max(m, 1))
    points = docs.sparkSession.range(m).select(F.col("id").alias("slot"), point.alias("p")).withColumn("cell", _div("p", str(width)))
    shares = sources.where("slots > 0").select("source_no", "blocks", (F.col("upto") - F.col("slots")).alias("lo"), "upto")
    shares = shares.withColumn("cell", F.explode(F.sequence(_div("lo", str(width)), _div("upto - 1", str(width)))))
    slotted = points.join(shares, "cell").where("p >= lo AND p < upto").select("slot", "source_no", "blocks", _div("slot", str(range_size(m))).alias("range"))
    ranked = _running(slotted, ["source_no"], "range", ["slot"], F.lit(1))
    taken = ranked.select("slot", "source_no", (F.col("before") % F.col("blocks")).cast("bigint").alias("block"))

    n_rows = rows.count()
    n_buckets = max(1, n_rows // range_size(n_rows))
    placed = same(rows, sources.select("source", "source_no", "source_size", "target", "blocks"), ["source"], "inner")
    placed = placed.withColumn("bucket", F.floor((F.col("h") / 2.0**64 + 0.5) * n_buckets).cast("int"))
    placed = _running(placed, ["source_no"], "bucket", ["h", "doc_id", "size"], F.col("size"))
    placed = materialize(placed.select("doc_id", "source_no", "size", "source_size", "target", "blocks", "before"), "mix-placed")
    # block b holds the tokens t with floor(t * blocks / source_size) = b
    block_of = lambda t: _div(f"{_wide(t)} * {_wide('blocks')}", _wide("source_size"))
    first_of = lambda b: _div(f"{_wide(b)} * {_wide('source_size')} + {_wide('blocks - 1')}", _wide("blocks"))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(block_of("before"), block_of("before + size - 1"))))
    cut = cut.withColumn("lo", F.greatest(F.col("before"), first_of("block"))).withColumn("hi", F.least(F.col("before") + F.col("size"), first_of("block + 1")))
    pieces = cut.select("source_no", "block", "doc_id", "before", (F.col("lo") - F.col("before")).alias("start"), (F.col("hi") - F.col("lo")).alias("tokens"))
    mix = taken.join(pieces, ["source_no", "block"]).select("slot", "source_no", "before", "doc_id", "start", "tokens")
    return sources, placed, mix


def mix_summary(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, size, source_size, target and taken (tokens the mix takes, repeats counted) of every row of ``docs``.

    Null texts have size 0 and are never taken; a null source is a source, weighted last; rows that
    repeat are documents of their own; a very long text is spread over blocks; other columns are ignored; an empty table gives an empty
    result; ids may be text. No document is taken more than MAX_REPEATS times, and a rerun gives the same mix.
    """
    _, placed, mix = schedule(docs, **options)
    taken = mix.groupBy("source_no", "before").agg(F.sum("tokens").alias("taken"))
    sized = placed.where("size > 0").join(taken, ["source_no", "before"], "left")
    rest = placed.where("size = 0").withColumn("taken", F.lit(None).cast("bigint"))
    return sized.unionByName(rest).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))

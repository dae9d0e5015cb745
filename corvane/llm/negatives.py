"""Hard negatives by exact search in inverted lists.

Every row of the table is in the list of its nearest of k centroids; a list keeps its radius, the greatest distance of a member from the
centroid. An anchor a scores a member x of the list (c, r) between a.c - |a| r and a.c + |a| r (Cauchy-Schwarz). Lists are visited in falling
order of the upper bound: those whose bounds miss the window asked for are skipped, and a list whose upper bound falls strictly below the
k-th score found so far ends the visit (an equal one may hold a tie with a smaller id). So the search is exact, whatever the centroids are,
which are fitted by Spark's k-means on a bounded sample.

A visit is a join: the first lists of every anchor in one pass, from which it gets its k-th score, then all that its bounds leave in a second
one. Lists are stored as blocks of rows, anchors as blocks of anchors; what meets in a task is one block of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import materialize, release

#: Parameters of the index: rows that k-means is fitted on at most (the least by hash), rounds of it, centroids at most.
SAMPLE, ROUNDS, MAX_LISTS = 20_000, 8, 1024
#: Rows of a block of a list, anchors of a block of anchors, and lists of a first visit.
BLOCK, ANCHORS, FIRST = 4096, 2048, 4
#: What rounding may add to a bound, relative to the lengths involved.
SLACK = 1e-9


def whole_vectors(vector: Column, factor: int) -> Column:
    """Each component x as floor(factor * x); null if the vector or any of its components is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors as rows of one matrix; shorter ones end in zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * dim:
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; refused if one could leave 63 bits."""
    if not len(a) or not len(x):
        return np.zeros((len(a), len(x)), np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2**53:  # whole in doubles
        return np.rint(a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ x.T
    raise ArithmeticError("inner products of these vectors do not fit into 63 bits")


def bounds(anchors: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper): between them lie an anchor's scores with a list's members (anchors by lists)."""
    a = anchors.astype(np.float64)
    length = np.sqrt((a**2).sum(axis=1))[:, None]
    middle, reach = a @ centroids.T, length * radius
    slack = 1e-6 + SLACK * (np.abs(middle) + reach + length * np.sqrt((centroids**2).sum(axis=1)))
    return middle - reach - slack, middle + reach + slack


def _sample(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.xxhash64("vec", "label", "id")).limit(SAMPLE)


class Index:
    """The inverted lists of a table of rows (id, label, vec of integers)."""

    def __init__(self, rows: DataFrame, lists: int | None = None):
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        self.dim = dim or 0
        k = min(lists or round(n**0.5), MAX_LISTS, n)
        self.centroids = self._fit(rows, k) if k > 1 and self.dim else np.zeros((1, self.dim))
        assigned = materialize(self._assign(rows), "vectors-in-lists")
        sizes = {r["list"]: r for r in assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}  # one row a centroid
        self.used = np.array(sorted(sizes), np.int64)
        self.radius = np.array([sizes[i]["radius"] for i in self.used], np.float64)
        counts = F.create_map(*[F.lit(x) for i in self.used.tolist() for x in (i, -(-sizes[i]["n"] // BLOCK))]) if sizes else F.lit(None)
        # a list of any size is dealt out to blocks by hash, so no task holds a large one
        dealt = assigned.withColumn("block", F.pmod(F.xxhash64("id", "label", "vec"), counts[F.col("list")]) if sizes else F.lit(0).cast("bigint"))
        packed = dealt.groupBy("list", "block").agg(F.collect_list(F.struct("id", "label", "vec")).alias("members"))
        self.blocks = materialize(packed, "vector-blocks")
        release(assigned)

    def _fit(self, rows: DataFrame, k: int) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        padded = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.get("vec", i), F.lit(0)).cast("double"))
        sample = materialize(_sample(rows).select(array_to_vector(padded).alias("features")), "vector-sample")
        fitted = KMeans(k=k, maxIter=ROUNDS, initMode="random", seed=1).fit(sample)
        release(sample)
        return np.array(fitted.clusterCenters(), np.float64).reshape(-1, self.dim)

    def _assign(self, rows: DataFrame) -> DataFrame:
        centroids, dim = self.centroids, self.dim

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centroids**2).sum(axis=1) / 2
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    x = _matrix(part.column("vec"), dim).astype(np.float64)
                    own = (x @ centroids.T - half).argmax(axis=1)
                    dist = np.sqrt(((x - centroids[own]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int64()), pa.array(dist, pa.float64())], names=["id", "label", "vec", "list", "dist"])

        plain = rows.select("id", "label", "vec")
        return plain.mapInArrow(nearest, StructType([*plain.schema.fields, StructField("list", LongType()), StructField("dist", DoubleType())]))

    def visit(self, wanted: DataFrame, choose: Callable, best: Callable, out: StructType) -> DataFrame:
        """One pass. ``wanted`` has a row of arrays (id, label, vec, more) per block of anchors; ``choose`` (block, lower, upper) marks the lists that each
        of its anchors visits; ``best`` (anchors, members, scores) gets the anchors that visit a list with each block of its members, and returns columns of ``out``."""
        used, dim, own, balls = self.used, self.dim, wanted.schema.names, (self.centroids[self.used], self.radius)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    block = {n: b.column(n)[r].values for n in own}
                    take = choose(block, *bounds(_matrix(block["vec"], dim), *balls))
                    for j in np.flatnonzero(take.any(axis=0)).tolist():
                        at = pa.array(np.flatnonzero(take[:, j]))
                        going = [(v := block[n].take(at), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))[1] for n in own]
                        yield pa.RecordBatch.from_arrays([pa.array(used[j : j + 1]), *going], names=["list", *own])

        # a list with very many blocks is one key: adaptive execution splits it between the two exchanges. Neither side is to be broadcast: what is
        # sent is larger than the anchors it is estimated by
        meets = wanted.mapInArrow(send, StructType([StructField("list", LongType()), *wanted.schema.fields])).join(self.blocks.hint("merge"), "list")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    block = {n: b.column(n)[r].values for n in own}
                    members = b.column("members")[r].values
                    x = {n: members.field(n).to_numpy() for n in ("id", "label")}
                    done = best(block, x, products(_matrix(block["vec"], dim), _matrix(members.field("vec"), dim)))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in done.values()], names=list(done))

        return meets.select(*own, "members").mapInArrow(score, out)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores, then smaller ids."""
    if len(score) > 4 * k:  # ties with the k-th stay in
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near]))][:k]
    return np.lexsort((ids, -score))[:k]


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows per key; ranks are limited before the exchange as well."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(anchors: DataFrame, extra: list[str]) -> DataFrame:
    """A row of arrays for each block of anchors."""
    fields = ["id", "label", "vec", *extra]
    one = anchors.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))
    return one.select(*[F.col(f"m.{f}").alias(f) for f in fields])


def hard_negatives(
    vectors: DataFrame, *, anchor: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    k_positives: int = 5, k_negatives: int = 5, low: tuple[int, int] = (80, 100), high: tuple[int, int] = (100, 100), factor: int = 256, lists: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (``anchor``, a condition; by default every row)
    and each of its ``k_positives`` best rows of its label, the ``k_negatives`` best rows of other labels whose score lies between low and high
    times the positive's score (fractions of whole numbers, both ends included). Scores are inner products of the vectors' whole parts times ``factor``.

    Rows with a null id, label or vector or with a component that is null or not finite take no part; rows equal in id, label and vector
    are one row, and a row is never matched with one of its own id. Vectors shorter than the longest end in zeros. Ties go to the smaller id. A label without other rows
    or a window without rows gives no rows, and so does an empty table. Scores that could leave 63 bits are refused. Other columns are ignored.
    Rows that share vector and label can only appear as their least ids, so only those enter the lists: a vector with very many copies is no hot list.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole_vectors(F.col(embedding), factor).alias("vec"), (F.lit(True) if anchor is None else anchor).alias("is_anchor"))
    valid = materialize(rows.dropna(subset=["id", "label", "vec"]).distinct(), "vectors")
    # copies: an anchor is matched with at most k others of them, itself left out
    copies = Window.partitionBy("vec", "label").orderBy("id")
    least = valid.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= 1 + max(k_positives, k_negatives)).drop("nth")
    index = Index(materialize(least, "vectors-least"), lists)
    if not len(index.used):
        return valid.limit(0).select(*[F.lit(0).cast("int" if c == "rank" else "bigint").alias(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    asked = valid.where("is_anchor").select("id", "label", "vec")
    n_blocks = max(1, -(-asked.count() // ANCHORS))
    # anchors with a list in common share a block where there are many: the list's number orders them
    own = index._assign(asked).select("id", "label", "vec", F.least(F.lit(n_blocks - 1), F.floor((F.col("list") + F.pmod(F.xxhash64("id", "label", "vec"), F.lit(1000)) / 1000) * n_blocks / len(index.centroids))).alias("block"))
    anchors = materialize(own, "anchors")

    def first_lists(block: dict, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        take = np.zeros(upper.shape, bool)
        take[np.arange(len(upper))[:, None], np.argsort(-upper, axis=1)[:, :FIRST]] = True
        return take

    def rest(block: dict, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        floor = block["floor"].fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
        return (upper >= floor) & ~first_lists(block, lower, upper)

    def same_label(a: dict, x: dict, score: np.ndarray) -> dict:
        found: list[tuple] = []
        for i, (own_id, own_label) in enumerate(zip(a["id"].to_pylist(), a["label"].to_pylist(), strict=True)):
            at = np.flatnonzero((x["label"] == own_label) & (x["id"] != own_id))
            at = at[_first(score[i, at], x["id"][at], k_positives)]
            found.append((np.full(len(at), own_id), np.full(len(at), own_label), np.full(len(at), i), x["id"][at], score[i, at]))
        aid, alabel, ai, xid, s = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True))
        return {"anchor": aid, "anchor_label": alabel, "vec": a["vec"].take(pa.array(ai)), "id": xid, "score": s}

    fields = lambda *names: StructType([StructField(n, ArrayType(LongType()) if n == "vec" else LongType()) for n in names])
    found_as = fields("anchor", "anchor_label", "vec", "id", "score")
    key = ["anchor", "anchor_label", "vec"]
    one = materialize(_top(index.visit(_packed(anchors, []), first_lists, same_label, found_as), key, k_positives), "positives-first")
    kth = one.groupBy(*key).agg(F.when(F.count(F.lit(1)) == k_positives, F.min("score")).alias("floor"))
    floors = anchors.join(kth.withColumnsRenamed({"anchor": "id", "anchor_label": "label"}), ["id", "label", "vec"], "left")
    two = index.visit(_packed(floors, ["floor"]), rest, same_label, found_as)
    positives = materialize(_top(one.drop("rank").unionByName(two), key, k_positives).drop("rank"), "positives")

    # negatives: every positive of an anchor is a window of scores
    window = F.struct("score", "id", F.lit(None).cast("bigint").alias("kth"))
    each = positives.groupBy(*key).agg(F.array_sort(F.collect_list(window)).alias("windows")).withColumnsRenamed({"anchor": "id", "anchor_label": "label"})
    windows = materialize(anchors.join(each, ["id", "label", "vec"]), "windows")

    def ends(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window of every anchor: the anchor's position, and the least and greatest score."""
        w = block["windows"]
        at = np.repeat(np.arange(len(w)), np.diff(w.offsets.to_numpy()))
        s = w.flatten().field("score").to_numpy().astype(object)
        lo, hi = -((-low[0] * s) // low[1]), high[0] * s // high[1]
        return at, lo, hi

    def inside(block: dict, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Lists whose bounds meet a window, no farther down than the window's k-th score so far."""
        at, lo, hi = ends(block)
        kth_so_far = block["windows"].flatten().field("kth").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        lo = np.maximum(lo.astype(np.float64), kth_so_far.astype(np.float64))
        take = np.zeros(upper.shape, bool)
        for i, a, b in zip(at, lo, hi.astype(np.float64), strict=True):
            if a <= b:
                take[i] |= (upper[i] >= a) & (lower[i] <= b)
        return take & ~first_inside(block, lower, upper)

    def first_inside(block: dict, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """For each window the first lists down from its upper end that can fill it."""
        at, lo, hi = ends(block)
        take = np.zeros(upper.shape, bool)
        for i, a, b in zip(at, lo.astype(np.float64), hi.astype(np.float64), strict=True):
            fit = np.flatnonzero((upper[i] >= a) & (lower[i] <= b)) if a <= b else np.zeros(0, np.int64)
            take[i, fit[np.argsort(-upper[i, fit], kind="stable")[:FIRST]]] = True
        return take

    def other_labels(a: dict, x: dict, score: np.ndarray) -> dict:
        at, lo, hi = ends(a)
        w = a["windows"].flatten()
        pid, ps = w.field("id").to_numpy(), w.field("score").to_numpy()
        aid, alabel = a["id"].to_numpy(), a["label"].to_numpy()
        found: list[tuple] = []
        for j, i in enumerate(at):
            m = np.flatnonzero((x["label"] != alabel[i]) & (x["id"] != aid[i]) & (score[i] >= lo[j]) & (score[i] <= hi[j]))
            m = m[_first(score[i, m], x["id"][m], k_negatives)]
            found.append((np.full(len(m), aid[i]), np.full(len(m), alabel[i]), np.full(len(m), i), np.full(len(m), pid[j]), np.full(len(m), ps[j]), x["id"][m], score[i, m]))
        c = [np.concatenate([np.zeros(0, np.int64), *v]) for v in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 7
        return {"anchor": c[0], "anchor_label": c[1], "vec": a["vec"].take(pa.array(c[2].astype(np.int64))), "positive": c[3], "positive_score": c[4], "id": c[5], "score": c[6]}

    negative_as = fields("anchor", "anchor_label", "vec", "positive", "positive_score", "id", "score")
    slot = [*key, "positive", "positive_score"]
    one = materialize(_top(index.visit(_packed(windows, ["windows"]), first_inside, other_labels, negative_as), slot, k_negatives), "negatives-first")
    full = one.groupBy(*slot).agg(F.when(F.count(F.lit(1)) == k_negatives, F.min("score")).alias("kth"))
    again = positives.withColumnsRenamed({"id": "positive", "score": "positive_score"}).join(full, slot, "left")
    each = again.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive").alias("id"), "kth"))).alias("windows"))
    second = anchors.join(each.withColumnsRenamed({"anchor": "id", "anchor_label": "label"}), ["id", "label", "vec"])
    two = index.visit(_packed(second, ["windows"]), inside, other_labels, negative_as)
    best = _top(one.drop("rank").unionByName(two), slot, k_negatives)
    return best.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

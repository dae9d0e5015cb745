"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit majority votes over hashed 3-word shingles. Two documents are linked if their
fingerprints differ in at most MAX_BITS bits; a class is what links connect.

The self-join walks a binary trie over fingerprints with itself: pairs of nodes descend together, one
bit at a time, a pair adds a bit to its difference where its branches part, and it is dropped as soon
as the difference exceeds the budget. To spread the walk over a cluster, four tries are used, each
with another quarter of the bits at its top: two fingerprints within 3 bits agree wholly on some
quarter, so in that trie their paths part only below the top, and each subtree under a top can be
walked by itself. A subtree of more than ``max_nodes`` fingerprints is divided once more in the same way
(quarters of the bits left), until it is small or MAX_BITS bits are left. Two parents can have the same
child; its fingerprints are made distinct before it is counted and walked. A walk returns, for the
fingerprints it connects, links to one of them: as many rows as nodes, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import id_type, materialize, same, sized

MAX_BITS = 3
SHINGLE = 3
SEED = 42
BITS = 64
#: Bits set in each byte value, most significant first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The text's fingerprint, unsigned; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    data = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(data, np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(rows[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * votes > len(rows)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp.astype(np.int64))], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed bigint) of every whole text. Ids may be text; the least one is then by code point."""
    whole = F.col(text).cast("string")
    kind = id_type(docs, doc_id)
    rows = docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.xxhash64(whole).alias("th"), whole.alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, th bigint, fp bigint")


def trie_join(fps: np.ndarray, roots: np.ndarray, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, within ``budget`` bits inside one root's trie.

    ``fps`` is sorted within each root (unsigned); ``roots`` holds the roots' bounds. A node is a range of
    rows, its children are the rows with a 0 and a 1 at the level's bit. All roots descend together.
    Rows that hold one fingerprint are connected through the first of them instead of pair by pair.
    """
    a0, a1 = roots[:-1], roots[1:]
    wide = a1 - a0 > 1
    a0, a1 = a0[wide], a1[wide]
    b0, b1, d = a0, a1, np.zeros(len(a0), np.int8)
    found_i, found_j = [], []
    for level in range(BITS):
        if not len(a0):
            break
        zero = ((fps >> np.uint64(BITS - 1 - level)) & np.uint64(1)) == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        self_pair = a0 == b0
        other = ~self_pair
        a0, a1, b0, b1, d = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (d, d, d + 1, d[other] + 1),
            )
        )
        keep = (a1 > a0) & (b1 > b0) & (d <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, d = (x[keep] for x in (a0, a1, b0, b1, d))
        # two leaves: what is left of their paths is compared at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
        found_i.append(i[near])
        found_j.append(j[near])
        a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
    # ranges of equal fingerprints never part: each row is tied to the first row of the other range
    empty = np.zeros(0, np.int64)
    for start, end, to in ((a0, a1, b0), (b0, b1, a0)):
        rows = np.concatenate([empty, *map(np.arange, start, end)])
        firsts = np.repeat(to, end - start)
        found_i.append(rows[rows != firsts])
        found_j.append(firsts[rows != firsts])
    i, j = (np.concatenate([empty, *x]) for x in (found_i, found_j))
    return np.minimum(i, j), np.maximum(i, j)


def _stars(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the connected rows to the first row of their class."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


#: Rows squared that one walk may hold: node pairs are at most this many.
WALK = 4_000_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, top, fp) in, links (a, b) out; a subtree is walked when its last row has come."""
    held = np.zeros((3, 0), np.int64)

    def run(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        bounds = np.concatenate(([0], cut, [rows.shape[1]]))
        cost = np.cumsum((np.diff(bounds)) ** 2) // WALK
        for part in np.split(np.arange(len(bounds) - 1), np.flatnonzero(np.diff(cost)) + 1):
            lo, hi = bounds[part[0]], bounds[part[-1] + 1]
            fps = rows[2, lo:hi].astype(np.uint64)
            # signed order within a subtree is not trie order
            ids = np.repeat(np.arange(len(part)), np.diff(bounds[part[0] : part[-1] + 2]))
            fps = fps[np.lexsort((fps, ids))]
            a, b = _stars(fps, *trie_join(fps, bounds[part[0] : part[-1] + 2] - lo))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    for batch in batches:
        held = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in ("mask", "top", "fp")])), axis=1)
        if held.shape[1] > 1:
            last = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
            if len(last) and last[-1] + 1 > 50_000:
                yield from run(held[:, : last[-1] + 1])
                held = held[:, last[-1] + 1 :]
    if held.shape[1]:
        yield from run(held)


def quarters(mask: int) -> list[int]:
    """The bits outside ``mask`` in four parts, each joined to ``mask``."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * q // 4 for q in range(5)]
    return [mask | sum(1 << b for b in free[cuts[q] : cuts[q + 1]]) for q in range(4)]


#: With at most MAX_BITS bits left, any two fingerprints of a subtree are near: it is not divided again (2 ** MAX_BITS rows at most).
UNDIVIDED = BITS - MAX_BITS


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def near_links(fps: DataFrame, *, max_nodes: int = 2048) -> DataFrame:
    """Links (a, b) that connect all fingerprints (distinct column fp) within MAX_BITS bits."""
    out = None
    masks, state = [0], fps.select(F.lit(0).cast("bigint").alias("mask"), "fp")
    while masks:
        deeper = {m: quarters(m) for m in masks}
        to = F.create_map(*[x for m, q in deeper.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(v)) for v in q]))])
        rows = state.select(F.explode(to[F.col("mask")]).alias("mask"), "fp")
        masks = sorted({v for q in deeper.values() for v in q})
        if len(masks) < 4 * len(deeper):  # a child of two parents would get the fingerprints in both twice
            rows = materialize(rows.distinct(), "trie-rows")
        rows = rows.withColumn("top", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "top").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = materialize(sizes, "trie-tops")
        small = (F.col("n") <= max_nodes) | (F.bit_count("mask") >= UNDIVIDED)
        walked = rows.join(sizes.where(small).select("mask", "top"), ["mask", "top"])
        links = walked.repartition("mask", "top").sortWithinPartitions("mask", "top").mapInArrow(_walk, "a bigint, b bigint")
        out = links if out is None else out.unionByName(links)
        large = sizes.where(~small)
        masks = [r["mask"] % 2**64 for r in large.select("mask").distinct().collect()]  # few: 4 ** depth at most
        if masks:
            state = materialize(rows.join(large.select("mask", "top"), ["mask", "top"]).select("mask", "fp"), "trie-large")
    return out


def near_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_nodes: int = 2048) -> DataFrame:
    """doc_id, th (hash of the text), fp, component_id (the least doc_id of the class) and class (its least fingerprint) of every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows get a row
    each; a null doc_id is linked but never names a class unless it is alone; other columns are
    ignored; a very long text is one fingerprint like any other. Copies of one text share a fingerprint and meet the join once.
    """
    rows = materialize(fingerprints(docs, doc_id=doc_id, text=text), "fingerprints")
    each = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-firsts")
    linked = components(near_links(each.select("fp"), max_nodes=max_nodes)).withColumnRenamed("node", "fp")
    member = each.join(linked, "fp")
    least = member.groupBy("component").agg(F.min("first").alias("least"))
    moved = member.join(least, "component").select("fp", "least", "component")
    # written, so that the last join is between two plain exchanges, of which adaptive execution can split a hot fingerprint's
    ids = materialize(each.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "fp").alias("class")), "fingerprint-classes")
    return rows.join(ids, "fp").select("doc_id", "th", "fp", "component_id", "class")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, a null one last; among equal ids the one with the least text hash.

    Columns are unchanged. Rows are told apart by id and text, so a text that shares its id with a near copy of another stays, and of
    rows that agree in both one stays. Only rows that repeat others wholly are moved by key.
    """
    classes = materialize(near_classes(docs, doc_id=doc_id, text=text), "near-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    each = classes.select("class", rank.alias("rank"))
    first = each.groupBy("class").agg(F.min("rank").alias("first"))
    gone = each.join(first, "class").where(~F.col("rank").eqNullSafe(F.col("first"))).select(F.col("rank.doc_id").alias("__d"), F.col("rank.th").alias("__t"))
    gone = sized(gone.distinct(), "near-copies")
    again = classes.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).count().where("count > 1").select("__d", "__t")
    again = sized(same(again, gone, ["__d", "__t"], "left_anti"), "near-repeats")
    keyed = docs.withColumn("__d", F.col(doc_id).cast(id_type(docs, doc_id))).withColumn("__t", F.xxhash64(F.col(text).cast("string")))
    left = same(keyed, gone, ["__d", "__t"], "left_anti")
    if not again.isEmpty():
        left = same(left, again, ["__d", "__t"], "left_anti").unionByName(same(left, again, ["__d", "__t"], "left_semi").dropDuplicates(["__d", "__t"]))
    return left.drop("__d", "__t")

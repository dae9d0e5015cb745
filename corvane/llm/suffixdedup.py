"""Removal of byte strings that occur more than once, by suffixes.

A byte goes if a string of ``min_bytes`` bytes that covers it also starts at another place, in the same text or another one. Which strings
do is read from common prefixes of neighbouring suffixes: suffixes are ordered by their first bytes, the Burrows-Wheeler transform of that
order is extended backward breadth first, interval by interval, and each level sets the common prefixes of one more value. The walk stops at
``min_bytes``: what is not set by then is at least as long, which is all that is asked.

No order of all suffixes of a corpus is made. Every window of ``min_bytes`` bytes names the least hashed gram inside it as its anchor, so
equal windows have equal anchors, and the windows of one anchor form a short context. Contexts whose anchors occur once cannot hold a repeat.
Equal contexts are one with a weight; one that is alone under its anchor has nothing to be compared with, all of it repeats if it has copies.
The others meet by anchor, in blocks of about a megabyte, each with a suffix order of its own. An anchor with very many contexts (the edge of
a passage that is on millions of pages) is divided: half the places of a window around the anchor make a new key out of all bytes that such
windows share, until the key is the window itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import materialize, release

MIN_BYTES = 200
#: Bytes of contexts in one suffix order, contexts of an anchor beyond which it is divided, bytes of text hashed at once.
BLOCK_BYTES, CONTEXTS, SEGMENT = 1 << 20, 2048, 1 << 19
#: Keys, or entries of arrays, that may be broadcast; more are joined by a shuffle.
BROADCAST = 2_000_000
#: Ends each context in a block; no byte of UTF-8.
END = 255
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def gram_bytes(min_bytes: int) -> int:
    """Length of the anchors of windows: 64 for 200."""
    g = 8
    while 2 * g <= min_bytes // 3:
        g *= 2
    return g


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8, 16, 32, ...) from each position on."""
    h = text.astype(np.uint64)
    for s in (1, 2, 4):
        h = h[:-s] | (h[s:] << np.uint64(8 * s))
    h, size = _mixed(h * A), 8
    while size < gram:
        h, size = _mixed(h[:-size] * A + h[size:] * B), 2 * size
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    up = np.full(n + 1, A, np.uint64)
    down = np.full(n + 1, pow(int(A), -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def contexts(text: np.ndarray, ends: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor, key, context hash) of every context of the texts that ``text`` holds one after another up to ``ends``."""
    gram = gram_bytes(min_bytes)
    n, span = len(text), min_bytes - gram + 1
    none = np.zeros(0, np.int64)
    if n < min_bytes:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = gram_hashes(text, gram)
    low = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:  # the least of ever longer stretches, ties to the left
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    m = n - min_bytes + 1
    low = np.minimum(low[:m], low[span - size : span - size + m])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    crosses = np.zeros(m + 1, np.int32)  # windows that reach into the next text
    before = np.maximum(ends[:-1] - min_bytes + 1, np.concatenate(([0], ends[:-2])))
    np.add.at(crosses, np.minimum(before, m), 1)
    np.add.at(crosses, np.minimum(ends[:-1], m), -1)
    at = np.flatnonzero(np.cumsum(crosses[:m]) == 0)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[at][1:] != anchor[at][:-1]) | (np.diff(at) > 1))))
    first, last = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
    up, down = _powers(len(h))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[:-1])))
    whole = _mixed((sums[last + span] - sums[first]) * down[first] + (last - first).astype(np.uint64) * B)
    return first, last - first + 1, anchor[first], h[anchor[first]], whole


def _marks(min_bytes: int):
    names = ["rk", "th", "place", "key", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk, th, texts = (b.column(i) for i in range(3))
            rk, th = rk.to_numpy(), th.to_numpy()
            held, size = [], 0  # (row, offset in its text, bytes)

            def flush() -> pa.RecordBatch:
                parts = [np.frombuffer(p, np.uint8) for _, _, p in held]
                ends = np.cumsum([len(p) for p in parts])
                first, n, anchor, key, whole = contexts(np.concatenate(parts), ends, min_bytes)
                part = np.searchsorted(ends, first, "right")
                row = np.array([r for r, _, _ in held])[part]
                x = first - np.concatenate(([0], ends[:-1]))[part] + np.array([o for _, o, _ in held])[part]
                place = (x << 32) | (n << 16) | (anchor - first)
                return pa.RecordBatch.from_arrays([pa.array(v) for v in (rk[row], th[row], place, key.view(np.int64), whole.view(np.int64))], names=names)

            for r, t in enumerate(texts):
                data = memoryview(t.as_buffer())
                for o in range(0, len(data) - min_bytes + 1, SEGMENT):  # windows are dealt to segments by where they start
                    held.append((r, o, data[o : o + SEGMENT + min_bytes - 1]))
                    size += len(held[-1][2])
                    if size >= SEGMENT:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes (the text read in a circle) in order of their first ``depth`` bytes at least, by doubling; only those not yet told apart are sorted again."""
    n = len(text)
    v = np.resize(text, n + 8).astype(np.uint64)
    for s in (1, 2, 4):
        v = (v[:-s] << np.uint64(8 * s)) | v[s:]
    v = v[:n]
    order = np.argsort(v)
    v = v[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots, known = np.flatnonzero(~(new & np.concatenate((new[1:], [True])))), 8
    while known < depth and len(slots):
        at = order[slots]
        key = (rank[at] << 32) | rank[(at + known) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        known *= 2
    return order


def long_prefixes(text: np.ndarray, order: np.ndarray, bound: int, ends: int = 0) -> np.ndarray:
    """For each suffix in order: does it share its first ``bound`` bytes with the one before?

    Intervals of the order are extended backward by every byte that stands before them, all intervals of a length at once; an interval
    that ends where no common prefix is known sets it to the length, and only such intervals go on. ``ends``: how many END bytes there are by design;
    if there are no others, strings that begin with one need not be followed.
    """
    n = len(text)
    values, symbol = np.unique(text[order - 1], return_inverse=True)
    symbol = symbol.astype(np.uint8)
    starts = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=len(values)))))
    ahead = np.empty(n, np.int64)  # where the suffix one byte longer stands
    ahead[np.argsort(symbol, kind="stable")] = np.arange(n)
    # a wavelet matrix: zeros before each position, bit by bit
    bits, zeros, left = max(1, (len(values) - 1).bit_length()), [], symbol
    for b in range(bits - 1, -1, -1):
        one = (left >> b) & 1
        zeros.append(np.concatenate(([0], np.cumsum(1 - one))).astype(np.int32))
        left = np.concatenate((left[one == 0], left[one == 1]))
    base = np.zeros(len(values), np.int64)
    for z, b in zip(zeros, range(bits - 1, -1, -1), strict=True):
        base = np.where((np.arange(len(values)) >> b) & 1, z[n] + base - z[base], z[base])
    skip = (0, 0)
    if values[-1] == END and int((text == END).sum()) == ends:
        skip = (starts[-2], starts[-1])
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lo, hi = starts[:-1], starts[1:]
    unset[hi] = False
    for _ in range(1, bound):
        size = hi - lo
        one, two, more = size == 1, size == 2, size > 2
        x, y, z = ahead[lo[one]], ahead[lo[two]], ahead[lo[two] + 1]
        alike = symbol[lo[two]] == symbol[lo[two] + 1]
        l, h = lo[more].astype(np.int32), hi[more].astype(np.int32)
        c = np.zeros(len(l), np.int32)
        for zero in zeros:
            l0, h0 = zero[l], zero[h]
            l1, h1 = zero[n] + l - l0, zero[n] + h - h0
            k0, k1 = h0 > l0, h1 > l1
            l, h, c = np.concatenate((l0[k0], l1[k1])), np.concatenate((h0[k0], h1[k1])), np.concatenate((c[k0] << 1, (c[k1] << 1) | 1))
        shift = starts[c] - base[c]
        lo = np.concatenate((x, y, z[~alike], l + shift))
        hi = np.concatenate((x + 1, np.where(alike, z, y) + 1, z[~alike] + 1, h + shift))
        go = unset[hi] & ~((lo >= skip[0]) & (lo < skip[1]))
        lo, hi = lo[go], hi[go]
        unset[hi] = False
        if not len(lo):
            break
    return unset[:n]


def repeated_windows(parts: list[bytes], weights: np.ndarray, min_bytes: int) -> list[np.ndarray]:
    """For each part the starts of its windows that occur twice or more among all parts, each counted ``weights`` times."""
    text = np.frombuffer(b"".join(p + bytes([END]) for p in parts), np.uint8)
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    order = suffix_order(text, min_bytes)
    group = np.cumsum(~long_prefixes(text, order, min_bytes, len(parts)))
    part = np.repeat(np.arange(len(parts)), sizes)
    valid = np.arange(len(text)) <= (begin[1:] - 1 - min_bytes)[part]
    weight = np.bincount(group, np.where(valid, weights[part], 0)[order])
    again = np.zeros(len(text), bool)
    again[order] = weight[group] > 1
    again &= valid
    return [np.flatnonzero(again[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Joined ranges of bytes that windows of ``length`` cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate(([0], new + 1))], starts[np.concatenate((new, [len(starts) - 1]))] + length


def _compared(min_bytes: int):
    """Rows (key, ctx, w, bytes) sorted by key in, (key, ctx, s, e) of repeated ranges out, a block of whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows([h[3] for h in held], np.array([h[2] for h in held]), min_bytes)
            keys, ctxs, lo, hi = [], [], [], []
            for (key, ctx, _, _), starts in zip(held, found, strict=True):
                s, e = _spans(starts, min_bytes)
                keys += [key] * len(s)
                ctxs += [ctx] * len(s)
                lo.append(s)
                hi.append(e)
            cols = [np.array(keys, np.int64), np.array(ctxs, np.int64), np.concatenate(lo), np.concatenate(hi)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["key", "ctx", "s", "e"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return run


STATE = StructType([StructField(n, BinaryType() if n == "bytes" else LongType()) for n in ("key", "ctx", "w", "at", "lo", "hi", "okey", "octx", "shift", "bytes")])


def _cut(min_bytes: int):
    """Texts with the places of contexts in, contexts with their bytes out."""
    span = min_bytes - gram_bytes(min_bytes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                data = b.column("text")[r].as_buffer()
                rows = []
                for p in b.column("places")[r].as_py():
                    x, n, at = p["place"] >> 32, (p["place"] >> 16) & 0xFFFF, p["place"] & 0xFFFF
                    rows.append((p["key"], p["ctx"], p["w"], at, 1 - span, 0, p["key"], p["ctx"], 0, data[x : x + n + min_bytes - 1].to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f == "bytes" else pa.int64()) for c, f in zip(zip(*rows, strict=True), STATE.names, strict=True)], names=STATE.names)

    return run


def _halved(min_bytes: int):
    """Each context in two, one with the windows of the lower half of places around the anchor; keys are all bytes such windows share."""
    import xxhash

    def hashed(data: bytes, seed: int) -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(data, seed % 2**32)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, w, at, lo, hi, okey, octx, shift, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mid = (lo + hi) // 2
                for a, z in ((lo, mid), (mid + 1, hi)):
                    first, last = max(0, a + at), min(len(data) - min_bytes, z + at)
                    if first <= last:
                        part = data[first : last + min_bytes]
                        anchor = at - first
                        shared = part[anchor + z : anchor + a + min_bytes]
                        out.append((hashed(shared, a), hashed(part, len(part)), w, anchor, a, z, okey, octx, shift + first, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f == "bytes" else pa.int64()) for c, f in zip(zip(*out, strict=True), STATE.names, strict=True)], names=STATE.names)

    return run


def _bounded(df: DataFrame, weight: Column, name: str) -> DataFrame:
    """``df`` written, and marked for broadcast if it holds at most BROADCAST entries; past that it is joined by a shuffle, with the same rows."""
    kept = materialize(df, name)
    out = F.broadcast(kept) if (kept.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST else kept
    out._corvane_path = kept._corvane_path
    return out


def repeated_ranges(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, max_contexts: int = CONTEXTS) -> DataFrame:
    """(rk, th, spans): for rows of ``docs``, named by hashes of id and text, the maximal ranges of bytes that repeated windows cover."""
    named = docs.select(*_names(docs, doc_id, text), F.col(text).cast("string").cast("binary").alias("text"))
    rows = named.where(F.octet_length("text") >= min_bytes)
    marks = materialize(rows.mapInArrow(_marks(min_bytes), "rk bigint, th bigint, place bigint, key bigint, ctx bigint"), "suffix-marks")
    keys = marks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("z")).where("n > 1")
    keys = _bounded(keys.select("key", (F.col("a") != F.col("z")).alias("mixed")), F.lit(1), "suffix-keys")
    hits = materialize(marks.join(keys, "key"), "suffix-hits")
    release(marks)
    release(keys)
    # one place of each context that has others under its key
    mixed = hits.where("mixed").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("rk", "th", "place")).alias("p"))
    places = mixed.groupBy("p.rk", "p.th").agg(F.collect_list(F.struct("p.place", "key", "ctx", "w")).alias("places"))
    places = _bounded(places, F.size("places"), "suffix-places")
    cut = rows.join(places, ["rk", "th"]).select("text", "places").mapInArrow(_cut(min_bytes), STATE)
    if not rows.groupBy("rk", "th").count().where("count > 1").isEmpty():  # repeated rows give each context again
        cut = cut.dropDuplicates(["key", "ctx"])
    state = materialize(cut, "suffix-contexts")
    release(places)
    found = []
    while True:
        one = state.groupBy("key", "ctx").agg(F.sum("w").alias("w"), F.any_value("bytes").alias("bytes")) if found else state.select("key", "ctx", "w", "bytes")
        sizes = one.groupBy("key").agg(F.count(F.lit(1)).alias("n")) if not found else state.select("key", "ctx").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(sizes.where(F.col("n") > max_contexts).select("key"), "suffix-large-keys")
        deeper = not large.isEmpty()
        if deeper:
            one = one.join(large, "key", "left_anti")
        here = one.repartition("key").sortWithinPartitions("key").select("key", "ctx", "w", "bytes").mapInArrow(_compared(min_bytes), "key bigint, ctx bigint, s bigint, e bigint")
        if found:
            here = here.join(state.select("key", "ctx", "okey", "octx", "shift"), ["key", "ctx"]).select(F.col("okey").alias("key"), F.col("octx").alias("ctx"), (F.col("s") + F.col("shift")).alias("s"), (F.col("e") + F.col("shift")).alias("e"))
        found.append(materialize(here, "suffix-ranges"))
        if not deeper:
            break
        last, state = state, materialize(state.join(large, "key", "left_semi").select(*STATE.names).mapInArrow(_halved(min_bytes), STATE), "suffix-halves")
        release(last)
        release(large)
    release(state)
    x, n = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(0xFFFF)
    lone = hits.where("NOT mixed").select("rk", "th", x.alias("s"), (x + n + (min_bytes - 1)).alias("e"))
    compared = hits.where("mixed").join(reduce(DataFrame.unionByName, found), ["key", "ctx"]).select("rk", "th", (x + F.col("s")).alias("s"), (x + F.col("e")).alias("e"))
    gathered = lone.unionByName(compared).groupBy("rk", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    out = _bounded(gathered.mapInArrow(_joined, gathered.schema), F.size("spans"), "suffix-spans")
    for df in [hits, *found]:
        release(df)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's ranges, joined where they meet."""
    for b in batches:
        out = []
        for spans in b.column("spans"):
            ranges: list[dict] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans.as_py()):
                if ranges and s <= ranges[-1]["e"]:
                    ranges[-1]["e"] = max(ranges[-1]["e"], e)
                else:
                    ranges.append({"s": s, "e": e})
            out.append(ranges)
        yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("th"), pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["rk", "th", "spans"])


def _names(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    whole = F.col(text).cast("string")
    return [F.xxhash64(F.col(doc_id).cast("string"), whole).alias("rk"), F.xxhash64(whole).alias("th")]


FIELDS = [
    StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()),
    StructField("removed", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField("kept", BinaryType()),
]


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, keep: list[str] | None = None,
    detail: bool = False, max_contexts: int = CONTEXTS,
) -> DataFrame:
    """The columns ``keep`` (by default all), then n_bytes of the text as UTF-8, n_removed, n_spans (maximal removed ranges) and kept_sha256 of the
    bytes that stay; with ``detail`` also ``removed`` (the ranges) and ``kept`` (the bytes; a range can end inside a character).

    A null or empty text has no bytes and a digest of nothing; texts under ``min_bytes`` lose nothing. Both places of a repeat lose it, the
    first too; overlaps count; repeated rows are copies of each other. Ids may be of any type, null or repeated. A text of any length is
    hashed in segments. An empty table gives no rows; names in ``docs`` that clash with those added are refused.
    """
    kept_columns = docs.columns if keep is None else keep
    fields = FIELDS if detail else FIELDS[:4]
    clash = {f.name for f in FIELDS} & set(kept_columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added here; rename or leave them out with keep")
    if min_bytes < 16:
        raise ValueError("min_bytes is at least 16")
    spans = repeated_ranges(docs, doc_id=doc_id, text=text, min_bytes=min_bytes, max_contexts=max_contexts)
    rk, th = _names(docs, doc_id, text)
    numbered = [F.col(c).alias(f"c{i}") for i, c in enumerate(kept_columns)]
    rows = docs.select(*numbered, F.col(text).cast("string").cast("binary").alias("text"), rk, th)
    joined = rows.join(spans, ["rk", "th"], "left").select(*[f"c{i}" for i in range(len(numbered))], "text", "spans")
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in kept_columns), *fields])
    width = len(kept_columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column("text"), b.column("spans"), strict=True):
                data = t.as_py() or b""
                removed = [(x["s"], x["e"]) for x in found.as_py() or ()]
                stay = b"".join(data[a:z] for a, z in zip([0, *(e for _, e in removed)], [*(s for s, _ in removed), len(data)], strict=True))
                out.append((len(data), len(data) - len(stay), len(removed), sha256(stay).hexdigest(), [{"start": s, "end": e} for s, e in removed], stay)[: len(fields)])
            ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), ranges, pa.binary()][: len(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(fields), types, strict=True))], names=schema.names)

    return joined.mapInArrow(cut, schema)

"""Benchmark decontamination: test windows found in training texts, by DataFrame functions only.

A benchmark item's windows are WINDOW consecutive words (an item of fewer words is one window). Any
occurrence of a window of L words covers a whole block of k = (L + 1) // 2 words that starts at a
multiple of k in the text. So each text is cut into such blocks once, where it lies, and their
hashes are looked up in the hash set of all k-word runs of the benchmark: a semi-join by one number,
broadcast while the set is counted to be small, shuffled beyond; the way is the same at every size. Only texts with a hit block
are looked at closer: the windows around their hit blocks are built, verified by their
words against the benchmark, and numbered by item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, release, same, sized

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that is not lower-cased yet, and what separates such words.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Numbers in a hash set that may be broadcast: some 40 bytes each with its slot, so 40 MB at most.
MAX_BROADCAST = 1_000_000


def raw_words(text: Column) -> Column:
    """The words as they are written."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), RAW_SEPARATOR), "")


def _low(word: Column) -> Column:
    """``lower_ascii`` of a word; words of ASCII alone, most of them, take the faster function."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(lower_ascii(word))


def words_of(text: Column) -> Column:
    return F.transform(raw_words(text), _low)


def block_size(window: int) -> int:
    """Every run of ``window`` words holds a whole aligned block of so many."""
    return (window + 1) // 2


def _run_hash(words: Column, start: Column, k: int) -> Column:
    """Hash of k raw words from ``start`` (0-based). Words equal but for A-Z give equal hashes, which is all that is needed here."""
    return F.xxhash64(F.lit(k), F.lower(F.array_join(F.slice(words, start + 1, F.lit(k)), " ")))


def benchmark_windows(bench: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, len, gram) of all items; gram is the window's words, space-joined."""
    items = bench.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return items.select("item_id", n.alias("len"), F.explode(grams).alias("gram")).distinct()


def benchmark_runs(bench: DataFrame, *, text: str = "text") -> DataFrame:
    """The hash set: distinct h of all runs of block_size(len) words of the benchmark's windows."""
    items = bench.select(raw_words(F.col(text)).alias("w")).withColumn("n", F.least(F.size("w"), F.lit(WINDOW))).where("n > 0")
    runs = reduce(
        lambda c, n: c.when(F.col("n") == n, F.transform(F.sequence(F.lit(0), F.size("w") - block_size(n)), lambda i: _run_hash(F.col("w"), i, block_size(n)))),
        range(2, WINDOW + 1),
        F.when(F.col("n") == 1, F.transform("w", lambda w: F.xxhash64(F.lit(1), F.lower(w)))),
    )
    return items.select(F.explode(runs).alias("h")).distinct()


def _covered(spans: Column) -> Column:
    """Union of sorted spans: array<struct<a, b>>, disjoint, b exclusive."""
    zero = F.array().cast("array<struct<a:int,b:int>>")

    span = lambda a, b: F.array(F.named_struct(F.lit("a"), a, F.lit("b"), b))

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), span(last.a, F.greatest(last.b, s.pos + s.len)))
        new = F.concat(acc, span(s.pos, s.pos + s.len))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).b >= s.pos), joined).otherwise(new)

    return F.aggregate(spans, zero, add)


def find_hits(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), n_words, spans, item_ids, n_hit, contaminated.

    spans: array<struct<a, b>>, the union of all occurrences in word positions; item_ids: sorted
    array<string> of items with occurring windows. A document is contaminated if it has a hit word and
    20 * n_hit >= n_words. Null or empty texts and items have no words; repeated rows give a row each;
    a null doc_id or item_id is kept as null (and not listed); a very long text is one row of its blocks' hashes; extra columns are
    ignored; an empty benchmark hits nothing.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    wins = materialize(benchmark_windows(bench), "benchmark-windows")
    lens = sorted(r["len"] for r in wins.select("len").distinct().collect())  # WINDOW at most
    ks = sorted({block_size(n) for n in lens})
    runs = sized(benchmark_runs(bench), "benchmark-runs", max_broadcast)

    # one row for the document itself (k 0, at the number of its words) and one for each of its blocks
    entry = lambda k, at, h: F.struct(F.lit(k).alias("k"), at.alias("at"), h.alias("h"))
    own = F.array(entry(0, F.size("w"), F.xxhash64("doc_id", "th")))  # spread, should the set be too large to broadcast
    starts = lambda k: F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k, F.lit(k))).otherwise(F.array().cast("array<int>"))
    blocks_of = lambda k: F.transform(starts(k), lambda i: entry(k, i, _run_hash(F.col("w"), i, k)))
    cut = docs.select("doc_id", F.xxhash64("text").alias("th"), raw_words(F.col("text")).alias("w"))
    cut = cut.select("doc_id", "th", F.explode(F.concat(own, *map(blocks_of, ks))).alias("b")).select("doc_id", "th", "b.*")
    # a document's own row stays; blocks stay only if the benchmark has them
    met = cut.join(runs.select("h", F.lit(True).alias("hit")), "h", "left").where("k = 0 OR hit").select("doc_id", "th", "k", "at")
    met = materialize(met, "benchmark-blocks")
    own = met.where("k = 0").select("doc_id", "th", F.col("at").cast("bigint").alias("n_words"))

    hit = sized(met.where("k > 0").groupBy("doc_id", "th").agg(F.collect_set(F.struct("k", "at")).alias("near")), "benchmark-near")
    keyed = docs.withColumn("th", F.xxhash64("text"))
    close = same(keyed, hit, ["doc_id", "th"], "inner").select("doc_id", "th", words_of(F.col("text")).alias("w"), "near")
    # a window of n words that covers the block at b starts at most n - k before it
    each = lambda n: F.array_distinct(
        F.flatten(
            F.transform(
                F.filter("near", lambda x: x.k == block_size(n)),
                lambda x: F.when(F.size("w") >= n, F.sequence(F.greatest(x["at"] - (n - block_size(n)), F.lit(0)), F.least(x["at"], F.size("w") - n))).otherwise(F.array().cast("array<int>")),
            )
        )
    )
    some = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    windows_of = lambda n: F.transform(each(n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice("w", i + 1, F.lit(n)), " ").alias("gram")))
    found = close.select("doc_id", "th", F.explode(F.concat(some, *map(windows_of, lens))).alias("f")).select("doc_id", "th", "f.*").join(wins.select("item_id", "gram"), "gram")
    found = found.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("at"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    hits = materialize(found.select("doc_id", "th", _covered(F.col("at")).alias("spans"), "item_ids"), "benchmark-hits")
    release(hit), release(runs), release(wins)
    out = same(own, hits, ["doc_id", "th"], "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + (x.b - x.a))
    return out.select("doc_id", "th", "n_words", "spans", "item_ids", n_hit.alias("n_hit")).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, mode: str = "documents", doc_id: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """``docs`` without contaminated documents, or (mode "spans") without the hit words of any document.

    Columns are unchanged. A removed span takes the separators after its words along. Rows are matched by
    doc_id and text, so rows that share a doc_id are judged each by its own text.
    """
    hits = find_hits(docs, bench, doc_id=doc_id, text=text, **bounds)
    keyed = docs.withColumn("__d", F.col(doc_id)).withColumn("__t", F.xxhash64(F.col(text).cast("string")))
    keys = [F.col("doc_id").alias("__d"), F.col("th").alias("__t")]
    if mode == "documents":
        gone = sized(hits.where("contaminated").select(*keys).distinct(), "contaminated")
        return same(keyed, gone, ["__d", "__t"], "left_anti").drop("__d", "__t")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    cut = hits.where("n_hit > 0").select(*keys, "spans").dropDuplicates(["__d", "__t"])
    joined = same(keyed, cut.withColumnRenamed("spans", "__spans"), ["__d", "__t"], "left")
    whole = F.col(text).cast("string")
    parts = joined.withColumn("__w", F.regexp_extract_all(whole, F.lit(RAW_WORD), 0)).withColumn("__s", F.split(whole, RAW_WORD))
    pieces = F.zip_with("__w", F.slice("__s", F.lit(2), F.size("__w")), lambda w, s: F.concat(w, s))
    start = lambda k: F.coalesce(F.get("__spans", k - 1).b, F.lit(0))
    stop = lambda k: F.coalesce(F.get("__spans", k).a, F.size("__w"))
    kept = F.transform(F.sequence(F.lit(0), F.size("__spans")), lambda k: F.array_join(F.slice(pieces, start(k) + 1, stop(k) - start(k)), ""))
    clean = F.when(F.col("__spans").isNull(), whole).otherwise(F.concat(F.element_at("__s", 1), F.array_join(kept, "")))
    return parts.withColumn(text, clean).select(*docs.columns)

"""Line deduplication over a corpus by a deletion-neighbourhood join.

A line's form is its words joined by single spaces. A line goes if an earlier line (by document, then
line number) has the same form, or a form within one edit of it: one word changed, added or left out,
for lines of MIN_EDIT_WORDS words or more (so 0.8 of the longer line agrees). Whether the
earlier line goes itself does not matter, so no chain has to be followed.

Exact copies fall together by hash. For the rest, every line emits as keys the hashes of all
variants with one word deleted, and of itself. Lines that share a variant deleted at one place differ in that
word at most; a line equal to another's variant lacks one word of it. Each key keeps its earliest
line, so a key of any size yields one row per member, never pairs. Each pair (line, earliest) is
verified on its words. A line only emits variants if its first or last half occurs in another
line: two lines within one edit always share a half, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, materialize

MIN_EDIT_WORDS = 5
SPACES = r"[\x20\x09-\x0D]+"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def variant_hashes(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Hash of a line and of each of its variants with one word deleted, from 64-bit word hashes.

    The hash is the polynomial sum of h[i] * BASE**i modulo 2**64, so all variants come from prefix sums.
    """
    with np.errstate(over="ignore"):
        terms = words * _powers(BASE, len(words))[:-1]
        before = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
        variants = before[:-1] + (before[-1] - before[1:]) * np.uint64(INVERSE)
    return int(before[-1].astype(np.int64)), variants.astype(np.int64)


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """At most one word changed, added or left out, and the longer line has MIN_EDIT_WORDS words."""
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < MIN_EDIT_WORDS:
        return False
    short = min(len(a), len(b))
    p = 0
    while p < short and a[p] == b[p]:
        p += 1
    s = 0
    while s < short - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of whole texts, with their forms."""
    for b in batches:
        rows = []
        for doc, th, text, want in zip(*(b.column(c).to_pylist() for c in ("doc", "th", "text", "want")), strict=True):
            lines = text.split("\n")
            rows += [(doc, th, w["line"], w["a"], w["b"], b" ".join(lines[w["line"]].encode().split()).decode()) for w in want]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (b.schema.field("doc").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "th", "line", "a", "b", "form"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, line, key, place) of the variants with one of the words a..b-1 deleted, and (place -1) of the line itself."""
    import xxhash

    for b in batches:
        keys, places, rows = [], [], []
        for r, (form, lo, hi) in enumerate(zip(*(b.column(c).to_pylist() for c in ("form", "a", "b")), strict=True)):
            h = np.array([xxhash.xxh64_intdigest(w) for w in form.encode().split(b" ")], np.uint64)
            lo, hi = (lo, hi) if len(h) >= MIN_EDIT_WORDS else (0, 0)  # a shorter line only meets longer ones, by itself
            whole, variants = variant_hashes(h)
            keys.append(np.concatenate(([whole], variants[lo:hi])))
            places.append(np.concatenate(([-1], np.arange(lo, min(hi, len(h))))))
            rows.append(np.full(len(keys[-1]), r))
        if rows:
            at = pa.array(np.concatenate(rows))
            arrays = [b.column(c).take(at) for c in ("doc", "th", "line")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int32))], names=["doc", "th", "line", "key", "place"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(b.column("form").to_pylist(), b.column("other").to_pylist(), strict=True)]
        yield b.select(["doc", "th", "line"]).filter(pa.array(ok, pa.bool_()))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, th, line, two hashes of the form, and the halves of every line that holds a word.

    halves: array<struct<h, a, b>>, hash of a first or last half and the places where an edit may be if it is shared.
    """
    lines = docs.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.select("doc", "th", "line", F.filter(F.split("raw", SPACES), lambda w: w != "").alias("ws")).where(F.size("ws") > 0)
    n = F.size("ws")
    part = lambda name, words, a, b: F.struct(F.xxhash64(F.lit(name), words).alias("h"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    head = lambda k: part("head", F.slice("ws", F.lit(1), k), k, n)
    tail = lambda k: part("tail", F.slice("ws", n - k + 1, k), F.lit(0), n - k)
    # a line of n words meets one of n words at its halves, one of n - 1 at the halves of n - 1, and one of n + 1 at its own
    lower, upper = F.expr("int(floor(size(ws) / 2))"), F.expr("int(ceil(size(ws) / 2))")
    other = F.when(n % 2 == 0, head(lower - 1)).otherwise(tail(lower))
    halves = F.when(n >= MIN_EDIT_WORDS - 1, F.array(head(lower), tail(upper), other)).otherwise(F.array().cast("array<struct<h:bigint,a:int,b:int>>"))
    form = F.array_join("ws", " ")
    return lines.select("doc", "th", "line", F.xxhash64(form).alias("h1"), F.hash(form).alias("h2"), halves.alias("halves"))


def _with_lists(docs: DataFrame, rows: DataFrame, value: Column, name: str, how: str) -> DataFrame:
    """``docs`` joined to what ``rows`` lists for each (doc, th); a list is no longer than its text."""
    lists = rows.groupBy("doc", "th").agg(F.collect_set(value).alias(name))
    return docs.join(lists, ["doc", "th"], how)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.col(text).cast("string")
    if id_type(docs, doc_id) == "bigint":
        doc = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(2**63)))
    else:  # a mark before the text keeps the order and leaves one key below all for null
        doc = F.coalesce(F.concat(F.lit("1"), F.col(doc_id).cast("string")), F.lit("0"))
    return docs.withColumns({"doc": doc, "th": F.xxhash64(whole), "text": whole})


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edits: int = 1) -> DataFrame:
    """doc, th, line: the lines (numbered from 0) that go.

    ``edits``, 0 or 1, is the bound: how many words of an earlier line may differ. (Two would take a number of variants that grows
    with the square of a line's words.)

    ``th``, a hash of the text, names a document together with its id: rows equal in both are one
    document and lose nothing because of each other; rows that share only the id are ordered by th. A
    null id stands for the least one; ids may be text, ordered by code point (``doc`` is then "1" and the id, "0" for null). Null texts have no lines; lines without words always stay.
    """
    if edits not in (0, 1):
        raise ValueError(f"edits is 0 or 1, not {edits}")
    docs = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").select("doc", "th", "text")
    kind = docs.schema["doc"].dataType.simpleString()
    lines = materialize(_lines(docs), "line-hashes")
    here = F.struct("doc", "th", "line")
    firsts = lines.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n"), F.first("halves").alias("halves"))
    firsts = materialize(firsts, "line-firsts")
    many = firsts.where("n > 1").select("h1", "h2", "first")
    copies = lines.join(many, ["h1", "h2"]).where(here != F.col("first")).select("doc", "th", "line")

    if edits == 0:
        return copies.distinct()
    halves = firsts.select("first", F.explode("halves").alias("x")).select("first", "x.*")
    shared = halves.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    near = halves.join(shared, "h").groupBy("first").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("first.*", "a", "b")
    held = _with_lists(docs, near, F.struct("line", "a", "b"), "want", "inner")
    cand = held.mapInArrow(_pick, f"doc {kind}, th bigint, line int, a int, b int, form string")
    cand = materialize(cand, "line-candidates")

    variants = cand.mapInArrow(_emit, f"doc {kind}, th bigint, line int, key bigint, place int")
    earliest = materialize(variants.groupBy("key", "place").agg(F.min(here).alias("lo"), F.count(F.lit(1)).alias("n")), "line-variants")
    # one place: all members are within one edit of the earliest
    at_place = earliest.where("place >= 0 AND n > 1").select("key", "place", F.col("lo").alias("other"))
    pairs = variants.join(at_place, ["key", "place"]).select(here.alias("me"), "other")
    # a line and those that have one word more
    whole = earliest.where("place < 0").select("key", F.col("lo").alias("whole"))
    longer = earliest.where("place >= 0").join(whole, "key")
    fewer = longer.groupBy("key").agg(F.min("lo").alias("other"), F.first("whole").alias("me")).select("me", "other")
    more = variants.where("place >= 0").join(longer.select("key", "place", F.col("whole").alias("other")), ["key", "place"]).select(here.alias("me"), "other")
    pairs = pairs.unionByName(fewer).unionByName(more).where("other < me").groupBy("me").agg(F.min("other").alias("other"))
    forms = cand.select(here.alias("me"), "form")
    checked = pairs.join(forms, "me").join(forms.select(F.col("me").alias("other"), F.col("form").alias("other_form")), "other")
    close = checked.select("me.*", "form", F.col("other_form").alias("other")).mapInArrow(_verify, f"doc {kind}, th bigint, line int")
    return copies.unionByName(close).distinct()


def _cut(text: pd.Series, lines: pd.Series) -> pd.DataFrame:
    rows = []
    for t, gone in zip(text, lines, strict=True):
        if t is None:
            rows.append((None, 0, 0, False))
            continue
        parts = t.split("\n")
        drop = set() if gone is None else set(int(x) for x in gone)
        kept = [x for i, x in enumerate(parts) if i not in drop]
        rows.append(("\n".join(kept), len(parts), len(drop), bool(drop) and not any(x.encode().split() for x in kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "emptied"])


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", detail: bool = False, edits: int = 1) -> DataFrame:
    """``docs`` with the text of what is left; ``detail`` adds n_lines, n_removed and emptied.

    emptied: the document had words and all went. Extra columns stay, whatever their names (with ``detail`` those
    three are refused); an empty table gives an empty result; a very long text is cut where it lies.
    """
    if detail and {"n_lines", "n_removed", "emptied"} & set(docs.columns):
        raise ValueError("docs has a column n_lines, n_removed or emptied")
    gone = removed_lines(docs, doc_id=doc_id, text=text, edits=edits)
    keyed = docs.select(*[F.col(c).alias(f"c_{c}") for c in docs.columns])
    keyed = _keyed(keyed, f"c_{doc_id}", f"c_{text}")
    cut_lines = F.pandas_udf(_cut, "text string, n_lines bigint, n_removed bigint, emptied boolean")
    cut = _with_lists(keyed, gone, F.col("line"), "gone", "left").withColumn("cut", cut_lines("text", "gone"))
    out = [F.col("cut.text").alias(c) if c == text else F.col(f"c_{c}").alias(c) for c in docs.columns]
    return cut.select(*out, *([F.col(f"cut.{c}").alias(c) for c in ("n_lines", "n_removed", "emptied")] if detail else []))

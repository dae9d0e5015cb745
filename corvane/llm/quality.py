"""Quality rules judged by host.

Rule failures of single documents are summed by host, each host's failure rates are shrunk to a beta
prior fitted to all hosts, and a host whose shrunk rate of any rule is too high loses all its
documents. Every statistic covers the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, materialize, same, sized

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules on one document, as SQL over STATS and n_lines; the first is the base rule.
RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    windows = [joined[a:b] for a, b in zip(starts[: len(words) - WINDOW + 1].tolist(), ends[WINDOW - 1 :].tolist(), strict=True)]
    if len(set(windows)) == len(windows):
        return 0
    first: dict[bytes, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            for at in (i, j):
                hit[at] += 1
                hit[min(at + WINDOW, len(words))] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """STATS and the number of lines that hold a word."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(b"".join(words).decode()),
        sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = (*STATS, "n_lines")
    for b in batches:
        rows = [text_stats(t.as_py()) for t in b.column("text")]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("host"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "host", *names]
        )


def document_stats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, STATS and n_lines of every whole text; null text has no words. Ids may be text."""
    kind = id_type(docs, doc_id)
    rows = docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_stats, f"doc_id {kind}, host string, " + ", ".join(f"{c} bigint" for c in (*STATS, "n_lines")))


def host_verdicts(stats: DataFrame, *, max_rate: float = 0.5) -> DataFrame:
    """One row per host: host, n_docs, <rule>_rate (shrunk) and host_ok.

    The prior's mean m and strength s come from the moments of the hosts' rates: s = m(1-m)/var - 1,
    held between 1 and 1e6 (1 for a single host). Only the one-row table of moments is broadcast.
    """
    fails = stats.select("host", *[F.expr(sql).cast("bigint").alias(f"{r}_f") for r, sql in RULES.items()])
    hosts = fails.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(f"{r}_f").alias(f"{r}_f") for r in RULES])
    rate = lambda r: F.col(f"{r}_f") / F.col("n_docs")
    moments = hosts.agg(*[f(rate(r)).alias(f"{r}_{n}") for r in RULES for n, f in (("m", F.avg), ("v", F.var_pop))])
    out = hosts.withColumn("one", F.lit(1)).join(F.broadcast(moments.withColumn("one", F.lit(1))), "one")
    shrunk = {}
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.coalesce(F.col(f"{r}_v"), F.lit(0.0))
        strength = F.when(v <= 0, 1.0).otherwise(F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1e6)))
        shrunk[r] = (F.col(f"{r}_f") + m * strength) / (F.col("n_docs") + strength)
    return out.select("host", "n_docs", *[c.alias(f"{r}_rate") for r, c in shrunk.items()]).withColumn(
        "host_ok", F.greatest(F.lit(0.0), *[F.col(f"{r}_rate") for r in RULES]) <= max_rate
    )


def judge(docs: DataFrame, *, max_rate: float = 0.5, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, STATS, n_lines, base_failed, host_ok and kept of every row of ``docs``.

    A null host is a host of its own; repeated rows are judged (and counted) each; a very long text is counted whole, in time linear in its length; extra columns are
    ignored; an empty table gives an empty result. The statistics are written once to shared storage,
    as hosts and documents both read them. A hot host is summed map-side and its share of the join is
    split by adaptive execution.
    """
    stats = materialize(document_stats(docs, doc_id=doc_id, text=text, host=host), "quality-stats")
    verdicts = host_verdicts(stats, max_rate=max_rate).select("host", "host_ok")
    failed = F.expr(RULES["base"])
    return same(stats, verdicts, ["host"], "inner").select(
        "doc_id", *STATS, "n_lines", "host", failed.alias("base_failed"), "host_ok", (~failed & F.col("host_ok")).alias("kept")
    )


def _stats_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in text], columns=[*STATS, "n_lines"])


def keep_good(docs: DataFrame, *, max_rate: float = 0.5, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; columns unchanged.

    Every text is counted once: rows are written with their statistics (the columns of those that fail the base rule as nulls), hosts
    are judged on the written statistics, and what was written is read without the rejected rows. Only rejected hosts are
    joined, so texts move only if these are counted to be too many to broadcast.
    """
    stats_of = F.pandas_udf(_stats_of, ", ".join(f"{c} bigint" for c in (*STATS, "n_lines")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).cast("string").alias("host"), stats_of(F.col(text).cast("string")).alias("s"))
    failed = F.expr(re.sub(r"\b(n_words|n_repeat_words)\b", r"s.\1", RULES["base"]))
    rows = materialize(rows.select(F.when(~failed, F.col("row")).alias("row"), "host", "s"), "quality-rows")
    verdicts = host_verdicts(rows.select("host", "s.*"), max_rate=max_rate)
    bad = sized(verdicts.where(~F.col("host_ok")).select("host"), "quality-hosts")
    return same(rows.where("row IS NOT NULL").select("row", "host"), bad, ["host"], "left_anti").select("row.*")

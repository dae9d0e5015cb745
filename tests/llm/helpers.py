"""Awkward inputs that every operator takes."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
GOOD = "The quick brown fox jumps over the lazy dog while seven quiet people watch from the old stone bridge near town tonight.\nSecond line of it here."
#: Columns whose names operators may use inside.
CLASH = ("th", "doc", "line", "fp", "h", "n", "w", "spans", "before", "rank", "gone", "cut", "key", "host", "mask", "top", "conv", "t", "ts", "at")


def awkward(spark, extra: bool = True):
    rows = [
        (1, GOOD, "en", "a", 1), (2, GOOD, "en", "a", 1), (2, GOOD, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", None, 3),
        (6, LONG, "en", "c", 9), (None, "no id but some words here", "de", "c", 1), (7, "émile ÉTÉ 日本語 ?", "fr", "日", 1), (8, "one\n\n\ntwo", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in CLASH:
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, tmp_path, name, df) -> str:
    """Writes ``df`` as a table of a data folder; returns the folder."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)

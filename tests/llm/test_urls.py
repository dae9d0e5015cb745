from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.llm import urls


def test_as_of_intervals(spark):
    entries = spark.sql("""SELECT kind, pattern, action, CAST(at AS TIMESTAMP) AS at FROM VALUES ('domain', 'bad.org', 'add', '2024-01-02'), ('domain', 'bad.org', 'remove', '2024-01-04'), ('domain', 'bad.org', 'add', '2024-01-06'),
      ('host', 'x.com', 'add', '2024-01-01'), ('host', 'x.com', 'remove', '2024-01-01'), ('prefix', 'Y.com/a/b/', 'add', '2024-01-01'), ('host', NULL, 'add', '2024-01-01') AS t(kind, pattern, action, at)""")
    cases = [
        ("http://www.BAD.org/x", "2024-01-01", None), ("http://www.bad.org:80/x", "2024-01-02", "d:bad.org"), ("https://u:p@bad.org", "2024-01-04", None), ("http://bad.org", "2025-01-01", "d:bad.org"),
        ("http://notbad.org", "2025-01-01", None), ("http://x.com/", "2024-01-01", None), ("http://y.com/a/b/c?q", "2024-01-01", "p:y.com/a/b"), ("http://y.com/a/bc", "2024-01-01", None),
        ("nonsense", "2024-01-01", None), (None, "2024-01-01", None), ("http://bad.org", None, None), ("", "2024-01-03", None),
    ]
    df = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)], "i int, url string, t string").selectExpr("i", "url", "CAST(t AS TIMESTAMP) AS fetched_at", "1 AS key", "2 AS at", "3 AS valid_to")
    for bound in (0, 100):
        got = {r.i: r for r in urls.filter_urls(df, entries, broadcast_rows=bound).collect()}
        assert len(got) == len(cases)
        for i, (_, _, key) in enumerate(cases):
            assert got[i].matched == ([key] if key else []) and got[i].blocked == bool(key)
    assert urls.filter_urls(df.unionByName(df), entries).count() == 2 * len(cases)
    assert urls.filter_urls(df.limit(0), entries).count() == 0 and urls.filter_urls(df, entries.limit(0)).where("blocked").count() == 0


def test_clashes_kinds_and_long_addresses(spark):
    entries = spark.sql("SELECT kind, pattern, 'add' AS action, TIMESTAMP '2024-01-01' AS at FROM VALUES ('domain', 'a.b.org'), ('host', 'x.com'), ('hosts', 'y.com'), ('dom', 'z.com') AS t(kind, pattern)")
    long = "http://" + "s." * 60 + "a.b.org/" + "p/" * 50_000
    df = spark.createDataFrame([(u,) for u in (long, "http://y.com", "http://z.com", "http://x.com", "http://b.org")], "url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    got = {r.url: r.matched for r in urls.filter_urls(df, entries).collect()}
    assert got == {long: ["d:a.b.org"], "http://y.com": [], "http://z.com": [], "http://x.com": ["h:x.com"], "http://b.org": []}
    for name in ("blocked", "matched"):
        with pytest.raises(ValueError):
            urls.filter_urls(df.withColumn(name, F.lit(1)), entries)

"""Job state: the stream, stopped and started again from its checkpoint, against the table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.streaming import jobs

WEIGHTS = {"news": 3.0, "social": 2.0, "scores": 5.0}
EVENTS = "job_id string, ts timestamp, seq bigint, event string, stage string, progress double, message string"
T0 = datetime(2024, 1, 1, 10)


def made(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for j in range(30):
        at = T0 + timedelta(seconds=r.randrange(6000))
        steps = [("queued", None, None), ("running", None, None)]
        steps += [(r.choice(list(jobs.STAGE_STATES)), r.choice([*WEIGHTS, "other"]), r.choice([None, -1.0, 0.2, 0.5, 3.0])) for _ in range(r.randrange(12))]
        if j % 4:
            steps += [(r.choice(jobs.FINISHED), None, None)]
            steps += [("stage_progress", "news", 0.7)] * (j % 3)  # events after the end, in time or too late
        if j % 7 == 0:
            steps = [("running", None, None), *steps]  # one that comes before the job
        for k, (event, stage, p) in enumerate(steps):
            at += timedelta(seconds=r.choice([0, 5, 60, 400, 1000]))
            out.append((f"job-{j}", at, len(out), event, stage, p, None if k % 5 == 4 else f"m{len(out)}"))
    return sorted(out, key=lambda e: (e[1], e[2]))


def test_stream_equals_table(spark, tmp_path):
    events = made()
    end = datetime(2024, 1, 1, 10) + timedelta(days=1)
    events.append(("tick", end, 10**6, "queued", None, None, None))  # moves the watermark past every timeout
    cuts = [0, len(events) // 3, 2 * len(events) // 3, len(events) - 1, len(events)]

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    for lo, hi in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(events[lo:hi], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        q = jobs.job_stream(stream, WEIGHTS, most=4).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    table = spark.createDataFrame(events, EVENTS)
    shown = lambda r: (r.status, pytest.approx(r.percent), r.active_stage, list(r.messages))
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.job_id] = r
    every = {r.job_id: r for r in jobs.job_snapshots(table, F.lit(end), WEIGHTS, ttl_seconds=900, most=4).collect()}
    running = {j for j, r in last.items() if r.held}
    assert set(every) == running and len(running) > 5
    for j in running:
        assert shown(last[j]) == shown(every[j])
    gone = {r.job_id: r for r in rows if not r.held}
    finished = {e[0] for e in events if e[3] in jobs.FINISHED}
    assert set(gone) == finished and len(finished) > 10 and sum(not r.held for r in rows) == len(gone)
    for j in finished:  # what leaves is the job as the table showed it just before it left
        at = F.timestamp_micros(F.lit(gone[j].updated_us))
        mine = table.where((F.col("job_id") == j) & (F.col("ts") <= at))
        assert shown(jobs.job_snapshots(mine, at, WEIGHTS, most=4).first()) == shown(gone[j])


def test_no_events(spark):
    assert jobs.job_snapshots(spark.createDataFrame([], EVENTS), F.lit(T0), WEIGHTS).count() == 0
    assert jobs.advance(None, iter([(0, "running", None, None, "m")]), list(WEIGHTS), 10, 4) is None

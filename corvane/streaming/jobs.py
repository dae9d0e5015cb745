"""Jobs and their progress from events, as a table at a moment and as a stream with state.

Events: job_id, ts, seq (order among equal times), event, stage, progress, message. A job begins with ``queued``; what comes
before is not counted, nor what comes more than ``ttl_seconds`` after the last event of a finished job, which has left by then. Ids are not used twice.
A stage's progress never falls: started counts as 0.02, progress is held between 0 and 0.99, completed is 1. Unknown stages only leave their message.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "completed", "failed")
FINISHED = ("completed", "failed")
STAGE_STATES = {"stage_started": "loading", "stage_progress": "loading", "stage_completed": "done", "stage_failed": "error"}


def job_snapshots(events: DataFrame, as_of: Column, weights: Mapping[str, float], ttl_seconds: int = 900, most: int = 80) -> DataFrame:
    """job_id, status, percent, active_stage, updated_ts and the newest ``most`` messages of the jobs held at ``as_of``.

    ``weights`` lists the stages in order. One exchange by job; the active stage is the first that is loading, else the first not done, none if all are.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") <= as_of).withColumn("status", F.when(F.col("event").isin(*STATUSES), F.col("event")))
    e = e.withColumn("begun", F.max(F.col("event") == "queued").over(upto)).where("begun")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    late = F.last("status", ignorenulls=True).over(before).isin(*FINISHED) & (gap > ttl_seconds * 1_000_000)
    e = e.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("late", F.max("late").over(upto)).where("NOT late")
    e = e.withColumn("back", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq"))))
    at = F.struct("ts", "seq")
    state = F.create_map(*[F.lit(x) for pair in STAGE_STATES.items() for x in pair])[F.col("event")]
    reached = (
        F.when(F.col("event") == "stage_started", 0.02).when(F.col("event") == "stage_progress", F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.coalesce("progress", F.lit(0.0)))))
        .when(F.col("event") == "stage_completed", 1.0).otherwise(0.0)
    )
    of = {s: F.col("stage") == s for s in weights}
    g = e.groupBy("job_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.max("ts").alias("updated_ts"),
        *[F.coalesce(F.max(F.when(of[s], reached)), F.lit(0.0)).alias(f"p_{k}") for k, s in enumerate(weights)],
        *[F.coalesce(F.max_by(state, F.when(of[s] & state.isNotNull(), at)), F.lit("pending")).alias(f"s_{k}") for k, s in enumerate(weights)],
        F.array_sort(F.collect_list(F.when((F.col("back") <= most) & F.col("message").isNotNull(), F.struct("ts", "seq", "message")))).alias("messages"),
    )
    first = lambda test: F.coalesce(*[F.when(test(F.col(f"s_{k}")), s) for k, s in enumerate(weights)])
    percent = sum((F.col(f"p_{k}") * x for k, x in enumerate(weights.values())), F.lit(0.0)) * 100 / (sum(weights.values()) or 1.0)
    held = ~F.col("status").isin(*FINISHED) | (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("updated_ts") <= ttl_seconds * 1_000_000)
    active = F.coalesce(first(lambda c: c == "loading"), first(lambda c: c != "done"))
    return g.where(held).select("job_id", "status", percent.alias("percent"), active.alias("active_stage"), "updated_ts", F.transform("messages", lambda m: m["message"]).alias("messages"))


def advance(state: tuple | None, rows: Iterator[tuple], stages: list[str], ttl_micros: int, most: int) -> tuple | None:
    """State (status, updated, progress, states, messages, gone) after ``rows`` (micros, event, stage, progress, message) in order; None before a job begins.

    ``messages`` keeps a null for an event without one, so that it holds the newest ``most`` events."""
    for micros, event, stage, progress, message in rows:
        if state is None:
            if event != "queued":
                continue
            state = (event, micros, [0.0] * len(stages), ["pending"] * len(stages), [], False)
        status, updated, reached, states, messages, gone = state
        if gone or (status in FINISHED and micros - updated > ttl_micros):
            state = (*state[:5], True)
            continue
        if stage in stages and event in STAGE_STATES:
            k = stages.index(stage)
            now = {"stage_started": 0.02, "stage_completed": 1.0, "stage_failed": 0.0}.get(event)
            now = max(0.0, min(0.99, 0.0 if pd.isna(progress) else progress)) if now is None else now
            reached, states = list(reached), list(states)
            reached[k], states[k] = max(reached[k], now), STAGE_STATES[event]
        state = (event if event in STATUSES else status, micros, reached, states, [*messages, message][-most:], False)
    return state


def job_stream(events: DataFrame, weights: Mapping[str, float], ttl_seconds: int = 900, lateness: str = "10 minutes", most: int = 80) -> DataFrame:
    """The same as a stream (update mode): a row for each job that a batch moves, with ``held``; a last one with ``held`` false when it leaves.

    State is a job's status, stages and newest messages, kept in the checkpoint; a finished job's is dropped once the watermark has passed
    its last event by ``ttl_seconds``. Events later than ``lateness`` behind the newest are dropped; within it a batch's events are put in order, those of
    different batches count as they come. A running job has no timeout.
    """
    stages, total = list(weights), sum(weights.values()) or 1.0
    kind = events.schema["job_id"].dataType.simpleString()
    columns = ["job_id", "status", "percent", "active_stage", "updated_us", "messages", "held"]

    def row(job_id: object, s: tuple, held: bool) -> pd.DataFrame:
        status, updated, reached, states, messages, _ = s
        active = next((n for n, x in zip(stages, states, strict=True) if x == "loading"), next((n for n, x in zip(stages, states, strict=True) if x != "done"), None))
        percent = sum(p * w for p, w in zip(reached, weights.values(), strict=True)) * 100 / total
        return pd.DataFrame([(job_id, status, percent, active, updated, [m for m in messages if m is not None], held)], columns=columns)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        old = (*state.get, False) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield row(key[0], old, False)
            return
        rows = pd.concat(batches).sort_values(["us", "seq"])[["us", "event", "stage", "progress", "message"]]
        rows = rows.astype({c: object for c in ("event", "stage", "message")}).where(rows.notna(), None)
        new = advance(old, rows.itertuples(index=False, name=None), stages, ttl_seconds * 1_000_000, most)
        if new is None:
            return
        if new[5]:
            if state.exists:
                state.remove()
            yield row(key[0], new, False)
            return
        state.update(new[:5])
        if new[0] in FINISHED:
            state.setTimeoutTimestamp(max(int(new[1]) // 1000 + ttl_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield row(key[0], new, True)

    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return e.groupBy("job_id").applyInPandasWithState(
        run, f"job_id {kind}, status string, percent double, active_stage string, updated_us bigint, messages array<string>, held boolean",
        "status string, updated bigint, progress array<double>, states array<string>, messages array<string>", "update", "EventTimeTimeout",
    )

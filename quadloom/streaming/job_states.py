"""Job states as a stream: each content's latest status, how many reports were late or repeated, and jobs as keyed state with a timer.

A job moves forward through the states alone, whatever order its reports come in; `failed` may follow any state that isn't done, and of several
reports that it is done the earliest counts. Counters keep the greatest number reported. So late and repeated reports change nothing that is
settled, and states() over all reports gives what the stream ends with. A job without reports for as long as the timeout has failed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadloom.schemas import DONE_STATES, JOB_STATES

COUNTERS = ("chunks_total", "chunks_embedded", "chunks_extracted", "chunks_failed", "chunks_skipped", "items_rejected", "triples_created", "entities_resolved")


def latest_status(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """content_id, status and since of the newest report; for output mode `update`. Repeated reports (event_id) within the delay count once."""
    own = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return own.groupBy("content_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("x")).select("content_id", F.col("x.status").alias("status"), F.col("x.ts").alias("since"))


def reports_by_window(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """How many reports of each status came in each stretch of time, closed when the watermark has passed it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def reports(events: DataFrame) -> DataFrame:
    """Rows (job_id, event_id, ts, status) with all counters and the error, null where the table lacks them, of known states alone."""
    own = events.where(F.col("status").isin(*JOB_STATES) & F.col("job_id").isNotNull() & F.col("ts").isNotNull())
    have = lambda c, kind: (F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c)
    return own.select(F.col("job_id").cast("string").alias("job_id"), F.col("event_id").cast("long").alias("event_id"), "ts", "status", have("error", "string"), *(have(c, "int") for c in COUNTERS))


def orphaned(phase: Column | str) -> Column:
    return F.to_json(F.struct(F.lit("Orphaned").alias("type"), F.lit("no report in time").alias("message"), F.col(phase).alias("phase")))


def states(events: DataFrame, *, at=None, timeout: str = "1 hour") -> DataFrame:
    """job_id, status, since, error and counters after all reports, as a batch. at: the time by which jobs without reports for the timeout have failed (none: none has)."""
    own = reports(events)
    rank = F.array_position(F.array(*map(F.lit, JOB_STATES)), F.col("status"))
    done = F.col("status").isin(*DONE_STATES)
    report = F.struct("ts", "event_id", "status", "error")
    out = own.groupBy("job_id").agg(
        F.min(F.when(done, report)).alias("done"), F.max(F.when(~done, F.struct(rank.alias("rank"), "status"))).alias("last"),
        F.max("ts").alias("heard"), *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in COUNTERS),
    )
    begun = own.where(~done).groupBy("job_id", "status").agg(F.min("ts").alias("since"))
    out = out.withColumn("status", F.coalesce("done.status", "last.status")).join(begun, ["job_id", "status"], "left").withColumn("since", F.coalesce("done.ts", "since"))
    late = F.lit(False) if at is None else F.col("done").isNull() & (F.col("heard") + F.expr(f"interval {timeout}") <= F.lit(at))
    return out.select("job_id", F.when(late, "failed").otherwise(F.col("status")).alias("status"), F.when(late, F.col("heard") + F.expr(f"interval {timeout}")).otherwise(F.col("since")).alias("since"), F.when(late, orphaned("status")).otherwise(F.col("done.error")).alias("error"), *COUNTERS)


_STATE = "status string, since timestamp, error string, heard timestamp, done_id long, moves int, ignored int, " + ", ".join(f"{c} int" for c in COUNTERS)
_TRACKED = "job_id string, status string, since timestamp, error string, moves int, ignored int, " + ", ".join(f"{c} int" for c in COUNTERS)
_RANK = {s: k for k, s in enumerate(JOB_STATES)}


def _at(ms: pd.Timestamp) -> int:
    return int(ms.timestamp() * 1000)


def _tracker(timeout: pd.Timedelta, keep: pd.Timedelta):
    plain = lambda x: None if x is None or x is pd.NaT or x != x else x

    def row(key: tuple, held: dict) -> pd.DataFrame:
        return pd.DataFrame([{"job_id": key[0], **{c: held[c] for c in ("status", "since", "error", "moves", "ignored", *COUNTERS)}}])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ("status", "since", "error", "heard", "done_id", "moves", "ignored", *COUNTERS)
        held = dict(zip(names, state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            if held["status"] in DONE_STATES:
                state.remove()
                return
            error = json.dumps({"type": "Orphaned", "message": "no report in time", "phase": held["status"]}, separators=(",", ":"))
            held |= {"error": error, "status": "failed", "since": held["heard"] + timeout, "done_id": None, "moves": held["moves"] + 1}
        for batch in batches:
            for e in batch.sort_values(["ts", "event_id"]).to_dict("records"):
                before = held and held["status"]
                if held is None:
                    held = dict.fromkeys(names) | {"heard": e["ts"], "moves": 0, "ignored": 0} | dict.fromkeys(COUNTERS, 0)
                done = e["status"] in DONE_STATES
                settled = before in DONE_STATES
                earlier = settled and done and held["done_id"] is not None and (e["ts"], e["event_id"]) < (held["since"], held["done_id"])
                if before is None or earlier or (not settled and (done or _RANK[e["status"]] > _RANK[before])):
                    held |= {"status": e["status"], "since": e["ts"], "error": plain(e["error"]), "done_id": e["event_id"] if done else None, "moves": held["moves"] + 1}
                elif not settled and e["status"] == before:
                    held["since"] = min(held["since"], e["ts"])
                else:
                    held["ignored"] += 1
                held["heard"] = max(held["heard"], e["ts"])
                for c in COUNTERS:
                    held[c] = max(held[c], int(plain(e[c]) or 0))
        state.update(tuple(held[c] for c in names))
        wait = keep if held["status"] in DONE_STATES else timeout
        state.setTimeoutTimestamp(max(_at(held["heard"] + wait), state.getCurrentWatermarkMs() + 1))
        yield row(key, held)

    return step


def tracked(events: DataFrame, *, timeout: str = "1 hour", delay: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """Jobs as keyed state over a stream of reports; for output mode `update`.

    job_id, status, since, error, moves (changes of state), ignored (reports that a settled or later state passes over) and counters. delay: how
    late reports may come; timeout: without a report for so long a job that isn't done has failed; keep: how long a job that is done is remembered."""
    step = _tracker(pd.Timedelta(timeout), pd.Timedelta(keep))
    own = reports(events).withWatermark("ts", delay)
    return own.groupBy("job_id").applyInPandasWithState(step, _TRACKED, _STATE, "update", GroupStateTimeout.EventTimeTimeout)

"""Jobs as keyed state: a stream against the same rules as a batch, and against a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quadloom.schemas import DONE_STATES, JOB_STATES
from quadloom.streaming import job_states

BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, event_id long, ts timestamp, status string, error string, chunks_total int, triples_created int"


def at(minutes):
    return BEGIN + dt.timedelta(minutes=minutes)


def run(spark, path, batches, **options):
    """The last row of each job after the batches, each a micro-batch; and how many rows came for it."""
    out = {}

    def keep(df, _):
        for r in df.collect():
            out.setdefault(r.job_id, []).append(r)

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/events")
        events = spark.readStream.schema(SCHEMA).parquet(f"{path}/events")
        job_states.tracked(events, **options).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return out


def plain(rows, end, timeout):
    """status and since of each job, from all its reports in order of time."""
    out = {}
    for job in {r[0] for r in rows}:
        own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == job and r[3] in JOB_STATES)
        if not own:
            continue
        done = [r for r in own if r[2] in DONE_STATES]
        last = max(own, key=lambda r: (JOB_STATES.index(r[2]), -r[0].timestamp()))
        heard = max(r[0] for r in own)
        if done:
            out[job] = (done[0][2], done[0][0])
        elif heard + timeout <= end:
            out[job] = ("failed", heard + timeout)
        else:
            out[job] = (last[2], last[0])
    return out


def test_batch_rules(spark):
    r = random.Random(4)
    rows = [(f"j{r.randrange(12)}", i, at(r.randrange(200)), r.choice([*JOB_STATES[:-2], *JOB_STATES, "nonsense"]), None, r.choice([None, 1, 7]), r.randrange(5)) for i in range(70)] + [("quiet", 900, at(1), "embedding", None, 3, 0)]
    end, timeout = at(200), dt.timedelta(hours=1)
    got = {x.job_id: x for x in job_states.states(spark.createDataFrame(rows, SCHEMA), at=end).collect()}
    assert {k: (x.status, x.since) for k, x in got.items()} == plain(rows, end, timeout)
    assert all(x.chunks_total == max((v[5] or 0 for v in rows if v[0] == k and v[3] in JOB_STATES), default=0) for k, x in got.items())
    assert got["quiet"].error == '{"type":"Orphaned","message":"no report in time","phase":"embedding"}'
    assert job_states.states(spark.createDataFrame(rows, SCHEMA)).where("job_id = 'quiet'").first().status == "embedding"


def test_stream_with_late_repeated_and_illegal_reports(spark, tmp_path):
    first = [("a", 1, at(0), "accepted", None, 4, 0), ("b", 2, at(1), "embedding", None, None, None), ("c", 3, at(2), "processing", None, 9, 1), ("d", 4, at(2), "odd", None, 1, 1)]
    second = [("a", 5, at(5), "processing", None, None, 3), ("a", 6, at(4), "embedding", None, None, None), ("a", 5, at(5), "processing", None, None, 3), ("c", 7, at(6), "completed", None, None, 12), ("c", 8, at(7), "processing", None, None, 2), ("c", 9, at(5), "failed", "{}", None, None)]
    third = [("e", 10, at(200), "accepted", None, 1, 0)]
    fourth = [("e", 11, at(201), "failed", '{"phase":"x"}', None, None)]
    out = run(spark, str(tmp_path), [first, second, third, fourth])
    last = {k: v[-1] for k, v in out.items()}
    assert (last["a"].status, last["a"].since, last["a"].triples_created, last["a"].ignored) == ("failed", at(65), 3, 0)
    assert last["a"].error == '{"type":"Orphaned","message":"no report in time","phase":"processing"}' and last["a"].moves == 4
    assert (last["b"].status, last["b"].since) == ("failed", at(61))
    assert (last["c"].status, last["c"].since, last["c"].chunks_total, last["c"].triples_created, last["c"].ignored) == ("failed", at(5), 9, 12, 2)
    assert (last["e"].status, last["e"].error) == ("failed", '{"phase":"x"}') and "d" not in last


def test_stream_ends_as_the_batch(spark, tmp_path):
    r = random.Random(11)
    rows = [(f"j{r.randrange(8)}", i, at(i + r.randrange(-6, 7)), r.choice(JOB_STATES), None, r.choice([None, 2, 5]), r.randrange(5)) for i in range(60)]
    batches = [rows[k : k + 15] for k in range(0, 60, 15)]
    out = {k: v[-1] for k, v in run(spark, str(tmp_path), batches, timeout="2 hours", delay="30 minutes").items()}
    want = {x.job_id: x for x in job_states.states(spark.createDataFrame(rows, SCHEMA), timeout="2 hours").collect()}
    same = ("status", "since", "chunks_total", "triples_created")
    assert {k: tuple(x[c] for c in same) for k, x in out.items()} == {k: tuple(x[c] for c in same) for k, x in want.items()}
    assert spark.createDataFrame(rows, SCHEMA).select(F.max("ts")).first()[0] < at(120)

"""The delta store and the ordered outbox against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadloom.operators import common, quads
from quadloom.operators import store as store_module
from quadloom.operators.store import Store
from quadloom.schemas import OUTBOX, QUADS
from quadloom.streaming import outbox


def made(graph, k, confidence=0.5, derived=None):
    return (graph, f"urn:s{k}", "urn:p", "urn:o", "iri", f"h{k}", confidence, "claim", None, None, None, derived)


def plain(store, rows):
    """The rows one after the other; the state and the entries."""
    state = {(q[0], q[5]): {"confidence": q[6], "derived": set(q[11] or ()), "method": q[10], "type": q[7]} for q in store}
    entries = []
    for r in sorted((r for r in rows if r[13] is None and r[2] in outbox.OPERATIONS), key=lambda r: r[0]):
        key, new, payload = (r[10], r[1]), None, json.loads(r[11]) if r[11] else {}
        if r[2].startswith("insert"):
            new = key not in state
            inferred = r[2] == "insert_inferred"
            own = state.setdefault(key, {"confidence": r[6], "derived": set(), "method": None, "type": r[7] or ("inferred" if inferred else None)})
            if inferred:
                own["derived"] |= set(payload.get("derived_from", ()))
                own["method"] = own["method"] or payload.get("inference_method")
        elif r[2] == "update_confidence":
            for (_, h), own in state.items():
                if h == r[1] and r[6] is not None:
                    own["confidence"] = r[6]
        else:
            level = [r[1]]
            seen = {r[1]}
            for _ in range(10):
                hit = [h for (g, h), own in state.items() if g == "inferred" and own["derived"] & set(level)]
                for h in hit:
                    del state["inferred", h]
                level = [h for h in hit if h not in seen]
                seen |= set(hit)
        entries.append((r[0], r[2], r[1], new))
    return {(g, h, v["confidence"], tuple(sorted(v["derived"])), v["method"], v["type"]) for (g, h), v in state.items()}, sorted(entries)


def random_rows(r, n, keys=8, first=1):
    out = []
    for i in range(first, first + n):
        k = r.randrange(keys)
        op = r.choice(["insert", "insert_inferred", "insert_inferred", "update_confidence", "retract_inference", "unknown"])
        graph = r.choice(["extracted", "asserted"]) if op == "insert" else "inferred"
        rests = r.sample(range(keys), r.randint(0, 2))
        payload = json.dumps({"derived_from": [f"h{x}" for x in rests], "inference_method": r.choice(["inverse", "transitive"])}) if op == "insert_inferred" else None
        confidence = None if op == "update_confidence" and r.random() < 0.2 else round(r.random(), 3)
        out.append((i, f"h{k}", op, f"urn:s{k}", "urn:p", "urn:o", confidence, r.choice(["claim", None]), None, None, graph, payload, None, None))
    return out


def state_of(df):
    return {(r.graph, r.triple_hash, r.confidence, tuple(r.derived_from or ()), r.inference_method, r.knowledge_type) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_any_order_of_rows(spark, seed):
    r = random.Random(seed)
    store = [made("extracted", 0), made("inferred", 1, 0.4, ["h0"]), made("inferred", 2, 0.3, ["h1", "h5"]), made("asserted", 9)]
    rows = random_rows(r, 60)
    want, entries = plain(store, rows)
    shuffled = r.sample(rows, len(rows))
    done = outbox.replay(spark.createDataFrame(shuffled, OUTBOX), lambda k: spark.createDataFrame(store, QUADS).join(k, "triple_hash", "left_semi"), spark.createDataFrame(store, QUADS).where("graph = 'inferred'"))
    assert sorted(map(tuple, done.entries.collect())) == entries
    assert state_of(outbox.apply(spark.createDataFrame(store, QUADS), spark.createDataFrame(shuffled, OUTBOX))) == want


def test_chains_and_cycles(spark):
    row = lambda i, k, op, *on: (i, f"h{k}", op, f"urn:s{k}", "urn:p", "urn:o", 0.5, None, None, None, "inferred", json.dumps({"derived_from": [f"h{x}" for x in on]}), None, None)
    rows = [row(k, k, "insert_inferred", k - 1) for k in range(1, 14)] + [row(14, 20, "insert_inferred", 21, 0), row(15, 21, "insert_inferred", 20), row(16, 30, "insert_inferred", 31), row(17, 31, "insert_inferred", 30)]
    rows += [row(18, 0, "retract_inference"), row(19, 1, "insert_inferred", 0), row(20, 0, "retract_inference"), row(21, 2, "insert_inferred", 1)]
    want, _ = plain([], rows)
    assert state_of(outbox.apply(spark.createDataFrame([], QUADS), spark.createDataFrame(rows, OUTBOX))) == want
    assert {h for _, h, *_ in want} == {"h2", "h11", "h12", "h13", "h30", "h31"}


def test_one_key_many_rows(spark):
    rows = [(i, "h1", "insert" if i % 3 else "update_confidence", "urn:s1", "urn:p", "urn:o", i / 1e4, "claim", None, None, "extracted", None, None, None) for i in range(5000)]
    rows += [(6000 + i, "h2", "insert_inferred" if i % 2 else "retract_inference", "urn:s2", "urn:p", "urn:o", i / 1e4, None, None, None, "inferred", '{"derived_from": ["h2"]}', None, None) for i in range(3000)]
    want, entries = plain([], rows)
    done = outbox.replay(spark.createDataFrame(rows, OUTBOX), lambda k: spark.createDataFrame([], QUADS), spark.createDataFrame([], QUADS))
    assert state_of(done.state) == want
    assert sorted(map(tuple, done.entries.collect())) == entries


def test_store_rewrites_touched_buckets_alone(spark, tmp_path):
    every = [made(g, k) for g in ("extracted", "asserted", "odd/graph=1") for k in range(200)]
    store = Store(spark, str(tmp_path / "s")).create(spark.createDataFrame(every, QUADS), buckets=8)
    files = lambda df: {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert len(files(store.read())) == 24 and len(files(store.read(graphs=["odd/graph=1"]))) == 8
    keys = spark.createDataFrame([("extracted", "h5")], "graph string, triple_hash string")
    assert len(files(store.holding(keys))) == 1 and len(files(store.holding(keys.select("triple_hash")))) == 3
    before = files(store.read())
    assert store.replace(keys, spark.createDataFrame([made("extracted", 5, 0.9)], QUADS), label="a") == 1
    after = files(store.read())
    assert len(before - after) == len(after - before) == 1
    assert store.replace(keys, spark.createDataFrame([made("extracted", 5, 0.1)], QUADS), label="a") == 1
    assert store.read().where("triple_hash = 'h5' AND graph = 'extracted'").first().confidence == 0.9
    assert store.read(version=0).where("confidence = 0.9").isEmpty() and store.read().count() == 600
    gone = spark.createDataFrame([(g, f"h{k}") for g in ("extracted", "asserted", "odd/graph=1") for k in range(200)], "graph string, triple_hash string")
    store.replace(gone, spark.createDataFrame([], QUADS))
    assert store.read().isEmpty() and store.read(graphs=["none"]).isEmpty()
    assert store.clean_up(keep=1) == [0, 1] and store.read().isEmpty() and store.versions() == [2]


def test_store_insert_and_update(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s")).create(spark.createDataFrame([made("extracted", k) for k in range(50)], QUADS), buckets=4)
    new = spark.createDataFrame([(k, *made("extracted", k % 60, 0.9)) for k in range(40, 130)], "seq long, " + QUADS)
    own = store.read()
    marks = {(r.seq, r.is_new) for r in store.insert(new).collect()}
    want, plain_marks = quads.insert(own, new)
    assert marks == {(r.seq, r.is_new) for r in plain_marks.collect()}
    assert state_of(store.read()) == state_of(want)
    updates = spark.createDataFrame([("h3", 0.1, 1), ("h3", 0.2, 2), ("h77", 0.3, 1)], "triple_hash string, confidence double, seq long")
    assert store.update_confidence(updates, label="u") == store.update_confidence(updates, label="u") == 2
    assert {r.triple_hash: r.confidence for r in store.read().where("confidence < 0.5").collect()} == {"h3": 0.2}
    store.clean_up()
    assert store.versions() == [1, 2] and store.read().count() == 60


def test_drain_with_repeated_batches(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    batches = [random_rows(r, 20, first=1 + 20 * b) for b in range(2)]
    begin = [made("inferred", 1, 0.4, ["h0"]), made("extracted", 0)]
    store = Store(spark, str(tmp_path / "s")).create(spark.createDataFrame(begin, QUADS), buckets=3)
    box = str(tmp_path / "box")
    write = outbox.drain_into
    failed = []

    def breaks(*a, **b):
        entries = write(*a, **b)
        if not failed:
            failed.append(1)
            raise RuntimeError("lost after the change, before the marks")
        return entries

    monkeypatch.setattr(outbox, "drain_into", breaks)
    done = []
    for b in batches:
        outbox.stage(spark, spark.createDataFrame(b, OUTBOX).coalesce(1), box)
        done += b
        for _ in range(2):
            try:
                outbox.drain(spark, box, store, str(tmp_path / "c")).awaitTermination()
            except Exception as e:  # noqa: BLE001
                assert "lost after" in str(e)
        want, entries = plain(begin, done)
        assert state_of(store.read()) == want
    marks = spark.read.parquet(f"{store.at}/applied")
    assert sorted((m.id, m.operation, m.triple_hash, m.is_new) for m in marks.collect()) == entries
    rows = outbox.marked(spark.read.schema(OUTBOX).parquet(box), marks)
    assert rows.where("applied_at IS NULL").select("operation").distinct().collect() == [("unknown",)]
    assert outbox.apply(store.read(), rows).exceptAll(store.read()).isEmpty()
    assert rows.where(F.col("applied_at").isNotNull()).count() == len(entries)


def test_sieve_keeps_every_row_and_lets_few_others_through(spark):
    df = spark.range(60_000).select(F.col("id").cast("string").alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    keys = spark.range(0, 60_000, 30).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([("5",)] * 50 + [("not there",)], "k string"))
    may, other = common.sieve(df, keys, "k")
    assert may.unionByName(other).exceptAll(df).isEmpty() and may.count() + other.count() == 60_001
    assert other.join(keys, "k", "left_semi").isEmpty() and may.count() < 2_000 + 3_000
    assert may.where("id >= 0").join(keys, "k", "left_semi").count() == 2_001
    # Rows are looked up before a join with the keys shuffles them.
    plan = may.join(keys.hint("merge"), "k", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Inner")


def test_store_changed_by_many_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "few", lambda df, rows=0: False)
    monkeypatch.setattr(store_module, "BUCKET_ROWS", 100)
    every = [made(g, k) for g in ("extracted", "asserted") for k in range(400)]
    store = Store(spark, str(tmp_path / "s")).create(spark.createDataFrame(every, QUADS), buckets=4)
    keys = spark.createDataFrame([("extracted", f"h{k}") for k in range(0, 400, 7)] * 2, "graph string, triple_hash string")
    assert state_of(store.holding(keys)) == {(g, f"h{k}", 0.5, (), None, "claim") for g in ("extracted",) for k in range(0, 400, 7)}
    assert store.holding(keys.select("triple_hash")).count() == 2 * 58
    store.replace(keys, spark.createDataFrame([made("extracted", k, 0.9) for k in range(0, 400, 7)], QUADS))
    want = {(g, f"h{k}", 0.9 if g == "extracted" and k % 7 == 0 else 0.5, (), None, "claim") for g in ("extracted", "asserted") for k in range(400)}
    assert state_of(store.read()) == want and store.read().count() == 800
    assert all(".zstd." in f for f in store.read().inputFiles())
    # The kept quads of a large store go to files without being shuffled, so both are linear in the quads alone.
    plan = store._apart(store._entries()[1], keys)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 0 and plan.index("LeftAnti") < plan.rindex("Inner")

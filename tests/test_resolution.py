"""Entities made in order and the vector index against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.operators import resolution, retrieval, vector_index
from quadloom.operators.common import numbered
from quadloom.plans.ontology import DATA_NS as DATA
from quadloom.plans.ontology import SCHEMA_NS as KS


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def plain(labels, entities, aliases, least, ns=DATA):
    """Each label once, in order: alias, nearest of all made so far, or a new one."""
    held, cache, how, added = [(u, e) for u, e in entities], {}, {}, []
    for label, e in labels:
        if label.lower() in cache:
            continue
        if label.lower() in aliases:
            cache[label.lower()], how[label.lower()] = ns + aliases[label.lower()], "alias"
            continue
        near = max(((cosine(e, x), -k) for k, (_, x) in enumerate(held)), default=(-1, 0)) if e else (-1, 0)
        if near[0] >= least:
            cache[label.lower()], how[label.lower()] = held[-near[1]][0], "near"
        else:
            uri = ns + re.sub("[^a-z0-9]+", "_", label.lower())
            cache[label.lower()], how[label.lower()] = uri, "new"
            added.append((uri, label))
            if e:
                held.append((uri, e))
    return {(label, cache[label.lower()], how[label.lower()]) for label, _ in labels}, added


@pytest.mark.parametrize(("seed", "size", "least"), [(0, 2, 0.95), (2, 6, 0.5)])
def test_entities_made_in_order(spark, seed, size, least):
    r = random.Random(seed)
    vector = lambda: [r.gauss(0, 1) for _ in range(size)]
    entities = [(DATA + f"old{k}", vector()) for k in range(3)]
    labels = []
    for k in range(120):
        label = r.choice([f"Label {k}", f"LABEL {max(0, k - 3)}", "Known"])
        first = next((e for x, e in labels if x.lower() == label.lower()), None)
        labels.append((label, first or (None if k == 50 else vector())))
    rows = [(k, label, e) for k, (label, e) in enumerate(labels)]
    r.shuffle(rows)
    got, added = resolution.resolve_entities(
        spark.createDataFrame(rows, "seq long, label string, embedding array<double>"), spark.createDataFrame(entities, "uri string, embedding array<double>"), spark.createDataFrame([("KNOWN", "known_one")], "alias string, canonical string"), least
    )
    want, new = plain(labels, entities, {"known": "known_one"}, least)
    assert {tuple(x) for x in got.collect()} == want
    assert sorted((x.uri, x.label) for x in added.collect()) == sorted(new)


def test_chain_of_near_labels(spark):
    # Each label is near its neighbours alone, so every other one makes something new.
    rows = [(k, f"l{k:02}", [float(np.cos(k * 0.3)), float(np.sin(k * 0.3))]) for k in range(10)]
    got = {r.label for r in resolution.leaders(spark.createDataFrame(rows, "ord long, label string, embedding array<double>"), 0.94).collect()}
    assert got == {"l00", "l02", "l04", "l06", "l08"}


def test_predicates_made_in_order(spark):
    rows = [(1, "urn:p", [1.0, 0.0]), (2, "leads to", [1.0, 0.1]), (3, "brand new", [0.0, 1.0]), (4, "almost new", [0.02, 1.0]), (5, "boosted", [1.0, 0.01])]
    known = spark.createDataFrame([(KS + "causes", [1.0, 0.0])], "uri string, embedding array<double>")
    synonyms = spark.createDataFrame([("leads_to", KS + "causes")], "synonym string, predicate string")
    got, added = resolution.resolve_predicates(spark.createDataFrame(rows, "seq long, label string, embedding array<double>"), known, synonyms)
    assert {tuple(r) for r in got.collect()} == {("urn:p", "urn:p", "uri"), ("leads to", KS + "causes", "synonym"), ("brand new", KS + "brand_new", "new"), ("almost new", KS + "brand_new", "near"), ("boosted", KS + "causes", "near")}
    assert [r.uri for r in added.collect()] == [KS + "brand_new"]


def test_numbered(spark):
    values = random.Random(1).sample(range(10_000), 500)
    got = numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v", "n").collect()
    assert [r.n for r in sorted(got)] == list(range(500))


def test_vector_index(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    x = centres[r.integers(0, 30, 1500)] + 0.4 * r.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>").repartition(5)
    queries = items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    centroids = vector_index.fit(items, sample=600)
    indexed = vector_index.index(items, centroids)
    assert indexed.count() == 1500 and len(centroids) == 38
    exact = retrieval.knn_join(queries, items, 10)
    found = vector_index.search(queries, indexed, centroids, 10, probes=6, list_rows=40, query_rows=5)
    assert vector_index.recall(found, exact) >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").isEmpty()
    every = vector_index.search(queries, indexed, centroids, 10, probes=len(centroids))
    assert {(q.query_id, q.item_id, q.place) for q in every.collect()} == {(q.query_id, q.item_id, q.place) for q in exact.collect()}
    # One list with all rows is dealt into blocks.
    one = vector_index.search(queries, indexed.withColumn("list", F.lit(0)), centroids[:1], 10, probes=1, list_rows=100)
    assert {(q.query_id, q.item_id) for q in one.collect()} == {(q.query_id, q.item_id) for q in exact.collect()}
    assert vector_index.search(queries, indexed, centroids, 3, 0.9, probes=6).where("similarity < 0.9").isEmpty()


def test_index_on_disk_reads_probed_lists(spark, tmp_path):
    r = np.random.default_rng(4)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 8)))], "item_id long, embedding array<double>")
    centroids = vector_index.fit(items, lists=10)
    vector_index.write(vector_index.index(items, centroids), str(tmp_path / "i"))
    query = r.normal(size=8).tolist()
    near = vector_index.near(spark.read.parquet(str(tmp_path / "i")), centroids, query, probes=3)
    assert "PartitionFilters: [isnotnull(list#" in (plan := near._jdf.queryExecution().toString()) or "PartitionFilters: [list#" in plan
    assert {x.list for x in near.select("list").distinct().collect()} == set(vector_index.nearest_lists(query, centroids, 3))
    assert vector_index.fit(items.limit(0)).size == 0
    assert vector_index.search(items.select(F.col("item_id").alias("query_id"), "embedding"), vector_index.index(items, np.zeros((0, 0))), np.zeros((0, 0)), 3).isEmpty()


def test_nearest_holds_tiles_not_products():
    import tracemalloc

    import pandas as pd

    r = np.random.default_rng(7)
    # Components of few values, so that many scores tie.
    q, i = r.integers(-1, 2, (2_000, 4)).astype(float), r.integers(-1, 2, (10_000, 4)).astype(float)
    frame = lambda v, name, seed: pd.DataFrame({name: np.random.default_rng(seed).permutation(len(v)), "embedding": list(v), "ord": range(len(v))})
    asked, items = frame(q, "query_id", 1), frame(i, "item_id", 2)
    tracemalloc.start()
    got = retrieval._nearest(3, None, True)(asked, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    by_id = items.sort_values("item_id")
    with np.errstate(invalid="ignore"):
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        at = np.arange(0, 2_000, 37)
        scores = np.nan_to_num(unit(q[at]) @ unit(np.stack(by_id.embedding)).T, nan=-np.inf)
    scores[by_id.ord.to_numpy()[None, :] >= at[:, None]] = -np.inf
    found = {k: x for k, x in got.groupby("query_id")}
    for row, s in zip(at, scores, strict=True):
        own = found.get(asked.query_id[row])
        want = np.sort(s)[::-1][:3]
        want = want[want > -np.inf]
        assert np.allclose([] if own is None else own.similarity, want)
    # Whatever the tiles, the same rows.
    small = retrieval._nearest(3, 0.2, True, tile=(7, 11))(asked[:200], items[:300])
    whole = retrieval._nearest(3, 0.2, True, tile=(200, 300))(asked[:200], items[:300])
    assert len(small) == len(whole) and np.allclose(small.similarity, whole.similarity) and list(small.query_id) == list(whole.query_id)

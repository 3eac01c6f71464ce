"""Operators on small made-up tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadloom.functions.terms import triple_hash
from quadloom.operators import conflicts, ingest, jobs, patterns, quads, reasoning, resolution, retrieval
from quadloom.operators.upsert import upsert
from quadloom.plans import ontology

KS, DATA = ontology.SCHEMA_NS, ontology.DATA_NS


def made(spark, triples, graph="asserted", confidence=0.8):
    rows = [(graph, DATA + s, KS + p, DATA + o if o.islower() else o, "iri" if o.islower() else "literal", confidence, "claim", None, None) for s, p, o in triples]
    return quads.with_hash(spark.createDataFrame(rows, "graph string, s string, p string, o string, o_kind string, confidence double, knowledge_type string, valid_from string, valid_until string"))


def names(df):
    return {tuple(x.rsplit("/", 1)[-1] for x in r) for r in df.select("s", "p", "o").collect()}


def infer(spark, triggers, store, **options):
    return reasoning.infer(triggers.select("s", "p", "o", "o_kind", "confidence", "triple_hash"), store, ontology.inverses(spark), ontology.transitive(spark), **options)


def test_inverses(spark):
    store = made(spark, [("a", "contains", "b")])
    assert names(infer(spark, store, store, max_depth=1)) == {("b", "part_of", "a")}


def test_chains_through_inverses(spark):
    store = made(spark, [("c", "part_of", "b"), ("a", "contains", "b")])
    found = infer(spark, store.where(F.col("s").endswith("/a")), store)
    assert ("c", "part_of", "a") in names(found)
    assert ("c", "part_of", "a") not in names(infer(spark, store.where(F.col("s").endswith("/a")), store, max_depth=1))


def test_cycles_end(spark):
    store = made(spark, [("a", "part_of", "b"), ("b", "part_of", "a")])
    assert ("a", "part_of", "a") not in names(infer(spark, store, store))


def test_what_is_stored_is_not_derived(spark):
    store = made(spark, [("a", "contains", "b"), ("b", "part_of", "a")])
    assert ("b", "part_of", "a") not in names(infer(spark, store, store))


def test_inheritance_multiplies_confidence(spark):
    store = made(spark, [("cat", "is_a", "animal"), ("animal", "has_property", "Fur")], confidence=0.5)
    (row,) = infer(spark, store.where(F.col("s").endswith("cat")), store, max_depth=1).collect()
    assert (row.o, row.confidence, row.method, row.depth) == ("Fur", 0.25, "type_inheritance", 1)


def test_retraction_cascades(spark):
    rows = [("asserted", "h1", None), ("inferred", "h2", ["h1"]), ("inferred", "h3", ["h2", "h9"]), ("inferred", "h4", ["h9"])]
    store = spark.createDataFrame(rows, "graph string, triple_hash string, derived_from array<string>")
    left, taken = reasoning.retract(store, spark.createDataFrame([("h1",)], "triple_hash string"))
    assert {r.triple_hash for r in left.collect()} == {"h1", "h4"}
    assert {(r.triple_hash, r.depth) for r in taken.collect()} == {("h2", 1), ("h3", 2)}


def test_expansion_stops_at_literals_and_hops(spark):
    store = made(spark, [("a", "is_a", "b"), ("b", "is_a", "c"), ("c", "is_a", "d"), ("b", "has_property", "Red")])
    start = spark.createDataFrame([(DATA + "a",)], "node string")
    assert names(reasoning.expand(store, start, max_hops=2)) == {("a", "is_a", "b"), ("b", "is_a", "c"), ("b", "has_property", "Red")}


def test_graph_retrieval_visits_the_farthest_nodes(spark):
    chain = "abcdefgh"
    store = made(spark, [*((x, "is_a", y) for x, y in zip(chain, chain[1:], strict=False)), ("b", "has_property", "Red")])
    store = store.withColumn("knowledge_type", F.lit("claim"))
    vector = lambda name: [1.0, 0.0] if name == "a" else [0.0, 1.0]
    entities = spark.createDataFrame([(DATA + "a", [1.0, 0.0])], "uri string, embedding array<double>")
    chunks = spark.createDataFrame([("k", "c", "text", [1.0, 0.0])], "chunk_id string, content_id string, chunk_text string, embedding array<double>")
    content = spark.createDataFrame([("c", "u")], "content_id string, url string")
    ask = lambda hops: retrieval.retrieve("how is a related", vector, chunks=chunks, content=content, quads=store, entities=entities, predicates=entities, kind="graph", names=["a"], max_hops=hops)
    for hops in (0, 2, 4):
        got = ask(hops)
        edges = {(x, "is_a", y) for x, y in zip(chain[: hops + 1], chain[1:], strict=False)} | ({("b", "has_property", "Red")} if hops else set())
        assert names(got.triples) == edges
        assert got.depth.first().depth == hops
        assert sorted(r.uri.rsplit("/", 1)[-1] for r in got.entities.collect()) == sorted(["a", *chain[: hops + 1]])


def test_visited_nodes_end_with_the_edges(spark):
    store = made(spark, [("a", "is_a", x) for x in "bcd"] + [(x, "is_a", x + str(i)) for x in "bcd" for i in range(2)])
    start = spark.createDataFrame([(DATA + "a",)], "node string")
    seen = lambda limit: {(r.node.rsplit("/", 1)[-1], r.hop) for r in reasoning.visited(reasoning.expand(store, start, 3, limit=limit), start, 2, limit).collect()}
    assert seen(2) == {("a", 0)}
    assert seen(5) == {("a", 0), ("b", 1)}
    assert seen(6) == {("a", 0), ("b", 1), ("c", 1)}
    assert len(seen(200)) == len(seen(None)) == 10


def test_conflicts(spark):
    store = made(spark, [("a", "amount", "One"), ("a", "amount", "Two"), ("a", "is_a", "X"), ("a", "is_a", "Y"), ("a", "increases", "z"), ("a", "decreases", "z")])
    (value,) = conflicts.functional_conflicts(store, ontology.functional(spark)).collect()
    assert (value.o1, value.o2, round(value.probability, 6)) == ("One", "Two", 0.64)
    assert conflicts.opposite_conflicts(store, ontology.opposites(spark)).count() == 1
    assert conflicts.all_conflicts(store, ontology.functional(spark), ontology.opposites(spark), least=0.7).count() == 0
    assert conflicts.find_contradictions(store.select("s", "p", "o"), store).count() == 4


def test_inserts(spark):
    store = made(spark, [("a", "is_a", "b")]).select(*quads.KEY, "o_kind", "confidence")
    new = made(spark, [("a", "is_a", "b"), ("c", "is_a", "d"), ("c", "is_a", "d")], confidence=0.3).select(*quads.KEY, "o_kind", "confidence").withColumn("seq", F.monotonically_increasing_id())
    grown, marked = quads.insert(store, new)
    assert grown.count() == 2 and marked.where("is_new").count() == 1
    assert grown.where(F.col("s").endswith("/a")).first().confidence == 0.8


def test_patterns(spark):
    store = made(spark, [("a", "is_a", "b"), ("b", "is_a", "c"), ("a", "has_property", "Red")])
    isa = patterns.triple(store, "?x", KS + "is_a", "?y")
    assert patterns.group(isa, patterns.triple(store, "?y", KS + "is_a", "?z")).count() == 1
    assert patterns.optional(isa, patterns.triple(store, "?x", KS + "has_property", "?c")).where("c IS NULL").count() == 1
    assert patterns.minus(isa.select("x"), patterns.triple(store, "?x", KS + "has_property", "?c")).count() == 1
    assert patterns.path(store, "?x", KS + "is_a", "?y").count() == 3
    # Without a step every term is connected to itself, the literal too.
    assert patterns.path(store, "?x", KS + "is_a", "?y", at_least=0).count() == 7
    assert patterns.triple(store, "?x", "?p", "?x").count() == 0
    assert patterns.ask(isa).first().result is True
    with pytest.raises(ValueError, match="common variable"):
        patterns.group(isa, patterns.triple(store, "?q", KS + "is_a", "?r"))


def test_fusion(spark):
    v = spark.createDataFrame([("both", 0.9, 0)], "chunk_id string, similarity double, place int")
    t = spark.createDataFrame([("both", 0.5, 0), ("text", 0.4, 1)], "chunk_id string, rank double, place int")
    got = {r.chunk_id: (r.similarity, r.rrf_score) for r in retrieval.fuse(v, t, 5).collect()}
    assert got == {"both": (0.9, pytest.approx(2 / 61)), "text": (None, pytest.approx(1 / 62))}


def test_knn_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8))
    items = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "item_id long, embedding array<double>")
    asked = items.where("item_id % 7 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.place): r.item_id for r in retrieval.knn_join(asked, items, 3, chunk_rows=11, query_rows=4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 7):
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-(u @ u[q]))[:3].tolist()


def test_jobs(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("j1", "c1", "completed", at(1)), ("j2", "c1", "processing", at(2)), ("j3", "c2", "processing", at(1)), ("j4", "c2", "failed", at(2))]
    table = spark.createDataFrame(rows, "job_id string, content_id string, status string, created_at timestamp")
    content = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "content_id string")
    assert {r.content_id for r in jobs.readable(content, table).collect()} == {"c2", "c3"}
    assert jobs.readable(content, table, on=False).count() == 3
    new = spark.createDataFrame([("n1", "c1", 1), ("n2", "c9", 2), ("n3", "c9", 3)], "job_id string, content_id string, seq int")
    assert {r.job_id: r.serving_job for r in jobs.accepted(new, table).collect()} == {"n1": "j2", "n2": "n2", "n3": "n2"}


def test_upserts_keep_what_came_first(spark):
    table = spark.createDataFrame([(1, "old", 10), (2, "old", 20)], "k int, v string, since int")
    updates = spark.createDataFrame([(1, "new", 99, 1), (3, "first", 30, 1), (3, "last", 31, 2)], "k int, v string, since int, seq int")
    assert {tuple(r) for r in upsert(table, updates, ["k"], "seq", keep=("since",)).collect()} == {(1, "new", 10), (2, "old", 20), (3, "last", 30)}


def test_items(spark):
    schema = "seq long, shape string, subject string, predicate string, object string, rdf_type string, label string, occurred_at string, properties map<string,string>, confidence double, knowledge_type string"
    rows = [(1, "triple", "a", "is_a", "b", None, None, None, None, 0.8, "claim"), (2, "event", "e", None, None, None, None, "2024-01-01", {"k": "v"}, 1.0, "event"), (3, "entity", "x", None, None, "T", "L", None, {"k": "v"}, 0.9, "entity")]
    got = ingest.expand_items(spark.createDataFrame(rows, schema)).groupBy("seq").count().collect()
    assert {r.seq: r["count"] for r in got} == {1: 1, 2: 2, 3: 3}


def test_coreference(spark):
    mentions = spark.createDataFrame([(1, "Cat", "Q1"), (2, "House cat", "Q1"), (3, "cat", "Q1"), (4, "Dog", "Q2"), (5, "Bird", None)], "pos int, text string, wikidata_id string")
    groups = resolution.coreference_groups(mentions)
    assert {(r.canonical, tuple(r.aliases)) for r in groups.collect()} == {("cat", ("house_cat",)), ("dog", ())}
    triples = spark.createDataFrame([("HOUSE_CAT", "dog")], "s string, o string")
    assert tuple(resolution.canonicalise(triples, resolution.aliases(groups)).first()) == ("cat", "dog")


def test_resolution(spark):
    labels = spark.createDataFrame([("Kitty", [1.0, 0.0]), ("near", [0.99, 0.1]), ("far", [0.0, 1.0])], "label string, embedding array<double>")
    entities = spark.createDataFrame([(DATA + "cat", "cat", [1.0, 0.0])], "uri string, label string, embedding array<double>")
    known = spark.createDataFrame([("kitty", "cat")], "alias string, canonical string")
    got, added = resolution.resolve_entities(labels, entities, known)
    assert {(r.label, r.uri.rsplit("/")[-1], r.how) for r in got.collect()} == {("Kitty", "cat", "alias"), ("near", "cat", "near"), ("far", "far", "new")}
    assert [r.uri for r in added.collect()] == [DATA + "far"]


def test_one_batch_of_ingest(spark):
    store = made(spark, [("rain", "causes", "flood")], confidence=0.9).withColumns({"inference_method": F.lit(None).cast("string"), "derived_from": F.lit(None).cast("array<string>")})
    provenance = spark.createDataFrame([], "triple_hash string, source_url string, subject string, predicate string, object string, confidence double, ingested_at timestamp")
    rows = [(1, "Box", "contains", "ball", 0.7, "claim", "u1", "web", "llm", dt.datetime(2024, 1, 1)), (2, "Box", "contains", "ball", 0.8, "claim", "u2", "web", "llm", dt.datetime(2024, 1, 2)), (3, "rain", "inhibits", "flood", 0.8, "claim", "u3", "web", "api", dt.datetime(2024, 1, 3))]
    new = spark.createDataFrame(rows, "seq int, s string, p string, o string, confidence double, knowledge_type string, source_url string, source_type string, extractor string, ingested_at timestamp")
    got = ingest.ingest(new, store, provenance, ontology.inverses(spark), ontology.transitive(spark), ontology.opposites(spark))
    held = {(r.graph, r.s.rsplit("/")[-1], r.p.rsplit("/")[-1], r.o.rsplit("/")[-1]): r.confidence for r in got.quads.collect()}
    assert held["extracted", "box", "contains", "ball"] == pytest.approx(0.94)
    assert held["inferred", "ball", "part_of", "box"] == pytest.approx(0.94)
    assert held["asserted", "rain", "inhibits", "flood"] == pytest.approx(0.8 * (1 - 0.9 / 2))
    assert got.provenance.count() == 4  # the inferred triple has its own


def test_hashes_of_columns(spark):
    assert spark.range(1).select(triple_hash(F.lit("urn:a"), F.lit("urn:b"), F.lit("urn:c")).alias("h")).first().h != spark.range(1).select(triple_hash(F.lit("urn:a"), F.lit("urn:b"), F.lit("c")).alias("h")).first().h


def test_strongest_other_is_that_of_all_pairs(spark):
    rows = [("a", "p", "x", 0.5), ("a", "p", "y", 0.9), ("a", "p", "z", 0.7), ("b", "p", "x", 0.4), ("c", "p", "x", 0.2), ("c", "p", "y", 0.2), ("a", "q", "x", None)]
    quads_ = spark.createDataFrame(rows, "s string, p string, o string, confidence double")
    new = spark.createDataFrame([("a", "p", "y"), ("a", "p", "new"), ("b", "p", "x"), ("c", "p", "y"), ("d", "p", "x")], "s string, p string, o string")
    want = {tuple(r) for r in conflicts.strongest(conflicts.find_contradictions(new, quads_), ["s", "p", "o"]).where("existing IS NOT NULL").collect()}
    assert {tuple(r) for r in conflicts.strongest_other(new, quads_).select("s", "p", "o", "existing").collect()} == want


def test_store_by_graph_prunes(spark, tmp_path):
    own = made(spark, [("a", "is_a", "b")]).withColumn("graph", F.lit("asserted")).unionByName(made(spark, [("c", "is_a", "d")]).withColumn("graph", F.lit("inferred")))
    quads.write(own, str(tmp_path / "store"))
    found = quads.pattern(spark.read.parquet(str(tmp_path / "store")), graphs=["asserted"])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(graph" in plan
    assert [r.s.rsplit("/")[-1] for r in found.collect()] == ["a"]


def test_changed_values_retract_what_rests_on_them(spark):
    store = made(spark, [("socrates", "is_a", "man")], confidence=0.9).withColumns({"inference_method": F.lit(None).cast("string"), "derived_from": F.lit(None).cast("array<string>")})
    old = store.first().triple_hash
    resting = store.withColumns({"graph": F.lit("inferred"), "o": F.lit("mortal"), "triple_hash": F.lit("h"), "derived_from": F.array(F.lit(old))})
    new = store.select("s", "p", F.lit("statue").alias("o"))
    gone = ingest.prior_values(new, store)
    assert [r.triple_hash for r in gone.collect()] == [old]
    left, taken = reasoning.retract(store.unionByName(resting), gone)
    assert [r.triple_hash for r in taken.collect()] == ["h"] and [r.triple_hash for r in left.collect()] == [old]
    assert ingest.prior_values(store.select("s", "p", "o"), store).count() == 0


def test_rules_of_ones_own(spark):
    store = made(spark, [("a", "likes", "b")], confidence=0.5)
    triggers = store.select("s", "p", "o", "o_kind", "confidence", "triple_hash")

    def mutual(frontier, held):
        return frontier.where("p LIKE '%likes'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "o_kind", "confidence", F.lit("mutual").alias("method"), F.array("triple_hash").alias("derived_from"), "trigger", "path")

    got = reasoning.infer(triggers, store, ontology.inverses(spark), ontology.transitive(spark), more={"mutual": mutual}).collect()
    assert [(r.s.rsplit("/")[-1], r.o.rsplit("/")[-1], r.method) for r in got] == [("b", "a", "mutual")]


def test_path_operators(spark):
    q = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("d", "p", "b")], "s string, p string, o string")
    pairs = lambda df: {tuple(r) for r in df.collect()}
    p, q_ = patterns.step(q, "p"), patterns.step(q, "q")
    assert pairs(patterns.then(p, q_)) == {("a", "c"), ("d", "c")}
    assert pairs(patterns.then(p, patterns.step(q, "p", backward=True))) == {(x, y) for x in "ad" for y in "ad"}
    assert pairs(patterns.either(p, q_)) == {("a", "b"), ("d", "b"), ("b", "c")}
    assert pairs(patterns.maybe(q_, spark.createDataFrame([("b",)], "node string"))) == {("b", "c"), ("b", "b")}


def test_strongest_other_of_many_quads_is_dealt_out_once(spark, monkeypatch):
    from quadloom.operators import common

    monkeypatch.setattr(common, "TASK_ROWS", 100)
    rows = [(f"s{i % 300}", f"o{i % 7}", (i * 37 % 100) / 100) for i in range(2000)] + [("s1", "x", 0.99)]
    flags = spark.createDataFrame(rows, "s string, o string, confidence double").groupBy("s", "o").agg(F.max("confidence").alias("confidence")).withColumn("p", F.lit("flag"))
    found = conflicts.strongest_other(flags, flags, rows=2001)
    held = [tuple(r) for r in flags.select("s", "o", "confidence").collect()]
    want = {(s, o, max(c for t, x, c in held if t == s and x != o)) for s, o, _ in held if sum(t == s for t, _, _ in held) > 1}
    assert {(r.s, r.o, r.existing) for r in found.collect()} == want and found.count() == len(want)
    # All steps work on the tasks that the rows were dealt to, though p is the same everywhere.
    plan = conflicts.strongest_other(flags.hint("merge"), flags, rows=2001)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_class" in line]
    assert dealt and all(", 21), REPARTITION_BY_NUM" in line for line in dealt)


def test_provenance_by_terms_shuffles_no_hash(spark):
    from quadloom.operators import evidence
    from quadloom.plans.queries import QUERIES

    p = spark.createDataFrame([("a", "x", dt.datetime(2020, 1, d), f"u{d}", "t", "e", 0.5) for d in (3, 1, 2)] + [("b", "x", dt.datetime(2020, 1, 1), "v", "t", "e", 0.5)], "subject string, object string, ingested_at timestamp, source_url string, source_type string, extractor string, confidence double")
    triples = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "subject string, object string")
    lists = {r.subject: [x.source_url for x in r.provenance] for r in evidence.with_provenance(triples, p, keys=("subject", "object")).collect()}
    assert lists == {"a": ["u1", "u2", "u3"], "b": ["v"], "c": []}
    plan = QUERIES["q_provenance_enrich"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and plan.count("Exchange hashpartitioning") == 2

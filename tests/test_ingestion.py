"""Items of answers, the stand-ins for models, and a whole run."""

import datetime as dt
import re
from collections import Counter

from pyspark.sql import functions as F

from quadloom.functions.vectors import hashing_embedder
from quadloom.operators import extraction
from quadloom.plans import ingestion, ontology
from quadloom.schemas import QUADS


def test_items_of_answers(spark):
    answer = """Here: ```json
    {"entities": [{"uri": "dopamine", "rdf_type": "T", "label": "Dopamine"}, {"uri": "x"}],
     "relations": [{"subject": "a", "predicate": "is_a", "object": "b", "confidence": 1.5}, {"subject": "a", "predicate": "is_a", "object": "c"}],
     "items": [{"subject": "e", "occurred_at": "2024-01-01", "properties": {"k": "v"}}]}```"""
    got = extraction.items_of(spark.createDataFrame([("c1", answer), ("c2", "no json")], "content_id string, answer string")).collect()
    assert [(r.shape, r.confidence, r.rejected) for r in sorted(got, key=lambda r: r.item_index)] == [("entity", 0.95, None), ("entity", 0.95, "no label"), ("triple", 1.5, "confidence out of range"), ("triple", 0.8, None), ("event", 1.0, None)]


def test_chosen_text_and_sentences(spark):
    df = spark.createDataFrame([("  ", None, "Title")], "raw string, summary string, title string")
    assert df.select(extraction.chosen_text(*map(F.col, ("raw", "summary", "title"))).alias("x")).first().x == "Title"
    assert df.select(extraction.sentence_count(F.lit("One. Two! v1.5 three? ")).alias("x")).first().x == 3


def test_extraction(spark):
    chunks = spark.createDataFrame([("c", 0, "Caffeine boosts alertness. Nothing here.\nThe heart is part of it"), ("c", 1, "Rain leads to floods!")], "content_id string, chunk_index int, chunk_text string")
    got = {(r.subject, r.predicate.rsplit("/")[-1], r.object) for r in extraction.extract(chunks, ontology.synonyms(spark)).collect()}
    assert {("caffeine", "increases", "alertness"), ("rain", "causes", "floods")} <= got


def test_extraction_from_sentences_of_any_length(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    texts = [f"{filler} caffeine leads to alertness {filler}. rain boosts growth.", f"caffeine boosts {filler}", f"{filler} boosts alertness", "boosts", "", "of boosts", " ".join(["sun boosts joy and"] * 5_000)]
    synonyms = {"boosts": "p/up", "leads_to": "p/causes", "w7_w8_w9": "p/odd"}
    chunks = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "content_id string, chunk_index int, chunk_text string")
    want = Counter()
    for i, t in enumerate(texts):
        for sentence in re.split(r"[.!?\n]+\s*", t):
            w = re.findall(r"[\w-]+", sentence)
            want.update((i, w[k - 1], synonyms[p], w[k + n]) for n in (1, 2, 3) for k in range(1, len(w) - n) if (p := "_".join(w[k : k + n])) in synonyms)
    got = extraction.extract(chunks, spark.createDataFrame(list(synonyms.items()), "synonym string, predicate string")).collect()
    assert want[0, "caffeine", "p/causes", "alertness"] == 1 and want[6, "sun", "p/up", "joy"] == 5_000
    assert Counter((r.chunk_index, r.subject, r.predicate, r.object) for r in got) == want


def test_run(spark):
    rows = [("c1", "http://x/1", "Caffeine boosts alertness. Box contains ball.", None, "T", "web", dt.datetime(2024, 1, 1)), ("c2", "http://x/2", "", "caffeine reduces alertness.", None, "web", dt.datetime(2024, 1, 2))]
    content = spark.createDataFrame(rows, "content_id string, url string, raw_text string, summary string, title string, source_type string, ingested_at timestamp")
    store = spark.createDataFrame([], QUADS)
    provenance = spark.createDataFrame([], "triple_hash string, source_url string, subject string, predicate string, object string, confidence double, ingested_at timestamp")
    got = ingestion.run(content, store, provenance, hashing_embedder(8), gazetteer=spark.createDataFrame([("Caffeine", "CHEM", "Q1")], "name string, label string, wikidata_id string"))
    held = {(r.graph, r.s.rsplit("/")[-1], r.p.rsplit("/")[-1], r.o.rsplit("/")[-1]) for r in got.batch.quads.collect()}
    assert {("extracted", "caffeine", "increases", "alertness"), ("extracted", "caffeine", "decreases", "alertness"), ("inferred", "ball", "part_of", "box")} <= held
    assert got.batch.contradictions.count() == 2
    counters = {r.content_id: r for r in got.counters.collect()}
    assert (counters["c1"].chunks_total, counters["c1"].chunks_embedded, counters["c1"].entities_linked) == (1, 1, 1)


def test_entities_and_counters_of_a_run(spark):
    """Near labels of one run are one entity; only new triples count, and what objects name still comes in as a fallback."""
    rows = [("c1", "http://x/1", "Caffeine boosts alertness. Coffee boosts alertnes. It helps Rome boosts Paris.", None, "T", "web", dt.datetime(2024, 1, 1))]
    content = spark.createDataFrame(rows, "content_id string, url string, raw_text string, summary string, title string, source_type string, ingested_at timestamp")
    provenance = spark.createDataFrame([], "triple_hash string, source_url string, subject string, predicate string, object string, confidence double, ingested_at timestamp")
    embed = lambda c: F.array(F.when(F.col(c).startswith("alert"), 1.0).otherwise(0.0), F.lit(0.0))
    none = spark.createDataFrame([], "uri string, label string, embedding array<double>")
    got = ingestion.run(content, spark.createDataFrame([], QUADS), provenance, embed, entities=none)
    short = lambda x: x.rsplit("/")[-1]
    held = {(short(r.s), short(r.p), short(r.o)) for r in got.batch.quads.where("graph = 'extracted'").collect()}
    assert {("caffeine", "increases", "alertness"), ("coffee", "increases", "alertness"), ("rome", "increases", "paris")} <= held
    assert {("paris", "label", "Paris")} <= {(s, p.rsplit("#")[-1], o) for s, p, o in held} and not any(s == "rome" and p.endswith("label") for s, p, o in held)
    uris = {short(r.uri) for r in got.entities.collect()}
    assert {"caffeine", "coffee", "alertness", "rome", "paris"} <= uris and "alertnes" not in uris
    first = got.counters.first()
    assert first.triples_created == len(held) and first.entities_resolved >= first.triples_created
    again = ingestion.run(content, got.batch.quads, got.batch.provenance, embed, entities=got.entities)
    assert again.counters.first().triples_created == 0 and again.entities.count() == got.entities.count()

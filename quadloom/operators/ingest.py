"""From knowledge items to quads: expansion, then one batch of the ingest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.functions.terms import target_graph, to_entity_uri, to_predicate_uri, triple_hash
from quadloom.operators import conflicts, evidence, quads, reasoning
from quadloom.operators.common import cut_lineage, small
from quadloom.operators.upsert import upsert
from quadloom.plans.ontology import uri

# Predicates that events and entities expand to.
OCCURRED_AT, TYPE, LABEL = uri("occurredAt"), "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label"


def expand_items(items: DataFrame) -> DataFrame:
    """Triples of items (seq, shape, subject, predicate, object, rdf_type, label, occurred_at, properties, confidence, knowledge_type):
    one of a triple, one and its properties of an event, two and its properties of an entity. Subjects and predicates are URIs."""
    row = lambda p, o: F.struct(p.alias("p"), o.alias("o"))
    shape = F.col("shape")
    own = F.when(shape == "triple", F.array(row(F.col("predicate"), F.col("object")))).when(shape == "event", F.array(row(F.lit(OCCURRED_AT), F.col("occurred_at")))).otherwise(F.array(row(F.lit(TYPE), F.col("rdf_type")), row(F.lit(LABEL), F.col("label"))))
    more = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("p"), e["value"].alias("o")))
    every = F.when((shape == "triple") | F.col("properties").isNull(), own).otherwise(F.concat(own, more))
    out = items.select("seq", to_entity_uri("subject").alias("s"), "confidence", "knowledge_type", F.posexplode(every).alias("n", "x"))
    return out.select("seq", "n", "s", to_predicate_uri("x.p").alias("p"), "x.o", "confidence", "knowledge_type")


def prior_values(triples: DataFrame, store: DataFrame) -> DataFrame:
    """The stored triples (triple_hash, s, p, o) that new ones change: of a subject and predicate the first stored value in the alphabet, where a new one is another."""
    keys = triples.select("s", "p", F.col("o").alias("_new")).distinct()
    first = store.join(keys.select("s", "p").distinct(), ["s", "p"], "left_semi").groupBy("s", "p").agg(F.min(F.struct("o", "o_kind")).alias("_old"))
    changed = first.join(keys, ["s", "p"]).where("_old.o <> _new").select("s", "p", "_old.o", "_old.o_kind").distinct()
    return changed.select(triple_hash("s", "p", "o", F.col("o_kind") == "iri").alias("triple_hash"), "s", "p", "o")


def capped_chunks(chunks: DataFrame, most: int = 50) -> DataFrame:
    """The first chunks of each content, with how many there were where some were left out."""
    n = F.count("*").over(W.partitionBy("content_id"))
    return chunks.withColumn("chunks_capped_from", F.when(n > most, n)).where(F.col("chunk_index") < most)


@dataclass
class Ingested:
    quads: DataFrame
    provenance: DataFrame
    triples: DataFrame
    contradictions: DataFrame
    inferred: DataFrame


def ingest(triples: DataFrame, store: DataFrame, provenance: DataFrame, inverses: DataFrame, transitive: DataFrame, opposites: DataFrame, *, apply_penalty: bool = True, max_depth: int = 3) -> Ingested:
    """One batch: normalise, retract what rests on values that change, insert, keep provenance, find contradictions, combine evidence, infer.

    triples: seq, s, p, o, confidence, knowledge_type, source_url, source_type, extractor, ingested_at. The batch sees the store
    as it was and its own earlier rows; of a key the first row's annotations stay, of a source the last row's.
    apply_penalty: new triples lose to the strongest contradiction; off, it is found and not applied."""
    own = quads.normalised(triples).withColumn("graph", target_graph("extractor"))
    own = cut_lineage(own)
    store = reasoning.retract(store, prior_values(own, quads.pattern(store)))[0]
    grown, marked = quads.insert(store, own)
    known = upsert(provenance, own.select(*(c for c in provenance.columns if c in own.columns and c not in ("subject", "predicate", "object")), F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "seq"), ["triple_hash", "source_url"], "seq", keep=("ingested_at",))
    probe = marked.select("seq", "triple_hash", "s", "p", "o", "is_new").distinct()
    against = conflicts.find_contradictions(probe, quads.pattern(grown)).select("seq", "triple_hash", "is_new", "existing")
    against = against.unionByName(conflicts.find_opposites(probe, quads.pattern(grown), opposites).select("seq", "triple_hash", "is_new", "existing"))
    combined = evidence.combine_evidence(known.join(own.select("triple_hash").distinct(), "triple_hash", "left_semi"), ["triple_hash"])
    # The penalty needs the strongest contradiction alone, so the pairs are found only if the caller looks at them.
    new = probe.where("is_new")
    other = conflicts.strongest_other(new.select("triple_hash", "s", "p", "o"), quads.pattern(grown).join(small(new.select("s", "p").distinct()), ["s", "p"], "left_semi")).select("triple_hash", "existing")
    opposite = conflicts.find_opposites(new, quads.pattern(grown), opposites).select("triple_hash", "existing")
    worst = conflicts.strongest(other.unionByName(opposite), ["triple_hash"])
    confidence = combined.join(worst, "triple_hash", "left").withColumn("confidence", evidence.penalised(F.col("combined"), F.col("existing")) if apply_penalty else F.col("combined"))
    updates = own.select("triple_hash", "s", "p", "o").distinct().join(confidence.select("triple_hash", "confidence"), "triple_hash").withColumn("seq", F.lit(0))
    settled = cut_lineage(quads.update_confidence(grown, updates))
    triggers = settled.join(own.select("graph", "s", "p", "o").distinct(), ["graph", "s", "p", "o"], "left_semi").select("s", "p", "o", "o_kind", "confidence", "triple_hash").dropDuplicates(["triple_hash"])
    derived = reasoning.infer(triggers, settled, inverses, transitive, max_depth)
    added = derived.select(F.lit("inferred").alias("graph"), "s", "p", "o", "o_kind", "triple_hash", "confidence", F.lit("inferred").alias("knowledge_type"), F.col("method").alias("inference_method"), "derived_from").dropDuplicates(["triple_hash"])
    # Derived triples have the source of the triple that led to them, and their rule as extractor.
    cause = own.groupBy(F.col("triple_hash").alias("trigger")).agg(F.min(F.struct("seq", "source_url", "source_type", "ingested_at")).alias("by"))
    of_rules = derived.join(cause, "trigger").select("triple_hash", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "by.source_url", "by.source_type", F.concat(F.lit("inference:"), "method").alias("extractor"), "confidence", "by.ingested_at", "by.seq")
    known = upsert(known, of_rules, ["triple_hash", "source_url"], "seq", keep=("ingested_at",))
    return Ingested(settled.unionByName(added, allowMissingColumns=True), known, marked, against, derived)

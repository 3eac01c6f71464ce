"""From accepted contents to quads: chunks, vectors, entities, triples, one ingested batch, and the jobs' counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_object_entity, is_uri
from quadloom.operators import extraction, ingest, resolution
from quadloom.operators.common import cut_lineage
from quadloom.plans import ontology
from quadloom.sources.chunking import chunk_documents


@dataclass
class Run:
    chunks: DataFrame
    mentions: DataFrame
    aliases: DataFrame
    batch: ingest.Ingested
    counters: DataFrame
    entities: DataFrame


def run(content: DataFrame, store: DataFrame, provenance: DataFrame, embed: Callable[[str], Column], *, gazetteer: DataFrame | None = None, extractor: Callable[[DataFrame], DataFrame] | None = None, max_chunks: int = 50, max_depth: int = 3, entities: DataFrame | None = None) -> Run:
    """Runs all phases over the contents (content_id, url, raw_text, summary, title, source_type, ingested_at).

    embed: from a column's name to its vectors; extractor: from chunks to triples, else the built-in rule over the ontology's synonyms (a column
    `rejected` says why a triple isn't taken). Recognised entities that no triple names come in as fallbacks. entities (uri, embedding): known ones, to
    which subjects and objects that look like entities are resolved by alias or nearness, and to those that earlier labels of the run made; the
    result has them all. Predicates are resolved likewise, beginning with the ontology's."""
    spark = content.sparkSession
    own = content.withColumn("text", extraction.chosen_text(F.col("raw_text"), F.col("summary"), F.col("title"))).where("text IS NOT NULL")
    chunks = ingest.capped_chunks(chunk_documents(own), max_chunks)
    chunks = cut_lineage(chunks.withColumns({"chunk_id": F.concat_ws("#", "content_id", "chunk_index"), "embedding": embed("chunk_text")}))
    mentions = cut_lineage(extraction.recognise(chunks, gazetteer))
    aliases = resolution.aliases(resolution.coreference_groups(mentions.withColumn("pos", F.struct("content_id", "chunk_index", "pos"))))
    found = extractor(chunks) if extractor else extraction.extract(chunks, ontology.synonyms(spark))
    if "rejected" not in found.columns:
        found = found.withColumn("rejected", F.lit(None).cast("string"))
    every = cut_lineage(resolution.canonicalise(found, aliases, ("subject", "object")))
    every_triple = every.where("rejected IS NULL").drop("rejected").unionByName(_fallbacks(mentions, every), allowMissingColumns=True)
    found, entities = _resolved(cut_lineage(every_triple), embed, entities, aliases)
    found = cut_lineage(found)
    source = content.select("content_id", F.col("url").alias("source_url"), "source_type", "ingested_at")
    triples = found.join(source, "content_id").select(F.monotonically_increasing_id().alias("seq"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), "confidence", F.lit("claim").alias("knowledge_type"), "source_url", "source_type", F.lit("llm").alias("extractor"), "ingested_at")
    triples = cut_lineage(triples)
    batch = ingest.ingest(triples, store, provenance, ontology.inverses(spark), ontology.transitive(spark), ontology.opposites(spark), max_depth=max_depth)
    new = batch.triples.where("is_new").join(content.select("content_id", F.col("url").alias("source_url")), "source_url")
    return Run(chunks, mentions, aliases, batch, extraction.job_counters(chunks, chunks, every, every, mentions, new, found), entities)


def _fallbacks(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """Type and label of the recognised entities that no extracted triple of their chunk has as its subject."""
    named = found.select("content_id", "chunk_index", F.col("subject").alias("name"))
    key = F.struct("content_id", "chunk_index")
    own = mentions.select(key.alias("chunk_index"), "text", "label").distinct()
    names = named.select(key.alias("chunk_index"), F.replace("name", F.lit("_"), F.lit(" ")).alias("name"))
    missed = resolution.missed_entities(own, names).select("chunk_index.content_id", "chunk_index.chunk_index", F.col("text").alias("subject"), "rdf_type", "text", "confidence")
    row = lambda p, o: F.struct(F.lit(p).alias("predicate"), F.col(o).alias("object"))
    return missed.select("content_id", "chunk_index", "subject", F.explode(F.array(row(ingest.TYPE, "rdf_type"), row(ingest.LABEL, "text"))).alias("x"), "confidence").select("content_id", "chunk_index", "subject", "x.*", "confidence")


def _resolved(found: DataFrame, embed: Callable[[str], Column], entities: DataFrame | None, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples with subjects, predicates and objects that are entities resolved to URIs, and all entities then known (uri, label, embedding)."""
    spark = found.sparkSession
    place = F.struct("content_id", "chunk_index", "subject", "predicate", "object")
    # Within a triple the subject comes before the object.
    labels = lambda c, n: found.where(~is_uri(c)).select(F.col(c).alias("label"), F.struct(place.alias("of"), F.lit(n).alias("n")).alias("seq"))
    once = lambda df: cut_lineage(df.groupBy("label").agg(F.min("seq").alias("seq")).withColumn("embedding", embed("label")))
    known = ontology.predicates(spark).select(F.col("predicate").alias("uri"), "label").withColumn("embedding", embed("label")).drop("label")
    p, _ = resolution.resolve_predicates(once(labels("predicate", 0)), known, ontology.synonyms(spark))
    out = found.join(p.select(F.col("label").alias("predicate"), F.col("uri").alias("_p")), "predicate", "left").withColumn("predicate", F.coalesce("_p", "predicate")).drop("_p")
    if entities is None:
        return out, spark.createDataFrame([], "uri string, label string, embedding array<double>")
    names = once(labels("subject", 0).union(labels("object", 1).where(is_object_entity("label"))))
    e, added = resolution.resolve_entities(names, entities, aliases)
    for c in ("subject", "object"):
        to = e.select(F.col("label").alias(c), F.col("uri").alias("_uri"))
        # A literal stays one, though a subject may have the same text.
        resolved = F.col("_uri") if c == "subject" else F.when(is_object_entity(c), F.col("_uri"))
        out = out.join(to, c, "left").withColumn(c, F.coalesce(resolved, c)).drop("_uri")
    return out, entities.unionByName(cut_lineage(added.select("uri", "label", F.col("embedding").cast(entities.schema["embedding"].dataType))), allowMissingColumns=True)

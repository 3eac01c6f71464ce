"""Table schemas as DDL, and the names of graphs and states."""

from __future__ import annotations

# Named graphs, by trust, and the states of an ingestion job.
GRAPHS = ("ontology", "asserted", "extracted", "inferred", "federated")
JOB_STATES = ("accepted", "embedding", "analyzing", "extracting", "resolving", "processing", "completed", "failed")
DONE_STATES = ("completed", "failed")

QUADS = """graph string, s string, p string, o string, o_kind string, triple_hash string, confidence double,
    knowledge_type string, valid_from string, valid_until string, inference_method string, derived_from array<string>"""
PROVENANCE = """triple_hash string, subject string, predicate string, object string, source_url string, source_type string,
    extractor string, confidence double, ingested_at timestamp, valid_from string, valid_until string, metadata string, chunk_id string"""
CONTENT = "content_id string, url string, title string, summary string, raw_text string, source_type string, tags array<string>, metadata string, ingested_at timestamp"
CHUNKS = "chunk_id string, content_id string, chunk_index int, chunk_text string, section_header string, char_start int, char_end int, embedding array<float>"
JOBS = """job_id string, content_id string, status string, chunks_total int, chunks_embedded int, chunks_extracted int,
    chunks_failed int, triples_created int, entities_resolved int, error string, created_at timestamp, updated_at timestamp"""
OUTBOX = """id long, triple_hash string, operation string, subject string, predicate string, object string, confidence double,
    knowledge_type string, valid_from string, valid_until string, graph string, payload string, created_at timestamp, applied_at timestamp"""
ALIASES = "alias string, canonical string"
ENTITIES = "uri string, label string, rdf_type string, embedding array<float>"

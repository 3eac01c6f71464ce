"""Prompts for extraction as columns over chunks: templates with fields, overrides by domain, hints of recognised entities, truncated texts."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a chunk that go into a prompt.
MOST_CHARS = 4000
KINDS = ("entities", "relations", "combined")
#: Used where no file has a kind's base template.
DEFAULTS = {
    "entities": 'List the entities and the dated events of the text.\n{context}\nAnswer in JSON alone: {{"entities": [{{"uri": "...", "rdf_type": "...", "label": "..."}}], "events": [{{"subject": "...", "occurred_at": "YYYY-MM-DD"}}]}}\n\nText:\n{text}',
    "relations": 'Say how the entities of the text relate.\n{context}\nEntities: {entities}\nPredicates: {predicates}\nAnswer in JSON alone: {{"relations": [{{"subject": "...", "predicate": "...", "object": "...", "confidence": 0.0}}]}}\n\nText:\n{text}',
    "combined": 'List the entities of the text and how they relate.\n{context}\nPredicates: {predicates}\nAnswer in JSON alone: {{"entities": [], "relations": []}}\n\nText:\n{text}',
}


def templates(spark: SparkSession, path: str) -> dict[str, str]:
    """The templates of a folder of .txt files by their names (`base_entities`, `health_relations`): a few short texts, for the driver."""
    found = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return {r.name: r.value for r in found.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("name"), "value").collect()}


def chosen(kind: str, held: Mapping[str, str], domains: list[str]) -> tuple[str, bool]:
    """The template of a kind, and whether it is a domain's own: that of the first domain that has one (entities have none), else the base one, else the default."""
    if kind not in KINDS:
        raise ValueError(f"no prompts of kind {kind}")
    for domain in domains if kind != "entities" else ():
        if domain != "base" and held.get(f"{domain}_{kind}"):
            return held[f"{domain}_{kind}"], True
    return held.get(f"base_{kind}", DEFAULTS[kind]), False


def filled(template: str, **fields: Column) -> Column:
    """A template's text with columns in place of its fields; doubled braces stand for braces."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if field is not None:
            if field not in fields:
                raise ValueError(f"no field {field}")
            parts.append(F.coalesce(fields[field], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def with_hints(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks with the entities recognised in them (content_id, chunk_index, pos, text, label) as `hints`, in their order; an empty list if there are none."""
    hint = F.struct("pos", "text", "label")
    lists = mentions.groupBy("content_id", "chunk_index").agg(F.array_sort(F.collect_list(hint)).alias("hints"))
    none = F.array().cast(lists.schema["hints"].dataType)
    return chunks.join(lists, ["content_id", "chunk_index"], "left").withColumn("hints", F.coalesce("hints", none))


def context(chunks: DataFrame) -> Column:
    """Title, kind of source and hints, those that a chunk has."""
    line = lambda c, said: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(said), F.col(c), F.lit("\n"))) if c in chunks.columns else F.lit(None)
    parts = [line("title", "Title: "), line("source_type", "Source type: ")]
    if "hints" in chunks.columns:
        listed = F.array_join(F.transform("hints", lambda h: F.concat(F.lit("- "), h["text"], F.lit(" ("), h["label"], F.lit(")\n"))), "")
        parts.append(F.when(F.size("hints") > 0, F.concat(F.lit("\nNLP-detected entities (confirm, correct, or add to these):\n"), listed)))
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def prompts(chunks: DataFrame, kind: str, *, held: Mapping[str, str] | None = None, domains: list[str] | None = None, predicates: DataFrame | None = None, most_chars: int = MOST_CHARS) -> DataFrame:
    """Chunks (chunk_text, and title, source_type, hints, entities where they have them) with the prompt of a kind.

    held: templates by name; domains: those whose own templates and predicates count, in order (none: every predicate counts, no domain's template); predicates: the
    ontology's (label, domain), some dozens. Texts are cut after most_chars characters. A domain's own template of relations gets no context."""
    template, own = chosen(kind, held or {}, domains or [])
    labels: list[str] = []
    if predicates is not None and kind != "entities":
        known = predicates.select("domain", "label").orderBy("domain", "predicate").collect()
        labels = [r.label for d in domains for r in known if r.domain == d] if domains else [r.label for r in known]
    entities = F.array_join("entities", ", ") if "entities" in chunks.columns else F.lit("")
    said = F.lit("") if own and kind == "relations" else context(chunks)
    text = F.left(F.coalesce("chunk_text", F.lit("")), F.lit(most_chars))
    return chunks.withColumn("prompt", filled(template, context=said, entities=entities, predicates=F.lit(", ".join(labels)), text=text))

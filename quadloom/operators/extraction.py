"""What ingestion takes from contents and from extractors' answers, and the built-in stand-ins for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.text import first_json_object
from quadloom.functions.terms import slugify
from quadloom.operators.common import small

_ITEM = "subject string, predicate string, object string, uri string, rdf_type string, label string, occurred_at string, properties map<string,string>, confidence double, knowledge_type string"
_STRUCT = f"struct<{_ITEM.replace(' ', ':').replace(',:', ', ')}>"
KEYS = ("entities", "relations", "items")


def _list_of(c: str) -> Column:
    """Items as a list, or the values of an object of items; null for anything else."""
    as_object = F.map_values(F.from_json(c, f"map<string,{_STRUCT}>"))
    return F.when(F.trim(c).startswith("{"), as_object).otherwise(F.from_json(c, f"array<{_STRUCT}>"))


def chosen_text(raw: Column, summary: Column, title: Column) -> Column:
    """The first of them that isn't empty."""
    filled = [F.when(F.trim(c) != "", c) for c in (raw, summary, title)]
    return F.coalesce(*filled)


def items_of(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Items of answers in JSON (entities, relations or items; other columns stay), by shape, with the reason for which one is rejected.

    The shape is told by the fields: a uri makes an entity, a time an event, else it is a triple. Missing confidences take the shape's default."""
    parsed = answers.withColumn("_a", F.from_json(first_json_object(text), ", ".join(f"{k} string" for k in KEYS)))
    none = F.expr(f"cast(array() as array<{_STRUCT}>)")
    every = F.concat(*(F.coalesce(_list_of(f"_a.{k}"), none) for k in KEYS))
    others = [c for c in answers.columns if c != text]
    out = parsed.select(*others, F.posexplode(every).alias("item_index", "i")).select(*others, "item_index", "i.*")
    shape = F.when(F.col("uri").isNotNull(), "entity").when(F.col("occurred_at").isNotNull(), "event").otherwise("triple")
    out = out.withColumn("shape", shape)
    default = {"entity": 0.95, "event": 1.0, "triple": 0.8}
    kind = {"entity": "entity", "event": "event", "triple": "claim"}
    pick = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("shape")]
    out = out.withColumns({"subject": F.coalesce("subject", "uri"), "confidence": F.coalesce("confidence", pick(default)), "knowledge_type": F.coalesce("knowledge_type", pick(kind))})
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(~F.col("confidence").between(0, 1), "confidence out of range").when(missing("subject"), "no subject")
    reason = reason.when((F.col("shape") == "triple") & (missing("predicate") | missing("object")), "incomplete triple").when((F.col("shape") == "entity") & missing("label"), "no label")
    return out.drop("uri").withColumn("rejected", reason)


def sentence_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(c, r"[.!?]+(?:\s+|$)"), lambda s: F.trim(s) != ""))


def recognise(chunks: DataFrame, gazetteer: DataFrame | None = None, text: str = "chunk_text") -> DataFrame:
    """A stand-in for a model: runs of capitalised words as entities of each chunk, linked where the gazetteer (name, label, wikidata_id) knows them.

    content_id, chunk_index, pos, text, label, wikidata_id."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][\p{L}0-9]+(?:\s[A-Z][\p{L}0-9]+)*"), F.lit(0))
    rows = chunks.select("content_id", "chunk_index", F.posexplode(found).alias("pos", "text"))
    if gazetteer is None:
        return rows.withColumns({"label": F.lit("MISC"), "wikidata_id": F.lit(None).cast("string")})
    known = gazetteer.select(F.lower("name").alias("_name"), "label", "wikidata_id")
    return rows.join(known, F.lower("text") == F.col("_name"), "left").drop("_name").withColumn("label", F.coalesce("label", F.lit("MISC")))


def extract(chunks: DataFrame, synonyms: DataFrame, text: str = "chunk_text") -> DataFrame:
    """A stand-in for a model: `X predicate Y` in a sentence, for the synonyms (synonym, predicate) of the ontology.

    content_id, chunk_index, subject, predicate, object, confidence."""
    sentences = chunks.select("content_id", "chunk_index", F.explode(F.split(text, r"[.!?\n]+\s*")).alias("sentence"))
    words = sentences.withColumn("words", F.regexp_extract_all("sentence", F.lit(r"[\p{L}0-9_-]+"), F.lit(0))).where("size(words) >= 3")
    # One- to three-word phrases with a word on either side meet the synonyms in an equi-join; a row has its own few words, however long the sentence.
    around = F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda i: F.struct(F.element_at("words", i - 1).alias("before"), F.slice("words", i, 4).alias("next")))
    spans = words.select("content_id", "chunk_index", F.explode(around).alias("span")).select("content_id", "chunk_index", "span.*")
    spans = spans.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).where("n < size(next)")
    phrase = F.lower(F.array_join(F.slice("next", F.lit(1), F.col("n")), "_"))
    hits = spans.withColumn("synonym", phrase).join(small(synonyms), "synonym")
    return hits.select("content_id", "chunk_index", slugify("before").alias("subject"), "predicate", slugify(F.element_at("next", F.col("n") + 1)).alias("object"), F.lit(0.5).alias("confidence"))


def job_counters(chunks: DataFrame, embedded: DataFrame, extracted: DataFrame, items: DataFrame, mentions: DataFrame, new: DataFrame, triples: DataFrame) -> DataFrame:
    """One row for each content: chunks, chunks embedded and extracted, those that gave nothing, items rejected, entities linked and resolved, new triples."""
    n = lambda df, name, what=F.count("*"): df.groupBy("content_id").agg(what.cast("int").alias(name))
    parts = [n(chunks, "chunks_total"), n(embedded.where("embedding IS NOT NULL"), "chunks_embedded"), n(extracted, "chunks_extracted", F.countDistinct("chunk_index")), n(items.where("rejected IS NOT NULL"), "items_rejected"), n(mentions.where("wikidata_id IS NOT NULL"), "entities_linked"), n(new, "triples_created"), n(triples, "entities_resolved")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "content_id", "left")
    return out.na.fill(0).withColumn("chunks_skipped", F.col("chunks_total") - F.col("chunks_extracted"))

"""Entity and predicate resolution: aliases, coreference groups, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_uri, slugify, to_entity_uri, to_predicate_uri
from quadloom.operators.common import cut_lineage, first_by, numbered, small
from quadloom.operators.retrieval import knn_join

ENTITY_LEAST, PREDICATE_LEAST = 0.85, 0.90


def coreference_groups(mentions: DataFrame) -> DataFrame:
    """wikidata_id, canonical and aliases of mentions (pos, text, wikidata_id): the first slug of each id, and the others in order."""
    slugs = mentions.where("wikidata_id IS NOT NULL").groupBy("wikidata_id", slugify("text").alias("slug")).agg(F.min("pos").alias("pos"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "slug"))), lambda x: x["slug"])
    groups = slugs.groupBy("wikidata_id").agg(listed.alias("slugs"))
    return groups.select("wikidata_id", F.col("slugs")[0].alias("canonical"), F.expr("slice(slugs, 2, size(slugs))").alias("aliases"))


def aliases(groups: DataFrame) -> DataFrame:
    """alias and canonical; of an alias with several groups the last id's counts."""
    pairs = groups.select("wikidata_id", F.explode("aliases").alias("alias"), "canonical")
    return first_by(pairs, ["alias"], F.desc("wikidata_id")).select("alias", "canonical")


def canonicalise(triples: DataFrame, alias_table: DataFrame, columns: tuple[str, ...] = ("s", "o")) -> DataFrame:
    """Terms replaced by their canonical ones, whatever their case."""
    table = small(alias_table)
    for c in columns:
        found = table.select(F.lower("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
        triples = triples.join(found, F.lower(c) == F.col("_alias"), "left").withColumn(c, F.coalesce("_canonical", c)).drop("_alias", "_canonical")
    return triples


def missed_entities(found: DataFrame, extracted: DataFrame) -> DataFrame:
    """Recognised entities (chunk_index, text, label) that no extracted item of their chunk (chunk_index, name) names, as fallbacks."""
    named = extracted.select("chunk_index", F.lower("name").alias("_name")).distinct()
    out = found.withColumn("_name", F.lower("text")).join(named, ["chunk_index", "_name"], "left_anti").drop("_name")
    return out.withColumns({"rdf_type": F.concat(F.lit("schema:"), "label"), "confidence": F.lit(0.5)})


def leaders(labels: DataFrame, least: float) -> DataFrame:
    """The labels (label, ord, embedding) that make something new when they come one after the other: those not near an earlier one that did.

    A round settles at once all labels without an unsettled earlier neighbour, and those near them; a neighbour is found block by block,
    one row a label, so dense groups of labels make no table of pairs. Ends when all are settled, after a few rounds unless
    labels form long chains. A label without a vector is near to none."""
    as_query = lambda df: df.select(F.col("label").alias("query_id"), "ord", "embedding")
    as_item = lambda df: df.select(F.col("label").alias("item_id"), "ord", "embedding")
    left, found = cut_lineage(labels.select("label", "ord", "embedding")), None
    while not left.isEmpty():
        waiting = cut_lineage(knn_join(as_query(left), as_item(left), 1, least, earlier=True).select(F.col("query_id").alias("label")))
        new = cut_lineage(left.join(waiting, "label", "left_anti"))
        found = new if found is None else found.unionByName(new)
        rest = left.join(waiting, "label", "left_semi")
        near = knn_join(as_query(rest), as_item(new), 1, least, earlier=True).select(F.col("query_id").alias("label"))
        left = cut_lineage(rest.join(near, "label", "left_anti"))
    return left if found is None else found


def _in_order(own: DataFrame, items: DataFrame, least: float, new_uri: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """uri and how of labels (label, ord, embedding): the nearest of the items (uri, embedding) and of what earlier labels made, else a new one.

    Also what is to be added (uri, label, embedding): of labels with one URI the first one's vector counts."""
    own = cut_lineage(own)
    query = lambda df: df.select(F.col("label").alias("query_id"), "ord", "embedding")
    old = cut_lineage(knn_join(query(own).drop("ord"), items.select(F.col("uri").alias("item_id"), "embedding"), 1, least).select(F.col("query_id").alias("label"), F.col("item_id").alias("_old"), F.col("similarity").alias("_by_old")))
    first = leaders(own.join(old, "label", "left_anti"), least)
    made = first.select("label", "ord", new_uri("label").alias("uri"), "embedding")
    among = knn_join(query(own.join(first.select("label"), "label", "left_anti")), made.select(F.col("label").alias("item_id"), "ord", "embedding"), 1, least, earlier=True)
    near = among.join(made.select(F.col("label").alias("item_id"), "uri"), "item_id").select(F.col("query_id").alias("label"), F.col("uri").alias("_near"), F.col("similarity").alias("_by_near"))
    out = own.select("label").join(old, "label", "left").join(near, "label", "left").join(made.select("label", F.col("uri").alias("_made")), "label", "left")
    # The nearer wins, the older on a tie.
    nearest = F.when(F.col("_by_near") > F.coalesce("_by_old", F.lit(-2.0)), F.col("_near")).otherwise(F.col("_old"))
    out = out.select("label", F.coalesce("_made", nearest).alias("uri"), F.when(F.col("_made").isNotNull(), "new").otherwise("near").alias("how"))
    added = first_by(made.join(items.select("uri"), "uri", "left_anti"), ["uri"], "ord").select("uri", "label", "embedding")
    return out, added


def _ordered(labels: DataFrame) -> DataFrame:
    """Labels once each, whatever their case, with the place of their first row: by seq where labels have it, else by label."""
    own = labels.withColumn("ord", F.struct(F.col("seq") if "seq" in labels.columns else F.lit(0).alias("seq"), "label"))
    first = own.groupBy(F.lower("label").alias("_key")).agg(F.min_by(F.struct("label", "embedding"), "ord").alias("x"), F.min("ord").alias("_at"))
    # Places as numbers, so that matrices of them can be compared: ranges of the order first, then places within each.
    return numbered(first.select("_key", "x.label", "x.embedding", "_at"), "_at", "ord").drop("_at")


def resolve_entities(labels: DataFrame, entities: DataFrame, alias_table: DataFrame, least: float = ENTITY_LEAST) -> tuple[DataFrame, DataFrame]:
    """uri and how of each label (label, embedding, and seq where there is an order), and the entities to add (uri, label, embedding).

    As if labels came one after the other: by alias, else the nearest of the entities and of those that earlier labels made, else a new
    one. Labels that differ in case alone are one."""
    own = cut_lineage(_ordered(labels))
    known = small(alias_table).groupBy(F.lower("alias").alias("_key")).agg(F.max("canonical").alias("_canonical"))
    by_alias = own.join(known, "_key").select("_key", to_entity_uri("_canonical").alias("uri"), F.lit("alias").alias("how"))
    out, added = _in_order(own.join(known, "_key", "left_anti"), entities, least, to_entity_uri)
    every = by_alias.unionByName(own.join(out, "label").select("_key", "uri", "how"))
    return labels.select("label", F.lower("label").alias("_key")).distinct().join(every, "_key").drop("_key"), added


def resolve_predicates(labels: DataFrame, predicates: DataFrame, synonym_table: DataFrame, least: float = PREDICATE_LEAST) -> tuple[DataFrame, DataFrame]:
    """As resolve_entities(), for predicates: a URI stands for itself, then synonyms, the nearest of the predicates (uri, embedding), a new URI."""
    own = cut_lineage(_ordered(labels))
    fixed = own.join(small(synonym_table), slugify("label") == F.col("synonym"), "left")
    uri = F.when(is_uri("label"), F.col("label")).otherwise(F.col("predicate"))
    fixed = fixed.select("_key", uri.alias("uri"), F.when(is_uri("label"), "uri").otherwise("synonym").alias("how")).where("uri IS NOT NULL")
    out, added = _in_order(own.join(fixed.select("_key"), "_key", "left_anti"), predicates, least, to_predicate_uri)
    every = fixed.unionByName(own.join(out, "label").select("_key", "uri", "how"))
    return labels.select("label", F.lower("label").alias("_key")).distinct().join(every, "_key").drop("_key"), added

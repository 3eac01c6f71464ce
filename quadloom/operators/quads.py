"""The quad store as a DataFrame partitioned by graph: patterns, inserts, counts and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import is_uri, normalised_object, short_type, to_entity_uri, to_predicate_uri, triple_hash
from quadloom.operators.common import first_by, small

KEY = ["graph", "s", "p", "o"]


def pattern(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, graphs: list[str] | None = None, annotated: bool = True) -> DataFrame:
    """Quads that match the given terms; an empty subject or predicate leaves it open, an empty object doesn't.

    graphs prunes partitions; annotated drops quads without a confidence."""
    conditions: list[Column] = []
    if s:
        conditions.append(F.col("s") == s)
    if p:
        conditions.append(F.col("p") == p)
    if o is not None:
        conditions.append(F.col("o") == o)
    if graphs:
        conditions.append(F.col("graph").isin(graphs))
    if annotated:
        conditions.append(F.col("confidence").isNotNull())
    for c in conditions:
        quads = quads.where(c)
    return quads


def write(quads: DataFrame, at: str, *, rows: int = 1_000_000) -> None:
    """The store as files in a folder for each graph, so that a restriction to graphs reads theirs alone; a task writes about `rows` of a graph, whatever its subjects."""
    largest = quads.groupBy("graph").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-largest // rows))
    quads.repartition("graph", F.pmod(F.xxhash64("s", "p", "o"), F.lit(groups))).sortWithinPartitions("graph", "s", "p").write.partitionBy("graph").parquet(at)


def by_hash(quads: DataFrame, *hashes: str) -> DataFrame:
    """The quads with one of the hashes, in every graph."""
    return quads.where(F.col("triple_hash").isin(*hashes))


def by_uri(table: DataFrame, *uris: str) -> DataFrame:
    """Rows of a table of entities or predicates with one of the URIs."""
    return table.where(F.col("uri").isin(*uris))


def by_hashes(table: DataFrame, hashes: DataFrame) -> DataFrame:
    """As by_hash(), for a table of hashes of any size; a repeated hash gives no row twice."""
    return table.join(small(hashes.select("triple_hash").distinct()), "triple_hash", "left_semi")


def knowledge_query(quads: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    """As pattern(), with labels made into URIs; at least one term is needed, and an object matches as URI or as literal."""
    if not (subject or predicate or object_):
        raise ValueError("give a subject, a predicate or an object")
    out = pattern(quads)
    if subject:
        out = out.where(F.col("s") == to_entity_uri(F.lit(subject)))
    if predicate:
        out = out.where(F.col("p") == to_predicate_uri(F.lit(predicate)))
    if object_:
        out = out.where((F.col("o") == object_) | (F.col("o") == to_entity_uri(F.lit(object_))))
    return out.withColumn("knowledge_type", short_type("knowledge_type"))


def with_hash(quads: DataFrame) -> DataFrame:
    return quads.withColumn("triple_hash", triple_hash("s", "p", "o", F.col("o_kind") == "iri"))


def normalised(triples: DataFrame) -> DataFrame:
    """Labels to URIs, with the object's kind and the triple's hash."""
    out = triples.withColumns({"s": to_entity_uri("s"), "p": to_predicate_uri("p"), "o": normalised_object("o")})
    return with_hash(out.withColumn("o_kind", F.when(is_uri("o"), "iri").otherwise("literal")))


def insert(quads: DataFrame, new: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The quads with the new ones, and the new ones with is_new: the first of its key that its graph doesn't hold.

    A key's first annotations stay; the same triple may be in several graphs."""
    # Of the store only the batch's keys take part.
    held = quads.select(*KEY).join(small(new.select(*KEY).distinct()), KEY, "left_semi").distinct().withColumn("_held", F.lit(True))
    marked = new.join(held, KEY, "left")
    first = first_by(marked, KEY, F.col(order)).select(*KEY, F.col(order).alias("_first"))
    marked = marked.join(first, KEY).withColumn("is_new", F.col("_held").isNull() & (F.col(order) == F.col("_first"))).drop("_held", "_first")
    added = marked.where("is_new").drop("is_new", order)
    return quads.unionByName(added.select(*(c for c in quads.columns if c in added.columns)), allowMissingColumns=True), marked


def update_confidence(quads: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets confidences by (s, p, o), in every graph that holds the triple; the last update of a triple (greatest seq) counts."""
    last = first_by(updates, ["s", "p", "o"], F.desc("seq")).select("s", "p", "o", F.col("confidence").alias("_new"))
    return quads.join(small(last), ["s", "p", "o"], "left").withColumn("confidence", F.coalesce("_new", "confidence")).drop("_new").select(*quads.columns)


def counts(quads: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: annotated triples, entities, chunks."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(pattern(quads), "triples").crossJoin(n(entities, "entities")).crossJoin(n(chunks, "content"))


def confidence_histogram(quads: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return pattern(quads).agg(F.count_if(c < 0.3).alias("low"), F.count_if((c >= 0.3) & (c < 0.7)).alias("medium"), F.count_if(c >= 0.7).alias("high"))


def type_breakdown(quads: DataFrame) -> DataFrame:
    return pattern(quads).groupBy(short_type("knowledge_type").alias("knowledge_type")).agg(F.count("*").alias("n"))


def browse(quads: DataFrame, q: str | None = None, subject: str | None = None, knowledge_type: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Filters of the browsing page: an exact subject wins over a text to look for in any term; types match in their exact case."""
    out = pattern(quads)
    if subject:
        out = out.where(F.col("s") == subject)
    elif q:
        found = [F.lower(c).contains(q.lower()) for c in ("s", "p", "o")]
        out = out.where(found[0] | found[1] | found[2])
    if knowledge_type:
        out = out.where(short_type("knowledge_type") == knowledge_type)
    if least is not None:
        out = out.where(F.col("confidence") >= least)
    if most is not None:
        out = out.where(F.col("confidence") <= most)
    return out


PAGE = ["s", "p", "o", "confidence", "knowledge_type", "valid_from", "valid_until"]


def browse_page(found: DataFrame, sort: str = "subject", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, by confidence or by subject from the last to the first; ties by the other terms."""
    by = [F.desc("confidence")] if sort == "confidence" else [F.desc("s")]
    return found.select(*PAGE).distinct().orderBy(*by, "s", "p", "o", "confidence").offset(offset).limit(limit)


def browse_total(found: DataFrame) -> DataFrame:
    """The number of distinct triples, whatever their annotations."""
    return found.select("s", "p", "o").distinct().agg(F.count("*").alias("total"))


def as_of(quads: DataFrame, at: str) -> DataFrame:
    """An addition: quads valid at a date, by their validity; open ends count as valid."""
    return quads.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at)))


def distinct_triples(triples: DataFrame, order: str) -> DataFrame:
    """Of each (s, p, o) the first in order."""
    return first_by(triples, ["s", "p", "o"], F.col(order))

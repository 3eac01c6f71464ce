"""Views that make quads, provenance, jobs and contents of the sample tables; the same as SQL for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.common import TASK_ROWS, dealt
from quadloom.operators.quads import with_hash
from quadloom.plans.ontology import DATA_NS, SCHEMA_NS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by keys to more tasks than a shuffle has by itself, if these would get over TASK_ROWS each; grouping by the keys then moves no row again."""
    n = df.count()
    return dealt(df, list(keys), n) if n > TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def data(prefix: str, c: str) -> Column:
    return F.concat(F.lit(f"{DATA_NS}{prefix}_"), F.col(c).cast("string"))


def ks(name: str) -> Column:
    return F.lit(SCHEMA_NS + name)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item is a source's claim that a supplier supplies a part."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        data("supplier", "l_suppkey").alias("subject"), ks("supplies").alias("predicate"), data("part", "l_partkey").alias("object"),
        F.concat(F.lit("order://"), F.col("l_orderkey").cast("string")).alias("source_url"), F.col("l_returnflag").alias("extractor"),
        F.round(0.5 + F.col("l_discount") * 4, 2).alias("confidence"), F.col("l_shipdate").cast("timestamp").alias("ingested_at"), F.col("l_linenumber").cast("long").alias("chunk"), F.col("l_orderkey").alias("orderkey"),
    )


PROVENANCE = f"""prov AS (SELECT '{DATA_NS}supplier_' || l_suppkey AS subject, '{SCHEMA_NS}supplies' AS predicate, '{DATA_NS}part_' || l_partkey AS object,
    'order://' || l_orderkey AS source_url, l_returnflag AS extractor, round(0.5 + l_discount * 4, 2) AS confidence, l_shipdate AS ingested_at,
    l_linenumber::BIGINT AS chunk, l_orderkey AS orderkey FROM lineitem)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """located_in: customers and suppliers in nations, nations in regions."""
    t = lambda name: table(spark, sf_dir, name)
    customers = t("customer").select(data("customer", "c_custkey").alias("s"), data("nation", "c_nationkey").alias("o"))
    suppliers = t("supplier").select(data("supplier", "s_suppkey").alias("s"), data("nation", "s_nationkey").alias("o"))
    nations = t("nation").select(data("nation", "n_nationkey").alias("s"), data("region", "n_regionkey").alias("o"))
    return customers.union(suppliers).union(nations).select("s", ks("located_in").alias("p"), "o")


LOCATIONS = f"""loc AS (SELECT '{DATA_NS}customer_' || c_custkey AS s, '{SCHEMA_NS}located_in' AS p, '{DATA_NS}nation_' || c_nationkey AS o FROM customer
    UNION ALL SELECT '{DATA_NS}supplier_' || s_suppkey, '{SCHEMA_NS}located_in', '{DATA_NS}nation_' || s_nationkey FROM supplier
    UNION ALL SELECT '{DATA_NS}nation_' || n_nationkey, '{SCHEMA_NS}located_in', '{DATA_NS}region_' || n_regionkey FROM nation)"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quads of all views, with confidence, type and hash."""
    # Grouped by the keys as they are; terms are made of the groups, so that no long terms are shuffled.
    li = table(spark, sf_dir, "lineitem")
    supplies = spread(li.select("l_suppkey", "l_partkey", "l_discount"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max(F.round(0.5 + F.col("l_discount") * 4, 2)).alias("confidence"))
    supplies = supplies.select(data("supplier", "l_suppkey").alias("s"), ks("supplies").alias("p"), data("part", "l_partkey").alias("o"), "confidence")
    part = table(spark, sf_dir, "part")
    brand = F.concat(F.lit(DATA_NS), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_"))
    kind = F.lower("p_type")
    contains = spread(li.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").distinct().select(data("order", "l_orderkey").alias("s"), data("part", "l_partkey").alias("o"))
    row = lambda df, graph, p, confidence, type_, o_kind="iri": df.select(F.lit(graph).alias("graph"), "s", p.alias("p"), "o", F.lit(o_kind).alias("o_kind"), confidence.cast("double").alias("confidence"), F.lit(type_).alias("knowledge_type"))
    parts = [
        row(supplies, "extracted", F.col("p"), F.col("confidence"), "claim"),
        row(contains, "asserted", ks("contains"), F.lit(0.9), "fact"),
        row(locations(spark, sf_dir), "asserted", F.col("p"), F.lit(0.95), "relationship"),
        row(part.select(data("part", "p_partkey").alias("s"), brand.alias("o")), "asserted", ks("is_a"), F.lit(0.8), "relationship"),
        row(part.select(brand.alias("s"), kind.alias("o")).distinct(), "extracted", ks("has_property"), F.lit(0.25), "claim", "literal"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    none = {c: F.lit(None).cast("string") for c in ("valid_from", "valid_until", "inference_method")}
    return with_hash(out).withColumns({**none, "derived_from": F.lit(None).cast("array<string>")})


QUADS = f"""{PROVENANCE}, {LOCATIONS}, quads AS (
    SELECT 'extracted' AS graph, subject AS s, predicate AS p, object AS o, 'iri' AS o_kind, max(confidence)::DOUBLE AS confidence, 'claim' AS knowledge_type FROM prov GROUP BY ALL
    UNION ALL SELECT DISTINCT 'asserted', '{DATA_NS}order_' || l_orderkey, '{SCHEMA_NS}contains', '{DATA_NS}part_' || l_partkey, 'iri', 0.9::DOUBLE, 'fact' FROM lineitem
    UNION ALL SELECT 'asserted', s, p, o, 'iri', 0.95::DOUBLE, 'relationship' FROM loc
    UNION ALL SELECT 'asserted', '{DATA_NS}part_' || p_partkey, '{SCHEMA_NS}is_a', '{DATA_NS}' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), 'iri', 0.8::DOUBLE, 'relationship' FROM part
    UNION ALL SELECT DISTINCT 'extracted', '{DATA_NS}' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '{SCHEMA_NS}has_property', lower(p_type), 'literal', 0.25::DOUBLE, 'claim' FROM part)"""


def return_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's return flags, as values of a single-valued predicate."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount"), "l_orderkey", "l_returnflag")
    flags = li.groupBy("l_orderkey", F.col("l_returnflag").alias("o")).agg(F.max(F.round(0.5 + F.col("l_discount") * 4, 2)).alias("confidence")).withColumn("s", data("order", "l_orderkey"))
    return flags.select(F.lit("extracted").alias("graph"), "s", ks("return_flag").alias("p"), "o", F.lit("literal").alias("o_kind"), "confidence")


RETURN_FLAGS = f"""flags AS (SELECT 'extracted' AS graph, '{DATA_NS}order_' || l_orderkey AS s, '{SCHEMA_NS}return_flag' AS p, l_returnflag AS o, max(round(0.5 + l_discount * 4, 2)) AS confidence FROM lineitem GROUP BY ALL)"""


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks increase and errors decrease what an event names."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'error')")
    p = F.when(F.col("event_type") == "click", ks("increases")).otherwise(ks("decreases"))
    return e.groupBy(data("user", "user_id").alias("s"), p.alias("p"), F.get_json_object("props", "$.k").alias("o")).agg(F.lit(0.7).alias("confidence")).select(F.lit("extracted").alias("graph"), "s", "p", "o", F.lit("literal").alias("o_kind"), "confidence")


EFFECTS = f"""effects AS (SELECT DISTINCT 'extracted' AS graph, '{DATA_NS}user_' || user_id AS s,
    '{SCHEMA_NS}' || CASE event_type WHEN 'click' THEN 'increases' ELSE 'decreases' END AS p, json_extract_string(props, '$.k') AS o, 0.7::DOUBLE AS confidence
    FROM events WHERE event_type IN ('click', 'error'))"""

# What an event says of a job.
_STATUS = {"purchase": "completed", "error": "failed", "signup": "accepted", "view": "embedding", "click": "processing"}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("content_id"), status[F.col("event_type")].alias("status"), F.col("ts").cast("timestamp").alias("created_at"))


JOBS = "jobs AS (SELECT event_id AS job_id, user_id AS content_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END AS status, ts AS created_at FROM events)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contents, each one chunk, without vectors: for what looks at texts alone, which a join would shuffle."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("source_type"), F.array("lang", "source").alias("tags"), F.col("text").alias("chunk_text"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with vectors; these go to the documents with their number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("content_id"), "embedding")
    return chunks(spark, sf_dir).join(vectors, "content_id", "left")


CONTENTS = """contents AS (SELECT doc_id AS content_id, doc_id AS chunk_id, 'doc://' || doc_id AS url, source AS source_type, [lang, source] AS tags, text AS chunk_text, embedding::DOUBLE[] AS embedding
    FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of one predicate with cycles, self-loops and literals: customers to nations, nations to others in rounds, to themselves where they are divisible by 5, and to their names."""
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, s, o, kind="iri": df.select(F.lit("asserted").alias("graph"), s.alias("s"), ks("next_to").alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(0.9).alias("confidence"))
    nation, near = t("nation"), F.concat(F.lit(f"{DATA_NS}nation_"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string"))
    own = data("nation", "n_nationkey")
    parts = [row(t("customer"), data("customer", "c_custkey"), data("nation", "c_nationkey")), row(nation, own, near), row(nation.where("n_nationkey % 5 = 0"), own, own), row(nation, own, F.col("n_name"), "literal")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NEIGHBOURS = f"""near AS (SELECT '{DATA_NS}customer_' || c_custkey AS s, '{DATA_NS}nation_' || c_nationkey AS o, 'iri' AS k FROM customer
    UNION ALL SELECT '{DATA_NS}nation_' || n_nationkey, '{DATA_NS}nation_' || (n_nationkey * 7 + 3) % 25, 'iri' FROM nation
    UNION ALL SELECT '{DATA_NS}nation_' || n_nationkey, '{DATA_NS}nation_' || n_nationkey, 'iri' FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT '{DATA_NS}nation_' || n_nationkey, n_name, 'literal' FROM nation)"""

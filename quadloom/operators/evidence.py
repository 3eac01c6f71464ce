"""Evidence: independent sources combined, and what conflicting claims take away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTY = 0.5


def noisy_or(c: Column | str) -> Column:
    """Aggregate: 1 less the product of what each source leaves open; confidences are clamped to 0 and 1, none give 0."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(1 - F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))), F.lit(0.0))


def combine_evidence(provenance: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """Each key's combined confidence: a single source's as it stands, else Noisy-OR. Partial products come before the shuffle."""
    n = F.count(confidence)
    return provenance.groupBy(*keys).agg(F.when(n == 1, F.max(confidence)).otherwise(noisy_or(confidence)).alias("combined"), n.alias("n_sources"))


def ask_confidence(df: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """Noisy-OR of what was retrieved, null where nothing was."""
    return df.groupBy(*keys).agg(F.when(F.count(confidence) > 0, noisy_or(confidence)).alias("confidence"))


def chat_confidence(df: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(confidence).alias("confidence"))


def penalised(confidence: Column, existing: Column, factor: float = PENALTY) -> Column:
    """The confidence less the share that the strongest conflicting claim takes."""
    return F.when(existing.isNull(), confidence).otherwise(confidence * (1 - existing * factor))


def with_provenance(triples: DataFrame, provenance: DataFrame, newest_first: bool = False, keys: tuple[str, ...] = ("triple_hash",)) -> DataFrame:
    """Each triple with the list of its provenance rows, by time; none give an empty list. For lookups: the list of a triple has all its sources.

    keys: columns that both have and that tell triples apart; hashes are longer to shuffle than most terms, so terms do for whole tables."""
    own = F.struct("ingested_at", "source_url", "source_type", "extractor", "confidence")
    lists = provenance.groupBy(*keys).agg(F.sort_array(F.collect_list(own), not newest_first).alias("provenance"))
    return triples.join(lists, list(keys), "left").withColumn("provenance", F.coalesce("provenance", F.array().cast(lists.schema["provenance"].dataType)))


def provenance_rows(triples: DataFrame, provenance: DataFrame) -> DataFrame:
    """As with_provenance(), as rows: each triple's sources, the newest first by sorting; a triple without any has one row of nulls. No list is gathered, whatever a triple's number of sources."""
    own = provenance.select("triple_hash", "ingested_at", "source_url", "source_type", "extractor", F.col("confidence").alias("source_confidence"))
    return triples.join(own, "triple_hash", "left").orderBy("triple_hash", F.desc_nulls_last("ingested_at"), "source_url")


def evidence(triples: DataFrame, provenance: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that the triples come from."""
    return triples.join(provenance, "triple_hash").join(chunks, "chunk_id")


def changes(provenance: DataFrame, triples: DataFrame, materiality: DataFrame, since, limit: int | None = None, default: float = 0.5) -> DataFrame:
    """Provenance since a date, ranked by materiality times confidence; a confidence of 0 falls through to the next."""
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    out = provenance.where(F.col("ingested_at") >= since).join(triples.withColumnRenamed("confidence", "stored"), ["subject", "predicate", "object"], "left").join(materiality, "predicate", "left")
    confidence = F.coalesce(nonzero("stored"), nonzero("confidence"), F.lit(0.0))
    weight = F.coalesce("materiality", F.lit(default))
    out = out.withColumns({"confidence": confidence, "materiality": weight, "score": weight * confidence})
    out = out.orderBy(F.desc("score"), F.desc("ingested_at"), "triple_hash", "source_url")
    return out if limit is None else out.limit(limit)

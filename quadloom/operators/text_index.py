"""An inverted index for text ranking: postings of terms, so that a question reads its terms' postings and no text.

Words are those of text.analyze(); with stems on, each distinct word is stemmed once and words of one stem are one term. Postings are stored in
folders by the term's hash, sorted by term, so a question reads a few folders, and of their files the row groups with its terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import text
from quadloom.functions.stemming import stem, stems
from quadloom.operators.common import cut_lineage

BUCKETS = 64
#: A frequent word's rows are dealt to so many keys when they are joined to the stems.
SALTS = 16


def postings(chunks: DataFrame, *, stemming: bool = True) -> DataFrame:
    """term, chunk_id and positions (from 0, among the words that count) of all chunks (chunk_id, chunk_text)."""
    # Texts are shuffled instead of their words with places: what is grouped lies together then.
    words = chunks.select("chunk_id", "chunk_text").repartition("chunk_id").select("chunk_id", F.posexplode(text.analyze("chunk_text")).alias("at", "word"))
    each = words.groupBy("chunk_id", "word").agg(F.collect_list("at").alias("positions"))
    if not stemming:
        return each.select(F.col("word").alias("term"), "chunk_id", F.array_sort("positions").alias("positions"))
    each = cut_lineage(each.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")))
    known = stems(each).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = each.join(known, ["word", "salt"]).groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    return joined.select("term", "chunk_id", F.array_sort("positions").alias("positions"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def write(found: DataFrame, at: str, *, buckets: int = BUCKETS, parts: int = 8) -> None:
    """Postings as files; a bucket's rows are dealt to `parts` tasks by chunk, so a frequent term isn't one task's."""
    own = found.repartition(_bucket(buckets), F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).withColumn("bucket", _bucket(buckets))
    own.sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(at)


def terms(question: str, *, stemming: bool = True) -> list[str]:
    words = text.query_terms(question)
    return list(dict.fromkeys(map(stem, words))) if stemming else words


def of_terms(index: DataFrame, asked: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms, from their folders alone."""
    spark = index.sparkSession
    where = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "term string").select(_bucket(buckets)).distinct().collect()]
    return index.where(F.col("bucket").isin(where) & F.col("term").isin(asked))


def ranks(index: DataFrame, question: str, *, stemming: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """chunk_id and rank of all chunks with any of the question's terms, as text.ts_rank() has it."""
    asked = terms(question, stemming=stemming)
    if not asked:
        return index.select("chunk_id", F.lit(0.0).alias("rank")).limit(0)
    one = text.term_rank(F.size("positions")) / len(asked)
    return of_terms(index, asked, buckets=buckets).groupBy("chunk_id").agg(F.sum(one).alias("rank"))


def near(index: DataFrame, first: str, second: str, within: int, *, stemming: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Chunks in which two words stand at most so many words apart, with the least distance."""
    one, two = (stem(w) if stemming else w for w in (first, second))
    held = of_terms(index, [one, two], buckets=buckets)
    a = held.where(F.col("term") == one).select("chunk_id", F.explode("positions").alias("a"))
    b = held.where(F.col("term") == two).select("chunk_id", F.explode("positions").alias("b"))
    # Positions meet by stretches of the given width, so a chunk's positions aren't all paired.
    a = a.withColumn("cell", F.explode(F.expr(f"array(a div {within} - 1, a div {within}, a div {within} + 1)")))
    b = b.withColumn("cell", F.expr(f"b div {within}"))
    met = a.join(b, ["chunk_id", "cell"]).withColumn("apart", F.abs(F.col("a") - F.col("b"))).where((F.col("apart") <= within) & (F.col("apart") > 0))
    return met.groupBy("chunk_id").agg(F.min("apart").alias("apart"))

"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, with DataFrame functions only.

A section ends with an empty line, a paragraph with a line break, a leaf with a stop or after 200 characters; each
delimiter belongs to what it ends, so the leaves make up the text. A leaf's hash is its MD5, a paragraph's that of
its leaves' hashes, a section's that of its paragraphs' hashes, and the root the SHA-256 of the sections' hashes.
As a string: root|section{paragraph(leaf,leaf)paragraph(leaf)}section{...}, hashes below the root by
their first 8 digits. Equal roots mean equal texts; where roots differ, the branches that differ show where. The likeness
of two fingerprints is the share of leaves they have in common (twice the common distinct leaves by the sum of both), 1 for equal roots;
it descends from the roots to the sections that differ, and only their leaves are compared. changed_paragraphs of a query's row counts
the edited text's paragraphs whose branch the original lacks.

A null text counts as empty: its tree is a root alone. An empty table gives no rows; other columns, whatever their names, take no part;
texts may be of any length, and work grows with it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import partitions, quoted, texts, written

_SECTION, _PARAGRAPH, _LEAF = r"(?<=\n\n)(?!\n)", r"(?<=\n)", r"[^.!?\n]{1,200}[.!?\n]*+|[.!?\n]++"
FIRST = -0x8000000000000000


def fingerprint(text: str) -> Column:
    """The fingerprint of a column of texts."""
    leaf = f"transform(filter(regexp_extract_all(p, r'{_LEAF}', 0), l -> l <> ''), l -> md5(l))"
    paragraph = f"transform(filter(split(s, r'{_PARAGRAPH}', -1), p -> p <> ''), p -> {leaf})"
    # Each list of hashes is kept with the hash of its parent.
    paragraphs = f"transform({paragraph}, ls -> struct(md5(array_join(ls, '')) as h, concat('(', array_join(transform(ls, l -> left(l, 8)), ','), ')') as below))"
    sections = f"transform(filter(split(coalesce({text}, ''), r'{_SECTION}', -1), s -> s <> ''), s -> {paragraphs})"
    hashed = f"transform({sections}, ps -> struct(md5(array_join(transform(ps, p -> p.h), '')) as h, concat('{{', array_join(transform(ps, p -> concat(left(p.h, 8), p.below)), ''), '}}') as below))"
    whole = f"transform(array({hashed}), ss -> concat(sha2(array_join(transform(ss, s -> s.h), ''), 256), '|', array_join(transform(ss, s -> concat(left(s.h, 8), s.below)), '')))[0]"
    return F.expr(whole)


def sections(fp: str) -> Column:
    """The distinct branches of a fingerprint's sections."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"[0-9a-f]{8}\{[^}]*\}"), F.lit(0)))


def paragraphs(fp: str) -> Column:
    """The distinct branches of a fingerprint's paragraphs."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"[0-9a-f]{8}\([^)]*\)"), F.lit(0)))


def leaves(branches: Column) -> Column:
    """The distinct leaves of an array of sections."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(branches, ""), F.lit(r"[0-9a-f]{8}(?=[,)])"), F.lit(0)))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of fingerprints a and b: only sections that differ are compared leaf by leaf."""
    held = [F.col(quoted(c)) for c in df.columns]
    df = df.select(*held, sections(a).alias("_sa"), sections(b).alias("_sb"))
    same = df.select(*held, F.array_intersect("_sa", "_sb").alias("_same"), F.array_except("_sa", "_sb").alias("_ra"), F.array_except("_sb", "_sa").alias("_rb"))
    df = same.select(*held, leaves(F.col("_same")).alias("_ls"), leaves(F.col("_ra")).alias("_la"), leaves(F.col("_rb")).alias("_lb"))
    both = F.size(F.array_union("_ls", F.array_intersect("_la", "_lb")))
    all_ = F.size(F.array_union("_ls", "_la")) + F.size(F.array_union("_ls", "_lb"))
    root = lambda fp: F.substring_index(fp, "|", 1)
    share = F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(2.0 * both, all_), F.lit(0.0)))
    return df.select(*held, share.alias(name))


def changed_paragraphs(a: str, b: str) -> Column:
    """The places (from 0) of the paragraphs of fingerprint a whose branch fingerprint b lacks; empty for equal roots."""
    branch = F.lit(r"[0-9a-f]{8}\([^)]*\)")
    there = F.regexp_extract_all(b, branch, F.lit(0))
    return F.filter(F.transform(F.regexp_extract_all(a, branch, F.lit(0)), lambda p, i: F.when(~F.array_contains(there, p), i)), lambda i: i.isNotNull())


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document."""
    return texts(documents).select("doc_id", fingerprint("text").alias("fingerprint"))


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text and next_text: of the next document in descending doc_id, after the last the first.

    Documents go to buckets of doc_ids, cut at approximate quantiles; each bucket's first is also sent to the end
    of the bucket before, so one shuffle brings all neighbours together. Null doc_ids come last; rows with one doc_id
    are in order of their texts' hashes."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = texts(documents).select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("rank"), text.alias("text"), F.md5(text).alias("tie"))
    ids = docs.select("rank")
    n = 4 * partitions(spark)
    # n numbers, whatever the input.
    cuts = sorted(set(ids.agg(F.percentile_approx("rank", [k / n for k in range(1, n)], 10 * n).alias("q")).first().q or []))
    coarse, step = cuts[255::256], 256
    bounds, upper = F.lit(cuts) if cuts else F.array().cast("array<bigint>"), F.lit(coarse) if coarse else F.array().cast("array<bigint>")
    high = F.size(F.filter(upper, lambda v: v <= F.col("rank")))
    bucket = high * step + F.size(F.filter(F.slice(bounds, high * step + 1, step), lambda v: v <= F.col("rank")))
    placed = docs.withColumn("bucket", bucket.cast("int"))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("rank", "tie")).alias("head"))
    # At most n rows: one for each bucket that has documents.
    heads = written(heads.select("bucket", F.col("head.rank").alias("rank"), F.col("head.tie").alias("tie")), "heads")
    above = heads.select("bucket", "rank", "tie", F.coalesce(F.lead("bucket").over(W.orderBy("bucket")), F.min("bucket").over(W.partitionBy())).alias("before"))
    sent = placed.join(F.broadcast(above), ["bucket", "rank", "tie"], "left")
    own = F.struct("bucket", F.lit(0).alias("guest"))
    there = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    sent = sent.select("doc_id", "rank", "tie", "text", F.explode(there).alias("at")).select("doc_id", "rank", "tie", "text", "at.bucket", "at.guest")
    order = W.partitionBy("bucket").orderBy("guest", F.desc("rank"), F.desc("tie"))
    return sent.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (last half replaced by the next document's beginning), likenesses and changes."""
    near = with_next(documents).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.left("next_text", half))
    fp = near.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    fp = fp.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("text").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"), fingerprint("next_text").alias("next_fingerprint"))
    fp = with_likeness(fp, "fingerprint", "edited_fingerprint", "near_edited")
    fp = with_likeness(fp, "fingerprint", "next_fingerprint", "near_next")
    changed = F.size(F.array_except(paragraphs("edited_fingerprint"), paragraphs("fingerprint"))).alias("changed_paragraphs")
    return fp.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", changed)

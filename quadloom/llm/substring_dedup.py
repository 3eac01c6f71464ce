"""Removal of long repeated passages over a compacted De Bruijn graph of words.

An edge of the graph is a window of k words. Windows are cut into paths by their anchor, the leftmost of
their 5-word runs with the least hash: consecutive windows with the same anchor are one path, and equal windows
always lie at the same place of paths with the same anchor. Then, by joins:

1. anchors that occur once in all texts are dropped; the others say which stretches of which documents can repeat;
2. these stretches' paths are grouped by anchor and content. Every place of a path but its earliest repeats as a
   whole, so a path that doesn't branch (its anchor has no other content) is settled as one row;
3. where an anchor has several contents, the paths branch, and their earliest places are opened into single
   windows, each of which keeps its earliest source coordinates (document, start);
4. paths that follow each other, in their document and at the source of their copies, become one longer path;
5. these repeated spans go back to their documents, whose words they cover are removed.

Documents with the same words are one class: the one with the least doc_id stands for it, all words of the others
repeat. "Earlier" is by doc_id, then start; rows with the same doc_id and words are one document, those with the
same doc_id and other words come by their words' hash; a null doc_id comes last. Texts of fewer than k words, empty
and null ones lose nothing. Windows match by two 64-bit hashes, of the anchor and of all k words.
An empty table gives no rows; extra columns of any name take no part (and stay, where whole rows are returned); a text may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import Block, blocks, dropped, mix, raw_texts, whole_rows, window_hashes, word_hashes, written

ANCHOR_WORDS = 5
LAST = 0x7FFFFFFFFFFFFFFF


def _paths(b: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each path of the block its first window's place, its windows, its anchor's hash; and all words' hashes."""
    words = word_hashes(b)
    n_words = np.diff(b.first)
    if len(words) < k:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64), words
    doc = np.repeat(np.arange(b.n_docs), n_words)
    runs = window_hashes(words, ANCHOR_WORDS)
    at = np.lib.stride_tricks.sliding_window_view(runs, k - ANCHOR_WORDS + 1).argmin(axis=1) + np.arange(len(words) - k + 1)
    ok = doc[: len(at)] == doc[k - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    begin = np.flatnonzero(new & ok)
    stop = np.flatnonzero(np.concatenate([(new | ~ok)[1:], [True]]) & ok) + 1
    return begin, stop - begin, runs[at[begin]], words


def _words(b: Block, i: int) -> list[bytes]:
    return b.data[b.doc_start[i] : b.doc_start[i + 1] - 1].tobytes().split()


def _scan(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_words", pa.int64()), ("digest", pa.binary()), ("anchors", pa.list_(pa.int64())), ("again", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b in blocks(batch):
                begin, _, anchors, _ = _paths(b, k)
                cut = np.searchsorted(begin, b.first)
                found = [np.unique(anchors[cut[d] : cut[d + 1]].view(np.int64), return_counts=True) for d in range(b.n_docs)]
                digests = [hashlib.sha256(b" ".join(_words(b, d))).digest() for d in range(b.n_docs)]
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(b.first).astype(np.int64)), pa.array(digests, pa.binary()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([(f[1] > 1).astype(np.int8) for f in found], pa.list_(pa.int8()))], schema=schema)

    return run


_PATHS = "anchor long, content long, rank long, tie long, start long, n long, loops boolean, windows binary"


def _repeatable(k: int):
    """(rank, text, tie, repeated anchors) to the paths of these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, ties = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, _, b in blocks(batch):
                begin, n, anchors, words = _paths(b, k)
                windows = window_hashes(words, k)
                cut = np.searchsorted(begin, b.first)
                take = []
                for d in range(b.n_docs):
                    own = np.arange(cut[d], cut[d + 1])
                    take.append(own[np.isin(anchors[own].view(np.int64), batch.column(3)[i + d].values.to_numpy())])
                take = np.concatenate(take) if take else np.empty(0, np.int64)
                if not len(take):
                    continue
                doc = np.searchsorted(b.first, begin[take], "right") - 1
                contents, loops, held = [], [], []
                for p in take.tolist():
                    own = windows[begin[p] : begin[p] + n[p]]
                    contents.append(own)
                    held.append(own.tobytes())
                    loops.append(len(own) > 1 and len(set(own.tolist())) < len(own))
                lengths = n[take]
                flat = np.concatenate(contents)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                content = np.add.reduceat(mix(flat + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(lengths) - lengths)
                yield pa.record_batch(
                    [pa.array(anchors[take].view(np.int64)), pa.array(content.view(np.int64)), pa.array(ranks[i + doc]), pa.array(ties[i + doc]), pa.array(begin[take] - b.first[doc]), pa.array(lengths.astype(np.int64)), pa.array(loops, pa.bool_()), pa.array(held, pa.binary())],
                    names=["anchor", "content", "rank", "tie", "start", "n", "loops", "windows"],
                )

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, rank, tie, start, windows) to a row for each window."""
    for batch in batches:
        held = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(4)]
        n = np.fromiter(map(len, held), np.int64, len(held))
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        anchor, rank, tie, start = (np.repeat(batch.column(k).to_numpy(), n) for k in range(4))
        yield pa.record_batch([pa.array(x) for x in (anchor, np.concatenate(held) if held else np.empty(0, np.int64), rank, tie, start + place)], names=["anchor", "window", "rank", "tie", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, text, tie, starts, ends) to what is left of the text."""
    for batch in batches:
        out = []
        for rank, text, tie, starts, ends in zip(*(batch.column(i) for i in range(5)), strict=True):
            words = (text.as_py() or b"").split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, starts.values.to_numpy(), 1)
            np.add.at(edge, ends.values.to_numpy(), -1)
            left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
            kept = b" ".join([words[w] for w in left.tolist()])
            out.append((rank.as_py(), tie.as_py(), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept))
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["rank", "tie", "n_removed", "kept_sha256", "kept"])


def _tie(digest: str = "digest") -> Column:
    return F.xxhash64(digest)


def _decided(documents: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each row's class (doc_id, key: its text's hash, n_words, rank, tie, digest, first: the class's least rank), and what is left of the texts that lose some of their words (rank, tie)."""
    spark = documents.sparkSession
    rank = F.coalesce("doc_id", F.lit(LAST)).alias("rank")
    docs = raw_texts(documents).select("doc_id", rank, "text", F.md5("text").alias("key"))
    scanned = written(docs.select("doc_id", "text", "key").mapInArrow(_scan(k), "doc_id long, key string, n_words long, digest binary, anchors array<long>, again array<tinyint>"), "anchors")
    rows = scanned.select("doc_id", "key", "n_words", rank, _tie().alias("tie"), "digest")
    firsts = rows.groupBy("digest").agg(F.min(F.struct("rank", "key")).alias("lead")).select("digest", F.col("lead.rank").alias("first"), F.col("lead.key").alias("lead_key"))

    anchors = scanned.select(rank, _tie().alias("tie"), F.explode(F.arrays_zip("anchors", "again")).alias("x")).select("rank", "tie", F.col("x.anchors").alias("anchor"), F.col("x.again").alias("again"))
    # Copies have one tie, so they don't make their anchors repeat. What rows are joined with is written first, so that Spark can split the rows of a frequent key.
    repeated = anchors.groupBy("anchor").agg(F.min("tie").alias("a"), F.max("tie").alias("b"), F.max("again").alias("again")).where("a < b OR again > 0").select("anchor")
    repeated = written(repeated, "repeated")
    marked = anchors.select("anchor", "rank", "tie").join(repeated, "anchor", "left_semi").groupBy("rank", "tie").agg(F.collect_set("anchor").alias("anchors"))
    leaders = firsts.select(F.col("first").alias("rank"), _tie().alias("tie"), F.col("lead_key").alias("key"))
    marked = written(marked.join(leaders, ["rank", "tie"]), "marked")
    dropped(spark, repeated)

    # A null doc_id has many rows, so texts are found by their hashes too.
    keyed = docs.select("rank", "key", "text")
    paths = keyed.join(marked, ["rank", "key"]).select("rank", "text", "tie", "anchors").mapInArrow(_repeatable(k), _PATHS)
    paths = written(paths, "paths")
    place = F.struct("rank", "tie", "start")
    earliest = written(paths.groupBy("anchor", "content").agg(F.min(place).alias("earliest"), F.max("loops").alias("loops")), "earliest")
    branching = written(earliest.groupBy("anchor").agg(F.count("*").alias("contents"), F.max("loops").alias("loops")).where("contents > 1 OR loops").select("anchor"), "branching")
    known = paths.join(earliest.drop("loops"), ["anchor", "content"])
    whole = known.where(place != F.col("earliest")).select("rank", "tie", "start", "n", "earliest")
    heads = known.where(place == F.col("earliest")).select("anchor", "rank", "tie", "start", "windows").join(branching, "anchor", "left_semi")
    windows = written(heads.mapInArrow(_opened, "anchor long, window long, rank long, tie long, start long"), "windows")
    source = windows.groupBy("anchor", "window").agg(F.min(place).alias("earliest"), F.max(place).alias("last")).where("earliest < last").drop("last")
    source = written(source, "sources")
    single = windows.join(source, ["anchor", "window"]).where(place != F.col("earliest")).select("rank", "tie", "start", F.lit(1).cast("long").alias("n"), "earliest")
    spans = _compacted(whole.union(single), k).groupBy("rank", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans.join(leaders, ["rank", "tie"]).select("rank", "key", "tie", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")), "spans")
    dropped(spark, marked, paths, earliest, branching, windows, source)
    left = keyed.join(spans, ["rank", "key"]).select("rank", "text", "tie", "starts", "ends").mapInArrow(_cut, "rank long, tie long, n_removed long, kept_sha256 string, kept binary")
    return rows.join(firsts.drop("lead_key"), "digest"), left


def _compacted(spans: DataFrame, k: int) -> DataFrame:
    """Paths and windows (rank, tie, start, n windows, earliest: the place of the same windows) that follow each other both where
    they are and at their source, as one span of words (rank, tie, start, end, source) each."""
    along = W.partitionBy("rank", "tie", "source", "shift").orderBy("start")
    own = spans.select("rank", "tie", "start", (F.col("start") + F.col("n")).alias("next"), F.struct("earliest.rank", "earliest.tie").alias("source"), (F.col("start") - F.col("earliest.start")).alias("shift"))
    new = F.when(F.max("next").over(along.rowsBetween(W.unboundedPreceding, -1)) >= F.col("start"), 0).otherwise(1)
    own = own.withColumn("new", new).withColumn("path", F.sum("new").over(along))
    return own.groupBy("rank", "tie", "source", "shift", "path").agg(F.min("start").alias("start"), (F.max("next") + (k - 1)).alias("end")).drop("path")


def repeated_words(documents: DataFrame, *, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space) of each row."""
    rows, left = _decided(documents, window)
    left = left.select("rank", "tie", "n_removed", "kept_sha256").distinct()
    out = rows.join(left, ["rank", "tie"], "left")
    copy = (F.col("rank") != F.col("first")) & (F.col("n_words") >= window)
    n_removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
    return out.select("doc_id", "n_words", n_removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def without_repeats(documents: DataFrame, *, window: int = 20) -> DataFrame:
    """The documents, all columns, with the repeated words taken out of their texts.

    A text that loses nothing stays as it is, one that loses some words has the others joined by one space, one
    that loses all is empty."""
    rows, left = _decided(documents, window)
    copies = rows.where((F.col("rank") != F.col("first")) & (F.col("n_words") >= window)).select("rank", "key", F.lit("").alias("kept"))
    some = rows.where("rank = first").select("rank", "tie", "key").join(left, ["rank", "tie"]).select("rank", "key", F.decode("kept", "UTF-8").alias("kept")).union(copies)
    some = some.groupBy(F.col("rank").alias("_rank"), F.col("key").alias("_key")).agg(F.min("kept").alias("_kept"))
    # One join by what a row's own text says about it, its id and its hash.
    own = documents.select(whole_rows(documents), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_rank"), F.md5(F.col("text").cast("binary")).alias("_key"))
    text = F.coalesce("_kept", F.col("own.text"))
    return own.join(some, ["_rank", "_key"], "left").select(F.col("own").withField("text", text).alias("own")).select("own.*")

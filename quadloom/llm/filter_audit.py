"""Filter interaction audit: what each filter removes in every order of the filters.

A text's failures are one number of a bit for each filter. A table made beforehand has, for each such number and each order, the
step at which the order first fails it (0 for none): 32 by 120 for five filters. mapInArrow looks the rows up in it and adds them
up by part, order, step and label with bincount; the partial arrays of all batches are summed.

The five filters (fixed): A under 200 words; B fewer than half of the words distinct; C more than 3 in 100 code points upper-case
ASCII letters; D any of #$%&*|; E a text that a smaller doc_id has as well, anywhere in the table. Rows are counted by text, id, part
and label first, so that a text of very many copies is a few rows before anything is decided by text, and no copy is sent twice.

Null texts count as empty, so all but the one of the least id fail E. A null language is the part of the empty string. A row without a doc_id has
no labels, isn't smaller than any and never fails E. Rows of one id are rows of their own, and don't fail E by each other. Labels that repeat an id count
as good or toxic if any of them says so. Words of very long texts are taken in pieces, distinct ones kept. Extra columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import texts, written

FILTERS = "ABCDE"
#: Bytes of a text whose words are held at once.
SEGMENT = 1 << 22

_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"
_SPACES = frozenset(b"\t\n\x0b\x0c\r ")


def _words(raw: bytes) -> tuple[int, int]:
    """How many words a text has, and how many distinct ones."""
    if len(raw) <= SEGMENT:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        words = raw[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failures(raw: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    n, distinct = _words(raw)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _CONTINUED))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | marked << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t.as_py() or b"" for t in batch.column(2)]
        bits = np.fromiter(map(failures, raw), np.int32, len(raw))
        digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in raw], pa.binary())
        yield pa.record_batch([batch.column(0), batch.column(1), digests, pa.array(bits)], names=["doc_id", "part", "digest", "bits"])


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """The step, from 1, at which each order (column) first fails each set of failures (row); 0 where it doesn't."""
    bits = np.arange(1 << len(filters))
    each = np.array([[filters.index(f) for f in o] for o in orders(filters)])
    fails = (bits[:, None, None] >> each) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2) + 1, 0)


_SUMS = "part string, cell int, n long, good long, toxic long"


def _added(filters: str):
    """Sums by part and cell: a cell is an order and a step (0 for what is kept), after these cells one for each set of failures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first_failures(filters)
        sets, n_orders = table.shape
        steps = len(filters) + 1
        cells = n_orders * steps + sets
        # Of each set of failures, its cells.
        of = np.concatenate([np.arange(n_orders) * steps + table, n_orders * steps + np.arange(sets)[:, None]], axis=1)
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            bits, place = batch.column(1).to_numpy(), parts.indices.to_numpy()
            weights = [batch.column(k).to_numpy() for k in (2, 3, 4)]
            # A few parts at a time, so that the arrays stay small whatever the number of parts.
            for low in range(0, len(parts.dictionary), 64):
                here = np.flatnonzero((place >= low) & (place < low + 64))
                sums = []
                for w in weights:
                    by_set = np.bincount((place[here] - low) * sets + bits[here], weights=w[here], minlength=64 * sets).reshape(64, sets)
                    held, s = np.nonzero(by_set)
                    at = held[:, None] * cells + of[s]
                    sums.append(np.bincount(at.ravel(), weights=np.repeat(by_set[held, s], of.shape[1]), minlength=64 * cells).astype(np.int64))
                some = np.flatnonzero(sums[0])
                names = parts.dictionary.take(pa.array(low + some // cells))
                yield pa.record_batch([names, pa.array((some % cells).astype(np.int32)), *(pa.array(s[some]) for s in sums)], names=["part", "cell", "n", "good", "toxic"])

    return run


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (of the filters failed), n, good, toxic: how many documents of a part fail just these filters."""
    texts(documents)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = written(own.mapInArrow(_judged, "doc_id long, part string, digest binary, bits int"), "judged")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int").alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    kind = ["digest", "bits", "part", "quality", "toxic"]
    # Rows without an id have no labels, and must not meet in one task of the join.
    named = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").fillna(0, ["quality", "toxic"]).groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    nameless = rows.where("doc_id IS NULL").withColumns({"quality": F.lit(0), "toxic": F.lit(0)}).groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    # Of each text, part and label: all rows, those without an id, and the least id with its rows.
    groups = named.unionByName(nameless).groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    )
    first = F.min("least.doc_id").over(W.partitionBy("digest"))
    once = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    again = F.lit(1 << FILTERS.index("E"))
    both = groups.withColumn("once", once).select("part", "quality", "toxic", F.explode(F.array(F.struct("bits", F.col("once").alias("n")), F.struct((F.col("bits") + again).alias("bits"), (F.col("n") - F.col("once")).alias("n")))).alias("x"))
    return both.select("part", "x.bits", "x.n", (F.col("x.n") * F.col("quality")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic")).where("n > 0")


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from rows (part, bits, n, good, toxic), bit k for filter k.

    One row for each part of the rows, each order of the filters and each step."""
    spark = failed.sparkSession
    steps, every = len(filters) + 1, orders(filters)
    sums = failed.mapInArrow(_added(filters), _SUMS).groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    sums = written(sums, "filter-sums")
    sets = sums.where(F.col("cell") >= len(every) * steps).select("part", (F.col("cell") - len(every) * steps).alias("bits"), "n")
    fails = [F.sum(F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)) for k in range(len(filters))]
    alone = [F.sum(F.when(F.col("bits") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(filters))]
    parts = sets.groupBy("part").agg(F.sum("n").alias("all"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    # Fixed rows: each order with its steps.
    cells = [(i * steps + k, o, k, filters.index(o[k - 1])) for i, o in enumerate(every) for k in range(1, steps)]
    grid = parts.crossJoin(F.broadcast(spark.createDataFrame(cells, "cell int, filter_order string, step int, filter int")))
    out = grid.join(sums.select("part", "cell", F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost")), ["part", "cell"], "left").fillna(0, ["removed", "good_lost", "toxic_lost"])
    so_far = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step"))
    return out.select(
        "part", "filter_order", "step", (F.col("all") - so_far).alias("kept"), "removed", (F.col("fails")[F.col("filter")] - F.col("removed")).alias("redundant"), F.col("alone")[F.col("filter")].alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents (doc_id, text, lang) by language, with labels (doc_id, quality, toxic)."""
    return audit(judged(documents, labels))

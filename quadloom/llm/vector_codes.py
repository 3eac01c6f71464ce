"""Vector code compression: product quantisation in integers, the nearest codebook entry found by VA-file filtering.

A component x becomes floor(scale * x); a vector is cut into `parts` equal consecutive parts, and each part position has a codebook that
starts as that part of the `entries` vectors of least vec_id and is refined by rounds of assignment and floored means.

Filtering: a codebook's coordinates are cut into 2^bits cells a dimension, each with the least and the greatest coordinate of the entries in it. A
query part has a table of a lower and an upper bound of its squared distance to each cell of each dimension; summed over an entry's cells they
bound its distance. Only entries whose lower bound doesn't exceed the least upper bound are refined by integer distances; the least wins, ties by the
lower index. So codes are exact, whatever the cells.

A round sends one row of sums for each part position, entry and coordinate from each task; the codebooks (parts x entries x length) are all that
reaches the driver and goes out again. Vectors are quantised once and read from the shared folder in each round.

Vectors that are null or empty, or hold a null or non-finite component, are dropped; so are those of a length that `parts` doesn't divide, or
of another length than that of the least vec_id left. Components whose squares could overflow 64 bits in a sum over the vector (2^27 for 64 components)
count as that bound. Repeated rows are rows of their own; ties of vec_id go by the vector; null vec_ids come last. Fewer vectors than
`entries` give a codebook of as many entries. Null labels are one label. An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import written

#: Part vectors whose tables are held at once.
CHUNK = 4096
#: Labels up to which their sums are broadcast; beyond, they are joined by label and a salt.
SMALL_LABELS = 10_000
SALTS = 32


def bound(length: int) -> int:
    """The greatest absolute component whose squared distances, summed over the vector, fit 64 bits."""
    return 1 << ((62 - max(length - 1, 1).bit_length()) // 2 - 1)


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            numbers = np.where(np.asarray(flat.is_null()), np.nan, flat.to_numpy(zero_copy_only=False)) if flat.null_count else flat.to_numpy(zero_copy_only=False)
            lengths = np.nan_to_num(lengths.astype(float)).astype(np.int64)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
            keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            rows, at = [], np.flatnonzero(keep)
            for i in at.tolist():
                x = numbers[ends[i] - lengths[i] : ends[i]]
                b = bound(len(x))
                with np.errstate(over="ignore"):
                    rows.append(np.clip(np.floor(x * float(scale)), -b, b).astype("<i4").tobytes())
            take = pa.array(at)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(rows, pa.binary())], names=["vec_id", "label", "vector"])

    return run


def quantised(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """vec_id, label and vector (32-bit integers, little-endian) of the rows (vec_id, embedding, label) that are whole and finite."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    label = own.schema["label"].dataType.simpleString()
    return own.where("embedding IS NOT NULL").mapInArrow(_quantised(scale), f"vec_id long, label {label}, vector binary")


class Filter:
    """One part position's codebook (entries x coordinates) with its cells."""

    def __init__(self, book: np.ndarray, bits: int = 3):
        self.book, n = book, 1 << bits
        low, high = book.min(axis=0), book.max(axis=0)
        width = np.maximum(-(-(high - low + 1) // n), 1)
        cells = (book - low) // width
        size = book.shape[1]
        #: Of each cell the least and the greatest coordinate in it; empty cells are never looked at.
        self.low, self.high = np.zeros((size, n), np.int64), np.zeros((size, n), np.int64)
        for j in range(size):
            for c in np.unique(cells[:, j]):
                inside = book[cells[:, j] == c, j]
                self.low[j, c], self.high[j, c] = inside.min(), inside.max()
        self.cells = (np.arange(size) * n + cells).astype(np.intp)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x and its squared distance."""
        at, d = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for i in range(0, len(x), CHUNK):
            at[i : i + CHUNK], d[i : i + CHUNK] = self._nearest(x[i : i + CHUNK])
        return at, d

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each row's squared distance to each entry."""
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        lower = np.maximum(np.maximum(below, above), 0) ** 2
        upper = np.maximum(-below, -above) ** 2
        n = len(x)
        return tuple(t.reshape(n, -1)[:, self.cells].sum(axis=2) for t in (lower, upper))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        d = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        # The candidates of a row stand together, by entry.
        begins = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(d, begins)
        return np.minimum.reduceat(np.where(d == least[row], entry, len(self.book)), begins), least


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), "<i4").reshape(len(column), length).astype(np.int64)


def _sums(books: np.ndarray, bits: int):
    """Sums and counts of the vectors next to each entry: a row for each part position, entry and coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        filters = [Filter(b, bits) for b in books] if books.size else []
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), parts * size)
            for p, f in enumerate(filters):
                own = x[:, p * size : (p + 1) * size]
                at, _ = f.nearest(own)
                for e in range(entries):
                    total[p, e] += own[at == e].sum(axis=0)
                count[p] += np.bincount(at, minlength=entries)
        if count.any():
            p, e, j = (k.ravel().astype(np.int32) for k in np.indices(total.shape))
            yield pa.record_batch([pa.array(p), pa.array(e), pa.array(j), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), size))], names=["part", "entry", "place", "total", "n"])

    return run


def fit(vectors: DataFrame, length: int, *, parts: int = 8, entries: int = 16, rounds: int = 6, bits: int = 3) -> np.ndarray:
    """The codebooks (part positions x entries x coordinates) of quantised vectors, all of one length."""
    first = np.array([np.frombuffer(r.vector, "<i4") for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()], np.int64)
    books = first.reshape(len(first), parts, length // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = vectors.select("vector").mapInArrow(_sums(books, bits), "part int, entry int, place int, total long, n long")
        after = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            after[r.part, r.entry, r.place] = r.total // r.n
        if (after == books).all():
            break  # further rounds change nothing
        books = after
    return books


def _encoded(books: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, size = books.shape
        filters = [Filter(b, bits) for b in books] if books.size else []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), parts * size)
            found = [f.nearest(x[:, p * size : (p + 1) * size]) for p, f in enumerate(filters)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8 if books.shape[1] <= 256 else "<u2")
            error = sum(d for _, d in found)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encode(vectors: DataFrame, books: np.ndarray, *, bits: int = 3) -> DataFrame:
    """vec_id, label, code (a byte for each part position, two beyond 256 entries) and error of quantised vectors."""
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(_encoded(books, bits), f"vec_id long, label {label}, code binary, error long")


def _decoded(books: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(1)), np.uint8 if entries <= 256 else "<u2").reshape(-1, parts)
            x = books[np.arange(parts), codes].reshape(len(codes), parts * size) / scale
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return run


def decode(codes: DataFrame, books: np.ndarray, *, scale: int = 4096) -> DataFrame:
    """vec_id and embedding: the codebook entries that codes (vec_id, code) stand for."""
    return codes.select("vec_id", "code").mapInArrow(_decoded(books, scale), "vec_id long, embedding array<double>")


def with_label_errors(encoded: DataFrame) -> DataFrame:
    """Each row with label_error, the error of all rows of its label."""
    sums = written(encoded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS:
        held = F.broadcast(sums.withColumnRenamed("label", "_label"))
        return encoded.join(held, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    held = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return encoded.withColumn("_salt", salt).join(held, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_of")), "left").drop("_label", "_of", "_salt")


def listed(books: np.ndarray) -> str:
    """All entries' components by part position, entry and place, as decimal numbers."""
    return ",".join(map(str, books.ravel().tolist()))


def compressed(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, bits: int = 3, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of the vectors, and the codebooks."""
    own = written(quantised(vectors, scale).where(F.octet_length("vector") % (4 * parts) == 0), "vectors")
    first = own.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.octet_length("vector").alias("n")).first()
    length = first.n // 4 if first else 0
    own = own.where(F.octet_length("vector") == 4 * length)
    books = fit(own, length, parts=parts, entries=entries, rounds=rounds, bits=bits) if length else np.zeros((parts, 0, 0), np.int64)
    return with_label_errors(written(encode(own, books, bits=bits), "vector-codes")), books

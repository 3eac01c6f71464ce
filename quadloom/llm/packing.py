"""Best-fit packing of token sequences by exact complements.

Documents are tokenized once, cut into pieces of at most `size` ids, and only the pieces' lengths matter
from there on. How many pieces have each length is a table of at most `size` rows, whatever the input; the
driver plans over these counts: for each length, longest first, it looks for one, two or three available
lengths that fill the gap exactly and consumes the combination as often as its scarcest length allows, then
packs what is left by best fit. The plan says for each length which stretches of its pieces go to which
sequences. A piece's number among those of its length comes from its task's counter and a running sum over
tasks, so frequent lengths need no large group.

Null texts count as empty (one piece: the end id alone); repeated rows are packed each, in any order among pieces of one length;
an empty table gives no rows, extra columns of any name take no part, and a text of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import id_cache, texts, written

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(path: str, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = id_cache(path, False), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), cache.of(batch.column(1)), strict=True):
                ids = own + end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    n = len(part) // 4
                    rows.append((doc_id, k // (4 * size), k // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


class _Counts:
    """Pieces left of each length, with the number of pairs of available lengths by their sum."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(2 * size + 2, np.int64)
        self.size = size
        there = np.flatnonzero(self.left)
        for i, a in enumerate(there):
            self.pairs[there[i:] + a] += 1

    def take(self, combination: tuple[int, ...]) -> int:
        """Consumes the combination as often as it can be had, and says how often."""
        need = Counter(combination)
        times = min(int(self.left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                self.left[x] -= times * k
                if not self.left[x]:
                    there = np.flatnonzero(self.left)
                    self.pairs[there + x] -= 1
                    self.pairs[2 * x] -= 1
        return times

    def pair(self, gap: int, at_most: int) -> tuple[int, int] | None:
        """The available pair of that sum with the largest member."""
        if gap < 2 or not self.pairs[gap]:
            return None
        a = np.arange(min(gap - 1, at_most), (gap + 1) // 2 - 1, -1)
        ok = a[(self.left[a] > (2 * a == gap)) & (self.left[gap - a] > 0)]
        return (int(ok[0]), gap - int(ok[0])) if len(ok) else None

    def fill(self, length: int) -> tuple[int, ...] | None:
        """One, two or three lengths, available beside `length` as often as they are needed, that fill up a sequence that starts with it."""
        gap = self.size - length
        if gap == 0:
            return ()
        self.left[length] -= 1
        try:
            if self.left[gap]:
                return (gap,)
            if found := self.pair(gap, self.size):
                return found
            a = np.arange(gap - 2, 0, -1)
            for x in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)]:
                self.left[x] -= 1
                found = self.pair(gap - int(x), int(x))
                self.left[x] += 1
                if found:
                    return (int(x), *found)
            return None
        finally:
            self.left[length] += 1


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each; all pieces counted are used up."""
    state = _Counts(counts, size)
    plan: list[tuple[tuple[int, ...], int]] = []
    for length in range(size, 0, -1):
        while state.left[length]:
            found = state.fill(length)
            times = state.take((length, *found)) if found is not None else 0
            if not times:
                break
            plan.append(((length, *found), times))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size, 0, -1):
        n = int(state.left[length])
        while n:
            gap = next((g for g in range(length, size + 1) if open_.get(g)), None)
            if gap is None:
                each = size // length
                bins, rest = divmod(n, each)
                for k, times in ((each, bins), (rest, 1)):
                    if k and times:
                        open_.setdefault(size - k * length, []).append(((length,) * k, times))
                break
            pattern, times = open_[gap].pop()
            k = min(n, times)
            if times > k:
                open_[gap].append((pattern, times - k))
            open_.setdefault(gap - length, []).append(((*pattern, length), k))
            n -= k
    return plan + [x for group in open_.values() for x in group]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where each of its stretches begins, and that stretch's first sequence and its offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(part):
                    begin, base, at = slots[int(lengths[part[0]])]
                    k = np.searchsorted(begin, nth[part], "right") - 1
                    sequence[part] = base[k] + nth[part] - begin[k]
                    offset[part] = at[k]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's pieces with the sequence and offset they go to."""
    pieces = written(texts(documents).mapInArrow(_cut(tokenizer_path, size, end_id), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # At most `size` rows, whatever the input.
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    numbered = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("nth"))
    return numbered.mapInArrow(_place(_slots(plan_packing(counts, size))), _PLACED)

"""Token counts without ids: pieces are counted once per distinct pre-token and joined to frequencies.

A scan turns each block of documents into postings, one row per pre-token of the block with the places of
the documents that hold it, as often as they hold it. Distinct pre-tokens are counted by the tokenizer, joined to
the postings by pre-token, and summed by document. Pre-tokens that a block of some millions holds fewer than OFTEN
times, most of the distinct ones, are counted once per block right there: to join each of them would move
more bytes than the texts have. A frequent pre-token has one row per block, whatever its
number of documents, so no key is hot. (What is called a pre-token here is SPACED_WORD, a whole number of
the tokenizer's own.) Nulls count as empty texts, an empty text has no tokens, and each row of the input has
its row of the output, repeated ids too. An empty table gives no rows, extra columns of any name take no part, and
a text of any length is one document of its block.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import SPACED_WORD, texts, written

BLOCK_DOCS = 1 << 16
BLOCK_POSTINGS = 4_000_000
OFTEN = 8
#: Documents whose sums make one row.
CHUNK = 1024
#: Documents whose sums a task holds before it passes them on.
HELD = 4_000_000

_POSTINGS = "block long, pretoken string, place int, doc_id long, n_bytes long, n_rare long, places binary"
_ARROW = pa.schema([("block", pa.int64()), ("pretoken", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_rare", pa.int64()), ("places", pa.binary())])


def _steps(places: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places, list after list, as bytes: each the step from the one before in its list, 255 to go on. Also where each list ends."""
    ends = np.cumsum(lengths)
    step = np.diff(places, prepend=0)
    begins = ends - lengths
    step[begins] = places[begins]
    at = np.cumsum(step // 255 + 1)
    out = np.full(at[-1] if len(at) else 0, 255, np.uint8)
    out[at - 1] = step % 255
    return out, at[ends - 1]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


@functools.lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _count(path: str, tokens: list[str]) -> np.ndarray:
    """How many ids each token has."""
    each = (len(e) for i in range(0, len(tokens), 2000) for e in _tokenizer(path).encode_batch_fast(tokens[i : i + 2000], add_special_tokens=False))
    return np.fromiter(each, np.int64, len(tokens))


def _block(path: str, at: int, docs: list[tuple], held: dict[str, list[int]], often: int) -> Iterator[pa.RecordBatch]:
    n = len(docs)
    rare = [t for t, places in held.items() if len(places) < often]
    n_rare = np.zeros(n, np.int64)
    for i in range(0, len(rare), 20_000):
        places, lengths = _flat([held[t] for t in rare[i : i + 20_000]])
        n_rare += np.bincount(places, weights=np.repeat(_count(path, rare[i : i + 20_000]), lengths), minlength=n).astype(np.int64)
    yield pa.record_batch([pa.array([at] * n, pa.int64()), pa.nulls(n, pa.string()), pa.array(range(n), pa.int32()), pa.array([d for d, _ in docs], pa.int64()), pa.array([b for _, b in docs], pa.int64()), pa.array(n_rare), pa.nulls(n, pa.binary())], schema=_ARROW)
    tokens = [t for t, places in held.items() if len(places) >= often]
    for i in range(0, len(tokens), 20_000):
        some = tokens[i : i + 20_000]
        n = len(some)
        data, ends = _steps(*_flat([held[t] for t in some]))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.record_batch([pa.array([at] * n, pa.int64()), pa.array(some, pa.string()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(3)), places], schema=_ARROW)


def _postings(path: str, often: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        held: defaultdict[str, list[int]] = defaultdict(list)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                place = len(docs)
                docs.append((doc_id, len(text.encode())))
                tokens = SPACED_WORD.findall(text)
                size += len(tokens)
                for token in tokens:
                    held[token].append(place)
                if len(docs) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield from _block(path, (task << 31) + number, docs, held, often)
                    docs, size, number = [], 0, number + 1
                    held = defaultdict(list)
        if docs:
            yield from _block(path, (task << 31) + number, docs, held, often)

    return run


def _pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_count(path, batch.column(0).to_pylist()))], names=["pretoken", "pieces"])

    return count


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by block and place over what a task has read, CHUNK places a row, held for a bounded number of documents."""
    sums: dict[int, np.ndarray] = {}
    cells = 0

    def out():
        for b, s in sums.items():
            n = -(-len(s) // CHUNK)
            rows = [s[k * CHUNK : (k + 1) * CHUNK].astype("<i8").tobytes() for k in range(n)]
            yield pa.record_batch([pa.array([b] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(rows, pa.binary())], names=["of", "part", "sums"])

    for batch in batches:
        blocks, pieces = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        lists = batch.column(1).to_pylist()
        order = np.argsort(blocks, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            if not len(part):
                continue
            some = [lists[i] for i in part.tolist()]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            step = np.frombuffer(b"".join(some), np.uint8)
            total = np.cumsum(step, dtype=np.int64)
            begins = np.cumsum(lengths) - lengths
            place = total - np.repeat(total[begins] - step[begins], lengths)
            real = step != 255
            add = np.bincount(place[real], weights=np.repeat(pieces[part], lengths)[real]).astype(np.int64)
            b = int(blocks[part[0]])
            old = sums.get(b, np.empty(0, np.int64))
            if len(old) < len(add):
                old, add = add, old
            old[: len(add)] += add
            cells += len(old) - len(sums.get(b, ()))
            sums[b] = old
        if cells > HELD:
            yield from out()
            sums, cells = {}, 0
    yield from out()


def _added(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of one part of a block (place, doc_id, n_bytes, n_rare) with the sums of all tasks for it."""
    n = np.zeros(CHUNK, np.int64)
    for x in sums["sums"]:
        s = np.frombuffer(x.as_buffer(), "<i8")
        n[: len(s)] += s
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": docs["n_rare"].to_numpy() + n[docs["place"].to_numpy() % CHUNK]})


def token_counts(documents: DataFrame, tokenizer_path: str, *, often: int = OFTEN) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each document under a byte-level BPE tokenizer file.

    often: pre-tokens that a block holds so many times are joined; 1 joins all."""
    table = written(texts(documents).mapInArrow(_postings(tokenizer_path, often), _POSTINGS), "token-postings")
    postings = table.where("pretoken IS NOT NULL").select("block", "pretoken", "places")
    pieces = postings.select("pretoken").distinct().mapInArrow(_pieces(tokenizer_path), "pretoken string, pieces long")
    joined = postings.join(pieces, "pretoken").select("block", "places", "pieces")
    sums = joined.mapInArrow(_sums, "of long, part int, sums binary")
    docs = table.where("pretoken IS NULL").select("block", F.expr(f"place div {CHUNK}").cast("int").alias("chunk"), "place", "doc_id", "n_bytes", "n_rare")
    # A part has CHUNK documents and one row of sums from each task.
    return docs.groupBy("block", "chunk").cogroup(sums.groupBy("of", "part")).applyInArrow(lambda d, s: _added(d, s), "doc_id long, n_bytes long, n_tokens long")

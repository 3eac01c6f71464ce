"""What the training-data operators share: inputs, written tables, blocks of texts and word hashes."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode's White_Space characters, as a class for regular expressions.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
#: Letters and digits with white space, a stop or the end of the text after them.
_RUN = f"[A-Za-z0-9{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0xFF)}]+(?![^{WHITE}.,!?;:])"
#: Bytes of text that a task works on at once (one document at least).
BLOCK_BYTES = 1 << 18
#: Bytes of a batch of rows for Python (one row at least).
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, take no part.

    Bounds the batches that the session sends to Python by bytes, as texts may be of any length."""
    conf = documents.sparkSession.conf
    now = conf.get(_BATCH)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_rows(documents: DataFrame) -> Column:
    """All columns of a row as one, so that none can clash with ours."""
    return F.struct(*(F.col(quoted(c)) for c in documents.columns)).alias("own")


def raw_texts(documents: DataFrame) -> DataFrame:
    """As texts(), but the text as its UTF-8 bytes."""
    return texts(documents).select("doc_id", F.col("text").cast("binary").alias("text"))


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quadloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one of our own where a local session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _own_folder()
    return at.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, for a table; it goes when the session ends if nobody drops it before."""
    at = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, *, at: str | None = None, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder (in the folder `at` where one is named, in subfolders of column `by`), read again.

    Later steps start from files, so a lost executor costs no recomputation, and the shuffle files behind the table aren't
    needed any more and go at once."""
    spark = df.sparkSession
    at = at or new_folder(spark, label)
    held = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(at)
    finally:
        spark.conf.set(_RELEASE, held)
    out = spark.read.schema(df.schema).parquet(at)
    out.folder = at
    return out


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of written(), or folders, whose successors are written."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Block:
    """Some documents' words, as places in one array of bytes; a word is a run of bytes other than x09-x0D and x20."""

    __slots__ = ("data", "doc_start", "ends", "first", "lengths", "n_docs", "starts")

    def __init__(self, raw: list[bytes], lower: bool = False):
        joined = b"\n".join(raw)
        if lower:
            joined = joined.lower()
        self.data = data = np.frombuffer(joined, np.uint8)
        self.n_docs = len(raw)
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.doc_start = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ((data - np.uint8(9)) > 4) & (data != 32)
        change = np.diff(inside)
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        #: The first word of each document, and the number of all words.
        self.first = np.searchsorted(self.starts, self.doc_start)

    def words_of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def blocks(batch: pa.RecordBatch, column: int = 1, lower: bool = False, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """The batch's documents from row i to row j, by the megabyte or so; a null text counts as empty."""
    raw = batch.column(column)
    n, i = len(raw), 0
    while i < n:
        some, size, j = [], 0, i
        while j < n and (size < most or j == i):
            t = raw[j].as_py() or b""
            size += len(t)
            some.append(t)
            j += 1
        yield i, j, Block(some, lower)
        i = j


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(b: Block) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of one running sum."""
    up, down = _powers(len(b.data) + 1)
    total = np.zeros(len(b.data) + 1, np.uint64)
    np.cumsum(_BYTES[b.data] * up[: len(b.data)], out=total[1:])
    h = (total[b.ends] - total[b.starts]) * down[b.starts]
    return mix(h + (b.ends - b.starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[i : i + n]
    return mix(h)


#: Pieces of text that the byte-level BPE treats independently: its pattern ends a pre-token between a word's last
#: character and white space, and between an ASCII or Latin-1 letter or digit and a stop, and looks no further
#: ahead than the end of a run of white space. So each of these is a whole number of pre-tokens.
SPACED_WORD = re.compile(f"[{WHITE}]*{_RUN}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The same for tokenizers that drop white space.
WORD = re.compile(f"{_RUN}|[^{WHITE}]+")


class IdCache:
    """Ids of texts by a tokenizers file; holds a bounded number of words.

    split: pattern of the pieces of text that the tokenizer treats independently."""

    def __init__(self, path: str, split: re.Pattern, most: int = 800_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.most, self.known = Tokenizer.from_file(path), split, most, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        lists = [self.split.findall(t) for t in texts]
        new = set(chain.from_iterable(lists)).difference(known)
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(chain.from_iterable(lists))
        new = list(new)
        known.update(zip(new, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in lists]

    def of(self, column: pa.Array, most: int = 8 * BLOCK_BYTES) -> Iterator[bytes]:
        """The ids of a column of texts, text by text; a null counts as empty."""
        held, size = [], 0
        for t in column:
            t = t.as_py() or ""
            held.append(t)
            size += len(t)
            if size >= most:
                yield from self.ids(held)
                held, size = [], 0
        yield from self.ids(held)


@functools.lru_cache(2)
def id_cache(path: str, spaced: bool) -> IdCache:
    """One cache for all tasks of a Python worker."""
    return IdCache(path, SPACED_WORD if spaced else WORD)

"""Language identification by rank-order profiles of letter n-grams (1 to 3 letters, word ends included).

A profile is the `size` most frequent n-grams of a language's training texts, by rank. A document's own most
frequent n-grams are compared with each profile: an n-gram's distance is how far out of place it is, or `size`
where the profile lacks it. The least mean distance wins, ties by name. The score is 1 less that mean as a
share of the largest possible one.

Training uses text and language of a sample of about `train_docs` documents of each language (a parameter; all
of them where there are fewer); every document is then predicted from its whole text alone. A null text and one
without letters give `und` and score 0. Without any labelled document all predictions are `und`;
a table without a column `lang` can't be learned from and is an error, as are more than 5,000 languages, whose profiles wouldn't fit a worker.
Repeated rows are predicted each, extra columns take no part, an empty table gives no rows, and n-grams of long texts are counted in parts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import texts, whole_rows

#: N-grams counted at once.
CHUNK = 1 << 19
#: Bounds what is broadcast: languages with their numbers of documents.
MOST_LANGUAGES = 5000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> np.ndarray:
    """The text's letters in lower case, each run of other characters as one 0, 0 at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def _grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, 21 bits a character, and how often each occurs."""
    found, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for i in range(0, len(c), CHUNK):
        one, two, three = c[i : i + CHUNK], c[i + 1 : i + CHUNK + 1], c[i + 2 : i + CHUNK + 2]
        pair = (one[: len(two)] << np.uint64(21)) | two
        triple = (pair[: len(three)] << np.uint64(21)) | three
        u, k = np.unique(np.concatenate([one[one != 0], pair, triple[two[: len(three)] != 0]]), return_counts=True)
        if len(found):
            u, inverse = np.unique(np.concatenate([found, u]), return_inverse=True)
            k = np.bincount(inverse, weights=np.concatenate([n, k])).astype(np.int64)
        found, n = u, k
    return found, n


def _top(found: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by n-gram."""
    return found[np.argsort(-n, kind="stable")[:size]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out():
        for lang, parts in held.items():
            u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, []).append(_grams(_symbols(text.as_py())))
        if sum(len(p[0]) for parts in held.values() for p in parts) > 2_000_000:
            yield from out()
            held = {}
    yield from out()


def profiles(labelled: DataFrame, *, size: int = 300, train_docs: int = 2000, seed: int = 11) -> dict[str, list[int]]:
    """Each language's n-grams by rank, from rows (doc_id, text, lang); one short list for each language reaches the driver."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = rows.sparkSession.createDataFrame(counts, "lang string, n long")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(F.broadcast(counts), "lang").where(chance * F.col("n") < train_docs).select("lang", "text")
    grams = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    best = grams.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32)))
    for by in (["lang", "part"], ["lang"]):
        best = best.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "place", "gram").collect()):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class _Predictor:
    def __init__(self, found: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(found), size
        self.known = np.unique(np.array([g for v in found.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, np.array(found[lang], np.uint64))] = np.arange(len(found[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        c = _symbols(text or "")
        if not self.langs or not c.any():
            return "und", 0.0
        top = _top(*_grams(c), self.size)
        at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        there = self.ranks[:, np.where(self.known[at] == top, at, len(self.known))]
        away = np.where(there < 0, self.size, np.abs(there - np.arange(len(top)))).sum(axis=1)
        k = int(away.argmin())
        return self.langs[k], 1.0 - float(away[k]) / (self.size * len(top))


def _predicted(found: dict[str, list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict_one = _Predictor(found, size)
        for batch in batches:
            out = [predict_one(text.as_py()) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def _identified(found: dict[str, list[int]], size: int, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict_one = _Predictor(found, size)
        for batch in batches:
            out = (predict_one(text.as_py()) for text in batch.column(at))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in out], pa.bool_()))

    return run


def predict(documents: DataFrame, found: dict[str, list[int]], *, size: int = 300) -> DataFrame:
    """doc_id, lang_pred and score of each document by the given profiles."""
    return texts(documents).mapInArrow(_predicted(found, size), "doc_id long, lang_pred string, score double")


def identified(documents: DataFrame, *, least: float = 0.2, size: int = 300, train_docs: int = 2000) -> DataFrame:
    """The documents, all columns, that have a language with a score of `least` or more; the rows stay where they are."""
    found = profiles(_labelled(documents), size=size, train_docs=train_docs)
    own = documents.select(whole_rows(documents), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_identified(found, size, least, 1), own.schema).select("own.*")


def _labelled(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out())


def held_out(doc_id: str = "doc_id"):
    """Whether a document takes no part in training: a fixed quarter, by its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, *, size: int = 300, train_docs: int = 2000) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all."""
    return predict(documents, profiles(_labelled(documents), size=size, train_docs=train_docs), size=size).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

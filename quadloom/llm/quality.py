"""Quality rules as a cascade: rules are ordered by what they reject per second, as a sample shows, and a document
leaves at its first failed rule.

Every document gets the base figures (words, their code points, symbols, repeated lines, words in repeated
3-word windows). Documents that pass the base rule go through the cascade; each later rule runs on what the
earlier ones left. The order changes the time taken and never the verdict. A null text counts as empty and
fails the base rule, as does any text under 50 words; repeated rows are judged each.
An empty table gives no rows, extra columns of any name take no part, and a text of any length is judged whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import Block, blocks, raw_texts, window_hashes, word_hashes

_FIGURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


class Figures:
    """A block's base figures, one number for each document."""

    def __init__(self, b: Block):
        self.block, self.first = b, b.first[:-1]
        self.n_words = np.diff(b.first)
        lead = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
        self.word_chars = self.by_doc(lead[b.ends] - lead[b.starts])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[b.data])])
        self.n_symbols = symbols[b.doc_start[1:] - 1] - symbols[b.doc_start[:-1]]
        self.n_dup_lines = np.zeros(b.n_docs, np.int64)
        self.n_lines = np.zeros(b.n_docs, np.int64)
        whole = b.data.tobytes()
        for i in range(b.n_docs):
            lines = [x for x in whole[b.doc_start[i] : b.doc_start[i + 1] - 1].split(b"\n") if x.strip()]
            self.n_lines[i] = len(lines)
            self.n_dup_lines[i] = len(lines) - len(set(lines))
        self.n_repeat_words = self.by_doc(self._repeated())

    def by_doc(self, of_words: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_words)])
        return total[self.block.first[1:]] - total[self.block.first[:-1]]

    def _repeated(self) -> np.ndarray:
        b = self.block
        n = len(b.starts)
        doc = np.repeat(np.arange(b.n_docs), self.n_words)
        inside = np.flatnonzero(doc[: n - 2] == doc[2:]) if n > 2 else np.empty(0, np.int64)
        self.hashes = word_hashes(b)
        h = window_hashes(self.hashes, 3)[inside] if len(inside) else np.empty(0, np.uint64)
        order = np.lexsort((h, doc[inside]))
        h, d = h[order], doc[inside][order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        at = inside[order][again]
        covered = np.zeros(n, np.int64)
        for k in range(3):
            covered[at + k] = 1
        return covered

    def words_at(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of some documents, and where each document's begin among them."""
        n = self.n_words[docs]
        begin = np.concatenate([[0], np.cumsum(n)])
        return np.repeat(self.first[docs] - begin[:-1], n) + np.arange(begin[-1]), begin


def _share(x: Figures, docs: np.ndarray, is_such: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]) -> np.ndarray:
    """The share of such words in each of some documents, whose bytes alone are read; is_such gets counts of a table's bytes by word."""
    b = x.block
    at, begin = x.words_at(docs)
    size = b.lengths[docs]
    moved = np.cumsum(size) - size
    data = b.data[np.repeat(b.doc_start[docs] - moved, size) + np.arange(size.sum())] if len(docs) < b.n_docs else b.data
    shift = np.repeat(b.doc_start[docs] - moved, x.n_words[docs]) if len(docs) < b.n_docs else 0
    starts, ends = b.starts[at] - shift, b.ends[at] - shift

    def counts(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[ends] - total[starts]

    total = np.concatenate([[0], np.cumsum(is_such(counts))])
    return (total[begin[1:]] - total[begin[:-1]]) / np.maximum(1, x.n_words[docs])


def few_symbols(x: Figures, docs: np.ndarray) -> np.ndarray:
    """Fewer symbols than a fifth of the words."""
    return 5 * x.n_symbols[docs] < x.n_words[docs]


def usual_word_length(x: Figures, docs: np.ndarray) -> np.ndarray:
    """Words of 2 to 20 code points on average."""
    return (x.word_chars[docs] >= 2 * x.n_words[docs]) & (x.word_chars[docs] <= 20 * x.n_words[docs])


def few_repeated_lines(x: Figures, docs: np.ndarray) -> np.ndarray:
    """At most half of the lines repeat an earlier one."""
    return 2 * x.n_dup_lines[docs] <= x.n_lines[docs]


def few_capitals(x: Figures, docs: np.ndarray) -> np.ndarray:
    """At most half of the words have two capitals or more from A to Z and no other letter but capitals."""
    return _share(x, docs, lambda counts: ((n := counts(_UPPER)) >= 2) & (n == counts(_LETTER))) <= 0.5


def mostly_letters(x: Figures, docs: np.ndarray) -> np.ndarray:
    """At least six in ten words hold a letter."""
    return _share(x, docs, lambda counts: counts(_LETTER) > 0) >= 0.6


def varied_words(x: Figures, docs: np.ndarray) -> np.ndarray:
    """No word makes up more than three in ten words."""
    out = np.ones(len(docs), bool)
    for k, i in enumerate(docs):
        own = x.hashes[x.block.words_of(i)]
        out[k] = 10 * np.unique(own, return_counts=True)[1].max(initial=0) <= 3 * len(own)
    return out


RULES: dict[str, Callable[[Figures, np.ndarray], np.ndarray]] = {f.__name__: f for f in (few_symbols, usual_word_length, few_repeated_lines, few_capitals, mostly_letters, varied_words)}


def base_failed(x: Figures) -> np.ndarray:
    return (x.n_words < 50) | (100 * x.n_repeat_words > 50 * x.n_words)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, gone, took = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0.0)
    for batch in batches:
        for _, _, b in blocks(batch):
            x = Figures(b)
            docs = np.flatnonzero(~base_failed(x))
            for name, rule in RULES.items():
                began = time.perf_counter()
                ok = rule(x, docs)
                took[name] += time.perf_counter() - began
                seen[name] += len(docs)
                gone[name] += len(docs) - int(ok.sum())
    yield pa.record_batch([pa.array(list(v)) for v in (RULES, seen.values(), gone.values(), took.values())], names=["rule", "seen", "gone", "took"])


def rule_order(documents: DataFrame, *, sample_docs: int = 2000, seed: int = 7) -> list[str]:
    """Rules by rejections per second on a sample of about sample_docs documents; it settles the order alone."""
    total = documents.count()
    sample = raw_texts(documents).sample(fraction=min(1.0, sample_docs / max(1, total)), seed=seed)
    rows = sample.mapInArrow(_sampled, "rule string, seen long, gone long, took double").groupBy("rule").agg(F.sum("gone").alias("gone"), F.sum("took").alias("took")).collect()
    worth = {r.rule: r.gone / max(r.took, 1e-9) for r in rows}
    return sorted(RULES, key=lambda name: (-worth.get(name, 0.0), name))


def _judged(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b in blocks(batch):
                x = Figures(b)
                failed = base_failed(x)
                docs = np.flatnonzero(~failed)
                for name in order:
                    if not len(docs):
                        break
                    docs = docs[RULES[name](x, docs)]
                kept = np.zeros(b.n_docs, bool)
                kept[docs] = True
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(v.astype(np.int64)) for v in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)), pa.array(failed), pa.array(kept)], names=_NAMES)

    return run


def quality(documents: DataFrame, *, sample_docs: int = 2000) -> DataFrame:
    """Each document's base figures, whether the base rule failed, and whether all rules passed."""
    order = rule_order(documents, sample_docs=sample_docs)
    return raw_texts(documents).mapInArrow(_judged(order), _FIGURES)

"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items, run once over each text.

Words are runs of ASCII letters (lower-cased), digits and all non-ASCII characters, so both sides are normalised alike. A
window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Each word of a window is
one symbol of the automaton, words that no window has are one other symbol, so a document is a string with a character a word
and matches end at word borders. Places of hits are counted in words and mapped back to code points of the original text.

The distinct windows and the items that hold them are dealt by hash to automata of at most MOST_WORDS symbols; a benchmark of usual size has
one. Each further automaton is a further pass over the texts that adds to the hits found, so a benchmark of any size is searched whole.
Only one automaton's windows are at the driver and in a Python worker at a time.

Nulls have no words, no hits and no items; so do empty texts. Texts of any length are read in pieces of SEGMENT bytes that
overlap by the last window's words. Each row of the input, repeated ids and null ids too, has its row of the output; extra
columns take no part. A repeated item counts once; an item without an item_id marks words but isn't listed. An empty benchmark
hits nothing, an empty documents table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadloom.llm.common import dropped, quoted, texts, whole_rows, written

#: Symbols of an automaton at most (a node has some 60 bytes).
MOST_WORDS = 500_000
#: Bytes of a text whose words are held at once.
SEGMENT = 1 << 22

#: Upper-case ASCII letters to lower case, what isn't part of a word to a space.
_FOLD = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PART = np.frombuffer(_FOLD, np.uint8) != 32
_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(items: DataFrame, window: int = 10) -> DataFrame:
    """Distinct item (as a string, null where it has none) and gram (words joined by spaces) of rows (item_id, text)."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(low, F.lit(_NORMAL), F.lit(0)).alias("words")).where("size(words) > 0")
    grams = F.expr(f"transform(sequence(1, greatest(1, size(words) - {window - 1})), i -> array_join(slice(words, i, {window}), ' '))")
    return words.select("item", F.explode(grams).alias("gram")).distinct()


class Automaton:
    """The automaton of some windows: (gram, item) pairs, of which an item may be null."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        import ahocorasick

        held: dict[str, set] = {}
        for gram, item in pairs:
            held.setdefault(gram, set()).add(item)
        self.symbols: dict[bytes, str] = {}
        self.found = ahocorasick.Automaton()
        for gram, items in held.items():
            # Symbol 1 is any other word.
            key = "".join(self.symbols.setdefault(w, chr(len(self.symbols) + 2)) for w in gram.encode().split(b" "))
            self.found.add_word(key, (len(key), frozenset(i for i in items if i is not None)))
        self.longest = max((k.count(" ") + 1 for k in held), default=0)
        if held:
            self.found.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the hits (first word and the one after the last, ascending and disjoint) and the items."""
        n, back, tail = 0, 0, ""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        get, at, size = self.symbols.get, 0, len(raw)
        while at < size:
            end = _cut(raw, min(size, at + SEGMENT))
            words = raw[at:end].translate(_FOLD).split()
            at = end
            if not self.longest:
                n += len(words)
                continue
            code = tail + "".join([get(w, "\x01") for w in words])
            for last, (length, which) in self.found.iter(code):
                if last < back:
                    continue  # found with the segment before
                last += 1 + n - back
                first = last - length
                # Matches come by their ends; a longer one may reach back over several spans.
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, last))
                items |= which
            n += len(words)
            back = min(len(code), self.longest - 1)
            tail = code[len(code) - back :]
        return n, spans, items


def _cut(raw: bytes, at: int) -> int:
    """The first place from `at` on where no word goes on."""
    while at < len(raw) and _PART[raw[at]]:
        at += 1
    return at


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as code points of the original text."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _PART[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in spans]


#: The automaton that this Python worker used last, by its name.
_LAST: dict[str, Automaton] = {}


def _automaton(key: str, pairs) -> Automaton:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Automaton(pairs.value)
    return _LAST[key]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_STRUCT = "array<struct<start: long, end: long>>"


def _as_spans(lists: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [s for spans in lists for s in spans]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), values).cast(_SPANS)


def _pass(key: str, pairs, last: bool):
    """A pass of one automaton: adds its hits to rows (own, text, hits, items); the last gives places instead of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(key, pairs)
        for batch in batches:
            n_words, spans, listed, places, n_hit = [], [], [], [], []
            for text, held, before in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = text.as_py() or b""
                n, hits, items = found.scan(raw)
                if len(held):
                    hits = _merged(hits + [(s["start"], s["end"]) for s in held.as_py()])
                n_words.append(n)
                spans.append(hits)
                listed.append(sorted(items.union(before.as_py())))
                if last:
                    n_hit.append(sum(b - a for a, b in hits))
                    places.append(_places(raw, hits) if hits else hits)
            items = pa.array(listed, pa.list_(pa.string()))
            if last:
                arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items, _as_spans(places)]
                yield pa.record_batch(arrays, names=["own", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.record_batch([batch.column(0), batch.column(1), _as_spans(spans), items], names=["own", "text", "hits", "items"])

    return run


def _found(rows: DataFrame, benchmark: DataFrame, window: int, most_words: int) -> DataFrame:
    """own, n_words, n_hit, items, spans of rows (own, text as bytes)."""
    spark = rows.sparkSession
    grams = written(windows(benchmark, window), "benchmark-windows")
    size = grams.agg(F.sum(F.size(F.split("gram", " "))).alias("n")).first().n or 0
    parts = -(-size * 5 // (4 * most_words)) if size > most_words else 1
    rows = rows.select("own", "text", F.expr(f"cast(array() as {_STRUCT})").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    held = None
    for part in range(parts):
        some = grams if parts == 1 else grams.where(F.pmod(F.xxhash64("gram", "item"), F.lit(parts)) == part)
        pairs = spark.sparkContext.broadcast([(r.gram, r.item) for r in some.select("gram", "item").collect()])
        last = part == parts - 1
        own, spans, items = (rows.schema[c].dataType for c in ("own", "hits", "items"))
        schema = StructType().add("own", own)
        if last:
            schema = schema.add("n_words", "long").add("n_hit", "long").add("items", items).add("spans", spans)
        else:
            schema = schema.add("text", "binary").add("hits", spans).add("items", items)
        rows = rows.mapInArrow(_pass(f"{grams.folder}-{part}", pairs, last), schema)
        if not last:
            rows = written(rows, "benchmark-hits")
            if held is not None:
                dropped(spark, held)
            held = rows
    return rows


def contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (start and end in code points) of each document.

    most_words: symbols of one automaton; the result doesn't hang on it."""
    rows = texts(documents).select(F.col("doc_id").alias("own"), F.col("text").cast("binary").alias("text"))
    return _found(rows, benchmark, window, most_words).withColumnRenamed("own", "doc_id")


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, most: float = 0.0) -> DataFrame:
    """The documents, with all their columns, of whose words at most the share `most` is hit; those without words stay."""
    texts(documents)
    rows = documents.select(whole_rows(documents), F.col("text").cast("string").cast("binary").alias("text"))
    found = _found(rows, benchmark, window, MOST_WORDS)
    return found.where(F.col("n_hit") <= F.col("n_words") * most).select(*(F.col(f"own.{quoted(c)}") for c in documents.columns))

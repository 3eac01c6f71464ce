"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece of the model crosses: before the marks that stand for spaces, between an ASCII letter
and a stop where the model has no piece with such a pair, and in long units between any two code points that are
neighbours in no piece. Each distinct unit is encoded once: its substrings up to the longest piece's length are exploded and joined to
the table of pieces, which gives the unit's edges; edges are grouped by unit and folded, with Spark's `aggregate`, into a
segmentation. An edge is one long (the piece's place by score, start, length, id), units are dealt out once, by a number of
tasks that follows their number, and each carries the places in blocks of documents that ask for it. The answers go back by block, where
the documents' units are replaced by their ids.

The public model is a BPE model. A Viterbi fold takes the best sum of scores, which for BPE isn't what the library
gives, so the fold runs over the same edges in the order of their scores instead: an edge is taken when it
joins exactly two of the parts there are, which is BPE's merging. The parts are bits of a long; for units of more than 60 code points,
whose substrings are exploded tile by tile, the same fold keeps its parts in a linked list. A code point without a piece becomes
its bytes' pieces. Null and empty texts have no ids, an empty table has no rows, each row has its row of the result,
and columns other than doc_id and text, whatever their names, take no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import dropped, new_folder, partitions, texts, written

SPACE = "▁"
#: Code points of a unit whose parts fit the bits of a long; longer units are exploded by tiles of so many starts.
FOLDED = 60
#: Units of a block of documents, units that a task folds, and units of documents that make one row.
BLOCK_UNITS, TASK_UNITS, CHUNK_UNITS = 6_000_000, 100_000, 1 << 18
#: Bits of an edge's fields from the lowest: the piece's id (_NONE: no piece, so bytes), its span (start and length), above them its place.
_ID, _SPAN = 20, 14
_NONE, _LAST = (1 << _ID) - 1, (1 << 28) - 1
#: Bits of a unit's number in its block.
_NUMBER = 23

_ROWS = "kind string, block long, number long, at int, unit string, doc_ids array<long>, counts binary, units binary"
_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("at", pa.int32()), ("unit", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("units", pa.binary())])


class Model:
    """What the joins need of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path = path
        ids = range(sp.vocab_size())
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        #: Piece, id and the place of its score from the best.
        self.pieces = [(sp.id_to_piece(i), i, places[sp.get_score(i)]) for i in plain]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if any(SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces):
            raise ValueError("the model has pieces over several words")
        if sp.vocab_size() >= _NONE or FOLDED * (self.longest + 1) > 1 << _SPAN:
            raise ValueError("the model has too many or too long pieces")
        #: Neighbours within pieces.
        self.pairs = frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))
        stops = "".join(c for c in ".,!?;:" if not any(re.search(f"[A-Za-z]{re.escape(c)}", p) for p, _, _ in self.pieces))
        run = f"{SPACE}*[A-Za-z]+(?![^{SPACE}{stops}])|" if stops else ""
        self.unit = f"{run}{SPACE}*[^{SPACE}]+|{SPACE}+"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pieces, "piece string, id int, place int")


def _cut(unit: str, pairs: frozenset[str]) -> list[str]:
    """The unit in parts that no piece crosses, by their neighbouring code points."""
    ends = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pairs]
    return [unit[a:b] for a, b in zip([0, *ends], [*ends, len(unit)], strict=True)]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, small ones often, compressed: a byte for those below 255, and the others' byte planes after them."""
    import zstandard

    numbers = numbers.astype("<u4")
    planes = np.ascontiguousarray(numbers[numbers >= 255].view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(3).compress(np.minimum(numbers, 255).astype(np.uint8).tobytes() + planes.tobytes() + len(numbers).to_bytes(8, "little"))


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[-8:], "little")
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    planes = np.frombuffer(data, np.uint8, len(data) - n - 8, n).reshape(4, -1)
    out[out == 255] = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return out


def _split(pattern: str, pairs: frozenset[str], longest: int):
    units = re.compile(pattern, re.S)

    def rows(kind: str, of: int, n: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array([kind] * n, pa.string()), pa.array([of] * n, pa.int64()), *(pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in list(_ARROW)[2:])], schema=_ARROW)

    def block(at: int, doc_ids: list, counts: list[int], held: list[np.ndarray], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held) if held else np.empty(0, np.int64)
        # Frequent units get small numbers.
        order = np.argsort(-np.bincount(every, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        every = rank[every]
        counts = np.array(counts, np.int64)
        ends = np.cumsum(counts)
        chunk = (ends - counts) // CHUNK_UNITS
        for part in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(chunk)) + 1):
            if len(part):
                a, b = part[0], part[-1] + 1
                yield rows("documents", at, 1, doc_ids=[doc_ids[a:b]], counts=[_packed(counts[a:b])], units=[_packed(every[ends[a] - counts[a] : ends[b - 1]])])
        names = list(numbers)
        long_ = [k for k in order.tolist() if len(names[k]) > FOLDED]
        short = [k for k in order.tolist() if len(names[k]) <= FOLDED] if long_ else order.tolist()
        for i in range(0, len(short), 20_000):
            some = short[i : i + 20_000]
            yield rows("units", at, len(some), number=rank[some], unit=[names[k] for k in some])
        for k in long_:
            tiles = range(0, len(names[k]), FOLDED)
            yield rows("tiles", at, len(tiles), number=[int(rank[k])] * len(tiles), at=list(tiles), unit=[names[k][t : t + FOLDED + longest - 1] for t in tiles])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId() << 20, 0, 0
        doc_ids, counts, held = [], [], []
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                own = units.findall(SPACE + text.replace(" ", SPACE)) if text else []
                if max(map(len, own), default=0) > FOLDED:
                    own = [p for u in own for p in ([u] if len(u) <= FOLDED else _cut(u, pairs))]
                doc_ids.append(doc_id)
                counts.append(len(own))
                held.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)).astype(np.int32))
                size += len(own)
                if size >= BLOCK_UNITS:
                    yield from block(task + number, doc_ids, counts, held, numbers)
                    doc_ids, counts, held, size, number = [], [], [], 0, number + 1
                    numbers.clear()
        if doc_ids:
            yield from block(task + number, doc_ids, counts, held, numbers)

    return run


def lattice(units: DataFrame, model: Model, starts: str = "char_length(unit)") -> DataFrame:
    """The units' rows, one for each edge: substrings that are pieces, and single code points, whether they are or not.

    start (from 1), len, and edge: one long, by whose order pieces of better scores come first, then those further left; single code points come last."""
    # As many rows as the model has pieces.
    pieces = F.broadcast(model.table(units.sparkSession))
    spans = units.select("*", F.explode(F.expr(f"sequence(1, {starts})")).alias("start"))
    spans = spans.select("*", F.explode(F.expr(f"sequence(1, least({model.longest}, char_length(unit) - start + 1))")).alias("len"))
    edges = spans.withColumn("piece", F.substring("unit", F.col("start"), F.col("len"))).join(pieces, "piece", "left").where("id IS NOT NULL OR len = 1")
    place = f"cast(CASE WHEN len = 1 THEN {_LAST} ELSE place END as bigint)"
    edge = F.expr(f"shiftleft({place}, {_ID + _SPAN}) | shiftleft(cast((start - 1) * {model.longest + 1} + len as bigint), {_ID}) | coalesce(id, {_NONE})")
    return edges.withColumn("edge", edge).drop("piece", "id", "place")


def _fold(longest: int) -> str:
    """Expression for a unit's parts from its edges, in the order of their scores: span and id of each, as one long, from left to right.

    A unit's parts begin where the bits of a long are set. An edge is taken if both of its ends and one place between them are set: that place goes."""
    spans = [(start, n) for start in range(FOLDED) for n in range(longest + 1)]
    bits = lambda values: "array(" + ", ".join(f"{v % (1 << 62)}L" for v in values) + ")"
    whole = bits((2 << start + n) - (1 << start) for start, n in spans)
    inner = bits(max(0, (1 << start + n) - (2 << start)) for start, n in spans)
    outer = bits((1 << start) | (1 << start + n) for start, n in spans)
    span = f"shiftright(e, {_ID}) & {(1 << _SPAN) - 1}"
    joined = "slice(edges, 1, size(edges) - char_length(unit))"
    taken = f"bit_count(m & {whole}[{span}]) = 3 AND bit_count(m & {inner}[{span}]) = 1"
    parts = f"aggregate({joined}, shiftleft(2L, char_length(unit)) - 1, (m, e) -> CASE WHEN {taken} THEN m & ~{inner}[{span}] ELSE m END)"
    kept = f"transform(filter(edges, e -> m & {whole}[{span}] = {outer}[{span}]), e -> e & {(1 << _ID + _SPAN) - 1})"
    return f"sort_array(transform(array({parts}), m -> {kept})[0])"


def _folded_long(model: Model):
    longest, first_byte = model.longest, model.bytes[0]

    """As _fold(), for one unit of any length from its tiles' edges (block, number, at, edge, char), and at once its answer as _answers() gives it."""

    def run(t: pa.Table) -> pa.Table:
        edge = t["edge"].to_numpy()
        span = (edge >> _ID) & ((1 << _SPAN) - 1)
        place, length, start = edge >> (_ID + _SPAN), span % (longest + 1), t["at"].to_numpy().astype(np.int64) + span // (longest + 1)
        end = start + length
        n = int(end.max())
        after, part = list(range(1, n + 1)), [True] * n + [False]
        order = np.lexsort((start, place))
        order = order[length[order] > 1]
        for a, b in zip(start[order].tolist(), end[order].tolist(), strict=True):
            if part[a] and (m := after[a]) < b and after[m] == b:
                part[m], after[a] = False, b
        kept = np.flatnonzero(np.array(part[:n])[start] & (np.array(after)[start] == end))
        kept = kept[np.argsort(start[kept])]
        chars = t["char"]
        ids = [x for k in kept.tolist() for x in ([int(edge[k] & _NONE)] if edge[k] & _NONE != _NONE else [b + first_byte for b in chars[k].as_py().encode()])]
        return pa.table({"of": t["block"][:1], **{name: pa.array([_packed(np.array(x))], pa.binary()) for name, x in (("numbers", [t["number"][0].as_py()]), ("counts", [len(ids)]), ("ids", ids))}})

    return run


_ANSWERS = "of long, numbers binary, counts binary, ids binary"


def encode_units(table: DataFrame, model: Model) -> DataFrame:
    """The ids of each distinct unit, as rows for the blocks that ask for it (of: the block; numbers, counts, ids: packed)."""
    rows = table.where("kind = 'units'")
    tasks = max(partitions(table.sparkSession), -(-rows.count() // TASK_UNITS))
    units = rows.select("unit", F.expr(f"shiftleft(block, {_NUMBER}) | number").alias("at")).repartition(tasks, "unit").groupBy("unit").agg(F.collect_list("at").alias("ats"))
    # Only one edge of a unit takes its places along.
    edges = lattice(units.withColumn("u", F.monotonically_increasing_id()), model).select("u", "unit", "edge", F.expr("CASE WHEN start = 1 AND len = 1 THEN ats END").alias("ats"))
    grouped = edges.groupBy("u", "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.first("ats", ignorenulls=True).alias("ats"))
    folded = grouped.select("ats", "unit", F.expr(_fold(model.longest)).alias("parts")).mapInArrow(_answers(model), _ANSWERS)
    tiles = lattice(table.where("kind = 'tiles'").select("block", "number", "at", "unit"), model, starts=f"least(char_length(unit), {FOLDED})")
    tiles = tiles.select("block", "number", "at", "edge", F.expr("CASE WHEN len = 1 THEN substring(unit, start, 1) END").alias("char"))
    return folded.unionByName(tiles.groupBy("block", "number").applyInArrow(_folded_long(model), _ANSWERS))


def _answers(model: Model):
    """(ats, unit, parts) of a task's units to a row for each block that asks for some of them, with code points without a piece as bytes."""
    wide, first_byte = model.longest + 1, model.bytes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ats, of, flat, n = [], [], [], []
        seen = 0
        for batch in batches:
            lists, own = batch.column(0), batch.column(2)
            counts, k = np.diff(lists.offsets.to_numpy()), np.diff(own.offsets.to_numpy())
            parts = own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()]
            ids = parts & _NONE
            if (ids == _NONE).any():
                each = np.repeat(np.arange(len(k)), k)
                bare = np.flatnonzero(ids == _NONE)
                units = batch.column(1)
                put, wider = [[x] for x in ids.tolist()], k.copy()
                for i in bare.tolist():
                    row = int(each[i])
                    put[i] = [first_byte + b for b in units[row].as_py()[int(parts[i] >> _ID) // wide].encode()]
                    wider[row] += len(put[i]) - 1
                ids, k = np.array([x for p in put for x in p], np.int64), wider
            ats.append(lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()])
            of.append(np.repeat(np.arange(seen, seen + len(counts)), counts))
            flat.append(ids)
            n.append(k)
            seen += len(counts)
        if not seen:
            return
        ats, of, flat, n = (np.concatenate(x).astype(np.int64) for x in (ats, of, flat, n))
        begin = np.cumsum(n) - n
        order = np.argsort(ats)
        ats, of = ats[order], of[order]
        for part in np.split(np.arange(len(ats)), np.flatnonzero(np.diff(ats >> _NUMBER)) + 1):
            own = of[part]
            k, ends = n[own], np.cumsum(n[own])
            ids = flat[np.repeat(begin[own] - ends + k, k) + np.arange(ends[-1])]
            numbers = ats[part] & ((1 << _NUMBER) - 1)
            yield pa.record_batch([pa.array([int(ats[part[0]] >> _NUMBER)]), *(pa.array([_packed(x)], pa.binary()) for x in (np.diff(numbers, prepend=0), k, ids))], names=["of", "numbers", "counts", "ids"])

    return run


def _gathered(docs: pa.Table, answers: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """One block's documents (doc_ids, counts, units) and its units' ids (numbers, counts, ids) to doc_ids, all their ids, and where each one's end; chunk by chunk."""
    parts = [(np.cumsum(_unpacked(a.as_py())), _unpacked(b.as_py()), _unpacked(c.as_py()).astype("<u4")) for a, b, c in zip(answers["numbers"], answers["counts"], answers["ids"], strict=True)]
    number, each, flat = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, "<u4") for i in range(3))
    n = np.zeros(len(number), np.int64)
    begin = np.zeros(len(number), np.int64)
    n[number], begin[number] = each, np.cumsum(each) - each
    for ids, counts, units in zip(docs["doc_ids"], docs["counts"], docs["units"], strict=True):
        own = _unpacked(units.as_py())
        k = n[own]
        ends = np.concatenate([[0], np.cumsum(k)])
        yield ids.as_py(), flat[np.repeat(begin[own] - ends[1:] + k, k) + np.arange(ends[-1])], ends[np.cumsum(_unpacked(counts.as_py()))]


def _listed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    doc_ids, lists = [], []
    for own, ids, ends in _gathered(docs, answers):
        doc_ids += own
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.chunked_array(lists, pa.list_(pa.int32()))})


def _encoded(documents: DataFrame, model: Model, gather, schema: str) -> DataFrame:
    spark = documents.sparkSession
    at = new_folder(spark, "units")
    table = written(texts(documents).mapInArrow(_split(model.unit, model.pairs, model.longest), _ROWS), "units", at=at, by="kind")
    answers = written(encode_units(table, model), "unit-ids")
    docs = table.where("kind = 'documents'").select("block", "doc_ids", "counts", "units")
    dropped(spark, f"{at}/kind=units", f"{at}/kind=tiles")
    # A block is bounded by its scan, so are the two groups that meet here.
    return docs.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(lambda d, a: gather(d, a), schema)


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids of each document, as the library gives them without begin and end."""
    return _encoded(documents, Model(model_path), _listed, "doc_id long, ids array<int>")


def _table(model: Model) -> list[bytes]:
    out = [b""] * (max([*model.bytes, *(i for _, i, _ in model.pieces)]) + 1)
    for p, i, _ in model.pieces:
        out[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(model.bytes):
        out[i] = bytes([b])
    return out


def _text(table: list[bytes], ids: np.ndarray) -> bytes:
    """Without the space put before a text; bytes that aren't UTF-8 come out as replacement characters."""
    return b"".join(map(table.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace").encode()


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of ids: the pieces' texts with spaces for marks, the bytes of byte pieces; null ids give an empty text."""
    table = _table(Model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_text(table, x.values.to_numpy()) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Encodes the documents and decodes the ids again: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers) and decoded_sha256 (of the ids' text)."""
    import hashlib
    import zlib

    model = Model(model_path)
    table = _table(model)

    def digested(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for doc_ids, ids, ends in _gathered(docs, answers):
            for doc_id, a, b in zip(doc_ids, [0, *ends.tolist()], ends.tolist(), strict=False):
                rows.append((doc_id, b - a, zlib.crc32(ids[a:b].tobytes()), hashlib.sha256(_text(table, ids[a:b])).hexdigest()))
        types = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string()}
        return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(types.items())})

    return _encoded(documents, model, digested, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")

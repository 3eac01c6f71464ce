"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Words are lower-cased (A-Z) runs of bytes other than x09-x0D and x20. A document's set is its distinct
shingles, as 64-bit hashes. A first permutation of 32-bit numbers scatters the shingles over a circle; a
second one, applied after turning the circle by 0, 1, 2, ... steps, gives one signature coordinate for each
turn. Bands of coordinates are buckets of candidates.

Documents with equal sets (by a 128-bit digest) are one class and one node from then on, so copies never
meet each other. In a bucket, members are first compared with the one that shares most buckets with others (a
star, not all pairs); then with the best member of another component; when stars no longer
join much, members that are still in different components are compared: all pairs of small buckets as rows,
those of large ones in tiles of bounded bytes, of which only the links come out. What is told of a bucket goes to its members by
bucket and salt, so large buckets are no hot keys. So any two
nodes that share a bucket are either linked, connected by links, or found unlike by their full sets. A pair at
the threshold of 0.85 misses all 25 bands of 5 with a chance of 4e-7.

Null and empty texts and those without words have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle as a whole. Rows with the same doc_id and text are one document in the result,
each with its row; a null doc_id sorts after all others. An empty table gives no rows, extra columns of any name take no part
(and stay, where whole rows are returned), and a text of any length is one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import blocks, dropped, mix, raw_texts, whole_rows, window_hashes, word_hashes, written
from quadloom.llm.graph import components

BANDS, ROWS = 25, 5
LAST = 0x7FFFFFFFFFFFFFFF
#: Members up to which all pairs of a bucket become rows; bytes of sets of larger buckets that make one tile (one set at least).
SMALL, TILE_BYTES = 16, 1 << 20
#: A bucket's members are dealt to so many keys, so that none gets all of a large bucket.
SALTS = 256


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each block of the batch its first row and its documents' sorted shingle hashes."""
    for i, _, b in blocks(batch, lower=True):
        words = word_hashes(b)
        out = []
        for d in range(b.n_docs):
            own = words[b.words_of(d)]
            out.append(np.unique(window_hashes(own, min(k, len(own)))) if len(own) else own)
        yield i, out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n coordinates: the least second permutation of the shingles' places, after each turn of the circle."""
    places = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    turns = np.arange(n, dtype=np.uint32)[:, None]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(least, _second(places[i : i + 2048] - turns).min(axis=1), out=least)
    return least


def _band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sig = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key + sig[:, r])
    return key.view(np.int64)


def _scan(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in _sets(batch, k):
                digests = [_digest(s) if len(s) else None for s in sets]
                keys = [_band_keys(s, bands, rows) if len(s) else None for s in sets]
                yield pa.record_batch([batch.column(0).slice(i, len(sets)), batch.column(2).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "digest", "bands"])

    return run


def _candidates(k: int):
    """(rank, text, node, digest, bands) to (node, shingles, bands) of the rows whose text has the node's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, digests = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, sets in _sets(batch, k):
                own = [j for j, s in enumerate(sets) if len(s) and _digest(s) == digests[i + j]]
                yield pa.record_batch([pa.array([nodes[i + j] for j in own], pa.int64()), pa.array([sets[j].tobytes() for j in own], pa.binary()), batch.column(4).take(pa.array([i + j for j in own], pa.int64()))], names=["node", "shingles", "bands"])

    return run


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (len(z) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are alike."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(_alike(percent), "a long, b long")


def _compared(percent: int):
    """Links between the members of a tile (bucket, i, j, node, root, tile, shingles, bands), by their full sets.

    A pair that shares several buckets is compared in that of its first band only. What two sets can share is at most the
    number of either's shingles that occur in another member too, which spares most comparisons."""

    def run(t: pa.Table) -> pa.Table:
        i, j, bucket = t["i"][0].as_py(), t["j"][0].as_py(), t["bucket"][0].as_py()
        node, root, tile = (t[c].to_numpy() for c in ("node", "root", "tile"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
        bands = np.stack([x.values.to_numpy() for x in t["bands"]])
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        _, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.add.reduceat((n[inverse] > 1).astype(np.int64), np.cumsum(size) - size)
        own = np.flatnonzero(bands == bucket)[0] % bands.shape[1]
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        found = []
        for a in left.tolist():
            b = right[right > a] if i == j else right
            both = size[a] + size[b]
            most = np.minimum(common[a], common[b])
            b = b[(root[b] != root[a]) & (100 * most >= percent * (both - most))]
            if own:
                b = b[~(bands[b, :own] == bands[a, :own]).any(axis=1)]
            for k in b.tolist():
                z = np.concatenate([sets[a], sets[k]])
                z.sort()
                shared = int((z[1:] == z[:-1]).sum())
                if 100 * shared >= percent * (len(z) - shared):
                    found.append((node[a], node[k]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _told(rows: DataFrame, first: dict[str, str], then: dict[str, str]) -> DataFrame:
    """Figures of each bucket, as a row for each (bucket, salt) that it has: `first` of its salts, then those of the bucket."""
    by_salt = rows.groupBy("bucket", "salt").agg(*(F.expr(c).alias(k) for k, c in first.items()))
    whole = by_salt.groupBy("bucket").agg(*(F.expr(c).alias(k) for k, c in then.items()), F.collect_list("salt").alias("salts"))
    return whole.select("bucket", F.explode("salts").alias("salt"), *then)


_PLACE = ["bucket", "salt"]
_SPAN = {"least": "min(root)", "most": "max(root)"}
_WHOLE_SPAN = {"least": "min(least)", "most": "max(most)"}


def _within_large(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members in different components of buckets (bucket, salt, node, size, root) of any size.

    A bucket's members in its heaviest component (which need no comparing with one another) and the others are dealt into
    tiles of about TILE_BYTES; a pair of tiles is one group, so groups are bounded and the rows sent grow with the others' tiles."""
    by_root = open_.groupBy("bucket", "root").agg(F.sum("size").alias("size"))
    main = by_root.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("m"), F.sum("size").alias("size"))
    tiles = lambda size: F.ceil(size * 8 / TILE_BYTES).cast("int")
    main = main.select("bucket", F.col("m.root").alias("main"), tiles(F.col("m.size")).alias("in_main"), tiles(F.col("size") - F.col("m.size")).alias("others"))
    main = main.join(open_.select(*_PLACE).distinct(), "bucket")
    chance = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), n).cast("int")
    own = open_.join(main, _PLACE).withColumn("tile", F.when(F.col("root") == F.col("main"), -1 - chance(F.col("in_main"))).otherwise(chance(F.col("others"))))
    every = F.sequence(F.lit(0), F.col("others") - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_main = F.transform(F.sequence(F.lit(1), F.col("in_main")), lambda m: pair(F.col("tile"), -m))
    with_others = F.transform(every, lambda o: pair(F.least("tile", o), F.greatest("tile", o)))
    to = F.when(F.col("tile") < 0, F.transform(every, lambda o: pair(o, F.col("tile")))).otherwise(F.concat(with_main, with_others))
    dealt = own.select("bucket", "node", "root", "tile", F.explode(to).alias("to")).select("bucket", "to.i", "to.j", "node", "root", "tile")
    return dealt.join(sets, "node").select("bucket", "i", "j", "node", "root", "tile", "shingles", "bands").groupBy("bucket", "i", "j").applyInArrow(_compared(percent), "a long, b long")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id is its component's)."""
    return _grouped(documents, **options).drop("key")


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """The documents, all columns, less those whose component has a document with a lesser doc_id."""
    gone = _grouped(documents, **options).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    own = documents.select(whole_rows(documents), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("binary")).alias("key"))
    return own.join(gone, own.id.eqNullSafe(gone._id) & (own.key == gone._key), "left_anti").select("own.*")


def _grouped(documents: DataFrame, *, shingle_words: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, star_rounds: int = 2) -> DataFrame:
    spark = documents.sparkSession
    docs = raw_texts(documents)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    scanned = written(keyed.mapInArrow(_scan(shingle_words, bands, rows), "doc_id long, key long, n_shingles long, digest binary, bands array<long>"), "shingles")
    rank = F.coalesce("doc_id", F.lit(LAST))
    classes = scanned.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(rank.alias("rank"), "key")).alias("lead"), F.max("n_shingles").alias("size"), F.min("bands").alias("bands"))
    classes = written(classes.select("digest", "lead.rank", "lead.key", "size", "bands", F.monotonically_increasing_id().alias("node")), "classes")

    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    placed = classes.select("node", "size", salt, F.explode("bands").alias("bucket"))
    shared = _told(placed, {"n": "count(*)"}, {"members": "sum(n)"}).where("members > 1")
    alone = written(placed.join(shared, _PLACE), "members")
    weight = alone.groupBy("node").agg(F.sum("members").alias("weight"))
    members = written(alone.join(weight, "node").select(*_PLACE, "node", "size", "weight"), "members")
    dropped(spark, alone)
    weight = members.select("node").distinct()

    some = classes.join(weight, "node").select("rank", "key", "node", "digest", "bands")
    ranked = keyed.select(rank.alias("rank"), "key", "text").join(some, ["rank", "key"])
    sets = written(ranked.select("rank", "text", "node", "digest", "bands").mapInArrow(_candidates(shingle_words), "node long, shingles binary, bands array<long>"), "sets")
    nodes = some.select("node", "rank")

    fits = F.lit(100) * F.least("size", "other_size") >= F.lit(percent) * F.greatest("size", "other_size")
    labels, links, tried = None, None, None
    for _ in range(star_rounds):
        now = members.withColumn("root", F.col("node")) if labels is None else members.join(labels.select("node", "root"), "node")
        # The heaviest member of each bucket; later, of those in another component than the bucket's least one.
        head = "struct(weight, node, size, root)"
        if labels is not None:
            now = written(now.join(_told(now, _SPAN, _WHOLE_SPAN).where("least < most"), _PLACE), "open")
            head = f"CASE WHEN root <> least THEN {head} END"
        heads = _told(now, {"h": f"max({head})"}, {"h": "max(h)"}).select(*_PLACE, F.col("h.node").alias("other"), F.col("h.size").alias("other_size"), F.col("h.root").alias("other_root"))
        pairs = now.join(heads, _PLACE).where((F.col("root") != F.col("other_root")) & fits)
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if labels is not None:
            dropped(spark, now)
        if pairs.isEmpty():
            # Other members of the buckets may still fit one another; so each node is its own root.
            if labels is None:
                labels = written(nodes.select("node", F.col("node").alias("root"), F.col("rank").alias("root_rank")), "labels")
            break
        found = written(_links(pairs, sets, percent), "links")
        links = found if links is None else links.union(found)
        known = components(links, nodes, start=labels)
        whole = nodes.join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("root_rank", "rank").alias("root_rank"))
        labels = written(whole, "labels")
    now = members.join(labels.select("node", "root"), "node")
    span = _told(now, _SPAN | {"n": "count(*)"}, _WHOLE_SPAN | {"n": "sum(n)"}).where("least < most").select(*_PLACE, "n")
    open_ = written(now.join(span, _PLACE).select(*_PLACE, "node", "size", "root", "n"), "open")
    few = open_.where(F.col("n") <= SMALL)
    other = few.select("bucket", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("root").alias("other_root"))
    pairs = few.join(other, "bucket").where((F.col("node") < F.col("other")) & (F.col("root") != F.col("other_root")) & fits)
    pairs = pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    large = open_.where(F.col("n") > SMALL).select(*_PLACE, "node", "size", "root")
    found = written(_links(pairs, sets, percent).union(_within_large(large, sets, percent)), "links")
    if not found.isEmpty():
        labels = components(found if links is None else links.union(found), nodes, start=labels)
    dropped(spark, sets, members, open_)
    of_class = classes.select("digest", "rank", "node")
    of_class = of_class.join(labels, "node", "left").select("digest", F.coalesce("root_rank", "rank").alias("least"))
    of_class = of_class.select("digest", F.when(F.col("least") != LAST, F.col("least")).alias("least"))
    out = scanned.select("doc_id", "key", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""An inverted-file index for nearest neighbours: every row stands in the list of its nearest centroid, a query looks into a few lists.

Centroids are fitted on a sample of at most `sample` rows (a parameter; those of the least hashes, so the same at each run); all rows are
indexed. What a query finds in the lists it looks into is ranked by exact cosines. retrieval.knn_join() is the exact way; recall() compares both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.retrieval import _nearest, knn_join, pair_schema, ranked_pairs

SAMPLE = 20_000
MOST_LISTS = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit(items: DataFrame, *, lists: int | None = None, sample: int = SAMPLE, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Unit centroids (a row each) of the items' vectors (item_id, embedding): spherical k-means over the sample, begun far apart.

    lists: how many; by default about the square root of the number of rows, MOST_LISTS at most."""
    held = items.where("embedding IS NOT NULL").select("item_id", "embedding")
    rows = held.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(sample).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array([r.embedding for r in rows], float))
    if lists is None:
        lists = min(MOST_LISTS, max(1, int(held.count() ** 0.5)))
    lists = min(lists, len(x))
    r = np.random.default_rng(seed)
    chosen = [int(r.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(lists - 1):
        far = np.maximum(far, 0)
        total = far.sum()
        chosen.append(int(r.choice(len(x), p=far / total)) if total > 1e-9 else int(r.integers(len(x))))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        used = np.bincount(near, minlength=lists) > 0
        centroids = np.where(used[:, None], _unit(sums), centroids)
    return centroids


def _lists(centroids: np.ndarray, probes: int):
    """Rows with the numbers of their `probes` nearest lists, best first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch.embedding.notna()]
            if not len(batch):
                continue
            scores = np.stack(batch.embedding).astype(float) @ centroids.T
            yield batch.assign(lists=list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return run


def _listed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    if not len(centroids):
        return rows.withColumn("lists", F.lit(None).cast("array<int>")).limit(0)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", lists array<int>"
    return rows.mapInPandas(_lists(centroids, probes), schema)


def index(items: DataFrame, centroids: np.ndarray) -> DataFrame:
    """item_id, embedding and list of all items that have a vector."""
    return _listed(items.select("item_id", "embedding"), centroids, 1).select("item_id", "embedding", F.col("lists")[0].alias("list"))


def write(indexed: DataFrame, at: str) -> None:
    """The index as a folder for each list, so that one question reads the lists it looks into alone."""
    indexed.repartition("list", F.pmod(F.xxhash64("item_id"), F.lit(16))).write.partitionBy("list").parquet(at)


def nearest_lists(query: list[float], centroids: np.ndarray, probes: int) -> list[int]:
    return np.argsort(-(centroids @ np.array(query, float)), kind="stable")[:probes].tolist() if len(centroids) else []


def near(indexed: DataFrame, centroids: np.ndarray, query: list[float], *, probes: int = 8) -> DataFrame:
    """The rows of the lists that one question looks into, for retrieval.vector_topk() and the like."""
    return indexed.where(F.col("list").isin(nearest_lists(query, centroids, probes)))


def search(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int, least: float | None = None, *, probes: int = 8, list_rows: int = 50_000, query_rows: int = 2_000) -> DataFrame:
    """query_id, item_id, similarity, place as knn_join() gives them, from the `probes` lists nearest to each query (query_id, embedding).

    A list of more than list_rows rows is dealt into blocks by hash, and so are the queries that look into it: a list with a third of all rows is many tasks' work."""
    asked = _listed(queries.select("query_id", "embedding"), centroids, probes).select("query_id", "embedding", F.explode("lists").alias("list"))
    blocks = lambda df, rows, name: df.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    # A row for each list.
    cells = F.broadcast(blocks(indexed, list_rows, "n_i").join(blocks(asked, query_rows, "n_q"), "list"))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cells, "list").withColumn("qb", salt("query_id", "n_q")).select("query_id", "embedding", "list", "qb", all_of("n_i").alias("ib"))
    right = indexed.join(cells, "list").withColumn("ib", salt("item_id", "n_i")).select("item_id", F.col("embedding").alias("embedding"), F.col("list").alias("list"), "ib", all_of("n_q").alias("qb"))
    best, key = _nearest(k, least, False), ["list", "qb", "ib"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda q, i: best(q, i), pair_schema(queries, indexed))
    return ranked_pairs(pairs, k)


def probes_for(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int, *, least: float = 0.95, sample: int = 200) -> int:
    """How many lists a query must look into so that the share `least` of its k exact neighbours is there, from at most `sample` of the queries."""
    some = queries.where("embedding IS NOT NULL").select("query_id", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = knn_join(some, indexed.select("item_id", "embedding"), k).select("query_id", "item_id")
    order = _listed(some, centroids, len(centroids)).select("query_id", "lists")
    place = exact.join(indexed.select("item_id", "list"), "item_id").join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("at"))
    counts = dict(place.groupBy("at").count().collect())
    total, so_far = sum(counts.values()), 0
    for probes in range(1, len(centroids) + 1):
        so_far += counts.get(probes, 0)
        if so_far >= least * total:
            return probes
    return len(centroids)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, item_id) that were found."""
    pairs = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return pairs.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0

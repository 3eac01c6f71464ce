"""Hybrid retrieval: exact cosine top-k and full-text ranking over filtered chunks, fused by reciprocal ranks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.functions import text, vectors
from quadloom.functions.terms import to_entity_uri, trust_tier
from quadloom.operators.common import cut_lineage, first_by
from quadloom.operators.conflicts import find_contradictions
from quadloom.operators.jobs import readable
from quadloom.operators.quads import pattern
from quadloom.operators.reasoning import expand, visited

RRF_K = 60
OVERFETCH = 3


def eligible(content: DataFrame, jobs: DataFrame | None = None, *, source_type: str | None = None, tags: list[str] | None = None, min_date: dt.datetime | None = None, content_id=None) -> DataFrame:
    """Contents that pass the filters (all of the tags), before any limit."""
    if source_type is not None:
        content = content.where(F.col("source_type") == source_type)
    if tags:
        content = content.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if min_date is not None:
        content = content.where(F.col("ingested_at") >= min_date)
    if content_id is not None:
        content = content.where(F.col("content_id") == content_id)
    return content if jobs is None else readable(content, jobs)


def _ranked(found: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best by score, ties by key, with their places from 0. Each task sends k rows, so one task can number them."""
    top = found.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(score), key)) - 1)


def vector_topk(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    return _ranked(chunks.withColumn("similarity", vectors.similarity("embedding", query)), "similarity", key, k)


def text_topk(chunks: DataFrame, question: str, k: int, key: str = "chunk_id") -> DataFrame:
    """Chunks with any of the question's words, by ts_rank."""
    terms = text.query_terms(question)
    found = chunks.where(text.holds_any("chunk_text", terms))
    return _ranked(found.withColumn("rank", text.text_rank("chunk_text", terms)), "rank", key, k)


def fuse(by_vector: DataFrame, by_text: DataFrame, limit: int, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Both lists as one: each place (from 0) gives 1/(k + place + 1); ties by the vector list's order, then the text list's."""
    v = by_vector.select(key, "similarity", F.col("place").alias("vector_place"))
    t = by_text.select(key, "rank", F.col("place").alias("text_place"))
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    both = v.join(t, key, "full").withColumn("rrf_score", part("vector_place") + part("text_place"))
    return both.orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_place"), F.asc_nulls_last("text_place")).limit(limit)


def search(chunks: DataFrame, content: DataFrame, query: list[float], question: str | None = None, *, limit: int = 10, jobs: DataFrame | None = None, **filters) -> DataFrame:
    """The best chunks of the eligible contents: by similarity alone, or fused with the text ranking if there is a question."""
    own = chunks.join(eligible(content, jobs, **filters).select("content_id"), "content_id", "left_semi")
    if not question:
        return vector_topk(own, query, limit).withColumn("rrf_score", F.col("similarity"))
    # Texts and contents are joined to the last few rows alone.
    by_vector = vector_topk(own.select("chunk_id", "embedding"), query, limit * OVERFETCH)
    fused = fuse(by_vector, text_topk(own.select("chunk_id", "chunk_text"), question, limit * OVERFETCH).drop("chunk_text"), limit)
    return F.broadcast(fused).join(chunks, "chunk_id").join(content, "content_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_place"), "text_place")


#: Rows of queries and of items whose scores are held at once, so that a block of any size takes some tens of MB.
TILE = (512, 4_096)


def _nearest(k: int, least: float | None, earlier: bool, tile: tuple[int, int] = TILE) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a block of queries and one of items each query's k best items by cosine, ties by item_id; earlier: of items with a smaller ord than the query's.

    Scores are made and ranked tile by tile, and of each tile k items a query go on, so memory grows with the rows of the blocks, not with their product."""

    def best(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        empty = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("query_id", object), ("item_id", object), ("similarity", float))})
        q, i = q[q.embedding.notna()], i[i.embedding.notna()].sort_values("item_id")
        if not len(q) or not len(i):
            return empty

        def unit(vectors: pd.Series) -> np.ndarray:
            v = np.stack(vectors).astype(float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v /= np.where(n > 0, n, np.nan)
            return v

        def first(at: np.ndarray, to: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((to, -score, at))
            at, to, score = at[order], to[order], score[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            return at[kept], to[kept], score[kept]

        def of_tile(qs: slice, js: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            scores = queries[qs] @ items[js].T
            np.copyto(scores, -np.inf, where=np.isnan(scores))
            if earlier:
                scores[item_ord[js][None, :] >= query_ord[qs][:, None]] = -np.inf
            # All that equal a query's k-th score come along, as ties go by item_id.
            bound = scores.max(axis=1) if k == 1 else np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -np.inf)
            at, to = np.nonzero((scores >= bound[:, None]) & (scores > -np.inf if least is None else scores >= least))
            return first(at, to + js.start, scores[at, to])

        queries, items = unit(q.embedding), unit(i.embedding)
        query_ord, item_ord = (q.ord.to_numpy(), i.ord.to_numpy()) if earlier else (None, None)
        found = []
        for a in range(0, len(q), tile[0]):
            tiles = [of_tile(slice(a, a + tile[0]), slice(b, b + tile[1])) for b in range(0, len(i), tile[1])]
            at, to, score = first(*(np.concatenate(x) for x in zip(*tiles, strict=True)))
            found.append((at + a, to, score))
        at, to, score = (np.concatenate(x) for x in zip(*found, strict=True))
        plain = lambda ids, n: pd.Series([ids.iloc[k] for k in n.tolist()], dtype=ids.dtype if ids.dtype.kind in "iu" else object)
        return pd.DataFrame({"query_id": plain(q.query_id, at), "item_id": plain(i.item_id, to), "similarity": score})

    return best


def ranked_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query's pairs (query_id, item_id, similarity) with their place from 1, ties by item_id."""
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))).where(F.col("place") <= k)


def pair_schema(queries: DataFrame, items: DataFrame) -> str:
    q_type, i_type = queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return f"query_id {q_type}, item_id {i_type}, similarity double"


def knn_join(queries: DataFrame, items: DataFrame, k: int, least: float | None = None, *, earlier: bool = False, chunk_rows: int = 20_000, query_rows: int = 20_000) -> DataFrame:
    """query_id, item_id, similarity and place (from 1) of the k items most like each query (query_id, embedding), ties by item_id.

    Items (item_id, embedding) and queries are dealt into blocks of bounded size by hash; each pair of blocks is multiplied
    tile by tile, and k rows a query go on. Exact; vector_index has an approximate way. earlier: only items whose ord is less than the query's."""
    blocks = lambda df, rows: max(1, -(-df.count() // rows))
    n_items, n_queries = blocks(items, chunk_rows), blocks(queries, query_rows)
    # Columns of their own, as both sides may come from one table.
    items = items.select(*(F.col(c).alias(c) for c in items.columns))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_queries))).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
    right = items.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(n_items)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    best = _nearest(k, least, earlier)
    pairs = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(lambda q, i: best(q, i), pair_schema(queries, items))
    return ranked_pairs(pairs, k)


@dataclass
class Retrieved:
    """What answers a question: chunks, triples with trust tiers, conflicts among them, entities and how far the graph was followed."""

    chunks: DataFrame
    triples: DataFrame
    contradictions: DataFrame
    entities: DataFrame
    depth: DataFrame


def intent(question: str) -> str:
    """A plain rule in place of a model: relations ask for the graph, names in capitals for entities, else semantic."""
    words = question.lower().split()
    if {"related", "connect", "connected", "connection", "between", "path", "cause", "causes"} & set(words):
        return "graph"
    return "entity" if any(w[:1].isupper() for w in question.split()[1:]) else "semantic"


def _context(quads: DataFrame, triples: DataFrame, chunks: DataFrame, entities: DataFrame, least: float | None, depth: DataFrame | None = None) -> Retrieved:
    triples = first_by(triples, ["s", "p", "o"], F.desc("confidence"), "graph")
    if least is not None:
        triples = triples.where(F.col("confidence") >= least)
    probes = first_by(triples, ["s", "p"], F.desc("confidence"), "o")
    none = triples.agg(F.lit(0).alias("depth")) if depth is None else depth
    return Retrieved(chunks, triples, find_contradictions(probes.select("s", "p", "o"), pattern(quads)), entities, none)


def retrieve(question: str, embed: Callable[[str], list[float]], *, chunks: DataFrame, content: DataFrame, quads: DataFrame, entities: DataFrame, predicates: DataFrame, jobs: DataFrame | None = None, kind: str | None = None, names: list[str] | None = None, least: float | None = None, max_sources: int = 5, max_hops: int = 4) -> Retrieved:
    """Chunks and triples by the strategy that the question asks for. entities: uri, embedding; predicates: uri, embedding.

    By graph, the entities found are those resolved and the first 10 nodes visited (without query_id), and depth is the farthest visited node's hop."""
    kind, query = kind or intent(question), embed(question)
    near = lambda df, k, at_least=None: _near(df, query, k, at_least)
    tiered = pattern(quads).withColumn("trust_tier", trust_tier("graph"))
    resolved = resolve_names(names or [], embed, entities, quads) if kind != "semantic" else None
    if kind == "graph" and resolved is not None:
        # Nodes max_hops away are visited too, so there is one more level of edges than hops.
        start = resolved.select(F.col("uri").alias("node"))
        edges = cut_lineage(expand(pattern(quads), start, max_hops + 1, max(least or 0.0, 0.1)))
        nodes = visited(edges, start, max_hops)
        names_found = resolved.unionByName(nodes.orderBy("hop", "node").limit(10).select(F.col("node").alias("uri")), allowMissingColumns=True)
        found = edges.join(tiered.drop("confidence", "o_kind"), ["s", "p", "o"]).withColumn("trust_tier", F.lit(None).cast("string"))
        return _context(quads, found, search(chunks, content, query, question, limit=3, jobs=jobs), names_found, least, nodes.agg(F.coalesce(F.max("hop"), F.lit(0)).alias("depth")))
    if kind == "entity" and resolved is not None:
        return _context(quads, tiered.join(resolved.select(F.col("uri").alias("s")), "s", "left_semi"), search(chunks, content, query, question, limit=3, jobs=jobs), resolved, least)
    near_entities = near(entities, 3)
    subjects = tiered.join(near_entities.select(F.col("uri").alias("s")), "s", "left_semi")
    by_predicate = tiered.join(near(predicates, 3, 0.80).select(F.col("uri").alias("p")), "p", "left_semi").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "s", "p", "o").limit(10)
    return _context(quads, subjects.unionByName(by_predicate), search(chunks, content, query, question, limit=max_sources, jobs=jobs), near_entities, least)


def _near(df: DataFrame, query: list[float], k: int, least: float | None = None) -> DataFrame:
    top = _ranked(df.withColumn("similarity", vectors.cosine("embedding", vectors.literal(query))), "similarity", "uri", k)
    return top if least is None else top.where(F.col("similarity") >= least)


def resolve_names(names: list[str], embed: Callable[[str], list[float]], entities: DataFrame, quads: DataFrame, least: float = 0.80) -> DataFrame:
    """uri of each name: the nearest entity's if it is near enough, else the name's own if the graph knows it; other names drop."""
    spark = entities.sparkSession
    asked = spark.createDataFrame([(n, embed(n)) for n in names], "query_id string, embedding array<double>")
    return resolve_by_graph(asked, entities, quads, least)


def resolve_by_graph(asked: DataFrame, entities: DataFrame, quads: DataFrame, least: float = 0.80) -> DataFrame:
    """As resolve_names(), for a table of names (query_id) and their vectors."""
    near = knn_join(asked, entities.select(F.col("uri").alias("item_id"), "embedding"), 1, least)
    own = asked.select("query_id", to_entity_uri("query_id").alias("own")).join(quads.select(F.col("s").alias("own")).distinct(), "own", "left_semi")
    out = near.select("query_id", F.col("item_id").alias("near")).join(own, "query_id", "full")
    return out.select("query_id", F.coalesce("near", "own").alias("uri"))


def within_budget(chunks: DataFrame, order: str, budget: int = 48_000, text_column: str = "chunk_text", ranges: int | None = None) -> DataFrame:
    """The chunks, in order, whose running total of characters stays within a prompt's budget.

    Chunks are dealt into ranges of the order; a window over the few ranges' totals says where each begins, and only those that begin
    within the budget get a running total of their own. ranges=1 takes one window: for a few dozen rows that a top-k has picked."""
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranges or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = [r[0] for r in chunks.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(20 * ranges).collect()] if ranges > 1 else []
    bounds = sorted(set(sorted(bounds)[20::20]))
    if not bounds:
        total = F.sum(F.length(text_column)).over(so_far(W.orderBy(order)))
        return chunks.withColumn("running_chars", total.cast("long")).where(F.col("running_chars") <= budget)
    # Nulls come first, as they sort.
    at = F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))))
    dealt = chunks.withColumn("_range", at)
    totals = dealt.groupBy("_range").agg(F.sum(F.length(text_column)).alias("_total"))
    begins = totals.withColumn("_before", F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)))
    begins = begins.where(F.coalesce("_before", F.lit(0)) <= budget).select("_range", "_before")
    own = F.sum(F.length(text_column)).over(so_far(W.partitionBy("_range").orderBy(order)))
    total = F.when(own.isNotNull() | F.col("_before").isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    out = dealt.join(F.broadcast(begins), "_range").withColumn("running_chars", total.cast("long")).drop("_range", "_before")
    return out.where(F.col("running_chars") <= budget)


def chunks_at(chunks: DataFrame, content_id, indexes: list[int]) -> DataFrame:
    """The chunks of one content with the given places, in their order."""
    return chunks.where((F.col("content_id") == content_id) & F.col("chunk_index").isin(indexes)).orderBy("chunk_index")


def truncated(c: str, most: int = 4000):
    """The beginning of a text, for prompts."""
    return F.left(F.col(c), F.lit(most))


def sources(chunks: DataFrame, order: str) -> DataFrame:
    """Distinct sources by URL, the first of each."""
    return first_by(chunks, ["url"], order)


def types_used(triples: DataFrame) -> DataFrame:
    return triples.agg(F.sort_array(F.collect_set("knowledge_type")).alias("types"))


def prompt(question: str, chunks: DataFrame, triples: DataFrame, order: str = "chunk_id") -> DataFrame:
    """One row: the question with its numbered sources and facts."""
    listed = within_budget(chunks, order, ranges=1).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("running_chars", "chunk_text"))), lambda c: F.concat(F.lit("- "), c["chunk_text"])), "\n").alias("texts"))
    fact = F.concat_ws(" ", "s", "p", "o", F.concat(F.lit("("), F.coalesce("trust_tier", F.lit("unknown")), F.lit(")")))
    facts = triples.agg(F.array_join(F.sort_array(F.collect_list(fact)), "\n").alias("facts"))
    return listed.crossJoin(facts).select(F.concat(F.lit("Question: " + question + "\n\nSources:\n"), "texts", F.lit("\n\nFacts:\n"), "facts").alias("prompt"))

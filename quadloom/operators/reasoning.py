"""Forward chaining by joins: inverses, transitive predicates, inherited properties; retraction; paths from a start.

Loops go by level, each level a few joins; their results are written out, so a level never recomputes the ones
before, and a lost executor costs no more than its own tasks. They end when a level adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.operators.common import SMALL_ROWS, cut_lineage, dealt, few, first_by, small, written
from quadloom.plans.ontology import uri

SPO = ["s", "p", "o"]
IS_A, HAS_PROPERTY = uri("is_a"), uri("has_property")


def inverse_step(triples: DataFrame, inverses: DataFrame) -> DataFrame:
    """o inverse s for each s predicate o with a declared inverse and a URI as object."""
    found = triples.where("o_kind = 'iri'").join(small(inverses), triples.p == inverses.predicate)
    return found.select(F.col("o").alias("s"), F.col("inverse").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), "confidence", F.lit("inverse").alias("method"), F.array("triple_hash").alias("derived_from"), *_kept(triples))


def _kept(frontier: DataFrame) -> list[str]:
    return [c for c in ("trigger", "path") if c in frontier.columns]


#: Rows that go to a task before each may lead to many.
STREAM_ROWS = 25_000


def _counted(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows, else for a join that shuffles both sides: Spark would go by the size of files, in which terms take little space."""
    return F.broadcast(df) if few(df) else df.hint("merge")


def _narrowed(df: DataFrame, columns: list[str], by: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The rows of df whose columns have values of the other table's (of its columns `names`), where these are few enough to be broadcast; else all of them."""
    keys = by.select(*(F.col(b).alias(a) for a, b in zip(columns, names or columns, strict=True))).distinct()
    return df.join(F.broadcast(keys), columns, "left_semi").select(*df.columns) if few(keys) else df


def _meet(own: DataFrame, held: DataFrame, on: dict[str, str], rows: tuple[int, int] | None = None) -> DataFrame:
    """own and held joined where own's columns equal held's.

    rows: how many each has, for tables so large that what they lead to is dealt out afterwards. A side with few rows is then broadcast, and the
    other's rows that meet one are dealt out, STREAM_ROWS to a task; of two large sides each is narrowed first by the other's keys, where these are few.
    So rows that lead to nothing aren't shuffled, and others only where both sides stay large."""
    met = lambda a, b: a.join(b, [F.col(x) == F.col(y) for x, y in on.items()])
    if rows is None:
        return met(own, held)
    left, right, (n, m) = list(on), list(on.values()), rows
    if min(n, m) > SMALL_ROWS:
        own = _narrowed(own, left, held, right)
        n = own.count()
    if min(n, m) > SMALL_ROWS:
        held = _narrowed(held, right, own, left)
        m = held.count()
    if min(n, m) > SMALL_ROWS:
        return met(own, held.hint("merge"))
    if m and n > SMALL_ROWS:
        own = _narrowed(own, left, held, right)
        n = own.count()
    elif n and m > SMALL_ROWS:
        held = _narrowed(held, right, own, left)
        m = held.count()
    if not n or not m:
        return met(own.limit(0), held)
    if m <= SMALL_ROWS:
        return met(dealt(own, ["triple_hash"], n, each=STREAM_ROWS), F.broadcast(held))
    return met(F.broadcast(own), dealt(held, ["qh"], m, each=STREAM_ROWS))


def _held(quads: DataFrame) -> DataFrame:
    return quads.where("confidence IS NOT NULL").select(F.col("s").alias("qs"), F.col("p").alias("qp"), F.col("o").alias("qo"), F.col("o_kind").alias("qk"), F.col("confidence").alias("qc"), F.col("triple_hash").alias("qh"))


def _sizes(df: DataFrame, links: DataFrame) -> tuple[int, int, int]:
    """How many triples there are with a predicate of the links and a URI as object, how many say what is a what, and how many give a property."""
    iri, p = F.col("o_kind") == "iri", F.col("p")
    every = df.join(F.broadcast(links.select(F.col("predicate").alias("p"), F.lit(True).alias("_link"))), "p", "left")
    return tuple(every.agg(F.count_if(F.col("_link") & iri), F.count_if((p == IS_A) & iri), F.count_if(p == HAS_PROPERTY)).first())


def transitive_step(frontier: DataFrame, quads: DataFrame, transitive: DataFrame, backward: bool = True, *, rows: tuple[int, int] | None = None) -> DataFrame:
    """a p c for a p b and b p c, extending the frontier's triples at their ends and, if backward, at their beginnings; never to a p a.

    rows: as _meet() takes them."""
    links = small(transitive.select("predicate"))
    own = frontier.where("o_kind = 'iri'").join(links, F.col("p") == F.col("predicate"), "left_semi")
    held = _held(quads).where("qk = 'iri'")
    if rows:
        held = held.join(links, F.col("qp") == F.col("predicate"), "left_semi")
    columns = lambda s, o: [F.col(s).alias("s"), "p", F.col(o).alias("o"), F.lit("iri").alias("o_kind"), (F.col("confidence") * F.col("qc")).alias("confidence"), F.lit("transitive").alias("method"), F.array("triple_hash", "qh").alias("derived_from"), *_kept(frontier)]
    ahead = _meet(own, held, {"o": "qs", "p": "qp"}, rows).where("qo <> s").select(*columns("s", "qo"))
    if not backward:
        return ahead
    behind = _meet(own, held, {"s": "qo", "p": "qp"}, rows).where("qs <> o").select(*columns("qs", "o"))
    return ahead.unionByName(behind)


def inheritance_step(frontier: DataFrame, quads: DataFrame, *, down_rows: tuple[int, int] | None = None, up_rows: tuple[int, int] | None = None) -> DataFrame:
    """a has_property v for a is_a b and b has_property v, whichever of the two is in the frontier.

    down_rows: as _meet() takes them, where a is_a b is in the frontier; up_rows: where b has_property v is."""
    kept, held = _kept(frontier), _held(quads)
    columns = lambda s, o, kind: [F.col(s).alias("s"), F.lit(HAS_PROPERTY).alias("p"), F.col(o).alias("o"), F.col(kind).alias("o_kind"), (F.col("confidence") * F.col("qc")).alias("confidence"), F.lit("type_inheritance").alias("method"), F.array("triple_hash", "qh").alias("derived_from"), *kept]
    isa = frontier.where((F.col("p") == IS_A) & (F.col("o_kind") == "iri"))
    down = _meet(isa, held.where(F.col("qp") == HAS_PROPERTY), {"o": "qs"}, down_rows).select(*columns("s", "qo", "qk"))
    prop = frontier.where(F.col("p") == HAS_PROPERTY)
    up = _meet(prop, held.where((F.col("qp") == IS_A) & (F.col("qk") == "iri")), {"s": "qo"}, up_rows).select(*columns("qs", "o", "o_kind"))
    return down.unionByName(up)


def _hashed(df: DataFrame) -> DataFrame:
    from quadloom.operators.quads import with_hash

    return with_hash(df)


_RULES = ("inverse", "transitive", "type_inheritance")


def infer(triggers: DataFrame, quads: DataFrame, inverses: DataFrame, transitive: DataFrame, max_depth: int = 3, more: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """What each trigger leads to, with its depth, as if triggers came alone: derived triples meet stored ones only, those
    already stored (in any graph) or seen aren't derived again, and the first derivation wins, by depth, then the place of what
    it comes from, then the rule. triggers: s, p, o, o_kind, confidence, triple_hash, as stored in `quads`.
    more: further rules by method, after the three built in: from the frontier and the quads to rows as inverse_step() gives them."""
    rules = [*_RULES, *(more or {})]
    # The store is gone through once: what the rules join with takes part in each level, and what a level finds is looked up in it too.
    joined = small(transitive.select(F.col("predicate").alias("p")).union(quads.sparkSession.createDataFrame([(IS_A,), (HAS_PROPERTY,)], "p string")).distinct())
    held = written(quads.join(joined, "p", "left_semi").select(*SPO, "o_kind", "confidence", "triple_hash"), "held")
    links, isa, props = _sizes(held.where("confidence IS NOT NULL"), transitive)
    triggers = written(triggers, "triggers")
    frontier = triggers.withColumns({"trigger": F.col("triple_hash"), "path": F.lit("")})
    done, seen = None, triggers.select(F.col("triple_hash").alias("trigger"), *SPO)
    # Where a derived triple comes from is in its path as far as its parent; the rest is put there when it is read, so that it isn't moved or stored twice.
    rule = F.array_position(F.array(*map(F.lit, rules)), F.col("method"))
    place = F.concat_ws("/", "path", F.concat(rule.cast("string"), F.lit(":"), F.array_join("derived_from", "+")))
    for depth in range(1, max_depth + 1):
        own = _sizes(frontier, transitive)
        found = inverse_step(frontier, inverses).unionByName(transitive_step(frontier, held, transitive, rows=(own[0], links)))
        found = found.unionByName(inheritance_step(frontier, held, down_rows=(own[1], props), up_rows=(own[2], isa)))
        for step in (more or {}).values():
            found = found.unionByName(step(frontier, quads))
        kinds = cut_lineage(found.groupBy("p").agg(F.count("*").alias("n")))
        n = kinds.agg(F.sum("n")).first()[0]
        if not n:
            break
        # Derivations go to tasks by their number before any is sorted, as a few quads of a class may lead to most of them.
        found = dealt(found, ["trigger", *SPO], n)
        known = _counted(_narrowed(seen, ["p"], kinds))
        found = first_by(found.join(known, ["trigger", *SPO], "left_anti"), ["trigger", *SPO], place)
        found = written(found.select(*SPO, "trigger", "o_kind", "confidence", "method", "derived_from", "path"), "found")
        more_kinds = kinds.join(joined, "p", "left_anti")
        stored = held.select(*SPO) if more_kinds.isEmpty() else held.select(*SPO).union(quads.select(*SPO).join(small(more_kinds.select("p")), "p", "left_semi").select(*SPO))
        for keys in (["p"], ["p", "o"], ["p", "s"]):
            if few(stored):
                break
            stored = _narrowed(stored, keys, found)
        else:
            stored = stored.join(found.select(*SPO).distinct().hint("merge"), SPO, "left_semi")
        stored = cut_lineage(stored.distinct())
        if few(stored):
            found = found.join(F.broadcast(stored), SPO, "left_anti")
        else:
            found = written(found.join(stored.hint("merge"), SPO, "left_anti").select(*found.columns), "found")
        if found.isEmpty():
            break
        found = _hashed(found.withColumns({"path": place, "depth": F.lit(depth)}))
        done = found if done is None else done.unionByName(found)
        seen = seen.unionByName(found.select("trigger", *SPO))
        frontier = found.select(*SPO, "o_kind", "confidence", "triple_hash", "trigger", "path")
    return _hashed(inverse_step(frontier, inverses)).withColumn("depth", F.lit(0)).limit(0) if done is None else done


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All pairs (s, o) that edges (s, o, confidence) of one predicate connect, with the best product of confidences and the
    least number of edges. Semi-naive: only pairs that got better go on; a pair from a node to itself is left out."""
    best = cut_lineage(edges.groupBy("s", "o").agg(F.max("confidence").alias("confidence")).where("s <> o").withColumn("hops", F.lit(1)))
    step, new, hops = best.select(F.col("s").alias("m"), F.col("o").alias("far"), F.col("confidence").alias("c")), best, 1
    while max_depth is None or hops < max_depth:
        hops += 1
        more = new.join(step, new.o == step.m).where("s <> far").groupBy("s", F.col("far").alias("o")).agg(F.max(F.col("confidence") * F.col("c")).alias("confidence"))
        known = best.select("s", "o", F.col("confidence").alias("had"))
        new = cut_lineage(more.join(known, ["s", "o"], "left").where("had IS NULL OR confidence > had").drop("had").withColumn("hops", F.lit(hops)))
        if new.isEmpty():
            break
        both = best.unionByName(new).groupBy("s", "o").agg(F.max("confidence").alias("confidence"), F.min("hops").alias("hops"))
        best = cut_lineage(both)
    return best


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and kind of what is reached from the start nodes (node) along edges (s, o, o_kind), in one step or more, level by level.

    A start node is among them only if a cycle leads back to it; literals end a path. What is broadcast in a level has been counted;
    otherwise both sides are shuffled, since Spark would send the whole table of edges through the driver in each level while its files are small."""
    seen, frontier, hops = None, cut_lineage(start.select("node").distinct()), 0
    while max_depth is None or hops < max_depth:
        hops += 1
        ahead = edges.join(_counted(frontier), edges.s == frontier.node).select(F.col("o").alias("node"), F.col("o_kind").alias("kind")).distinct()
        new = cut_lineage(ahead if seen is None else ahead.join(_counted(seen), ["node", "kind"], "left_anti"))
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.where("kind = 'iri'").select("node")
        if frontier.isEmpty():
            break
    return edges.select(F.col("o").alias("node"), F.col("o_kind").alias("kind")).limit(0) if seen is None else seen


def connected(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All pairs (s, o, o_kind) that edges connect in one step or more, each once; a node on a cycle is connected to itself."""
    step = cut_lineage(edges.select("s", "o", "o_kind").distinct())
    ahead = step.select(F.col("s").alias("m"), F.col("o").alias("far"), F.col("o_kind").alias("far_kind"))
    every, new, hops = step, step, 1
    while max_depth is None or hops < max_depth:
        hops += 1
        more = new.where("o_kind = 'iri'").join(ahead, new.o == ahead.m).select("s", F.col("far").alias("o"), F.col("far_kind").alias("o_kind")).distinct()
        new = cut_lineage(more.join(every, ["s", "o", "o_kind"], "left_anti"))
        if new.isEmpty():
            break
        every = every.unionByName(new)
    return every


def expand(quads: DataFrame, start: DataFrame, max_hops: int = 4, least: float = 0.1, limit: int | None = 200) -> DataFrame:
    """Edges reached from the start nodes, with the hop: along subjects, to objects that are URIs, over quads of enough confidence.

    max_hops is the number of levels of edges: those that leave nodes h hops away (the start nodes are 0) have hop h + 1. limit keeps so many edges, the first by hop, then by their terms."""
    usable = quads.where(F.col("confidence") >= least).select(*SPO, "o_kind", "confidence")
    visited = cut_lineage(start.select("node").distinct())
    frontier, found = visited, None
    for hop in range(1, max_hops + 1):
        edges = cut_lineage(frontier.join(usable, frontier.node == usable.s).drop("node").withColumn("hop", F.lit(hop)))
        found = edges if found is None else found.unionByName(edges)
        frontier = cut_lineage(edges.where("o_kind = 'iri'").select(F.col("o").alias("node")).distinct().join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return found if limit is None else found.orderBy("hop", *SPO).limit(limit)


def visited(edges: DataFrame, start: DataFrame, max_hops: int = 4, limit: int | None = 200) -> DataFrame:
    """Nodes at most max_hops away, with their hop (the start nodes are 0), for the edges of expand(..., max_hops + 1, limit=limit).

    Where the edges have reached the limit, nodes after the last edge's subject, by hop and name, aren't visited any more."""
    reached = edges.where((F.col("o_kind") == "iri") & (F.col("hop") <= max_hops)).select(F.col("o").alias("node"), "hop")
    nodes = start.select("node", F.lit(0).alias("hop")).unionByName(reached).groupBy("node").agg(F.min("hop").alias("hop"))
    if limit is None:
        return nodes
    last = edges.agg(F.count("*").alias("_n"), F.max(F.struct("hop", "s")).alias("_last"))
    before = (F.col("hop") + 1 < F.col("_last.hop")) | ((F.col("hop") + 1 == F.col("_last.hop")) & (F.col("node") <= F.col("_last.s")))
    return nodes.crossJoin(F.broadcast(last)).where((F.col("_n") < limit) | before).drop("_n", "_last")


def retract(quads: DataFrame, gone: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame]:
    """The quads less the inferred ones that rest on the triples gone (triple_hash), at any remove; and what was taken, with its depth."""
    rests = cut_lineage(quads.where("graph = 'inferred'").select("triple_hash", F.explode("derived_from").alias("on")))
    frontier = cut_lineage(gone.select("triple_hash").distinct())
    taken, seen = None, frontier
    for depth in range(1, max_depth + 1):
        hit = rests.join(frontier.withColumnRenamed("triple_hash", "on"), "on").select("triple_hash").distinct().join(seen, "triple_hash", "left_anti")
        hit = cut_lineage(hit)
        if hit.isEmpty():
            break
        step = hit.withColumn("depth", F.lit(depth))
        taken = step if taken is None else taken.union(step)
        seen, frontier = seen.union(hit), hit
    if taken is None:
        taken = frontier.limit(0).withColumn("depth", F.lit(0))
    inferred = F.col("graph") == "inferred"
    left = quads.where(~inferred).unionByName(quads.where(inferred).join(taken.select("triple_hash"), "triple_hash", "left_anti").select(*quads.columns))
    return left, taken


def deltas(triples: DataFrame, order: str = "seq") -> DataFrame:
    """Each triple's value before it of the same subject and predicate, where that is another one."""
    before = F.lag("o").over(W.partitionBy("s", "p").orderBy(order))
    return triples.withColumn("before", before).withColumn("before", F.when(F.col("before") != F.col("o"), F.col("before")))

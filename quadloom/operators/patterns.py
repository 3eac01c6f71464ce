"""Graph patterns over quads as DataFrame operations: what a SPARQL SELECT says, without its text.

A solution table has a column for each variable. A pattern's terms are variables (`?x`) or constants; triples of a group
share variables and are joined on them, optional() is a left join, union() fills what a branch lacks with nulls, minus() and
exists() are anti and semi joins, path() follows a predicate any number of times. Filters, projections, ordering and
aggregates are DataFrame methods on the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.reasoning import connected, reachable

ANNOTATIONS = ("confidence", "knowledge_type", "valid_from", "valid_until")


def triple(quads: DataFrame, s: str, p: str, o: str, graph: str | None = None, **annotations: str) -> DataFrame:
    """Solutions of one triple. graph: a constant, a variable or none for any; annotations: variables for a quad's annotations,
    which it must then have (confidence="?c")."""
    terms = {"s": s, "p": p, "o": o, **({"graph": graph} if graph else {}), **annotations}
    seen: dict[str, str] = {}
    for column, term in terms.items():
        if not term.startswith("?"):
            quads = quads.where(F.col(column) == term)
        elif term in seen:
            quads = quads.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
            if column in annotations:
                quads = quads.where(F.col(column).isNotNull())
    return quads.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def group(*parts: DataFrame) -> DataFrame:
    """All parts at once, joined on their common variables."""

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        if not (on := _shared(a, b)):
            raise ValueError("the parts of a group need a common variable")
        return a.join(b, on)

    return reduce(joined, parts)


def optional(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, _shared(a, b), "left")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, on, "left_anti") if (on := _shared(a, b)) else a


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, _shared(a, b), "left_semi")


def values(a: DataFrame, **bound: list) -> DataFrame:
    """Only solutions with one of the given terms for each variable."""
    return reduce(lambda df, item: df.where(F.col(item[0]).isin(item[1])), bound.items(), a)


def ask(a: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return a.limit(1).agg((F.count("*") > 0).alias("result"))


def path(quads: DataFrame, s: str, p: str, o: str, *, at_least: int = 1, max_depth: int | None = None) -> DataFrame:
    """Solutions of a path of a predicate, of at_least (0 or 1) steps or more, whatever the graph; each once.

    s and o are variables or constants, or one variable twice. A constant end is where the search begins, so only what it reaches is
    looked at. Cycles lead back to their nodes, and a path may end in a literal. Without a step, a constant is connected to itself, a variable
    stands for each subject and object of the quads. With two constants there is a row (`found`) if a path connects them."""
    edges = quads.where(F.col("p") == p).select("s", "o", "o_kind")
    constant = lambda t: not t.startswith("?")
    one = lambda t: quads.sparkSession.createDataFrame([(t,)], "node string")
    if constant(s):
        ends = reachable(edges, one(s), max_depth).select("node").distinct()
        ends = ends.union(one(s)).distinct() if not at_least else ends
        if constant(o):
            return ends.where(F.col("node") == o).select(F.lit(True).alias("found"))
        return ends.select(F.col("node").alias(o[1:]))
    if constant(o):
        last = edges.where(F.col("o") == o).select(F.col("s").alias("node")).distinct()
        back = edges.where("o_kind = 'iri'").select(F.col("o").alias("s"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"))
        begins = last if max_depth == 1 else last.union(reachable(back, last, None if max_depth is None else max_depth - 1).select("node")).distinct()
        begins = begins.union(one(o)).distinct() if not at_least else begins
        return begins.select(F.col("node").alias(s[1:]))
    pairs = connected(edges, max_depth).select("s", "o").distinct()
    if not at_least:
        nodes = quads.select("s").union(quads.select("o")).distinct()
        pairs = pairs.union(nodes.select("s", F.col("s").alias("o"))).distinct()
    if s == o:
        return pairs.where("s = o").select(F.col("s").alias(s[1:]))
    return pairs.select(F.col("s").alias(s[1:]), F.col("o").alias(o[1:]))


def step(quads: DataFrame, p: str, *, backward: bool = False) -> DataFrame:
    """Pairs (s, o) that a predicate connects, once each; backward: the path ^p."""
    pairs = quads.where(F.col("p") == p).select("s", "o").distinct()
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o")) if backward else pairs


def then(a: DataFrame, b: DataFrame) -> DataFrame:
    """The path a/b of pairs (s, o)."""
    return a.select("s", F.col("o").alias("_m")).join(b.select(F.col("s").alias("_m"), "o"), "_m").select("s", "o").distinct()


def either(*paths: DataFrame) -> DataFrame:
    """The path a|b."""
    return reduce(lambda a, b: a.union(b), paths).distinct()


def maybe(path_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The path a?, with each of the nodes (node) connected to itself."""
    return either(path_, nodes.select(F.col("node").alias("s"), F.col("node").alias("o")))


def bind(a: DataFrame, **values_: Column) -> DataFrame:
    """BIND: new variables from expressions over the others."""
    return a.withColumns(values_)


def reifiers(quads: DataFrame) -> DataFrame:
    """A reifier for each quad (its graph and hash), with the triple it reifies and its annotations, as rdf:reifies has them."""
    return quads.select(F.concat_ws("#", "graph", "triple_hash").alias("reifier"), "s", "p", "o", *ANNOTATIONS)


def annotations(quads: DataFrame) -> DataFrame:
    """Each annotation of a quad as a row (graph, s, p, o, name, value), as a variable annotation predicate would see it."""
    each = F.map_from_arrays(F.array(*map(F.lit, ANNOTATIONS)), F.array(*(F.col(c).cast("string") for c in ANNOTATIONS)))
    return quads.select("graph", "s", "p", "o", F.explode(each).alias("name", "value")).where("value IS NOT NULL")

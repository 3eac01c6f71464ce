"""Contradictions: several values of one property, and opposite predicates between the same terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.operators.common import cut_lineage, dealt, small


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    """The product of both confidences, where both are numbers and it reaches the least."""
    both = F.try_multiply(F.expr("try_cast(conf1 as double)"), F.expr("try_cast(conf2 as double)"))
    return pairs.withColumn("probability", both).where(F.col("probability") >= least)


def functional_conflicts(quads: DataFrame, functional: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of values of a single-valued predicate in one graph, each unordered pair once."""
    own = quads.where("confidence IS NOT NULL").join(small(functional), quads.p == functional.predicate, "left_semi")
    one = own.select("graph", "s", "p", F.col("o").alias("o1"), F.col("confidence").alias("conf1"))
    two = own.select("graph", "s", "p", F.col("o").alias("o2"), F.col("confidence").alias("conf2"))
    return _scored(one.join(two, ["graph", "s", "p"]).where("o1 < o2"), least)


def opposite_conflicts(quads: DataFrame, opposites: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of quads of one graph with opposite predicates between the same subject and object."""
    pairs = small(opposites.where("p1 < p2"))
    own = quads.where("confidence IS NOT NULL")
    one = own.select("graph", "s", F.col("p").alias("p1"), "o", F.col("confidence").alias("conf1")).join(pairs, "p1")
    two = own.select("graph", "s", F.col("p").alias("p2"), "o", F.col("confidence").alias("conf2"))
    return _scored(one.join(two, ["graph", "s", "o", "p2"]), least)


def all_conflicts(quads: DataFrame, functional: DataFrame, opposites: DataFrame, least: float = 0.0) -> DataFrame:
    """Both kinds, one after the other."""
    return functional_conflicts(quads, functional, least).withColumn("kind", F.lit("value")).unionByName(opposite_conflicts(quads, opposites, least).withColumn("kind", F.lit("opposite")), allowMissingColumns=True)


def find_contradictions(new: DataFrame, quads: DataFrame) -> DataFrame:
    """For each new triple the stored ones with its subject and predicate and another object, in any graph."""
    held = quads.select("s", "p", F.col("o").alias("other"), F.col("confidence").alias("existing"))
    return new.join(held, ["s", "p"]).where("o <> other")


def strongest_other(new: DataFrame, quads: DataFrame, rows: int | None = None) -> DataFrame:
    """The new triples (s, p, o) with `existing`: the greatest confidence of another stored object of their subject and predicate.

    As strongest(find_contradictions()), from the two best objects of each subject and predicate instead of all pairs.
    rows: how many quads there are about; both sides are then dealt out by subject and predicate to as many tasks as these need, once for all steps."""
    # A key of one column: of two, a constant one would be left out of a join's keys, and rows dealt out by both be shuffled again.
    held, new = (df.withColumn("_class", F.struct("s", "p")) for df in (quads.select("s", "p", "o", "confidence"), new))
    if rows is not None:
        held, new = dealt(held.select("_class", "o", "confidence"), ["_class"], rows), dealt(new, ["_class"], rows)
    each = held.groupBy("_class", "o").agg(F.max("confidence").alias("c"))
    best = each.groupBy("_class").agg(F.max(F.struct("c", "o")).alias("_best"))
    next_ = each.join(best, "_class").where(F.col("o") != F.col("_best.o")).groupBy("_class").agg(F.max("c").alias("_next"))
    out = new.join(best, "_class").join(next_, "_class", "left")
    return out.withColumn("existing", F.when(F.col("o") != F.col("_best.o"), F.col("_best.c")).otherwise(F.col("_next"))).drop("_class", "_best", "_next").where("existing IS NOT NULL")


#: A class's members are dealt to so many keys, so that a class of any size is many tasks' work.
SALTS = 64


def value_classes(quads: DataFrame, by: tuple[str, ...] = ("s", "p"), top: int = 10) -> DataFrame:
    """Contradictions as classes: a row for each subject and predicate (or other columns) with several values.

    n_values, n_pairs (unordered pairs of values) and `best`: the `top` values (o, confidence) by confidence, ties by value. So rows grow with
    the values, not with their pairs; pairs_of() gives the pairs of some classes. Each value counts once, with its greatest confidence."""
    keys = list(by)
    values = quads.where("confidence IS NOT NULL").groupBy(*keys, "o").agg(F.max("confidence").alias("confidence"))
    salted = values.withColumn("_salt", F.pmod(F.xxhash64("o"), F.lit(SALTS)))
    order = [F.desc("confidence"), F.asc("o")]
    # A salt's best go on, with how many values it has.
    parts = salted.withColumns({"_place": F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)), "_n": F.count("*").over(W.partitionBy(*keys, "_salt"))}).where(F.col("_place") <= top)
    own = F.struct((-F.col("confidence")).alias("c"), "o", "confidence")
    listed = F.transform(F.slice(F.array_sort(F.collect_list(own)), 1, top), lambda x: F.struct(x["o"].alias("o"), x["confidence"].alias("confidence")))
    out = parts.groupBy(*keys).agg(F.sum(F.when(F.col("_place") == 1, F.col("_n"))).alias("n_values"), listed.alias("best")).where("n_values > 1")
    return out.select(*keys, "n_values", F.expr("n_values * (n_values - 1) div 2").alias("n_pairs"), "best")


#: Values of a class that one key has, about, when its pairs are made.
KEY_VALUES = 1_000


def pairs_of(classes: DataFrame, quads: DataFrame, by: tuple[str, ...] = ("s", "p")) -> DataFrame:
    """The unordered pairs of values (o1 < o2, with conf1 and conf2) of the classes given, on demand.

    A class of up to KEY_VALUES values has one key. A larger one has a key for each so many of its values: its values are dealt to them on one
    side and copied to all of them on the other, so what is shuffled grows with the values and, for large classes, slower than their pairs."""
    keys = list(by)
    wanted = quads.where("confidence IS NOT NULL").join(small(classes.select(*keys).distinct()), keys, "left_semi")
    values = cut_lineage(wanted.groupBy(*keys, "o").agg(F.max("confidence").alias("c")))
    # Few classes are large, whatever the number of classes.
    large = values.groupBy(*keys).count().where(F.col("count") > KEY_VALUES).select(*keys, F.ceil(F.col("count") / KEY_VALUES).cast("int").alias("_keys"))
    dealt = values.join(small(large), keys, "left").withColumn("_keys", F.coalesce("_keys", F.lit(1)))
    one = dealt.select(*keys, F.col("o").alias("o1"), F.col("c").alias("conf1"), F.pmod(F.xxhash64("o"), F.col("_keys")).cast("int").alias("_salt"))
    two = dealt.select(*keys, F.col("o").alias("o2"), F.col("c").alias("conf2"), F.explode(F.sequence(F.lit(0), F.col("_keys") - 1)).alias("_salt"))
    return one.join(two, [*keys, "_salt"]).where("o1 < o2").drop("_salt")


def find_opposites(new: DataFrame, quads: DataFrame, opposites: DataFrame) -> DataFrame:
    """For each new triple the stored ones with an opposite predicate, declared in either direction; distinct by predicate and confidence."""
    both = small(opposites.select(F.col("p1").alias("p"), F.col("p2").alias("other_p")).union(opposites.select(F.col("p2").alias("p"), F.col("p1").alias("other_p"))).distinct())
    held = quads.where("confidence IS NOT NULL").select("s", "o", F.col("p").alias("other_p"), F.col("confidence").alias("existing"))
    return new.join(both, "p").join(held, ["s", "o", "other_p"]).distinct()


def strongest(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.max("existing").alias("existing"))

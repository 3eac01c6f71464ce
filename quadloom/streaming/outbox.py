"""The outbox: graph writes staged as rows, applied in the order of their ids, as a batch or as a stream.

Rows of different triples don't touch each other but through retractions, which take out the inferred triples that rest on a changed one
at that moment. So the keys that no retraction may reach go through plain aggregations (first insert, last confidence), however often one occurs; the others are folded in
the order of their ids, each task streaming over its sorted rows. What a fold takes out is told to the triples that rest on it, and
their folds run again, until nothing changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quadloom.operators.common import cut_lineage, first_by, small
from quadloom.operators.store import Store
from quadloom.schemas import OUTBOX, QUADS

# What a row asks for.
OPERATIONS = ("insert", "insert_inferred", "update_confidence", "retract_inference")
INSERTS = OPERATIONS[:2]
#: How many removes a retraction goes.
MAX_DEPTH = 10


def stage(spark: SparkSession, rows: DataFrame, at: str) -> None:
    """Appends rows of the outbox schema to its folder."""
    rows.write.mode("append").parquet(at)


def fold(rows: DataFrame, keys: tuple[str, ...] = ("graph", "triple_hash")) -> DataFrame:
    """Each key's state after its rows, in the order of their ids: the first insert's annotations, the last confidence set."""
    inserts = rows.where(F.col("operation").isin(*INSERTS))
    updates = rows.where("operation = 'update_confidence'").groupBy("triple_hash").agg(F.max_by("confidence", "id").alias("_confidence"))
    first = first_by(inserts, list(keys), "id")
    return first.join(updates, "triple_hash", "left").withColumn("confidence", F.coalesce("_confidence", "confidence")).drop("_confidence")


@dataclass
class Applied:
    """What rows come to: the keys (graph, triple_hash) that may change (a key may come twice), their quads afterwards, and each row applied (id, operation, triple_hash, is_new)."""

    keys: DataFrame
    state: DataFrame
    entries: DataFrame


_EVENT = QUADS + ", id long, kind string, on string, level int"
_FOLDED = QUADS + ", what string, id long, level int, is_new boolean"
_OWN = ["graph", "s", "p", "o", "o_kind", "confidence", "knowledge_type", "valid_from", "valid_until", "inference_method"]


def _events(rows: DataFrame) -> DataFrame:
    """Inserts and updates of the outbox as events."""
    payload = lambda path: F.get_json_object("payload", path)
    inferred = F.col("operation") == "insert_inferred"
    return rows.select(
        "graph", F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.when(F.col("object").rlike("^(http://|https://|urn:)"), "iri").otherwise("literal").alias("o_kind"), "triple_hash", "confidence",
        F.when(inferred, F.coalesce(F.nullif("knowledge_type", F.lit("")), F.lit("inferred"))).otherwise(F.col("knowledge_type")).alias("knowledge_type"), "valid_from", "valid_until",
        F.when(inferred, F.nullif(payload("$.inference_method"), F.lit(""))).alias("inference_method"), F.when(inferred, F.from_json(payload("$.derived_from"), "array<string>")).alias("derived_from"),
        "id", F.when(F.col("operation").isin(*INSERTS), "insert").otherwise("update").alias("kind"), F.lit(None).cast("string").alias("on"), F.lit(None).cast("int").alias("level"),
    )


class _Key:
    """A triple's state while its events go by: of each graph its annotations and what it rests on."""

    def __init__(self, triple_hash: str):
        self.hash, self.graphs, self.out = triple_hash, {}, []
        self.hit: tuple[int, int] | None = None

    def event(self, e) -> None:
        if self.hit and e.id != self.hit[0]:
            self.settle()
        own = self.graphs.get(e.graph)
        rests = set() if e.derived_from is None else set(e.derived_from)
        if e.kind in ("held", "insert"):
            if new := own is None:
                self.graphs[e.graph] = own = {c: getattr(e, c) for c in _OWN} | {"derived_from": rests}
            else:
                own["derived_from"] |= rests
                own["inference_method"] = own["inference_method"] or e.inference_method
            if e.kind == "insert":
                self.out.append({"what": "entry", "id": e.id, "is_new": new})
        elif e.kind == "update":
            for held in self.graphs.values():
                held["confidence"] = e.confidence
        elif (held := self.graphs.get("inferred")) and e.on in held["derived_from"]:
            self.hit = (e.id, min(int(e.level), self.hit[1] if self.hit else int(e.level)))

    def settle(self) -> None:
        """A retraction that has reached the triple takes its inferred quad out."""
        if self.hit:
            self.graphs.pop("inferred", None)
            self.out.append({"what": "reach", "id": self.hit[0], "level": self.hit[1]})
            self.hit = None

    def rows(self) -> list[dict]:
        self.settle()
        state = [{**{c: g[c] for c in _OWN}, "derived_from": sorted(g["derived_from"]) or None, "what": "state"} for g in self.graphs.values()]
        return [{"triple_hash": self.hash, **r} for r in (*self.out, *state)]


_COLUMNS = [c.strip().split(" ")[0] for c in _FOLDED.replace("\n", " ").split(",")]


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds events that come sorted by triple and id; a triple's events may go over several batches."""
    key: _Key | None = None
    as_frame = lambda rows: pd.DataFrame(rows, columns=_COLUMNS).astype(object).where(lambda f: f.notna(), None)
    for batch in batches:
        batch = batch.astype(object).where(batch.notna(), None)
        done: list[dict] = []
        for e in batch.itertuples(index=False):
            if key is None or e.triple_hash != key.hash:
                done += key.rows() if key else []
                key = _Key(e.triple_hash)
            key.event(e)
            if len(key.out) > 10_000:
                done += [{"triple_hash": key.hash, **r} for r in key.out]
                key.out = []
        if done:
            yield as_frame(done)
    if key:
        yield as_frame(key.rows())


def _reached(explicit: DataFrame, rests: DataFrame, events: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The folds of all triples that a retraction may reach; none if there is no such triple."""
    reach, folded = cut_lineage(explicit), None
    while True:
        near = reach.where(F.col("level") < MAX_DEPTH).select(F.col("triple_hash").alias("on"), "id", (F.col("level") + 1).alias("level"))
        hits = cut_lineage(rests.join(near, "on").select("triple_hash", "on", "id", "level", F.lit("reach").alias("kind")))
        if hits.isEmpty():
            return folded
        keys = hits.select("triple_hash").distinct()
        before = held(keys).withColumns({"id": F.lit(-1).cast("long"), "kind": F.lit("held")})
        every = events.join(keys, "triple_hash", "left_semi").unionByName(before, allowMissingColumns=True).unionByName(hits, allowMissingColumns=True)
        folded = cut_lineage(every.repartition("triple_hash").sortWithinPartitions("triple_hash", "id").mapInPandas(_folded, _FOLDED))
        after = cut_lineage(explicit.unionByName(folded.where("what = 'reach'").select("triple_hash", "id", "level")))
        if after.exceptAll(reach).isEmpty() and reach.exceptAll(after).isEmpty():
            return folded
        reach = after


def replay(rows: DataFrame, held: Callable[[DataFrame], DataFrame], inferred: DataFrame) -> Applied:
    """Pending rows in the order of their ids, over quads that held() gives by triple_hash (a hash may come many times); inferred: the inferred graph's quads.

    Inserts keep a quad's first annotations and add what it rests on; confidences are set in every graph that has the triple then (null ones
    are passed over); rows of no known operation stay pending."""
    spark = rows.sparkSession
    rows = cut_lineage(rows.where(F.col("applied_at").isNull() & F.col("operation").isin(*OPERATIONS)))
    events = _events(rows.where("operation <> 'retract_inference' AND (operation <> 'update_confidence' OR confidence IS NOT NULL)"))
    explicit = rows.where("operation = 'retract_inference'").select("triple_hash", "id", F.lit(0).alias("level"))
    rests = inferred.select("triple_hash", F.explode("derived_from").alias("on")).union(events.where("graph = 'inferred'").select("triple_hash", F.explode("derived_from"))).distinct()
    folded = None if explicit.isEmpty() else _reached(explicit, rests, events, held)
    keys = events.select("triple_hash")
    if folded is None:
        # Without retractions there is nothing to tell apart, and no row is shuffled for it.
        folded, others = spark.createDataFrame([], _FOLDED), lambda df: df
    else:
        ordered = folded.select("triple_hash").distinct()
        keys, others = keys.union(ordered), lambda df: df.join(ordered, "triple_hash", "left_anti")
    plain, stored = others(events), cut_lineage(held(keys))
    # Of the other triples: the first insert of each graph, what they rest on, and the last confidence if it came later.
    first = plain.where("kind = 'insert'").groupBy("graph", "triple_hash").agg(F.min("id").alias("since"), F.min_by(F.struct(*_OWN[1:]), "id").alias("x"), F.array_distinct(F.flatten(F.collect_set("derived_from"))).alias("more"))
    last = plain.where("kind = 'update'").groupBy("triple_hash").agg(F.max("id").alias("at"), F.max_by("confidence", "id").alias("_confidence"))
    own = others(stored).select("graph", "triple_hash", F.struct(*_OWN[1:], "derived_from").alias("h"))
    both = own.join(first, ["graph", "triple_hash"], "full").join(last, "triple_hash", "left")
    value = lambda c: F.when(F.col("h").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    later = F.col("_confidence").isNotNull() & (F.col("h").isNotNull() | (F.col("at") > F.col("since")))
    none = F.expr("cast(array() as array<string>)")
    rest = F.array_sort(F.array_distinct(F.concat(F.coalesce("h.derived_from", none), F.coalesce("more", none))))
    method = F.coalesce("h.inference_method", "x.inference_method").alias("inference_method")
    state = both.select("graph", "triple_hash", *(value(c) for c in _OWN[1:] if c not in ("confidence", "inference_method")), method, F.when(later, F.col("_confidence")).otherwise(F.coalesce("h.confidence", "x.confidence")).alias("confidence"), F.when(F.size(rest) > 0, rest).alias("derived_from"))
    state = cut_lineage(state.unionByName(folded.where("what = 'state'").select(*state.columns)))
    begun = first.join(own.select("graph", "triple_hash"), ["graph", "triple_hash"], "left_anti").select("graph", "triple_hash", "since")
    plain_new = plain.where("kind = 'insert'").join(begun, ["graph", "triple_hash"], "left").select("id", F.coalesce(F.col("id") == F.col("since"), F.lit(False)).alias("is_new"))
    is_new = plain_new.unionByName(folded.where("what = 'entry'").select("id", "is_new"))
    entries = rows.select("id", "operation", "triple_hash").join(is_new, "id", "left")
    keys = stored.select("graph", "triple_hash").union(state.select("graph", "triple_hash"))
    return Applied(keys, state, entries)


def apply(quads: DataFrame, rows: DataFrame) -> DataFrame:
    """The quads after the pending rows. Applying rows again changes nothing, unless they retract what they insert later."""
    done = replay(rows, lambda keys: quads.join(small(keys.distinct()), "triple_hash", "left_semi"), quads.where("graph = 'inferred'"))
    return quads.join(small(done.keys.distinct()), ["graph", "triple_hash"], "left_anti").select(*quads.columns).unionByName(done.state.select(*quads.columns))


def drain_into(store: Store, rows: DataFrame, *, label: str | None = None) -> DataFrame:
    """Applies pending rows to a store, which rewrites the buckets that they touch; the entries applied.

    A batch with the label of the store's last change is replayed over the version before that, for its entries alone."""
    versions = store.versions()
    again = label is not None and store.label() == label
    version = versions[-2] if again else versions[-1]
    done = replay(rows, lambda keys: store.holding(keys, version=version), store.read(graphs=["inferred"], version=version))
    entries = cut_lineage(done.entries)
    if not again:
        store.replace(done.keys, done.state, label=label)
    return entries


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The outbox rows with the time at which they were applied, by the marks (id, applied_at) of drain()."""
    when = marks.groupBy("id").agg(F.min("applied_at").alias("_at"))
    return rows.join(when, "id", "left").withColumn("applied_at", F.coalesce("applied_at", "_at")).drop("_at").select(*rows.columns)


def drain(spark: SparkSession, outbox: str, store: Store, checkpoint: str, *, files_per_batch: int = 100, keep: int = 2) -> StreamingQuery:
    """Drains the outbox folder into the store, a batch of its files at a time, and ends; marks go to the folder `applied` of the store.

    Files come in the order in which they were staged, the rows of a batch by id. A batch that is repeated, in part or whole,
    gives the same store and marks."""
    source = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", files_per_batch).parquet(outbox)

    def step(batch: DataFrame, number: int) -> None:
        entries = drain_into(store, batch, label=f"{checkpoint}#{number}")
        entries.withColumn("applied_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{store.at}/applied/batch={number}")
        store.clean_up(max(2, keep))

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

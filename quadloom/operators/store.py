"""A quad store of plain files that changes by the bucket: copy on write, numbered versions, clean-up.

A graph's quads are dealt into buckets by their hash, so buckets are alike in size whatever the subjects, and a triple's bucket
is known without an index. A version is a small table that names the folder of each (graph, bucket); a change writes the buckets that its keys
fall in to a new folder and then a version that points there for these and to the old folders for the rest. Readers hold on to the
version they began with. A change that fails leaves no version behind, one that is repeated under the label of the last one changes nothing. One writer at a time."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.common import few, sieve, small
from quadloom.operators.quads import insert as inserted
from quadloom.schemas import QUADS

#: Quads of a bucket, about, when a store is made.
BUCKET_ROWS = 1_000_000
#: A store of so few buckets may have buckets of any size: these are written by the tasks that have the rows, instead of one task for each.
FEW_BUCKETS = 16
_VERSION = "graph string, bucket int, folder string, buckets int, label string"


class Store:
    """The store at a folder. create() makes it; read() and the changes then work on its newest version."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    # Files

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, at: str) -> list[str]:
        path, fs = self._path(at)
        return [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()] if fs.exists(path) else []

    def _delete(self, at: str) -> None:
        path, fs = self._path(at)
        fs.delete(path, True)

    def versions(self) -> list[int]:
        """The versions that are whole, in order."""
        there = lambda n: (p := self._path(f"{self.at}/versions/{n}/_SUCCESS"))[1].exists(p[0])
        return sorted(int(n) for n in self._folders(f"{self.at}/versions") if n.isdigit() and there(n))

    def _entries(self, version: int | None = None) -> tuple[int, list[Row]]:
        """A version's number and rows: one for each bucket with quads (one without a graph if there is none)."""
        version = self.versions()[-1] if version is None else version
        return version, self.spark.read.schema(_VERSION).parquet(f"{self.at}/versions/{version}").collect()

    def _commit(self, version: int, entries: list[tuple], buckets: int, label: str | None) -> int:
        rows = [(g, b, f, buckets, label) for g, b, f in entries] or [(None, None, None, buckets, label)]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/versions/{version}")
        return version

    def _write(self, quads: DataFrame, version: int, buckets: int, *, gathered: bool) -> list[tuple]:
        """Writes quads by bucket, gathered in one file for each or, without a shuffle, in one for each of the tasks that have some; the folders made."""
        at = f"{self.at}/data/{version}"
        dealt = quads.select(*_columns(), F.col("graph").alias("g"), self._bucket(buckets).alias("b"))
        dealt = dealt.repartition("g", "b") if gathered else dealt
        # Hashes are most of a quad, and half as long when their digits are coded.
        dealt.sortWithinPartitions("g", "b", "s", "p").write.mode("overwrite").option("compression", "zstd").partitionBy("g", "b").parquet(at)
        name = lambda folder: unquote(folder.split("=", 1)[1])
        return [(name(g), int(name(b)), f"{at}/{g}/{b}") for g in self._folders(at) if g.startswith("g=") for b in self._folders(f"{at}/{g}")]

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("triple_hash"), F.lit(buckets)).cast("int")

    # Reading

    def create(self, quads: DataFrame, *, buckets: int | None = None) -> Store:
        """Writes the first version; the number of buckets of each graph is taken from the largest graph's size."""
        if buckets is None:
            largest = quads.groupBy("graph").count().agg(F.max("count")).first()[0] or 0
            buckets = max(1, -(-largest // BUCKET_ROWS))
        self._commit(0, self._write(quads, 0, buckets, gathered=buckets > FEW_BUCKETS), buckets, None)
        return self

    def label(self) -> str | None:
        """The label of the change that made the newest version."""
        return self._entries()[1][0].label

    def _of(self, entries: list[Row]) -> DataFrame:
        reader = self.spark.read.schema(QUADS)
        paths = [e.folder for e in entries if e.folder]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], QUADS)

    def read(self, *, graphs: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The quads of a version (the newest), of the given graphs alone."""
        return self._of([e for e in self._entries(version)[1] if graphs is None or e.graph in graphs])

    def holding(self, keys: DataFrame, *, version: int | None = None) -> DataFrame:
        """The quads with the keys' hashes (triple_hash, and graph if it has that), read from their buckets alone."""
        entries = self._entries(version)[1]
        on = [c for c in ("graph", "triple_hash") if c in keys.columns]
        return self._apart(self._touched(entries, keys), keys.select(*on))[0]

    def _apart(self, entries: list[Row], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The entries' quads with the keys, and those without; quads that can't have one aren't shuffled, whatever the number of keys."""
        own, on = self._of(entries), keys.columns
        if few(keys):
            return tuple(own.join(F.broadcast(keys), on, how).select(*_columns()) for how in ("left_semi", "left_anti"))
        may, other = sieve(own, keys, "triple_hash")
        keys = keys.distinct()
        return may.join(keys, on, "left_semi").select(*_columns()), other.unionByName(may.join(keys, on, "left_anti").select(*_columns()))

    def _touched(self, entries: list[Row], keys: DataFrame) -> list[Row]:
        """The entries that keys fall in; as many rows as there are buckets at most."""
        own = [F.col("graph")] if "graph" in keys.columns else []
        hit = {tuple(r) for r in keys.select(*own, self._bucket(entries[0].buckets).alias("b")).distinct().collect()}
        return [e for e in entries if e.folder and ((e.graph, e.bucket) if own else (e.bucket,)) in hit]

    # Changes

    def replace(self, keys: DataFrame, quads: DataFrame, *, label: str | None = None) -> int:
        """Puts `quads` in place of all quads with the given keys (graph, triple_hash), which those have too; the new version's number."""
        last, entries = self._entries()
        if label is not None and entries[0].label == label:
            return last
        touched = self._touched(entries, keys)
        kept = self._apart(touched, keys.select("graph", "triple_hash"))[1]
        gathered = entries[0].buckets > FEW_BUCKETS or self._of(touched).count() <= BUCKET_ROWS
        new = self._write(kept.unionByName(quads.select(*_columns())), last + 1, entries[0].buckets, gathered=gathered)
        gone = {(e.graph, e.bucket) for e in touched} | {(g, b) for g, b, _ in new}
        stays = [(e.graph, e.bucket, e.folder) for e in entries if e.folder and (e.graph, e.bucket) not in gone]
        return self._commit(last + 1, stays + new, entries[0].buckets, label)

    def insert(self, new: DataFrame, order: str = "seq", *, label: str | None = None) -> DataFrame:
        """Adds quads as quads.insert() does; the new rows with is_new."""
        _, marked = inserted(self.holding(new.select("graph", "triple_hash")), new, order)
        added = marked.where("is_new")
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.spark.createDataFrame([], QUADS).schema if f.name not in added.columns}
        self.replace(added.select("graph", "triple_hash"), added.withColumns(missing), label=label)
        return marked

    def update_confidence(self, updates: DataFrame, *, label: str | None = None) -> int:
        """Sets confidences by triple_hash, in every graph that has the triple; the last update (greatest seq) counts."""
        last = updates.groupBy("triple_hash").agg(F.max_by("confidence", "seq").alias("_new"))
        held = self.holding(last).join(small(last), "triple_hash").withColumn("confidence", F.col("_new")).drop("_new")
        return self.replace(held.select("graph", "triple_hash"), held, label=label)

    def clean_up(self, keep: int = 2) -> list[int]:
        """Deletes all but the newest versions and the folders that only they name; those deleted."""
        every = self.versions()
        old, kept = every[:-keep], every[-keep:]
        named = {e.folder for v in kept for e in self._entries(v)[1]}
        for v in old:
            self._delete(f"{self.at}/versions/{v}")
        for d in self._folders(f"{self.at}/data"):
            if int(d) > every[-1]:
                continue
            at = f"{self.at}/data/{d}"
            leaves = [f"{at}/{g}/{b}" for g in self._folders(at) for b in self._folders(f"{at}/{g}")]
            for leaf in leaves:
                if leaf not in named:
                    self._delete(leaf)
            if not named.intersection(leaves):
                self._delete(at)
        return old


def _columns() -> list[str]:
    return [c.strip().split(" ")[0] for c in QUADS.replace("\n", " ").split(",")]

"""Small helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast.
SMALL_ROWS = 10_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table marked for broadcast if it has at most so many rows, else as it is; its size is looked at, not assumed."""
    return F.broadcast(df) if few(df, rows) else df


def few(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether the table has at most so many rows; no more than these are looked at."""
    return df.limit(rows + 1).count() <= rows


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from files: of spark.checkpoint.dir where it is set, else (in a local session only) of a folder of our own."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="quadloom-")
        spark.sparkContext.setCheckpointDir(f"{at.rstrip('/')}/{uuid.uuid4().hex}")
    return df.checkpoint()


#: Rows that a task sorts or aggregates, about, where dealt() deals them out.
TASK_ROWS = 200_000


def dealt(df: DataFrame, keys: list[str], rows: int | None = None, *, each: int | None = None) -> DataFrame:
    """The rows dealt out by their keys to as many tasks as take about TASK_ROWS (or `each`) of them, so that what a task sorts doesn't grow with the table.

    rows: how many there are about, where that is known; else they are counted."""
    n = df.count() if rows is None else rows
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n // (each or TASK_ROWS))), *keys)


#: Bits of a sieve for each key, and in all: above that it lets more rows through, but doesn't grow.
SIEVE_BITS, MOST_BITS = 16, 1 << 28
# Bits of a word, words of a row of the sieve, and where in a hash the three bits of a value are.
_WORD, _WORDS, _PLACES = 64, 512, (40, 46, 52)


def sieve(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df in two parts: the rows that may have one of the keys' values in a column, and those that surely have none, without shuffling any of them.

    A value's hash is three bits of a word in a table of at most MOST_BITS, which is broadcast. Of other rows about one in a hundred gets
    through while the table isn't at its most, so a join with the keys that follows shuffles the rows that have them and few more."""
    words = min(MOST_BITS // _WORD, max(1, -(-keys.count() * SIEVE_BITS // (_WORD * _WORDS))) * _WORDS)
    word = F.pmod(F.xxhash64(column), F.lit(words)).alias("_word")
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(xxhash64(`{column}`), {p}) & 63 as int))" for p in _PLACES)).alias("_bits")
    every = keys.select(word, bits).union(df.sparkSession.range(words).select("id", F.lit(0).cast("long")))
    rows = every.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).groupBy(F.expr(f"_word div {_WORDS}").alias("_row"))
    table = cut_lineage(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"]).alias("_all")))
    own = df.withColumns({"_word": word, "_bits": bits}).withColumn("_row", F.expr(f"_word div {_WORDS}")).join(F.broadcast(table), "_row")
    may = F.expr(f"(_all[cast(_word % {_WORDS} as int)] & _bits) = _bits")
    # The column rests on the table too, or a semi join that follows would be moved before the join with it.
    through = own.where(may).select(*(F.when(may, F.col(c)).alias(c) if c == column else c for c in df.columns))
    return through, own.where(~may).select(*df.columns)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """The rows with their place in the order, from 0: they are sorted into ranges, and a window over the few ranges' sizes says where each begins."""
    spread = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()))
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return spread.withColumn("_within", within).join(F.broadcast(begins), "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in spark.checkpoint.dir (in a local session that names none, in one of our own), which goes when the session ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="quadloom-")
    at = f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """df from Parquet files in a new_folder(): as cut_lineage(), but terms and hashes that repeat take a fraction of the space, and partitions aren't kept."""
    at = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def first_by(df: DataFrame, keys: list[str], *order, most: int = 1) -> DataFrame:
    """Of each key the first row by the order, or so many of them."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= most).drop("_place")

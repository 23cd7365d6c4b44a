"""Helpers shared by the operators: tables in the shared folder, word counts, prefix sums."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task of a prefix sum takes, about.
RANGE_ROWS = 2_000_000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where spark.checkpoint.dir is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusmill.shared.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("corpusmill.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing is computed from them any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/part-" not in path and shared_dir(spark).rpartition(":")[2] in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to spark.sql.shuffle.partitions tasks, which stay as many however small the rows are: for work that takes long a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most so many rows at once to Python, for frames with large rows that are run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _hashed(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def row_key(df: DataFrame) -> Column:
    """A hash of a row's columns; rows have one in common only if they are equal (but for maps, which have no hash)."""
    return F.xxhash64(*(df[f"`{c}`"] for c in _hashed(df)))


def chosen_rows(df: DataFrame, chosen: DataFrame, extra: str | None = None) -> tuple[DataFrame, str | None]:
    """Rows of ``df`` whose row_key is in ``chosen`` (row, times, extra), one of those that are equal; ``extra`` is added under the name that is returned.

    ``times`` says how many rows have the key, so only rows that repeat are compared as a whole.
    ``chosen`` grows with ``df``, so both are shuffled, at any size.
    """

    def free(name: str) -> str:
        while name in df.columns:
            name += "_"
        return name

    key, name = free("row_key"), extra and free(extra)
    part = lambda which: df.join(chosen.where(which).select(F.col("row").alias(key), *([F.col(extra).alias(name)] if extra else [])).hint("merge"), row_key(df) == F.col(key)).drop(key)
    found = part("times = 1")
    if not chosen.where("times > 1").isEmpty():
        found = found.unionByName(part("times > 1").dropDuplicates(_hashed(df)))
    return found, name


def word_count(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Add for each row what precedes it in its group under an order, whatever the group's size.

    Adds ``index`` (rows before it) and, for each column in ``sums``, ``before_<column>`` and
    ``all_<column>`` (the group's total). Rows are dealt out in ranges of (group, order), so a
    hot group spreads over many partitions; only totals per (partition, group) meet in one place.
    Group columns must not hold nulls. Rows that tie in the whole order are equal for the caller.
    """
    spark = df.sparkSession
    narrow = cut(df, "narrow")  # dealing out by ranges reads twice: first a sample, then all rows
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // RANGE_ROWS))
    ranged = cut(narrow.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    drop(narrow)
    keys = ["_part", *group]
    totals = ranged.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{c}") for c in sums))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = totals.select(
        *keys, F.coalesce(F.sum("_n").over(before), zero).alias("_n0"),
        *(F.coalesce(F.sum(f"_t_{c}").over(before), zero).alias(f"_b_{c}") for c in sums),
        *(F.sum(f"_t_{c}").over(over).alias(f"all_{c}") for c in sums),
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(totals, keys)
    out = rows.withColumn("index", F.col("_n0") + F.count("*").over(within) - 1)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"_b_{c}") + F.sum(c).over(within) - F.col(c))
    return out.drop("_part", "_n0", *(f"_b_{c}" for c in sums))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (id, component), the component named by its least id.

    Alternates large and small stars until the edges rest: each round ties what a vertex sees to
    the least of it. Minima are combined before they are shuffled, so hot vertices are no burden;
    nothing but counts comes to the driver. Rounds grow with the logarithm of a component's width.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, now = now, cut(small.where("a <> b").distinct(), "edges")
        drop(before)
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(row) == sign or not row[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        sign = tuple(row)

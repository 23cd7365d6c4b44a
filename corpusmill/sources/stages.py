"""Stage tables: results that later steps read more than once, written to the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusmill.stage.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-stages-")
        spark.conf.set("corpusmill.stage.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no one has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lets Spark delete the shuffle files of a write once it is done; nothing reads them again, as the table ends the lineage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(rows: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write rows once and read them from there; lineage ends at the table. ``done``: stage tables that nothing else reads any more, deleted behind it."""
    spark = rows.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    drop(spark, *done)
    return spark.read.schema(rows.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stage tables."""
    for path in {f.rpartition("/")[0] for table in tables for f in table.inputFiles()}:
        if shared_dir(spark).rpartition(":")[2] in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Record tables as JSON lines and Parquet: read, write, append, replace; error log; workspace settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .stages import staged

ERROR = "task_id string, source_id string, stage string, level string, message string, details string, created_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at a path."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").isEmpty()
    except Exception as error:  # a missing path is an analysis error of its own kind, all else is passed on
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; no rows where nothing is stored; blank lines count for nothing."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record of each file, spread over any number of lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Records in place of what is stored; they are kept aside first, so they may come from the same path."""
    staged(rows, "records").write.mode("overwrite").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replaced(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old records but those whose keys are among the new, and the new ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new)


def replaced_where(old: DataFrame, keep: Column, new: DataFrame) -> DataFrame:
    """Old records that ``keep`` holds for, and the new ones; a null test drops."""
    return old.where(keep).unionByName(new)


def write_by_source(rows: DataFrame, path: str) -> None:
    """Chunks or other records in a folder for each source; the sources at hand replace their own folders alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").json(path)


def error_rows(rows: DataFrame, task: str, stage: str, level: str, message: Column, details: Column | None = None) -> DataFrame:
    """Rows with a ``source_id`` as records of the error log."""
    about = F.coalesce(details, F.lit("{}")) if details is not None else F.lit("{}")
    return rows.select(F.lit(task).alias("task_id"), "source_id", F.lit(stage).alias("stage"), F.lit(level).alias("level"), message.alias("message"), about.alias("details"), F.current_timestamp().alias("created_at"))


def index_or_live(index: DataFrame, live: DataFrame) -> tuple[DataFrame, str]:
    """(rows, ``index`` or ``live``): the stored search index if it has any row, else the pages as they are."""
    return (live, "live") if index.isEmpty() else (index, "index")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an indented settings file: nested keys joined by dots, list items numbered from 0; values stay text but for quotes.

    A settings file is small and ordered, so it is read as one row and split there.
    """
    each = F.posexplode(F.split("value", "\r?\n")).alias("no", "line")
    rows = spark.read.text(path, wholetext=True).select(each).where(~F.col("line").rlike(r"^\s*(?:#.*)?$"))
    indent, body = F.length("line") - F.length(F.ltrim("line")), F.trim("line")
    item = F.startswith(body, F.lit("- "))
    key, value = F.trim(F.regexp_extract(body, r"^([^:]*):", 1)), F.when(item, F.substring(body, 3, 1 << 20)).otherwise(F.regexp_extract(body, r"^[^:]*:(.*)$", 1))
    rows = rows.select("no", indent.alias("indent"), item.alias("item"), F.when(~item, key).alias("key"), T.sub(F.trim(value), r"^(['\"])(.*)\1$", "$2").alias("value")).where("item OR key <> ''")
    above = rows.where("NOT item AND value = ''").select(F.col("no").alias("a_no"), F.col("indent").alias("a_indent"), F.col("key").alias("a_key"))
    least = rows.select(F.col("no").alias("b_no"), F.col("indent").alias("b_indent"))
    open_ = rows.join(above, (F.col("a_no") < F.col("no")) & (F.col("a_indent") < F.col("indent")))
    closed = open_.join(least, (F.col("b_no") > F.col("a_no")) & (F.col("b_no") < F.col("no")) & (F.col("b_indent") <= F.col("a_indent")), "left_anti")
    path_ = closed.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct("a_no", "a_key"))), lambda x: x["a_key"]).alias("path"), F.max("a_no").alias("parent"))
    rows = rows.join(path_, "no", "left")
    place = rows.where("item").select("no", "parent").alias("x").join(rows.where("item").select(F.col("no").alias("o"), F.col("parent").alias("p")), (F.col("p") == F.col("parent")) & (F.col("o") < F.col("no")), "left").groupBy("no").agg(F.count("o").cast("string").alias("place"))
    rows = rows.join(place, "no", "left").where("item OR value <> ''")
    return rows.select(F.array_join(F.concat(F.coalesce("path", F.array().cast("array<string>")), F.array(F.coalesce("place", "key"))), ".").alias("key"), "value")

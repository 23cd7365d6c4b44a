"""Lineage and run history as append-only tables."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import staged

STEP = "step_id string, parent_id string, run_id string, name string, kind string, started double, ended double, status string"
# Words that mark a key as secret.
SECRET_KEYS = ("api_key", "apikey", "authorization", "password", "secret", "token")


class Trace:
    """Steps of a run, nested; each sets Spark's job group, and all are one table at the end."""

    def __init__(self, spark: SparkSession, run_id: str | None = None):
        self.spark, self.run_id, self.steps, self.open = spark, run_id or uuid.uuid4().hex, [], []

    @contextlib.contextmanager
    def step(self, name: str, kind: str = "stage") -> Iterator[str]:
        step, started, status = uuid.uuid4().hex, time.time(), "ok"
        parent = self.open[-1] if self.open else None
        self.open.append(step)
        self.spark.sparkContext.setJobGroup(step, name)
        try:
            yield step
        except BaseException:
            status = "failed"
            raise
        finally:
            self.open.pop()
            self.steps.append((step, parent, self.run_id, name, kind, started, time.time(), status))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.steps, STEP)


def events(rows: DataFrame, operation: str, inputs: Column, outputs: Column, reason: str = "") -> DataFrame:
    """(operation, inputs, outputs, reason, lineage_id): what was made of what."""
    body = rows.select(F.lit(operation).alias("operation"), inputs.alias("inputs"), outputs.alias("outputs"), F.lit(reason).alias("reason"))
    return body.withColumn("lineage_id", F.sha2(F.to_json(F.struct("operation", "inputs", "outputs")).cast("binary"), 256))


def summary(lineage: DataFrame) -> DataFrame:
    """(operation, events, inputs, outputs)."""
    return lineage.groupBy("operation").agg(F.count("*").alias("events"), F.sum(F.size("inputs")).alias("inputs"), F.sum(F.size("outputs")).alias("outputs"))


def descendants(steps: DataFrame, root: str) -> DataFrame:
    """(step_id, depth) of a step and all below it, level by level, as deep as they go; a step that is met again counts once."""
    steps = steps.select("step_id", "parent_id")
    front = found = staged(steps.where(F.col("step_id") == root).select("step_id", F.lit(0).alias("depth")).distinct(), "steps")
    depth = 0
    while not front.isEmpty():
        depth += 1
        below = steps.join(front.select(F.col("step_id").alias("parent_id")), "parent_id").select("step_id").distinct()
        front = staged(below.join(found, "step_id", "left_anti").select("step_id", F.lit(depth).alias("depth")), "steps")
        found = found.unionByName(front)
    return found


def runs(steps: DataFrame) -> DataFrame:
    """(run_id, started, ended, steps, failed), newest first."""
    return steps.groupBy("run_id").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.count("*").alias("steps"), F.sum((F.col("status") == "failed").cast("int")).alias("failed")).orderBy(F.desc("started"))


def expired(runs_: DataFrame, now: float, days: float = 7) -> DataFrame:
    """Ended runs past their retention; running and undated ones stay."""
    return runs_.where(F.col("ended").isNotNull() & (F.col("ended") < now - days * 86400))


def redacted(json: Column, secrets: list[str] = ()) -> Column:
    """JSON text with the values of secret keys, and known secret strings, blotted out."""
    keys = "|".join(SECRET_KEYS)
    out = F.regexp_replace(json, rf'(?i)("[^"]*(?:{keys})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]\s]+)', '$1"***"')
    for s in secrets:
        out = F.replace(out, F.lit(s), F.lit("***"))
    return out


def usage(attempts: DataFrame) -> DataFrame:
    """(run_id, requests, attempts, retries, failed, repaired, waited_ms, took_ms, with_usage, without_usage, input_tokens, output_tokens) of model calls.

    Attempts: run_id, request_id, status, repaired, backoff_ms, duration_ms, usage_available,
    input_tokens, output_tokens; a request without attempts is a row whose status is null.
    """
    made, has = F.col("status").isNotNull(), F.coalesce("usage_available", F.lit(False))
    total = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0)).cast("long")
    rows = attempts.groupBy("run_id").agg(
        F.count_distinct("request_id").alias("requests"), F.count_if(made).alias("attempts"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.coalesce("repaired", F.lit(False))).alias("repaired"),
        total("backoff_ms").alias("waited_ms"), total("duration_ms").alias("took_ms"), F.count_if(made & has).alias("with_usage"), total("input_tokens", has).alias("input_tokens"), total("output_tokens", has).alias("output_tokens"),
    )
    return rows.withColumns({"retries": F.greatest(F.col("attempts") - F.col("requests"), F.lit(0)), "without_usage": F.col("attempts") - F.col("with_usage")})


def backend_time(attempts: DataFrame) -> DataFrame:
    """(run_id, backend, took_ms)."""
    return attempts.where("status IS NOT NULL").groupBy("run_id", F.coalesce(F.nullif("backend", F.lit("")), F.lit("unknown")).alias("backend")).agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("took_ms"))

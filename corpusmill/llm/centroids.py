"""Centroid clustering with partial-distance search.

Vectors become integers once and lie in the shared folder as blocks. A round sends the centroids
(k numbers of each dimension, nothing that grows with the data) to every task. A block takes the
dimensions in order of their variance over all vectors, a few at a time: squared differences are
added up, and a centroid is given up for a vector as soon as its sum is strictly above the
distance of the best one known; only those that are left see the remaining dimensions. Sums and
counts of clusters are added within tasks, then by Spark, so a round brings k rows to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop
from .vectors import finite, matrices, narrow, scaled, wide

#: Vectors of a block, and dimensions that are added before centroids are given up.
BLOCK_ROWS, STEP = 4096, 8


def blocks(vectors: DataFrame, dim: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(ids, n, kind, ints): kept vectors in blocks of at most 4096, in the shared folder."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch, 1):
                for a in range(0, len(rows), BLOCK_ROWS):
                    raw, kind = narrow(x[a : a + BLOCK_ROWS])
                    ids = batch.column(0).take(pa.array(rows[a : a + BLOCK_ROWS]))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(ids)], pa.int32()), pa.array([kind]), pa.array([raw], pa.binary())], names=["ids", "n", "kind", "ints"])

    kept = vectors.where(finite(vec_col) & (F.size(F.col(f"`{vec_col}`")) == dim)).select(F.col(f"`{id_col}`").alias("id"), scaled(vec_col, scale).alias("v"))
    return cut(kept.mapInArrow(run, f"ids array<{id_type}>, n int, kind string, ints binary"), "vector_blocks")


def spread(table: DataFrame, dim: int) -> np.ndarray:
    """Dimensions in order of falling variance over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            for i in range(batch.num_rows):
                x = wide(batch.column(2)[i].as_py(), batch.column(1)[i].as_py(), dim, batch.column(0)[i].as_py())
                n, one, two = n + len(x), one + x.sum(0), two + (x.astype(float) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(one), pa.array(two)], names=["d", "n", "one", "two"])

    sums = table.select("n", "kind", "ints").mapInArrow(run, "d long, n long, one double, two double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    found = np.zeros(dim)
    for r in sums.collect():  # a row for each dimension
        found[r.d] = r.two / r.n - (r.one / r.n) ** 2 if r.n else 0
    return np.argsort(-found, kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and the squared distance, by partial sums."""
    x, c = x[:, order], centroids[:, order]
    reach = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.int32 if 4 * reach * reach * x.shape[1] < 1 << 31 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    part = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(2, dtype=kind)
    first = part.argmin(1)
    best = ((x - c[first]) ** 2).sum(1, dtype=np.int64)  # of one whole centroid
    row, at = np.nonzero(part <= best[:, None])
    sums = part[row, at].astype(np.int64)
    for a in range(STEP, x.shape[1], STEP):
        sums += ((x[row, a : a + STEP] - c[at, a : a + STEP]) ** 2).sum(1, dtype=np.int64)
        alive = sums <= best[row]
        row, at, sums = row[alive], at[alive], sums[alive]
    lead = np.lexsort((at, sums, row))
    lead = lead[np.unique(row[lead], return_index=True)[1]]
    return at[lead], sums[lead]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Kept are vectors of exactly ``dim`` components, none null or not finite, each as
    floor(scale * x). Centroids start as the k kept vectors with the smallest sha256 of
    ``seed:id`` (repeated ids by their vectors); a null id is clustered but starts none. Each round
    assigns all vectors, then moves centroids to the floor of their means; empty ones stay. Fewer
    vectors than k give fewer centroids, none an empty result. Repeated rows count each. Squared
    distances and sums must fit 64 bits. Only k rows a step come to the driver.
    """
    spark = vectors.sparkSession
    table = blocks(vectors, dim, scale, id_col, vec_col)
    id_type = vectors.schema[id_col].dataType.simpleString()
    start = vectors.where(finite(vec_col) & (F.size(F.col(f"`{vec_col}`")) == dim) & F.col(f"`{id_col}`").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256).alias("h"), scaled(vec_col, scale).alias("v"))
    centroids = np.array([r.v for r in start.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dim)  # k rows
    columns = f"`{id_col}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order, names = spread(table, dim), [f"s{d}" for d in range(dim)]

    def summed(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(now), np.int64), np.zeros((len(now), dim), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    x = wide(batch.column(2)[i].as_py(), batch.column(1)[i].as_py(), dim, batch.column(0)[i].as_py())
                    at, _ = nearest(x, now, order)
                    n += np.bincount(at, minlength=len(now))
                    np.add.at(sums, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now))), pa.array(n), *(pa.array(s) for s in sums.T)], names=["cluster", "n", *names])

        return run

    schema = "cluster long, n long, " + ", ".join(f"{c} long" for c in names)
    for _ in range(rounds):
        sums = table.select("n", "kind", "ints").mapInArrow(summed(centroids), schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
        moved = centroids.copy()
        for r in sums.collect():  # k rows
            if r.n:
                moved[r.cluster] = [r[c] // r.n for c in names]
        centroids = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                at, far = nearest(wide(batch.column(3)[i].as_py(), batch.column(2)[i].as_py(), dim, batch.column(1)[i].as_py()), centroids, order)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    rows = cut(table.mapInArrow(assigned, f"id {id_type}, cluster int, distance long"), "assigned")
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()  # k rows
    drop(table)
    signs = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(r.own for r in each)
    facts = spark.createDataFrame([(r.cluster, r.own, total, signs[r.cluster]) for r in each], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *columns[1:])


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def cluster_sql(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256) -> str:
    """The same in DuckDB SQL: every round a full comparison."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, min({{'d': d, 'cluster': cluster}}) AS best FROM (
  SELECT row, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (
  SELECT best.cluster AS cluster, i, (sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN v USING (row)) GROUP BY ALL) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.cluster = m{r}.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best.cluster::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (row) JOIN c{rounds} ON best.cluster = c{rounds}.cluster"""


SQL = cluster_sql()

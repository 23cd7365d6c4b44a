"""Exact top-k search by inner product over a bit-sliced index.

Blocks of vectors keep, for each component, bitmaps of the leading bits of its quantised value.
A query adds these slices, weighted by its own leading bits, with full adders on bitmaps: one
number of a few bits for each row, again as slices. The best rows are selected from the most
significant slice downward; every row that the rounding could still put among them is scored
exactly from the integers kept beside the slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut

U = np.uint64
#: Leading bits kept of a component in the index, and of a query's component.
ROW_BITS, QUERY_BITS = 6, 6
BLOCK_ROWS, CHUNK_QUERIES = 4096, 64


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component as integers; only vectors that are not null and hold finite numbers alone."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer matrices of up to ``rows`` vectors of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        v = batch.column(1)
        lens = v.value_lengths().to_numpy(zero_copy_only=False)
        ids, flat = batch.column(0).to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens)
        for d in np.unique(lens):
            which = np.flatnonzero(lens == d)
            x = flat[(ends[which] - d)[:, None] + np.arange(d)] if d else np.zeros((len(which), 0), np.int64)
            a, b = held.get(d, (np.zeros(0, ids.dtype), np.zeros((0, d), np.int64)))
            a, b = np.concatenate([a, ids[which]]), np.concatenate([b, x])
            while len(a) >= rows:
                yield a[:rows], b[:rows]
                a, b = a[rows:], b[rows:]
            held[d] = a, b
    for a, b in held.values():
        if len(a):
            yield a, b


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps of the leading bits: (component, bit, word), each component's least value, and the bits dropped."""
    low = x.min(0)
    up = x - low
    drop = max(0, int(up.max(initial=0)).bit_length() - ROW_BITS)
    rows = -(-len(x) // 64) * 64
    head = np.zeros((x.shape[1], rows), np.uint8)
    head[:, : len(x)] = (up >> drop).T
    bits = (head[:, None, :] >> np.arange(ROW_BITS, dtype=np.uint8)[:, None]) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(U), low, drop


def build_index(vectors: DataFrame, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index, one row per block of at most 4096 vectors of one length, in the shared folder."""

    def run(batches):
        for seq, (ids, x) in enumerate(_packed(batches, BLOCK_ROWS)):
            maps, low, drop = slices(x)
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), *(pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((x, "<i8"), (maps, "<u8"), (low, "<i8"))), pa.array([drop], pa.int32())], names=["seq", "dim", "ids", "ints", "maps", "low", "dropped"])

    rows = quantised(vectors, id_col, vec_col, scale).mapInArrow(run, "seq int, dim int, ids array<long>, ints binary, maps binary, low binary, dropped int")
    return cut(rows.withColumn("part", F.spark_partition_id()), "bit_slices")


def slice_sums(maps: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Slices of sum(|c| * (h if c > 0 else most - h)) for each query and row, h being the rows' leading bits."""
    size, sign = np.abs(c), np.where(c < 0, ~U(0), U(0))
    top = int((size.sum(1) * ((1 << ROW_BITS) - 1)).max(initial=0)).bit_length() + 1
    acc = np.zeros((top, len(c), maps.shape[2]), U)
    x, carry, t = (np.empty(acc.shape[1:], U) for _ in range(3))
    for d in range(maps.shape[0]):
        for j in range(int(size[:, d].max(initial=0)).bit_length()):
            on = np.where((size[:, d] >> j) & 1, ~U(0), U(0))[:, None]
            flip = sign[:, d, None] & on
            carry[:] = 0
            for b in range(top - j):
                a = acc[j + b]
                if b < ROW_BITS:  # a full adder: a, x and carry
                    np.bitwise_and(maps[d, b], on, out=x)
                    np.bitwise_xor(x, flip, out=x)
                    np.bitwise_xor(a, x, out=t)
                    np.bitwise_and(a, x, out=x)
                    np.bitwise_xor(t, carry, out=a)
                    np.bitwise_and(t, carry, out=t)
                    np.bitwise_or(x, t, out=carry)
                else:
                    if not carry.any():
                        break
                    np.bitwise_and(a, carry, out=t)
                    np.bitwise_xor(a, carry, out=a)
                    carry, t = t, carry
    return acc


def select_top(acc: np.ndarray, rows: int, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of every row whose sum is at least the query's k-th sum less its slack."""
    valid = np.zeros(acc.shape[2] * 64, np.uint8)
    valid[:rows] = 1
    valid = np.packbits(valid, bitorder="little").view(U)
    taken = np.zeros(acc.shape[1:], U)
    open_ = np.broadcast_to(valid, acc.shape[1:]).copy()
    kth = np.zeros(acc.shape[1], np.int64)
    if rows > k:
        for i in range(len(acc) - 1, -1, -1):  # rows in ``taken`` are above the k-th, rows in ``open_`` level with it
            high = open_ & acc[i]
            enough = np.bitwise_count(taken | high).sum(1, dtype=np.int64) >= k
            kth |= enough.astype(np.int64) << i
            taken = np.where(enough[:, None], taken, taken | high)
            open_ = np.where(enough[:, None], high, open_ & ~acc[i])
        least = np.maximum(kth - slack, 0)
    else:
        least = kth
    above, level = np.zeros(acc.shape[1:], U), np.broadcast_to(valid, acc.shape[1:]).copy()
    for i in range(len(acc) - 1, -1, -1):
        bit = ((least >> i) & 1).astype(bool)[:, None]
        above = np.where(bit, above, above | (level & acc[i]))
        level = np.where(bit, level & acc[i], level & ~acc[i])
    found = np.unpackbits((above | level).view(np.uint8), axis=1, bitorder="little")
    return np.nonzero(found)


def block_top(ids, ints, maps, low, dropped, q_ids, q, k):
    """Exact best k rows of one block for each query: (query index, row index, score), a few more for ties and rounding."""
    drop = np.maximum(0, np.array([int(v).bit_length() for v in np.abs(q).max(1, initial=0)]) - QUERY_BITS)
    half = (1 << drop) >> 1
    c = np.sign(q) * ((np.abs(q) + half[:, None]) >> drop[:, None])
    acc = slice_sums(maps, c)
    # exact = 2^(drop + dropped) * sum + a constant of the query + c-part and rest of what was dropped, each bounded by norms
    x = ints - low
    rest = (x & ((1 << dropped) - 1)) - ((1 << dropped) - 1) / 2
    head = (x >> dropped).astype(float)
    centre = head.mean(0)
    q_rest = q - c * (1 << drop)[:, None]
    far = np.linalg.norm(q, axis=1) * np.linalg.norm(rest, axis=1).max(initial=0) + np.linalg.norm(q_rest, axis=1) * np.linalg.norm(head - centre, axis=1).max(initial=0) * (1 << dropped)
    slack = np.ceil(2 * far / ((1 << drop) * float(1 << dropped)) + 1e-6).astype(np.int64) + 1
    at, row = select_top(acc, len(ids), k + 1, slack)
    score = np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 15):
        s = slice(a, a + (1 << 15))
        score[s] = (q[at[s]] * ints[row[s]]).sum(1)
    own = ids[row] == q_ids[at]
    at, row, score = at[~own], row[~own], score[~own]
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], row[keep], score[keep]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of the index by integer inner product.

    Ties go to the smaller id; rows with the query's own id take no part, nor do vectors of another
    length. Repeated rows of the index rank each; of query rows with one id the least vector asks.
    Null ids, null vectors and vectors with null or non-finite components take no part. Products must
    fit 64 bits. Queries meet blocks in chunks of 64: chunks go to groups of blocks, no row is paired.
    """
    spark = index.sparkSession
    names = index.select("part", "seq")
    n_blocks = names.count()
    groups = max(min(n_blocks, 64), -(-n_blocks // 64), 1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")).repartition(max(1, min(n, 64)))

    def chunk(batches):
        for seq, (ids, x) in enumerate(_packed(batches, CHUNK_QUERIES)):
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["dim", "q_ids", "q"])

    chunks = asked.mapInArrow(chunk, "dim int, q_ids array<long>, q binary").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    numbered = names.select("part", "seq", F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "seq")), F.lit(groups)).alias("g"))
    pairs = index.join(numbered, ["part", "seq"]).join(chunks, ["g", "dim"]).select("dim", "ids", "ints", "maps", "low", "dropped", "q_ids", "q")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, ints, maps, low, dropped, q_ids, q = (batch.column(c)[i] for c in range(8))
                dim, ids, q_ids = dim.as_py(), ids.values.to_numpy(), q_ids.values.to_numpy()
                ints, q = (np.frombuffer(b.as_py(), "<i8").reshape(-1, dim) for b in (ints, q))
                maps = np.frombuffer(maps.as_py(), "<u8").reshape(dim, ROW_BITS, -1)
                at, row, score = block_top(ids, ints, maps, np.frombuffer(low.as_py(), "<i8"), dropped.as_py(), q_ids, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[row]), pa.array(score)], names=["query_id", "vec_id", "score"])

    with arrow_batches(spark, 8):  # a pair of a block and a chunk takes some MB
        best = cut(pairs.mapInArrow(run, "query_id long, vec_id long, score long"), "block_top")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(build_index(vectors), vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, r.vec_id, sum(q.x * r.x)::BIGINT AS score FROM e q JOIN e r ON q.i = r.i AND q.vec_id <> r.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

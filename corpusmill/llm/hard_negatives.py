"""Hard-negative mining by dual-tree search over integer inner products.

Candidates and anchors are dealt by ranges of (label, id) and packed into blocks, each with a
balanced tree: nodes split by label first, then at the median of their widest dimension, and keep
a centre, a radius, the longest vector and the range of labels. Blocks of candidates meet blocks of
anchors in cells of a grid of bounded size. In a cell, node pairs are walked from both roots: from
centres and radii follow the least and the greatest inner product that any two of their rows can
have, and a pair is left out for the whole group of anchors where labels rule it out, or where that
interval can no longer change what any of them keeps. Leaf pairs are scored exactly, most promising
first. The first search finds an anchor's positives, the second its negatives in the windows that
the positives' scores set; cells give at most k rows a window, which Spark ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .vectors import finite, matrices, narrow, product, scaled, wide

#: Rows of a block and of a leaf, of candidates and of anchors.
CANDIDATES, ANCHORS = (4096, 128), (1024, 32)
#: Rows of a cell's sides: what one task holds at once.
CELL_CANDIDATES, CELL_ANCHORS = 1 << 18, 1 << 16
#: Leaves that are scored at once.
LEAVES = 8
LEAST = np.iinfo(np.int64).min

PACKED = "part int, dim int, n int, label_lo long, label_hi long, ids binary, labels binary, windows binary, kind string, ints binary, centres binary"


class Tree:
    """A block's rows in the order of its leaves, and facts of the nodes of a complete binary tree."""

    def __init__(self, x, ids, labels, windows, leaf: int, centres: bytes | None = None):
        self.x, self.ids, self.labels, self.windows = x, ids, labels, windows
        self.levels = max(0, (-(-len(x) // leaf) - 1).bit_length())
        if centres is None:
            order = self._ordered()
            self.x, self.ids, self.labels, self.windows = x[order], ids[order], labels[order], windows[order]
            self.centres = np.concatenate([[self.x[rows].mean(0) for rows in self.nodes(level)] for level in range(self.levels + 1)])
        else:
            self.centres = np.frombuffer(centres).reshape((2 << self.levels) - 1, x.shape[1])

    def nodes(self, level: int) -> list[slice]:
        """Rows of each node of a level."""
        n = len(self.x)
        return [slice((i * n) >> level, ((i + 1) * n) >> level) for i in range(1 << level)]

    def _ordered(self) -> np.ndarray:
        order, n = np.argsort(self.labels, kind="stable"), len(self.x)
        for level in range(self.levels):
            for i in range(1 << level):
                a, m, b = (i * n) >> level, ((2 * i + 1) * n) >> (level + 1), ((i + 1) * n) >> level
                rows = order[a:b]
                if self.labels[rows[0]] == self.labels[rows[-1]] and self.x.shape[1]:
                    order[a:b] = rows[np.argpartition(self.x[rows, self.x[rows].var(0).argmax()], m - a)]
        return order

    def leaf(self, i: int) -> slice:
        """Rows of a leaf, by the number of its node."""
        return self.nodes(self.levels)[i - (1 << self.levels) + 1]

    def raised(self, values: np.ndarray, f) -> np.ndarray:
        """f (least or greatest) of a value of rows, for every node."""
        levels = [f.reduceat(values, [rows.start for rows in self.nodes(self.levels)])]
        while len(levels[-1]) > 1:
            levels.append(f(levels[-1][0::2], levels[-1][1::2]))
        return np.concatenate(levels[::-1])

    def facts(self) -> None:
        """What node pairs are judged by: radii, lengths and labels."""
        near = self.x.astype(np.float64)
        nodes = [rows for level in range(self.levels + 1) for rows in self.nodes(level)]
        far = np.array([np.sqrt(((near[rows] - centre) ** 2).sum(1).max()) for rows, centre in zip(nodes, self.centres)])
        self.radius, self.away = far, np.linalg.norm(self.centres, axis=1)
        self.reach = self.raised(np.sqrt((near**2).sum(1)), np.maximum)
        self.lo, self.hi = self.raised(self.labels, np.minimum), self.raised(self.labels, np.maximum)


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of any two rows, for all pairs of nodes, rounding allowed for."""
    mid = a.centres @ b.centres.T
    off = a.radius[:, None] * b.away + a.away[:, None] * b.radius + a.radius[:, None] * b.radius[None, :]
    most = a.reach[:, None] * b.reach
    slack = 1e-9 * most + 1e-6
    return np.maximum(mid - off, -most) - slack, np.minimum(mid + off, most) + slack


def leaf_pairs(a: Tree, b: Tree, alive) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers of the leaf pairs that are left when pairs of nodes go by alive(i, j), level by level."""
    i = j = np.zeros(1, np.int64)
    for level in range(max(a.levels, b.levels) + 1):
        keep = alive(i, j)
        i, j = i[keep], j[keep]
        if level < a.levels:
            i, j = np.concatenate([2 * i + 1, 2 * i + 2]), np.concatenate([j, j])
        if level < b.levels:
            i, j = np.concatenate([i, i]), np.concatenate([2 * j + 1, 2 * j + 2])
    keep = alive(i, j)
    return i[keep], j[keep]


class Kept:
    """The k best (score, id) of each window of each anchor: scores falling, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), LEAST), np.zeros((n, k), np.int64)

    def offer(self, at: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Scores (window, row) that fit, for windows ``at``."""
        s = np.where(fits, scores, LEAST)
        bar = np.partition(s, s.shape[1] - self.k, 1)[:, s.shape[1] - self.k] if s.shape[1] > self.k else np.full(len(s), LEAST)
        w, r = np.nonzero(fits & (s >= np.maximum(bar, self.score[at, -1])[:, None]))
        if not len(w):
            return
        touched = np.unique(w)
        old = np.repeat(touched, self.k)
        w, s, i = np.concatenate([w, old]), np.concatenate([s[w, r], self.score[at[touched]].ravel()]), np.concatenate([ids[r], self.id[at[touched]].ravel()])
        order = np.lexsort((i, -np.maximum(s, LEAST + 1), w))
        w, s, i = w[order], s[order], i[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        best = place < self.k
        self.score[at[w[best]], place[best]], self.id[at[w[best]], place[best]] = s[best], i[best]


def search(a: Tree, b: Tree, kept: Kept, same: bool) -> None:
    """Let a block of candidates into what a block of anchors keeps: rows of the same label, or rows of others within each window."""
    windows = a.windows.shape[1]
    low, up = intervals(a, b)
    own = kept.score.reshape(len(a.x), windows, kept.k)

    def bars() -> tuple[np.ndarray, np.ndarray]:
        least = np.maximum(a.windows[:, :, 0], own[:, :, -1])
        open_ = a.windows[:, :, 0] <= a.windows[:, :, 1]
        least = np.where(open_, least, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        most = np.where(open_, a.windows[:, :, 1], LEAST).max(1, initial=LEAST)
        return a.raised(least, np.minimum), a.raised(most, np.maximum)

    need, cap = bars()

    def alive(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if same:
            labels = (a.lo[i] <= b.hi[j]) & (b.lo[j] <= a.hi[i])
        else:
            labels = ~((a.lo[i] == a.hi[i]) & (b.lo[j] == b.hi[j]) & (a.lo[i] == b.lo[j]))
        return labels & (up[i, j] >= need[i]) & (low[i, j] <= cap[i])

    i, j = leaf_pairs(a, b, alive)
    order = np.lexsort((-up[i, j], i))
    i, j = i[order], j[order]
    for node in np.unique(i):
        todo, rows = j[i == node], a.leaf(node)
        at = np.arange(rows.start, rows.stop)
        while len(todo):
            now, todo = todo[:LEAVES], todo[LEAVES:]
            cols = np.concatenate([np.arange(s.start, s.stop) for s in map(b.leaf, now)])
            scores = product(a.x[rows], b.x[cols])
            fits = (a.labels[rows, None] == b.labels[cols]) == same
            fits &= a.ids[rows, None] != b.ids[cols]
            for w in range(windows):
                lo, hi = a.windows[rows, w, 0], a.windows[rows, w, 1]
                kept.offer(at * windows + w, scores, fits & (scores >= lo[:, None]) & (scores <= hi[:, None]), b.ids[cols])
            need[node] = np.where(a.windows[rows, :, 0] <= a.windows[rows, :, 1], np.maximum(a.windows[rows, :, 0], own[rows, :, -1]), np.iinfo(np.int64).max).min(initial=np.iinfo(np.int64).max)
            todo = todo[alive(np.full(len(todo), node), todo)]


def _blocks(rows: DataFrame, parts: int, size: tuple[int, int], windows: int) -> DataFrame:
    """Rows (id, label, v, w) dealt into parts by ranges of label and id, then packed into blocks with their trees; in the shared folder."""
    most, leaf = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(part: int, dim: int, x, ids, labels, w) -> pa.RecordBatch:
            t = Tree(x, ids, labels, w, leaf)
            raw, kind = narrow(t.x)
            values = part, dim, len(ids), int(labels.min()), int(labels.max()), t.ids.tobytes(), t.labels.tobytes(), t.windows.tobytes(), kind, raw, t.centres.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in PACKED.split(", ")])

        part = 0
        for batch in batches:
            part = batch.column(4)[0].as_py() if batch.num_rows else part
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            bounds = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, windows, 2)
            for which, x in matrices(batch, 2):
                dim = x.shape[1]
                new = x.astype(np.int64), ids[which], labels[which], bounds[which]
                old = held.get(dim)
                new = tuple(np.concatenate(p) for p in zip(old, new)) if old else new
                while len(new[0]) >= most:
                    yield packed(part, dim, *(v[:most] for v in new))
                    new = tuple(v[most:] for v in new)
                held[dim] = new
        for dim, rest in held.items():
            if len(rest[0]):
                yield packed(part, dim, *rest)

    dealt = rows.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id").withColumn("part", F.spark_partition_id())
    return cut(dealt.mapInArrow(run, PACKED), "trees")


def _tree(table: pa.Table, i: int, windows: int, leaf: int) -> Tree:
    row = {c: table[c][i].as_py() for c in ("dim", "n", "ids", "labels", "windows", "kind", "ints", "centres")}
    numbers = lambda name: np.frombuffer(row[name], np.int64)
    t = Tree(wide(row["ints"], row["kind"], row["dim"], row["n"]), numbers("ids"), numbers("labels"), numbers("windows").reshape(row["n"], windows, 2), leaf, row["centres"])
    t.facts()
    return t


def _searched(candidates: DataFrame, anchors: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, w, id, score): the k best of each cell for each window of each anchor."""
    spans = [(r.part, r.lo, r.hi) for r in anchors.groupBy("part").agg(F.min("label_lo").alias("lo"), F.max("label_hi").alias("hi")).collect()]  # a row for each CELL_ANCHORS anchors
    parts = [r.part for r in candidates.select("part").distinct().collect()]  # a row for each CELL_CANDIDATES candidates

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of each block for each part of the anchors that it may concern."""
        for batch in batches:
            for i in range(batch.num_rows):
                one, lo, hi = batch.slice(i, 1), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                for part, first, last in spans:
                    if (first <= hi and lo <= last) if same else not (first == last == lo == hi):
                        yield pa.RecordBatch.from_arrays([*one.columns, pa.array([part], pa.int32())], names=[*one.schema.names, "h"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(right.num_rows):
            a = _tree(right, i, windows, ANCHORS[1])
            kept = Kept(len(a.x) * windows, k)
            fit = [j for j in range(left.num_rows) if left["dim"][j].as_py() == a.x.shape[1]]
            blocks = [_tree(left, j, 1, CANDIDATES[1]) for j in fit]
            roots = [-intervals(a, b)[1][0, 0] for b in blocks]
            for j in np.argsort(roots, kind="stable"):
                search(a, blocks[j], kept, same)
            row, place = np.nonzero(kept.score > LEAST)
            out.append((a.ids[row // windows], (row % windows).astype(np.int32), kept.id[row, place], kept.score[row, place]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("anchor_id", "w", "id", "score"), map(pa.array, columns))))

    left = candidates.mapInArrow(sent, PACKED + ", h int")
    right = anchors.withColumnRenamed("part", "h").withColumn("part", F.explode(F.array(*(F.lit(p) for p in parts))) if parts else F.lit(0))
    found = left.groupBy("part", "h").cogroup(right.groupBy("part", "h")).applyInArrow(meet, "anchor_id long, w int, id long, score long")
    return cut(found, "found")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``anchors`` against all of ``vectors``.

    Rows with a null id or label, a null vector or a component that is null or not finite take no
    part. Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id.
    An anchor's positives are its first rows of the same label; of each, the negatives are the
    first rows of other labels with low * p <= 100 * score <= high * p. Rows with the anchor's own
    id are neither. Vectors of another length don't meet. Repeated rows of ``vectors`` count each;
    of anchors with one id the least (label, vector) asks. Labels are integers; products must fit
    64 bits. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & finite(vec_col)
    part = lambda df: df.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), scaled(vec_col, scale).alias("v"))
    asked = cut(part(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"), "asked")
    rows, n_asked = vectors.count(), asked.count()
    cells = max(1, -(-rows // CELL_CANDIDATES), min(n, -(-rows // CANDIDATES[0])))
    blocks = _blocks(part(vectors).withColumn("w", F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))), cells, CANDIDATES, 1)
    h = max(1, -(-n_asked // CELL_ANCHORS))
    all_scores = F.array(F.lit(LEAST + 1), F.lit(np.iinfo(np.int64).max - 1).cast("long"))
    first = _blocks(asked.withColumn("w", all_scores), h, ANCHORS, 1)
    best = _searched(blocks, first, 1, positives, True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    chosen = cut(best.withColumn("w", (F.row_number().over(order) - 1).cast("int")).where(F.col("w") < positives).select("anchor_id", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    least, most = -_floor_div(-low * p, 100), _floor_div(high * p, 100)
    listed = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("w", least.alias("least"), most.alias("most")))).alias("at"))  # at most ``positives``
    closed = F.array(*(F.lit(x).cast("long") for x in (1, 0)))
    spans = reduce(lambda x, y: F.concat(x, y), (F.when(F.size("at") > i, F.array(F.col("at")[i]["least"], F.col("at")[i]["most"])).otherwise(closed) for i in range(positives)))
    again = _blocks(asked.join(listed, asked["id"] == listed["anchor_id"]).select("id", "label", "v", spans.alias("w")), h, ANCHORS, positives)
    found = _searched(blocks, again, positives, negatives, False)
    drop(blocks, first, again, asked)
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_div(x: Column, by: int) -> Column:
    """Floor of an integer quotient, by integers alone."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""

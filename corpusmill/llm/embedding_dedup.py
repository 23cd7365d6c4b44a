"""Embedding near-dedup: navigable small-world graphs per shard, queried by every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, dealt, drop

#: Links of a vertex on upper levels and on the ground, and the beam while building.
LINKS, GROUND, BUILD_BEAM = 12, 24, 48
#: Further places on the ground for links to vertices that no path reached.
SPARE = 4
#: Vectors that a task asks one graph about, in shards; and how many it asks about at once.
QUERIES, ASKED = 8, 1024
#: Vertices of at most so many links are audited apart.
FEW = 8


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; vertices are added, and queries answered, many at a time."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x = x.astype(np.float32)
        self.links, self.entry = links or [], entry

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        g = cls(x)
        n = len(x)
        level = np.minimum(-np.log(1 - np.random.default_rng(1).random(n)) / np.log(LINKS), 5).astype(int)
        order = np.argsort(-level, kind="stable")
        rank = np.random.default_rng(2).permutation(n)
        order = np.concatenate([order[:1], rank[rank != order[0]]]) if n else order
        g.links = [np.full((n, GROUND + SPARE if k == 0 else LINKS), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        g.entry = int(order[0]) if n else 0
        done = 1
        while done < n:
            batch = order[done : done + min(512, done)]
            done += len(batch)
            at = np.full(len(batch), g.entry)
            for k in range(len(g.links) - 1, -1, -1):
                new = level[batch] >= k
                beam, sims = g._beam(g.x[batch], at, k, BUILD_BEAM if new.any() else 1)
                at = beam[:, 0]
                own = batch[new]
                if len(own):
                    each = g.x[own] @ g.x[own].T
                    np.fill_diagonal(each, -2)
                    near = np.argsort(-each, axis=1)[:, :16]
                    cand = np.concatenate([beam[new], own[near]], axis=1)
                    sims = np.concatenate([sims[new], np.take_along_axis(each, near, 1)], axis=1)
                    cand = np.where(sims > -2, cand, -1)
                    g.links[k][own, :LINKS] = g._select(cand, sims, LINKS)
                    g._link_back(own, k)
        g._reach_all()
        return g

    def _reach_all(self) -> None:
        """Link what can't be reached from the entry on the ground to its nearest vertex that can, until nothing is lost; places are added when all are full."""
        while len(self.x):
            ground = self.links[0]
            reached = np.zeros(len(self.x), bool)
            front = np.array([self.entry])
            while len(front):
                reached[front] = True
                front = np.unique(ground[front])
                front = front[(front >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)[:256]
            if not len(lost):
                return
            near, _ = self._beam(self.x[lost], np.full(len(lost), self.entry), 0, 8)
            linked = False
            for v, to in zip(lost.tolist(), near.tolist()):
                for u in to:
                    free = np.flatnonzero(ground[u, GROUND:] < 0) if u >= 0 else ()
                    if len(free):
                        ground[u, GROUND + free[0]] = v
                        linked = True
                        break
            if not linked:
                self.links[0] = np.concatenate([ground, np.full((len(ground), SPARE), -1, np.int32)], axis=1)

    def _select(self, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row's candidates: nearest first, those nearer to a chosen one only to fill up."""
        order = np.argsort(-sims, axis=1)
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        rows = np.arange(len(cand))
        kept, count = np.full((len(cand), m), -1, np.int32), np.zeros(len(cand), int)
        used = cand < 0
        for fill in (False, True):
            for j in range(cand.shape[1]):
                c = cand[:, j]
                go = np.flatnonzero(~used[:, j] & (count < m))
                if not len(go):
                    continue
                if fill:
                    ok = ~(kept[go] == c[go, None]).any(1)
                else:
                    chosen = kept[go]
                    s = np.einsum("td,tmd->tm", self.x[c[go]], self.x[chosen])
                    ok = np.where(chosen >= 0, s, -2).max(1) < sims[go, j]
                go = go[ok]
                kept[rows[go], count[go]] = c[go]
                count[go] += 1
                used[go, j] = True
        return kept

    def _link_back(self, own: np.ndarray, k: int) -> None:
        links = self.links[k]
        to, source = links[own].ravel(), np.repeat(own, links.shape[1])
        source, to = source[to >= 0], to[to >= 0]
        sims = np.einsum("td,td->t", self.x[source], self.x[to])
        order = np.lexsort((-sims, to))
        source, to = source[order], to[order]
        target, first = np.unique(to, return_index=True)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        few = place < 32
        extra = np.full((len(target), int(min(32, place.max(initial=0) + 1))), -1, np.int32)
        extra[np.searchsorted(target, to[few]), place[few]] = source[few]
        cand = np.concatenate([links[target], extra], axis=1)
        sims = np.where(cand >= 0, np.einsum("td,tcd->tc", self.x[target], self.x[cand]), -2)
        sims[cand == target[:, None]] = -2
        width = GROUND if k == 0 else LINKS
        links[target, :width] = self._select(np.where(sims > -2, cand, -1), sims, width)

    def _beam(self, q: np.ndarray, at: np.ndarray, k: int, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beams of vertices nearest to each query on a level, best first (-1 and -2 where none). ``own``: a query's own vertex, to start from as well, or -1."""
        links, rows = self.links[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        ids, sims = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -2, np.float32)
        ids[:, 0], sims[:, 0] = at, np.einsum("bd,bd->b", q, self.x[at])
        seen[rows[:, 0], at] = True
        open_ = np.zeros((len(q), width), bool)
        open_[:, 0] = True
        if own is not None and width > 1:
            here = np.flatnonzero((own >= 0) & (own != at))
            ids[here, 1], sims[here, 1], open_[here, 1], seen[here, own[here]] = own[here], 1, True, True
        step = max(1, min(4, width // 8))
        live = np.arange(len(q))
        while len(live):
            r = live[:, None]
            score = np.where(open_[live], sims[live], -3)
            pick = np.argpartition(-score, step - 1, axis=1)[:, :step] if width > step else np.argsort(-score, axis=1)[:, :step]
            good = np.take_along_axis(score, pick, 1) > -3
            open_[r, pick] = False
            new = links[np.where(good, ids[r, pick], 0)]
            new = np.where(good[:, :, None], new, -1).reshape(len(live), -1)
            new = np.where(seen[r, new] | (new < 0), -1, new)
            seen[r, new] = True
            seen[live, -1] = False
            s = np.sort(new, axis=1)
            if (s[:, 1:] == s[:, :-1]).any():  # a vertex reached twice in one step counts once
                order = np.argsort(new, axis=1, kind="stable")
                s = np.take_along_axis(new, order, 1)
                s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
                new = s
            got = np.where(new >= 0, np.einsum("bd,bcd->bc", q[live], self.x[new]), -2).astype(np.float32)
            ids2, sims2 = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], got], 1)
            open2 = np.concatenate([open_[live], new >= 0], 1)
            top = np.argpartition(-sims2, width - 1, axis=1)[:, :width]
            ids[live], sims[live] = np.take_along_axis(ids2, top, 1), np.take_along_axis(sims2, top, 1)
            open_[live] = np.take_along_axis(open2, top, 1) & (sims[live] > -2)
            live = live[open_[live].any(1)]
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, width: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vertex) pairs of at least a similarity; beams that are full of such vertices are widened, and one as wide as the graph compares with all vertices."""
        q = q.astype(np.float32)
        todo, found = np.arange(len(q)), []
        while len(todo):
            if width >= len(self.x):
                for a in range(0, len(todo), 256):
                    b, c = np.nonzero(q[todo[a : a + 256]] @ self.x.T >= least)
                    found.append((todo[a + b], c))
                break
            again = []
            for a in range(0, len(todo), 256):
                part = todo[a : a + 256]
                at = np.full(len(part), self.entry)
                for k in range(len(self.links) - 1, 0, -1):
                    at = self._beam(q[part], at, k, 1)[0][:, 0]
                ids, sims = self._beam(q[part], at, 0, width, own[part])
                full = sims[:, -1] >= least
                again.append(part[full])
                b, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                found.append((part[b], ids[b, c]))
            todo, width = np.concatenate(again), width * 2
        return np.concatenate([f[0] for f in found] or [np.zeros(0, int)]), np.concatenate([f[1] for f in found] or [np.zeros(0, int)])


def joined(i: np.ndarray, j: np.ndarray, names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect queries names[i] and vertices ids[j] as the pairs (i, j) do: each end that occurs, and the first vertex of its component."""
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label, of_query = np.arange(len(ids)), np.zeros(len(names), np.int64)
    while True:
        before = label[j]
        of_query[:] = len(ids)
        np.minimum.at(of_query, i, before)
        np.minimum.at(label, j, of_query[i])
        np.minimum.at(label, before, of_query[i])
        label = label[label]
        if (label[j] == before).all():
            break
    q, v = np.unique(i), np.unique(j)
    a, b = np.concatenate([names[q], ids[v]]), ids[np.concatenate([label[of_query[q]], label[v]])]
    return a[a != b], b[a != b]


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the directions, in double precision, of vectors that aren't null or zero and hold finite numbers alone."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  f of a value that is computed once
    scaled = once(F.struct(v.alias("v"), F.array_max(F.transform(v, F.abs)).alias("most")), lambda s: F.when(s["most"] > 0, F.transform(s["v"], lambda x: x / s["most"])))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), scaled.alias("v")).where("v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", once(F.struct("v", norm.alias("norm")), lambda s: F.transform(s["v"], lambda x: x / s["norm"] + 0.0)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) if n else np.zeros((0, 0))


def _planted(wanted: list[tuple[int, list[float]]], least: float, below: int) -> list[tuple[int, list[float]]]:
    """For each unit vector a query turned from it, by chance, to just over a similarity, under ids below all others."""
    rng, out = np.random.default_rng(3), []
    share = least + 0.02 * (1 - least)
    for k, (_, v) in enumerate(wanted):
        x = np.array(v)
        turn = rng.normal(size=len(x))
        turn -= (turn @ x) * x
        size = np.linalg.norm(turn)
        q = share * x + np.sqrt(1 - share * share) * turn / size if len(x) > 1 and size > 1e-9 else x
        out.append((below - 1 - k, q.tolist()))
    return out


def near_vectors(vectors: DataFrame, least: float = 0.95, shard_rows: int = 200_000, recall: float = 0.99, first_beam: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of every row, by cosine of at least ``least`` in double precision.

    Equal directions are one vertex with a count. Vertices go to shards by hash, at least 8 of
    them and as many as keep a shard near ``shard_rows``; a graph is built for each shard and
    written to the shared folder; every vertex then queries every shard. The beam is doubled until
    an audit of at most about 2048 vertices, compared with all vertices by brute force, finds
    the share ``recall`` of each vertex's links on average, over vertices of few links and of many
    apart, and over queries planted at about the similarity ``least`` from audited vertices, so that
    large groups hide nothing and tables with rare links are audited too; a beam as wide as a
    graph compares with all its vertices. Beams that fill up with links widen on their own. Found
    pairs are verified in double precision. A vertex counts what its own queries find; of the pairs
    themselves a task gives only so many that components are the same, so large groups cost no
    more than their vectors. A graph is sent to one task for each ``QUERIES`` * ``shard_rows`` vectors that ask it.

    Vectors that are null or zero or hold null or non-finite components link with nothing; vectors
    of another length than the one in question link with each other alone. Rows with a null
    id link with nothing; repeated rows count as links of each other; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    units = unit_vectors(vectors, id_col, vec_col)
    classes = cut(units.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "directions")
    n = classes.count()
    shards = max(8, -(-n // shard_rows))
    parts = max(1, -(-n // (QUERIES * shard_rows)))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        x = _matrix(table["v"])[order]
        g = Graph.build(x)
        return pa.table({"shard": table["shard"][:1], "dim": table["dim"][:1], "copies": pa.array([table["copies"].to_numpy()[order].tolist()], pa.list_(pa.int64())), "ids": pa.array([table["id"].to_numpy()[order].tolist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary()), "links": pa.array([[a.tobytes() for a in g.links]], pa.list_(pa.binary())), "entry": pa.array([g.entry], pa.int32())})

    kind = "shard int, dim int, copies array<long>, ids array<long>, x binary, links array<binary>, entry int"
    graphs = cut(classes.select(shard.alias("shard"), "dim", "id", "copies", "v").groupBy("shard", "dim").applyInArrow(build, kind), "graphs")

    def search(queries: DataFrame, beam: int, parts: int) -> DataFrame:
        """Rows (id, other, found, weight): how many vertices a query found in a shard, and with their copies; or, with other, that both are in one component."""
        asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("id").alias("q"), "v")
        each = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
        rows = dealt(each.unionByName(asked, allowMissingColumns=True), "shard", "dim", "part").sortWithinPartitions("shard", "dim", "part", "kind", "q")
        rows = rows.select("shard", "dim", "part", "kind", "q", "v", "ids", "x", "links", "entry", "copies")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, key, ids, x, copies = None, None, None, None, None
            for batch in batches:
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                kinds = batch.column(3).to_numpy()
                bounds = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or kinds[k] != kinds[k - 1]), len(keys)]
                for start, end in zip(bounds, bounds[1:]):
                    part = batch.slice(start, end - start)
                    if kinds[start] == 0:
                        of = {c: part.column(part.schema.get_field_index(c))[0] for c in ("ids", "x", "links", "entry", "copies")}
                        key, ids, copies = keys[start], of["ids"].values.to_numpy(), of["copies"].values.to_numpy()
                        x = np.frombuffer(of["x"].as_py()).reshape(len(ids), -1)
                        g = Graph(x, [np.frombuffer(r, np.int32).reshape(len(ids), -1) for r in of["links"].as_py()], of["entry"].as_py())
                        continue
                    if keys[start] != key:  # no vertex of this length is in the shard
                        continue
                    for a in range(0, part.num_rows, ASKED):
                        some = part.slice(a, ASKED)
                        names, q = some.column(some.schema.get_field_index("q")).to_numpy(), _matrix(some.column(some.schema.get_field_index("v")))
                        own = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
                        i, j = g.within(q, least - 1e-5, beam, np.where(ids[own] == names, own, -1))
                        ok = np.zeros(len(i), bool)
                        for at in range(0, len(i), 1 << 17):
                            s = slice(at, at + (1 << 17))
                            ok[s] = (names[i[s]] != ids[j[s]]) & (np.einsum("td,td->t", q[i[s]], x[j[s]]) >= least)
                        i, j = i[ok], j[ok]
                        found, weight = np.bincount(i, minlength=len(names)), np.bincount(i, copies[j], len(names)).astype(np.int64)
                        hit = np.flatnonzero(found)
                        left, right = joined(i, j, names, ids)
                        none, zero = np.zeros(len(hit), np.int64), np.zeros(len(left), np.int64)
                        columns = [np.concatenate([names[hit], left]), np.concatenate([none, right]), np.concatenate([found[hit], zero]), np.concatenate([weight[hit], zero])]
                        arrays = [pa.array(c.astype(np.int64), mask=np.arange(len(c)) < len(hit) if k == 1 else None) for k, c in enumerate(columns)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["id", "other", "found", "weight"])

        return rows.mapInArrow(run, "id long, other long, found long, weight long")

    share = min(1.0, 2048 / max(n, 1))
    audit = cut(classes.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))), "audit")
    wanted = [(r.id, list(r.v)) for r in audit.select("id", "v").collect()]  # at most about 2048
    planted = _planted(wanted, least, classes.agg(F.least(F.min("id"), F.lit(0))).first()[0])
    audit = audit.select("id", "v", "dim").unionByName(spark.createDataFrame([(i, v, len(v)) for i, v in planted], "id long, v array<double>, dim int"))
    named = [i for i, _ in wanted]
    wanted += planted
    sample = spark.sparkContext.broadcast({d: (np.array([i for i, v in wanted if len(v) == d]), np.array([v for _, v in wanted if len(v) == d])) for d in {len(v) for _, v in wanted}})

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                names, x = own.column(0).to_numpy(), _matrix(own.column(1))
                ids, q = sample.value.get(int(d), (np.zeros(0, np.int64), np.zeros((0, d))))
                i, j = np.nonzero(q @ x.T >= least) if len(ids) else (np.zeros(0, int), np.zeros(0, int))
                links = np.bincount(i[ids[i] != names[j]], minlength=len(ids))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit].astype(np.int64)), pa.array(links[hit])], names=["id", "links"])

    truth = cut(classes.select("id", "v").mapInArrow(brute, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")), "audit_links")
    ids = spark.createDataFrame([(i, False) for i in named] + [(i, True) for i, _ in planted], "id long, planted boolean")
    beam = first_beam
    while beam < n:
        hits = search(audit, beam, 1).where("other IS NULL").groupBy("id").agg(F.sum("found").alias("hits"))
        shares = truth.join(F.broadcast(ids), "id").join(hits, "id", "left")
        shares = shares.groupBy("planted", (F.col("links") <= FEW).alias("few")).agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("links")).alias("found"))
        if all(r.found >= recall for r in shares.collect()):  # four at most
            break
        beam *= 2
    found = cut(search(classes, beam, parts), "found")
    others = found.where("other IS NULL").groupBy(F.col("id").alias("a")).agg(F.sum("weight").alias("others"))
    links = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    comps = components(links)
    named = classes.join(others, classes["id"] == others["a"], "left").join(comps.withColumnRenamed("id", "c"), classes["id"] == F.col("c"), "left")
    drop(graphs, audit, truth)
    named = named.select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", classes["id"]).alias("component_id"))
    linked = units.join(named, "v").select("id", "n_links", "component_id")
    good = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(id_col).join(good.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left")
    return rows.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id"""

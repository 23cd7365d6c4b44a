"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

Shingles have one global order: rare ones first. How often each occurs is counted over all
documents in a table of fixed size (tasks sum their counts by slot, the slots' sums are small
enough to send to every task), so the order costs one reading and no shuffle of shingles. Sets
of n shingles that are similar to another share one of their first n - ceil(t n) + 1 shingles
with it, and these are rare: passages that many documents share stand last and bring nothing
together. Sets with such a shingle in common are a group. In a group, size bounds and parity
sketches tell most sets apart; what they leave is a family, and each family is joined by one trie
of its sets in the global order: a probe walks down the trie, shares the overlap counted so far
among all sets below, and leaves a subtree when what remains of the probe and of the subtree
can't reach the overlap needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, chosen_rows, components, cut, dealt, drop, row_key
from .textscan import LOWER, U, mix, pieces, ragged, word_hashes

#: Slots of the table of counts, 8 bytes each on their way to the driver and 1 byte each when sent to the tasks; slots of one of its blocks.
SLOTS, BLOCK = 1 << 22, 1 << 16
#: Sets of a group whose sketches one task holds.
HELD = 4096
#: Rows of keys (16 bytes each) that are sent to all tasks at most.
SENT_ROWS = 1_000_000
#: Bits of a sketch for each difference allowed: of the one that groups are compared by, and of the one that large families are.
COARSE, FINE = 3, 12


def shingle_sets(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, each text's in ascending order, and where each text's begin."""
    h, first = word_hashes(buf, at, LOWER)
    docs = len(at) - 1
    n = np.diff(first)
    shingles = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(docs), shingles)
    begin = ragged(first[:-1], shingles)
    key = np.zeros(len(owner), U)
    whole = n[owner] >= width
    for k in range(width):
        ok = whole | (k < n[owner])
        key[ok] = mix(key[ok] * U(0x9E3779B97F4A7C15) + h[begin[ok] + k] + U(1))
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(docs + 1))


def _sums(slot: np.ndarray, value: np.ndarray, slots: int) -> np.ndarray:
    """Sums of 64-bit numbers by slot, modulo 2**64."""
    low = np.bincount(slot, (value & U(0xFFFFFFFF)).astype(float), slots).astype(U)
    high = np.bincount(slot, (value >> U(32)).astype(float), slots).astype(U)
    return low + (high << U(32))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key & U(SLOTS - 1)).astype(np.int64)


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each slot occur in all rows' sets. Tasks send blocks of sums; these are summed in two steps, so no task reads more than some of them, and the driver gets one row a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, buf, at in pieces(batch, "text"):
                np.add.at(total, _slot(shingle_sets(buf, at, width)[0]), 1)
        blocks = [b for b in range(SLOTS // BLOCK) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        sums = [pa.compress(total[b * BLOCK : (b + 1) * BLOCK].tobytes(), "zstd", asbytes=True) for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([TaskContext.get().partitionId() % 32] * len(blocks), pa.int32()), pa.array(sums, pa.binary())], names=["block", "salt", "sums"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "salt", "sums"])
        for batch in batches:
            for *now, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        yield row()
                    key, total = now, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(pa.decompress(sums, 8 * BLOCK, "zstd", asbytes=True), np.int64)
        if key is not None:
            yield row()

    kind = "block int, salt int, sums binary"
    sums = texts.mapInArrow(count, kind)
    for _ in range(2):
        sums = sums.repartition("block", "salt").sortWithinPartitions("block", "salt").mapInArrow(fold, kind)
    out = np.zeros(SLOTS, np.int64)
    for r in sums.collect():  # one for each block
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(pa.decompress(r.sums, 8 * BLOCK, "zstd", asbytes=True), np.int64)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """A byte for each slot, larger for more frequent shingles: eight steps for each doubling of what a slot has beyond the mean, in units of the chance spread."""
    mean = counts.mean()
    return np.minimum(255, np.round(8 * np.log2(1 + np.maximum(0, counts - mean) / max(1.0, np.sqrt(mean))))).astype(np.uint8)


def in_order(key: np.ndarray, at: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Each set's shingles as numbers that ascend in the global order: the rarity of the slot, then the hash."""
    rank = (rare[_slot(key)].astype(U) << U(56)) | (key >> U(8))
    return rank[np.lexsort((rank, np.repeat(np.arange(len(at) - 1), np.diff(at))))]


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first shingles a set of n has one of in common with any similar set."""
    return np.where(n > 0, n - (-(-n * percent // 100)) + 1, 0)


def sketches(key: np.ndarray, at: np.ndarray, percent: int, each: int) -> list[bytes]:
    """Parity sketches: each shingle flips one bit of a power of two of bits, at least ``each`` for each difference allowed (64 at least)."""
    n = np.diff(at)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * each * n * (100 - percent) / (100 + percent), 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    slot = np.repeat(base, n) + (mix(key ^ U(0x2545F4914F6CDD1D)) & np.repeat(bits - 1, n).astype(U)).astype(np.int64)
    odd = (np.bincount(slot, minlength=int(bits.sum())) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[a // 8 : (a + b) // 8] for a, b in zip(base.tolist(), bits.tolist())]


def possible_pairs(n: np.ndarray, sketch: list[bytes], percent: int, since: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (i, j) of sets that may be similar: neither their sizes nor their sketches tell them apart. With ``since``, one of each pair is before it and one isn't.

    Of similar sets, the longer sketch has at most the lengths' ratio 100 / percent, rounded up to a
    power of two; it is folded: bits that meet are added modulo 2.
    """
    length = np.array([len(s) for s in sketch])
    for size in np.unique(length):
        own, parts, longer = np.flatnonzero(length == size), [], size
        while longer * percent < size * 200:
            of = np.flatnonzero(length == longer)
            x = np.frombuffer(b"".join(sketch[k] for k in of), np.uint8).reshape(len(of), -1, size) if len(of) else np.zeros((0, 1, size), np.uint8)
            parts.append((of, np.bitwise_xor.reduce(x, axis=1)))
            longer *= 2
        both, x = np.concatenate([of for of, _ in parts]), np.ascontiguousarray(np.concatenate([x for _, x in parts])).view(U)
        late, all_of = both >= since, np.arange(len(both))
        sides = [(np.flatnonzero(late[: len(own)] == late_left), np.flatnonzero(late != late_left)) for late_left in (False, True)] if since else [(all_of[: len(own)], all_of)]
        for left, right in sides:
            step = max(1, (1 << 18) // max(1, len(right) * x.shape[1]))
            for a in range(0, len(left) if len(right) else 0, step):
                part = left[a : a + step]
                far = np.bitwise_count(x[part, None, :] ^ x[None, right, :]).sum(2, dtype=np.int64)
                na, nb = n[both[part]][:, None], n[both[right]][None]
                i, j = np.nonzero(np.maximum(far, np.abs(na - nb)) * (100 + percent) <= (na + nb) * (100 - percent))
                i, j = both[part[i]], both[right[j]]
                yield i[i != j], j[i != j]


def possible_links(n: np.ndarray, sketch: list[bytes], percent: int, label: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that connect all sets of a group which may be similar, and the sets' labels after them. ``label``: of the first sets, that are connected among themselves already where they can be."""
    since = 0 if label is None else len(label)
    label = np.concatenate([np.zeros(0, np.int64) if label is None else label, np.arange(since, len(n))])
    edges: list[tuple[int, int]] = []
    for i, j in possible_pairs(n, sketch, percent, since):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        # What is connected already leaves; then all of one set's new neighbours come in at once.
        while len(new := np.flatnonzero(label[i] != label[j])):
            i, j = i[new], j[new]
            p = int(i[0])
            labels, first = np.unique(label[j[: np.searchsorted(i, p, "right")]], return_index=True)
            edges.extend((p, int(j[k])) for k in first)
            label[np.isin(label, labels)] = label[p]
    return edges, label


class Trie:
    """Sets as paths of ascending hashes; a stretch without a branch is one array."""

    __slots__ = ("run", "below", "ends", "least", "rest")

    def __init__(self, run: np.ndarray, least: int, rest: int):
        self.run, self.below, self.ends = run, {}, []
        #: The smallest set at or below this node, and the most hashes that a set has from here on.
        self.least, self.rest = least, rest

    def insert(self, x: np.ndarray, name: int) -> None:
        node, at, n = self, 0, len(x)
        while True:
            m = min(len(node.run), n - at)
            differ = np.flatnonzero(node.run[:m] != x[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(node.run):
                child = Trie(node.run[same:], node.least, node.rest - same)
                child.below, child.ends = node.below, node.ends
                node.below, node.ends, node.run = {int(node.run[same]): child}, [], node.run[:same]
            node.least, node.rest = min(node.least, n), max(node.rest, n - at)
            at += same
            if at == n:
                node.ends.append(name)
                return
            if int(x[at]) not in node.below:
                leaf = node.below[int(x[at])] = Trie(x[at:], n, n - at)
                leaf.ends.append(name)
                return
            node = node.below[int(x[at])]

    def probe(self, x: np.ndarray, percent: int, known) -> Iterator[tuple[int, int]]:
        """(name, shared hashes) of the sets that may be similar to x; ``known(name)`` says whether a set needs no answer."""
        n = len(x)
        stack = [(self, 0, 0)]
        while stack:
            node, at, shared = stack.pop()
            need = -(-percent * (n + node.least) // (100 + percent))  # of the smallest set below
            rest, alive = node.rest, True
            if not node.below and all(map(known, node.ends)):
                continue
            for k in range(0, len(node.run), 64):
                if shared + min(n - at, rest) < need:
                    alive = False
                    break
                part = node.run[k : k + 64]
                where = np.searchsorted(x[at:], part)
                found = where < n - at
                shared += int((x[at:][where[found]] == part[found]).sum())
                at += int(np.searchsorted(x[at:], part[-1], "right"))
                rest -= len(part)
            if not alive or shared + min(n - at, rest) < need:
                continue
            yield from ((name, shared) for name in node.ends if not known(name))
            stack.extend((child, at, shared) for child in node.below.values())


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _links(groups: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """Links (a, b) between components, found group by group; with ``whole``, where no component is in two groups, each component and the least one that it is linked to.

    Takes rows (g, salt, kind, key, comp, shingles): of a group, rows of kind 0 enter the trie (each
    after probing it), rows of kind 1 only probe it. Once two components are linked in a group,
    their sets aren't compared again. Memory holds a trie and one batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trie, sizes, comps, parent, last = None, None, [], [], {}, None

        def find(c):
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        def roots() -> list[tuple[int, int]]:
            return [(c, find(c)) for c in dict.fromkeys(comps) if find(c) != c] if whole else []

        for batch in batches:
            links = []
            for g, salt, kind, key, comp, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, salt) != group:
                    links += roots()
                    group, trie, sizes, comps, parent, last = (g, salt), Trie(np.zeros(0, U), 1 << 60, 0), [], [], {}, None
                if key == last:  # another row of the same document
                    continue
                last = key
                x = np.frombuffer(raw, "<u8")
                own = find(comp)
                for name, shared in trie.probe(x, percent, lambda name: find(comps[name]) == own):  # noqa: B023
                    other = find(comps[name])
                    if other != own and 100 * shared >= percent * (len(x) + sizes[name] - shared):
                        if not whole:
                            links.append((comp, comps[name]))
                        parent[max(own, other)] = min(own, other)
                        own = find(comp)
                if kind == 0:
                    trie.insert(x, len(sizes))
                    sizes.append(len(x))
                    comps.append(comp)
            yield _pairs(links)
        yield _pairs(roots())

    rows = dealt(groups, "g", "salt").sortWithinPartitions("g", "salt", "kind", "key").select("g", "salt", "kind", "key", "comp", "shingles")
    with arrow_batches(groups.sparkSession, 256):
        return cut(rows.mapInArrow(run, "a long, b long"), "links")


def _few_ties(batch: pa.RecordBatch, first: np.ndarray, last: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The same for groups of at most four rows from first to last: all pairs that aren't told apart, each once."""
    key, n, column = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, size = np.frombuffer(column.buffers()[2], np.uint8), np.diff(at)
    pairs = [(first[last - first > j] + i, first[last - first > j] + j) for j in range(1, 4) for i in range(j)]
    i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    edges = []
    for short, long_ in {*zip(size[i].tolist(), size[j].tolist())}:
        if long_ * percent >= short * 200:
            continue
        own = np.flatnonzero((size[i] == short) & (size[j] == long_))
        for a in range(0, len(own), max(1, (1 << 20) // long_)):
            p, q = i[own[a : a + max(1, (1 << 20) // long_)]], j[own[a : a + max(1, (1 << 20) // long_)]]
            x = data[at[p][:, None] + np.arange(short)]
            y = np.bitwise_xor.reduce(data[at[q][:, None] + np.arange(long_)].reshape(len(q), -1, short), axis=1)
            far = np.maximum(np.bitwise_count((x ^ y).view(U)).sum(1, dtype=np.int64), np.abs(n[p] - n[q]))
            near = far * (100 + percent) <= (n[p] + n[q]) * (100 - percent)
            edges.append(np.sort(np.stack([key[p[near]], key[q[near]]], 1), axis=1))
    if edges:
        ends = np.unique(np.concatenate(edges), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"])


def _ties(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the sets of each (g, salt) which sizes and sketches don't tell apart.

    Takes rows (g, salt, kind, key, n, sketch): rows of kind 0 are held and compared with each other
    and with the rows of kind 1, which pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, passing, label = None, [], [], None

        def compare() -> list[tuple[int, int]]:
            nonlocal passing, label
            if label is None and len(held) + len(passing) > 1:
                edges, label = possible_links(np.array([x[1] for x in held]), [x[2] for x in held], percent)
                edges = [(held[i][0], held[j][0]) for i, j in edges]
            else:
                edges = []
            if passing and held:
                rows = held + passing
                more, label = possible_links(np.array([x[1] for x in rows]), [x[2] for x in rows], percent, label)
                edges += [(rows[i][0], rows[j][0]) for i, j in more]
                label = label[: len(held)]
            passing = []
            return edges

        for batch in batches:
            found = []
            g, salt, kind, key = (batch.column(i).to_numpy() for i in range(4))
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])]))
            last = np.append(first[1:], len(g))
            # Most groups are of a few sets and lie in one batch: they are compared all at once.
            few = (last - first <= 4) & (np.maximum.reduceat(kind, first) == 0)
            few[[0, -1]] = False
            yield from _few_ties(batch, first[few], last[few], percent)
            rows = np.zeros(len(g) + 1, int)
            np.add.at(rows, first[few], 1)
            np.add.at(rows, last[few], -1)
            batch = batch.take(pa.array(np.flatnonzero(np.cumsum(rows)[:-1] == 0)))
            for g, salt, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, salt) != group:
                    found += compare()
                    group, held, label = (g, salt), [], None
                (passing if kind else held).append(row)
            if passing:
                found += compare()
            yield _pairs(found)
        yield _pairs(compare())

    return dealt(groups, "g", "salt").sortWithinPartitions("g", "salt", "kind", "key").select("g", "salt", "kind", "key", "n", "sketch").mapInArrow(run, "a long, b long")


def _salt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("key"), parts)


def _families(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, family) of the sets that may be similar to another: components under what sketches leave.

    Groups of more than HELD sets are dealt out by salt, the group's least set going to all parts.
    What isn't in one family then (all but the largest family of such a group) is held part by
    part while the whole group passes by.
    """
    known = classes.select("key", "n", "sketch")
    parts = F.ceil(F.col("size") / HELD)
    one = members.withColumn("salt", _salt(parts)).select("g", "salt", "key")
    hot = members.where(F.col("size") > HELD)
    some = not hot.isEmpty()
    if some:
        led = hot.groupBy("g").agg(F.min("key").alias("key"), F.max("size").alias("size")).withColumn("own", _salt(parts))
        led = led.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).where("salt <> own")
        one = one.unionByName(led.select("g", "salt", "key"))
    ties = cut(_ties(one.join(known, "key").withColumn("kind", F.lit(0)), percent), "ties")
    comps = components(ties)
    if some:
        now = hot.join(comps, F.col("key") == F.col("id"), "left").select("g", "key", F.coalesce("component", "key").alias("comp"))
        each = cut(_across(now, HELD).join(known, "key"), "across")
        ties = cut(ties.unionByName(_ties(each, percent)), "ties")
        comps = components(ties)
    drop(ties)
    return comps.select(F.col("id").alias("key"), F.col("component").alias("family")).unionByName(comps.select(F.col("component").alias("key"), F.col("component").alias("family")).distinct())


def _across(now: DataFrame, at_once: int) -> DataFrame:
    """(g, salt, kind, key, comp): groups (g, key, comp) that hold several components. All but the largest component are dealt out by salt, as rows of kind 0; the rest of the group comes to each part as rows of kind 1."""
    by_comp = now.groupBy("g", "comp").agg(F.count("*").alias("k"))
    split = by_comp.groupBy("g").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), (F.sum("k") - F.max("k")).alias("others"), F.count("*").alias("comps")).where("comps > 1")
    parts = F.ceil(F.col("others") / at_once)
    each = now.join(split, "g").withColumn("parts", parts).withColumn("own", F.when(F.col("comp") != F.col("main"), _salt(parts)))
    # Others meet each other once: one of a later part passes by the earlier ones.
    each = each.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("own", F.col("parts") - 1))))
    return each.select("g", "salt", F.when(F.col("own") == F.col("salt"), 0).otherwise(1).alias("kind"), "key", "comp")


def _crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (g, salt, kind, key, comp, n, sketch), those that may be similar to a row of another component beside them, without n and sketch."""
    names = ["g", "salt", "kind", "key", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, passing, wanted = None, [], [], set()

        def compare() -> list[list]:
            rows, since = held + passing, len(held) if passing else 0
            n, comp, hit = np.array([x[5] for x in rows]), np.array([x[4] for x in rows]), np.zeros(len(rows), bool)
            for i, j in possible_pairs(n, [x[6] for x in rows], percent, since) if len(held) and len(rows) > 1 else ():
                apart = comp[i] != comp[j]
                hit[i[apart]] = hit[j[apart]] = True
            wanted.update(np.flatnonzero(hit[: len(held)]).tolist())
            out = [rows[k] for k in np.flatnonzero(hit[len(held) :]) + len(held)]
            passing.clear()
            return out

        def held_ones() -> list[list]:
            if len(held) > 1:
                compare()
            return [held[k] for k in sorted(wanted)]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != group:
                    found += compare() if passing else []
                    found += held_ones()
                    group, held, wanted = row[:2], [], set()
                (passing if row[2] else held).append(row)
            found += compare() if passing else []
            yield batch_of(found)
        yield batch_of(held_ones())

    rows = dealt(rows, "g", "salt").sortWithinPartitions("g", "salt", "kind", "key").select(*names, "n", "sketch")
    return rows.mapInArrow(run, "g long, salt long, kind int, key long, comp long")


def classified(docs: DataFrame, row: Column, percent: int, width: int, at_once: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, comp, component_id) of each row: its key, its number of shingles, a number of its component (null without shingles) and the least id in it. Takes what similar_documents takes."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    digest_of = ["d1", "d2"]
    own = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    rare = spark.sparkContext.broadcast(rarity(shingle_counts(own.select("text"), width)))  # SLOTS bytes

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, "text"):
                key, begin = shingle_sets(buf, at, width)
                n = np.diff(begin)
                owner = np.repeat(np.arange(len(n)), n)
                d1, d2 = (pa.array(_sums(owner, mix(key + U(k)), len(n)).view(np.int64)) for k in (1, 2))
                few = prefix_sizes(n, percent)
                first = in_order(key, begin, rare.value)[ragged(begin[:-1], few)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]), pa.int32()), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), d1, d2, lists, *(pa.array(sketches(key, begin, percent, each), pa.binary()) for each in (COARSE, FINE))], names=["id", "row", "n", "d1", "d2", "first", "sketch", "fine"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, "text"):
                key, begin = shingle_sets(buf, at, width)
                raw = in_order(key, begin, rare.value).astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:])], pa.binary())], names=["key", "shingles"])

    rows = cut(own.mapInArrow(measured, f"id {id_type}, row long, n long, d1 long, d2 long, first array<long>, sketch binary, fine binary"), "sets")
    # Equal sets have equal 128-bit digests; written once, a class keeps its number.
    classes = rows.where("n > 0").groupBy(*digest_of).agg(F.min("id").alias("least"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "first", "sketch", "fine")))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    postings = classes.select("key", F.explode("first").alias("g"))
    sizes = postings.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(postings.join(sizes, "g"), "members")
    family = _families(members, classes, percent)
    kin = cut(family.join(family.groupBy("family").agg(F.count("*").alias("kin")), "family"), "families")
    wanted = cut(kin.select("key").join(classes, "key").select("key", "row"), "wanted")
    if wanted.count() <= SENT_ROWS:  # else texts and keys are both shuffled
        wanted = F.broadcast(wanted)
    sets = cut(own.join(wanted, "row").select("key", "text").mapInArrow(ordered, "key long, shingles binary"), "active_sets")

    few = kin.where(F.col("kin") <= at_once).select(F.col("family").alias("g"), F.lit(0).alias("salt"), F.lit(0).alias("kind"), "key", F.col("key").alias("comp"))
    held = _merge(kin.select("key", F.col("key").alias("comp")), _links(few.join(sets, "key"), percent, whole=True), named=True)
    large = kin.where(F.col("kin") > at_once).select("key")
    if not large.isEmpty():
        held = _link_large(cut(members.join(large, "key", "left_semi"), "large"), kin, sets, held, classes, percent, at_once)
    drop(members, kin, sets)

    named = classes.select("key", "least", *digest_of).join(held, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = named.join(least, "comp").select(*digest_of, "comp", "component_id")
    out = rows.select("id", "row", "n", *digest_of).join(found, digest_of, "left")
    return out.select("id", "row", "n", F.when(F.col("n") > 0, F.col("comp")).alias("comp"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def similar_documents(docs: DataFrame, percent: int = 90, width: int = 3, at_once: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: sets of distinct shingles of ``width`` words
    (fewer words: the whole sequence as one), linked from a Jaccard similarity of percent / 100 on.

    Words are runs without ASCII white space, A-Z lower-cased. The component's id is the least id
    reachable by links; texts that are null or without words have 0 shingles and stay alone.
    Equal sets are one class from the start. Tries hold at most about ``at_once`` sets: a larger
    family takes three joins: each class in its largest group; one class of each component per
    group; last, without loss, what of the family may still link two of its components.
    Repeated rows each give a row. Rows whose id is null link like others; a null id is never a
    component's id unless all are null. An empty table gives no rows; other columns don't matter.
    """
    found = classified(docs, F.xxhash64(id_col, text_col), percent, width, at_once, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _link_large(members: DataFrame, kin: DataFrame, sets: DataFrame, held: DataFrame, classes: DataFrame, percent: int, at_once: int) -> DataFrame:
    """Components after the links of families too large for one trie, group by group."""
    salt = lambda size: _salt(F.ceil(F.col(size) / at_once))
    # 1. each class in its largest group
    first = members.groupBy("key").agg(F.max(F.struct("size", "g")).alias("most")).select("key", "most.g", "most.size")
    first = first.withColumn("salt", salt("size")).withColumn("comp", F.col("key")).withColumn("kind", F.lit(0))
    held = _merge(held, _links(first.join(sets, "key"), percent, whole=True), named=True)
    # 2. one class of each component in each group
    now = members.join(held, "key").groupBy("g", "comp").agg(F.min("key").alias("key"))
    many = now.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    second = now.join(many, "g").withColumn("salt", salt("size")).withColumn("kind", F.lit(0))
    held = _merge(held, _links(second.join(sets, "key"), percent))
    # 3. of every large family that still holds several components, all sets that may be similar across them
    third = kin.where(F.col("kin") > at_once).join(held, "key").select(F.col("family").alias("g"), "key", "comp")
    third = _across(third, HELD).join(classes.select("key", "n", F.col("fine").alias("sketch")), "key")
    third = cut(_crossing(third, percent), "crossing")
    held = _merge(held, _links(third.join(sets, "key"), percent))
    drop(members, third)
    return held


def _merge(held: DataFrame, links: DataFrame, named: bool = False) -> DataFrame:
    """Components (key, comp) after their links are joined in; ``named``: the links lead to the least of each component already."""
    merged = links.select(F.col("a").alias("comp"), F.col("b").alias("into")) if named else components(links).select(F.col("id").alias("comp"), F.col("component").alias("into"))
    return cut(held.join(merged, "comp", "left").select("key", F.coalesce("into", "comp").alias("comp")), "held")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, at_once: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their component: of each, the row of the least id, rows of one id in the order of a hash of all their columns.

    Rows without words stay, all of them. Rows that share an id but not a component each stand for
    their own; null ids come last, so such a row stays only where its component has no other. Of rows
    that are equal in all columns one stays. Columns of any names pass through.
    """
    found = cut(classified(docs, row_key(docs), percent, width, at_once, id_col, text_col), "classified")
    best = found.where("n > 0").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row")).select("row")
    kept = found.where("n > 0").groupBy("row").agg(F.count("*").alias("times")).join(best, "row")
    kept = cut(kept.unionByName(found.where("n = 0").select("row", F.lit(1).cast("long").alias("times")).distinct()), "kept")
    drop(found)
    return chosen_rows(docs, kept)[0]


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

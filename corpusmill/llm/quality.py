"""Quality classifier: random Fourier features, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .textscan import LOWER, hashes, pieces, word_bounds

# Byte kinds counted in a text.
_KIND = np.full(256, 7, np.uint8)  # 7: bytes of characters beyond ASCII
_KIND[:128] = 6  # other symbols and controls
_KIND[[ord(c) for c in " \t\r\v\f"]] = 0
_KIND[10] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5

#: Names of the statistics, in the order of the features.
STATISTICS = ("log_words", "word_bytes", "blank", "line_ends", "lower", "upper", "digit", "plain_marks", "symbols", "beyond_ascii", "distinct_words", "commonest_word", "distinct_pairs", "distinct_lines", "longest_word", "first_upper", "words_a_line", "mark_after_word", "one_byte_words")


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its commonest one stands."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    text = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, text, np.diff(np.append(first, len(key))))
    return np.bincount(text, minlength=docs), most


def statistics(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics for each text, whole texts counted."""
    docs, size = len(at) - 1, np.maximum(np.diff(at), 1)
    owner = np.repeat(np.arange(docs), np.diff(at))
    kinds = np.bincount(owner * 8 + _KIND[buf], minlength=docs * 8).reshape(docs, 8) / size[:, None]
    starts, ends = word_bounds(buf, at)
    low = LOWER[buf]
    h = hashes(low, starts, ends)
    word_of = owner[starts]
    n = np.bincount(word_of, minlength=docs)
    words = np.maximum(n, 1)
    kinds_of_words, commonest = _distinct(word_of, h, docs)
    same = word_of[1:] == word_of[:-1] if len(h) else np.zeros(0, bool)
    pairs, _ = _distinct(word_of[1:][same], (h[1:] * np.uint64(3) + h[:-1])[same] * np.uint64(0x9E3779B97F4A7C15), docs)
    cut = np.zeros(len(buf) + 1, bool)
    cut[at] = True
    nl = buf == 10
    line_start = np.flatnonzero(cut[:-1] | np.concatenate([[False], nl[:-1]]) if len(buf) else [])
    line_end = np.append(line_start[1:], len(buf)) if len(line_start) else line_start
    lines, _ = _distinct(owner[line_start], hashes(low, line_start, line_end), docs)
    n_lines = np.maximum(np.bincount(owner[line_start], minlength=docs), 1)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, word_of, ends - starts)
    last = _KIND[buf[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0, np.uint8)
    by_word = lambda mask: np.bincount(word_of[mask], minlength=docs) / words
    return np.column_stack([
        np.log1p(n), (1 - kinds[:, 0] - kinds[:, 1]) * size / words, *(kinds[:, k] for k in range(8)), kinds_of_words / words, commonest / words,
        pairs / np.maximum(n - 1, 1), lines / n_lines, np.log1p(longest), by_word(_KIND[buf[starts]] == 3 if len(starts) else np.zeros(0, bool)), np.log1p(n / n_lines), by_word((last == 5) | (last == 6)), by_word(ends - starts == 1),
    ])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    """Standardised statistics -> cosines of random projections -> ridge score -> isotonic steps."""

    def __init__(self, mean, sd, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        self.weights, self.phase = rng.normal(size=(len(mean), features)) * gamma, rng.uniform(0, 2 * np.pi, features)
        self.ridge, self.knots, self.values = np.zeros(features + 1), np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -4, 4)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability; a fiftieth of it is the raw score, which orders texts within a step."""
        raw = self.raw(stats)
        return 0.98 * np.interp(raw, self.knots, self.values) + 0.02 * np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and non-decreasing values that fit shares good / n at ascending x best (pool adjacent violators)."""
    blocks: list[list[float]] = []  # good, n, first x, last x
    for xi, g, k in zip(x.tolist(), good.tolist(), n.tolist()):
        blocks.append([g, k, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, k2, _, last = blocks.pop()
            blocks[-1][0] += g2
            blocks[-1][1] += k2
            blocks[-1][3] = last
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


def _stats_rows(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, text_col):
                s = statistics(buf, at)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(list(s), pa.list_(pa.float64()))], names=[*keep, "stats"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 50_000, features: int = 256, gamma: float = 0.15, ridge: float = 1e-2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled documents, at most about ``max_labelled`` of them, taken by a hash of their id.

    That bound makes the sample fit a broadcast and its statistics a few partitions, each of which
    sums its part of the normal equations; sums alone come to the driver. Rows without a label, id
    or document teach nothing; a null text is an empty one. Without both labels, every score is
    the share of good labels (0.5 with none).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("y"))
    n = known.count()
    share = int(min(1.0, max_labelled / max(n, 1)) * (1 << 30))
    known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share)
    rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col).select("y", F.col(text_col).alias("text"))
    stats = cut(_stats_rows(rows, ["y"], "text"), "labelled").coalesce(8)

    def summed(add, *shapes):
        """Partitions' sums of arrays, summed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(s) for s in shapes]
            for batch in batches:
                if batch.num_rows:
                    y = batch.column(0).to_numpy()
                    for t, a in zip(total, add(batch.column(1).flatten().to_numpy().reshape(len(y), -1), y)):
                        t += a
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())], names=["sums"])

        flat = sum((np.frombuffer(r.sums) for r in stats.mapInArrow(run, "sums binary").collect()), np.zeros(sum(int(np.prod(s)) for s in shapes)))
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return [a.reshape(s) for a, s in zip(np.split(flat, cuts), shapes)]

    d = len(STATISTICS)
    (n, good), s1, s2 = summed(lambda x, y: (np.array([len(y), y.sum()]), x.sum(0), (x * x).sum(0)), (2,), (d,), (d,))
    mean = s1 / max(n, 1)
    model = Model(mean, np.sqrt(np.maximum(s2 / max(n, 1) - mean**2, 0)) + 1e-6, features, gamma, seed)
    if not 0 < good < n:
        model.values = np.full(1, good / n if n else 0.5)
        return model

    def equations(x, y):
        z = model.features(x)
        return z.T @ z, z.T @ y

    zz, zy = summed(equations, (features + 1, features + 1), (features + 1,))
    model.ridge = np.linalg.solve(zz + ridge * np.eye(features + 1), zy)
    edges = np.linspace(-0.5, 1.5, 1001)

    def bins(x, y):
        at = np.clip(np.searchsorted(edges, model.raw(x), "right") - 1, 0, 999)
        return np.bincount(at, y, 1000), np.bincount(at, minlength=1000)

    good_in, n_in = summed(bins, (1000,), (1000,))
    some = n_in > 0
    model.knots, model.values = isotonic((edges[:-1] + edges[1:])[some] / 2, good_in[some], n_in[some])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each whole text, repeated rows too; null and empty texts are scored as empty ones; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, text_col):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.clip(shared.value.score(statistics(buf, at)), 0, 1))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


#: A document is good from this score on.
THRESHOLD = 0.3


def keep_good(docs: DataFrame, model: Model, least: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, text_col):
                yield rows.filter(pa.array(shared.value.score(statistics(buf, at)) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to three bytes deep with the counts of what followed.
A byte's probability is its share in the longest context known, else the escape share (method C)
times its probability one context shorter among the bytes not seen here; the last resort is
uniform. Statistics are frozen after learning, so the probability of a byte depends on its context
alone and the code length of a text is a sum of looked-up numbers. A text's language is the one
that codes it shortest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path
from .textscan import LOWER, pieces

_PAD = 0x0A
_worker: dict = {}


def windows(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, the three bytes before it (line ends before a text) and itself, as one number; A-Z lower-cased."""
    low = LOWER[buf].astype(np.uint32)
    out = low.copy()
    place = np.arange(len(buf)) - np.repeat(at[:-1], np.diff(at))
    for k in (1, 2, 3):
        back = np.full(len(buf), _PAD, np.uint32)
        back[k:] = low[:-k] if len(buf) > k else back[k:]
        back[place < k] = _PAD
        out |= back << np.uint32(8 * k)
    return out


def learn(docs: DataFrame, per_lang: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): counts of four-byte windows in at most about ``per_lang`` texts of each language.

    The sample is bounded by that parameter: texts are taken by a hash of their id, all of them
    where a language has fewer. Rows without text, language or id teach nothing.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").count().select("lang", (F.lit(float(per_lang)) / F.col("count") * (1 << 30)).cast("long").alias("share"))
    if sizes.count() <= 10_000:  # labels are free text: a row for each
        sizes = F.broadcast(sizes)
    sample = known.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, "text"):
                lang = rows.column(0).to_pylist()
                grams = windows(buf, at)
                for one in sorted(set(lang)):
                    own = np.repeat(np.array([x == one for x in lang]), np.diff(at))
                    g, n = np.unique(grams[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Level:
    """Contexts of one depth and what followed them: code lengths of the pairs that some language has seen, and what the step to the shorter context costs each language."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, kinds: int, contexts: int, langs: int):
        seen = np.unique(context)
        self.row = np.full(contexts, len(seen), np.int32)  # the last row is every context never seen
        self.row[seen] = np.arange(len(seen), dtype=np.int32)
        self.kinds = kinds
        self.pairs = np.unique(self.row[context].astype(np.int64) * kinds + symbol)
        self.place = np.full((len(seen) + 1) * kinds, -1, np.int32)
        self.place[self.pairs] = np.arange(len(self.pairs), dtype=np.int32)
        self.bits, self.step = np.zeros((len(self.pairs), langs), np.float32), np.zeros((len(seen) + 1, langs), np.float32)

    def fill(self, lang: int, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, shorter: np.ndarray, shorter_of_pairs: np.ndarray) -> None:
        """Take in a language's counts; ``shorter``: its probabilities of these symbols, and of all pairs' symbols, one context shorter."""
        row = self.row[context]
        size = len(self.step)
        total, distinct = np.bincount(row, n, size), np.bincount(row, minlength=size)
        left = np.maximum(1 - np.bincount(row, shorter, size), 1e-12)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / left, 1.0)
        p = shorter_of_pairs * escape[self.pairs // self.kinds]
        p[self.place[row.astype(np.int64) * self.kinds + symbol]] = n / (total + distinct)[row]
        self.bits[:, lang], self.step[:, lang] = -np.log2(np.maximum(p, 2.0**-60)), -np.log2(escape)

    def find(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of contexts, and places of pairs (-1: never seen)."""
        row = self.row[context]
        return row, self.place[row.astype(np.int64) * self.kinds + symbol]


class Trees:
    """Context trees of all languages. Nothing that was counted is left out; memory grows with the distinct windows of the sample, 4 bytes each and language, and a table of all context numbers (4 bytes each, 70 MB if all 256 bytes occur)."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        seen = np.unique(np.concatenate([(gram >> (8 * k)) & 255 for k in range(4)] + [np.array([_PAD])]))
        self.size = a = len(seen) + 1  # the last class is every byte never seen
        self.kind = np.full(256, a - 1, np.int64)
        self.kind[seen] = np.arange(a - 1)
        uniform = np.full(a, 1 / 256)
        uniform[-1] = others = (256 - (a - 1)) / 256
        sym = [self.kind[(gram >> (8 * k)) & 255] for k in range(4)]  # itself, then 1, 2 and 3 back
        two, three = sym[2] * a + sym[1], (sym[3] * a + sym[2]) * a + sym[1]
        self.one = np.zeros((a * a, len(langs)), np.float32)
        self.levels = [_Level(two, sym[0], a, a**2, len(langs)), _Level(three, sym[0], a, a**3, len(langs))]
        pairs = []  # contexts and symbols of each level's pairs
        for level in self.levels:
            context = np.flatnonzero(level.row < len(level.step) - 1)[level.pairs // a]
            pairs.append((context, level.pairs % a))
        for k in range(len(langs)):
            own = lang == k
            s0, s1, c2, c3, w = sym[0][own], sym[1][own], two[own], three[own], n[own].astype(float)
            p0 = self._blend(np.bincount(s0, w, a)[None], uniform[None])
            p1 = self._blend(np.bincount(s1 * a + s0, w, a * a).reshape(a, a), p0)
            each, where = np.unique(c2 * a + s0, return_inverse=True)  # two-byte contexts and what followed
            n2, c2, s2 = np.bincount(where, w), each // a, each % a
            context, symbol = pairs[0]
            self.levels[0].fill(k, c2, s2, n2, p1[c2 % a, s2], p1[context % a, symbol])
            self.one[:, k] = -np.log2(np.maximum(np.where(np.arange(a) == a - 1, p1 / max(256 * others, 1), p1), 2.0**-60)).ravel()
            two_p = lambda c, s: np.exp2(-self._two(c, s)[:, k].astype(float))  # noqa: B023, E731
            context, symbol = pairs[1]
            self.levels[1].fill(k, c3, s0, w, two_p(c3 % (a * a), s0), two_p(context % (a * a), symbol))

    @staticmethod
    def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities in contexts with these counts, given those one context shorter."""
        n, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        rest = np.where(counts > 0, 0, shorter)
        left = rest.sum(1, keepdims=True)
        escape = np.where(n > 0, kinds / np.maximum(n + kinds, 1), 1.0)
        kept = counts / np.maximum(n + kinds, 1)
        return np.where(left > 0, kept + escape * rest / np.where(left > 0, left, 1), counts / np.maximum(n, 1))

    def _two(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of symbols after two-byte contexts, by language."""
        row, place = self.levels[0].find(context, symbol)
        out = self.levels[0].bits[place] if len(self.levels[0].bits) else np.zeros((len(row), len(self.langs)), np.float32)
        miss = np.flatnonzero(place < 0)
        out[miss] = self.levels[0].step[row[miss]] + self.one[context[miss] % self.size * self.size + symbol[miss]]
        return out

    def code_lengths(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits that each language needs for each text."""
        w = windows(buf, at)
        a = self.size
        s0, s1, s2, s3 = (self.kind[(w >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4))
        row, place = self.levels[1].find((s3 * a + s2) * a + s1, s0)
        bits = self.levels[1].bits[place] if len(self.levels[1].bits) else np.zeros((len(row), len(self.langs)), np.float32)
        miss = np.flatnonzero(place < 0)
        bits[miss] = self.levels[1].step[row[miss]] + self._two(s2[miss] * a + s1[miss], s0[miss])
        out = np.zeros((len(at) - 1, len(self.langs)))
        filled = np.flatnonzero(np.diff(at) > 0)
        if len(filled):
            out[filled] = np.add.reduceat(bits, at[filled], axis=0, dtype=np.float64)
        return out


_ASCII_LETTER = np.zeros(256, np.int64)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


def _guesses(docs: DataFrame, model: DataFrame, text_col: str, finish, schema):
    """Run ``finish(rows, names, scores)`` on slices of rows and their guessed languages."""
    rows = model.toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.array([number[x] for x in rows["lang"].to_pylist()], np.int16), rows["gram"].to_numpy().astype(np.int64), rows["n"].to_numpy()))
    key = shared_path(docs.sparkSession, "trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = Trees(*shared.value) if shared.value[0] else None
        trees = _worker[key]
        for batch in batches:
            for part, buf, at in pieces(batch, text_col, 1 << 20):
                size = np.diff(at)
                letters = np.add.reduceat(np.append(_ASCII_LETTER[buf], 0), at[:-1]) * (size > 0)
                for i in np.flatnonzero((letters == 0) & (size > 0)):
                    letters[i] = any(c.isalpha() for c in buf[at[i] : at[i + 1]].tobytes().decode())
                if trees is None:
                    yield finish(part, ["und"] * len(size), np.zeros(len(size)))
                    continue
                bits = trees.code_lengths(buf, at)
                over = (bits - bits.min(1, keepdims=True)) * np.minimum(1, 64 / np.maximum(size, 1))[:, None]
                score = np.where(letters > 0, 1 / np.exp2(-over).sum(1), 0.0)
                yield finish(part, [langs[b] if ok else "und" for b, ok in zip(bits.argmin(1), letters)], score)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row: the language that codes the whole text shortest, and its share of the languages' probabilities.

    Code lengths are damped to at most 64 bytes' worth before probabilities are compared, so scores
    tell close cases in long texts too. ``und`` with score 0 for null texts, texts without a letter
    and models without a language. Ties go to the language first in order. Repeated rows each get
    a result; an empty table gives no rows. The model sent to the tasks is bounded by the sample
    that it was learnt from.
    """
    finish = lambda rows, names, score: pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])
    return _guesses(docs.select(id_col, text_col), model, text_col, finish, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: DataFrame, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language with at least a score."""
    finish = lambda rows, names, score: rows.filter(pa.array(np.asarray(score) >= least))
    return _guesses(docs, model, text_col, finish, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 modulo 4; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, learn(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine is the composition of the normaliser (a dummy prefix, blanks to the blank sign), the
pieces and byte fallback. Composed with a text, its states are (place, last piece) and its arcs
pieces; the encoding is the shortest path in the tropical semiring. Arcs of a unigram model weigh
minus the piece's score. Arcs of a BPE model weigh 0 after a piece with which they stand side by
side in the encoding of their joined text, and infinity after any other: merges across a border
depend on its two neighbours alone, so the one finite path is the text that BPE's merges give.
No piece crosses from text into a blank or holds a line end, so a text is cut there and equal
stretches are solved once.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import RaggedCache, U, hashes, pieces

BLANK = "▁"
_worker: dict = {}


class Transducer:
    """A compiled SentencePiece model with the identity normaliser."""

    def __init__(self, file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.prefix, self.bpe = spec.add_dummy_prefix, proto.trainer_spec.model_type == 2
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {self.text[i]: i for i in plain}
        self.scores = {self.text[i]: model.get_score(i) for i in plain}
        self.bytes_ = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if model.is_byte(i)}
        if any(re.search("[^▁]▁|\n", p) for p in self.ids):
            raise ValueError("a piece crosses into a blank or a line end")
        self.longest = max(map(len, self.ids), default=1)
        self.side: dict[tuple[str, str], bool] = {}
        surface = [bytes([b]) if (b := int(t[3:5], 16) if model.is_byte(i) else -1) >= 0 else t.replace(BLANK, " ").encode() if t in self.ids else b"" for i, t in enumerate(self.text)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array(list(map(len, surface)), np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len

    def merged(self, text: str) -> list[str]:
        """BPE merges from characters: the best-scored joined piece first, leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def weight(self, last: str, piece: str) -> float:
        """Of an arc: what it costs to go on with ``piece`` after ``last`` ("" at the start)."""
        if not self.bpe:
            return -self.scores.get(piece, min(self.scores.values()) - 10.0)
        ok = self.side.get((last, piece))
        if ok is None:
            ok = self.side[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return 0.0 if ok else np.inf

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the pieces composed with a normalised text."""
        n = len(text)
        cost, back = [0.0] + [np.inf] * n, [""] * (n + 1)
        ids, side = self.ids, self.side
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = text[start:end]
                if piece in ids or end - start == 1:
                    last = back[start]
                    w = (0.0 if side[last, piece] else np.inf) if self.bpe and (last, piece) in side else self.weight(last, piece)
                    if cost[start] + w < cost[end]:
                        cost[end], back[end] = cost[start] + w, piece
                        if self.bpe:
                            break  # the one finite path
        out: list[list[int]] = []
        while n:
            piece = back[n]
            out.append([ids[piece]] if piece in ids else [self.bytes_[b] for b in piece.encode()])
            n -= len(piece)
        return [i for part in reversed(out) for i in part]

    def encode(self, buf: np.ndarray, at: np.ndarray, cache: RaggedCache) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number for each."""
        raw = buf.tobytes()
        if BLANK.encode() in raw:  # the blank sign in a text is a blank
            texts = [raw[a:b].replace(BLANK.encode(), b" ") for a, b in zip(at[:-1], at[1:])]
            raw, at = b"".join(texts), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
            buf = np.frombuffer(raw, np.uint8)
        blank, line = buf == 0x20, buf == 0x0A
        edge = np.zeros(len(buf) + 1, bool)
        edge[at] = True
        edge[1:-1] |= blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
        first = np.zeros(len(buf) + 1, bool)
        first[at] = self.prefix
        starts = np.flatnonzero(edge[:-1]) if len(buf) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        first = first[starts]
        key = hashes(buf, starts, ends)
        key[first] = key[first] * U(5) + U(1)

        def fill(where: np.ndarray, _: np.ndarray):
            got = [self.shortest((BLANK if f else "") + raw[a:b].decode().replace(" ", BLANK)) for a, b, f in zip(starts[where].tolist(), ends[where].tolist(), first[where].tolist())]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for ids in got for i in ids), cache.dtype, int(lens.sum())), lens

        flat, lens = cache.runs(key, fill)
        total = np.concatenate([[0], np.cumsum(lens)])
        return flat, np.diff(total[np.searchsorted(starts, at)])

    def decode(self, flat: np.ndarray, n: np.ndarray) -> list[bytes]:
        """UTF-8 texts of id runs: surfaces joined, without the dummy prefix."""
        from .textscan import ragged

        lens = self.surface_len[flat]
        raw = self.surface[ragged(self.surface_at[flat], lens)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(n)])]
        return [raw[a + (self.prefix and raw[a : a + 1] == b" " and b > a) : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _machine(file: str) -> tuple[Transducer, RaggedCache]:
    if file not in _worker:
        _worker[file] = Transducer(file), RaggedCache(np.int32)
    return _worker[file]


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded_crc32): the encoding of each whole text, and the checksum of what it decodes to.

    Null texts are empty and have no ids; repeated rows are encoded each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = _machine(file)
        for batch in batches:
            for rows, buf, at in pieces(batch, text_col, 1 << 20):
                flat, n = machine.encode(buf, at, cache)
                sums = [zlib.crc32(x) for x in machine.decode(flat, n)]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), ids, pa.array(n), pa.array(sums, pa.int64())], names=[id_col, "ids", "n_tokens", "decoded_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_tokens long, decoded_crc32 long")


def decode(encoded: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of id runs; null runs give null texts, byte pieces that aren't UTF-8 the replacement sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = _machine(file)
        for batch in batches:
            n = batch.column(1).value_lengths().fill_null(0).to_numpy()
            texts = machine.decode(batch.column(1).flatten().to_numpy(), n)
            texts = [x.decode(errors="replace") if ok else None for x, ok in zip(texts, batch.column(1).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def model_file() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("piece_bpe_32k.model"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, model_file()).select("doc_id", "n_tokens", F.col("decoded_crc32"), "ids")

"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding.

A file set has four Parquet tables under one path: ``blocks`` (rows of documents in ascending
id order; each row has their ids and token counts, and the tokens as two byte strings: control
bytes with four two-bit lengths each, and the ranks' own bytes, low byte first), ``ranks``
(token id of each rank, most frequent first), ``index`` (the blocks' tokens and first positions)
and, while writing, ``encoded``.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path
from .textscan import LOWER, SPACE, RaggedCache, hashes, pieces

_worker: dict = {}

# Byte classes of text before pre-tokenisation. A word may be cut between letters and ASCII
# punctuation or digits: no token, composition or contraction spans such a place. Letters are ASCII
# and Latin-1 ones; lower-casing others can make marks, so nothing is cut beside them.
_BLANK, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[SPACE] = _BLANK
_CLASS[0x21:0x7F] = _MARK
_CLASS[ord("'")] = _OTHER
for _a, _b in ((65, 91), (97, 123), (0xC3, 0xC4)):
    _CLASS[_a:_b] = _LETTER


def chunk_bounds(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks whose tokens don't depend on what stands around them."""
    kind = _CLASS[buf]
    latin = np.flatnonzero(buf[:-1] == 0xC3)
    sign = latin[(buf[latin + 1] == 0x97) | (buf[latin + 1] == 0xB7)]
    kind[latin + 1] = _LETTER
    kind[sign] = kind[sign + 1] = _OTHER
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    edge[1:-1] |= (kind[:-1] == _BLANK) | (kind[1:] == _BLANK) | ((kind[:-1] ^ kind[1:]) == (_LETTER ^ _MARK)) & (kind[:-1] != _BLANK) & (kind[1:] != _BLANK) & (kind[:-1] != _OTHER) & (kind[1:] != _OTHER)
    filled = kind != _BLANK
    return np.flatnonzero(filled & edge[:-1]), np.flatnonzero(filled & edge[1:]) + 1


# The steps of tokenizers whose tokens never span the places at which texts are cut.
_STEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(tok) -> bool:
    """Whether a tokenizer ignores case and blanks and splits at words as ``chunk_bounds`` does; texts of any other are encoded whole."""
    steps, splits = ([] if part is None else (json.loads(part.__getstate__())) for part in (tok.normalizer, tok.pre_tokenizer))
    if not steps or not splits or splits.get("type") != "Sequence":
        return False
    found = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    first, *rest = splits["pretokenizers"]
    split = first.get("type") == "Split" and first["pattern"] == {"Regex": _WORDS} and first["behavior"] == "Removed" and first["invert"]
    return split and {"type": "Lowercase"} in found and all(step in _STEPS for step in found) and all(r.get("type") == "ByteLevel" and not r["add_prefix_space"] and not r["use_regex"] for r in rest)


def _tokenizer(file: str):
    if file not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(file)
        special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        wide = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        _worker[file] = tok, special, RaggedCache(wide), wide, by_words(tok)
    return _worker[file]


def tokenize(buf: np.ndarray, at: np.ndarray, file: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, and the number for each text."""
    tok, special, cache, wide, words = _tokenizer(file)
    if not words:
        raw = buf.tobytes()
        runs = [np.asarray(tok.encode(raw[a:b].decode(), add_special_tokens=False).ids, wide) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return np.concatenate(runs) if runs else np.zeros(0, wide), np.fromiter(map(len, runs), np.int64, len(runs))
    starts, ends = chunk_bounds(buf, at)
    low = LOWER[buf]

    def fill(where: np.ndarray, _: np.ndarray):
        raw = low.tobytes()
        got = [e.ids for e in tok.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist())], add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), wide, int(lens.sum())), lens

    flat, lens = cache.runs(hashes(low, starts, ends), fill)
    total = np.concatenate([[0], np.cumsum(lens)])
    bound = total[np.searchsorted(starts, at)]
    n = np.diff(bound)
    raw = buf.tobytes()
    odd = [d for d in range(len(n)) if any(s in raw[at[d] : at[d + 1]] for s in special)] if any(s in raw for s in special) else []
    if odd:  # texts that hold the strings of special tokens are encoded whole
        runs = np.split(flat, bound[1:-1])
        for d in odd:
            runs[d] = np.asarray(tok.encode(raw[at[d] : at[d + 1]].decode(), add_special_tokens=False).ids, wide)
        flat, n = np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))
    return flat, n


def encode_bytes(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    start = np.cumsum(size.astype(np.int64) + 1) - size - 1
    data = np.zeros(int(start[-1]) + int(size[-1]) + 1 if len(ranks) else 0, np.uint8)
    for k in range(4):
        has = size >= k
        data[start[has] + k] = (ranks[has] >> (8 * k)) & 0xFF
    return control.tobytes(), data.tobytes()


#: Lengths less one of the four numbers behind each control byte.
_SIZES = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3


def decode_bytes(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    start = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size >= k)
        out[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_tokens(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): the ids of each whole text and the end id, as little-endian unsigned numbers of 2 or 4 bytes by vocabulary size. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, at in pieces(batch, text_col):
                flat, n = tokenize(buf, at, file)
                flat = np.insert(flat, np.cumsum(n), end_id)
                n = n + 1
                cuts = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=[id_col, "n_tokens", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids binary")


def _vocab_size(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size()


def write_token_files(docs: DataFrame, path: str, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 19) -> None:
    """Tokenise whole texts and write them in ascending id order (null ids first; ties by content).

    The one thing sent to all tasks is the ranks' table, bounded by the vocabulary. Null texts
    hold the end id alone; repeated rows are written each; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    vocab = max(_vocab_size(file), end_id + 1)
    wide = np.uint16 if vocab <= 1 << 16 else np.uint32
    encode_tokens(docs, file, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), wide), minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    counts = encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    order = [r.token for r in counts.orderBy(F.desc("n"), "token").collect()]  # at most the vocabulary
    spark.createDataFrame(list(enumerate(order)), "rank int, token long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(vocab, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, block = [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[2] for x in held), wide)
            control, data = encode_bytes(shared.value[ids])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([[x[0] for x in held]], pa.list_(kind)), pa.array([[x[1] for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["block", "n_tokens", "ids", "counts", "control", "data"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(i) for i in range(3))):
                key, n, ids = (x.as_py() for x in row)
                if held and tokens + n > block_tokens:
                    yield flush()
                    held, tokens, block = [], 0, block + 1
                held.append((key, n, ids))
                tokens += n
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = encoded.schema[id_col].dataType.simpleString()
    ordered = encoded.repartitionByRange(n, id_col, "n_tokens").sortWithinPartitions(id_col, "n_tokens", "ids")
    blocks = ordered.mapInArrow(pack, f"block int, n_tokens long, ids array<{id_type}>, counts array<long>, control binary, data binary")
    blocks.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/blocks")
    each = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    parts = each.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("first"))  # a row for each partition
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    each.join(first, "part").select("part", "block", "n_tokens", (F.col("first") + own).alias("start")).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, each: Callable[[np.ndarray], object] | None = None, kind: str = "array<long>", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, tokens) from the files. ``each`` maps a document's ids (uint32) to the value of column tokens, of type ``kind``."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r.token for r in ranks], np.uint32))
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"part int, block int, `{id_col}` {id_type}, before long, n_tokens long, tokens {kind}"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, n, keys, counts, control, data = (batch.column(k)[i] for k in range(7))
                ids = shared.value[decode_bytes(control.as_py(), data.as_py(), n.as_py())]
                counts = counts.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                runs = [ids[a:b] for a, b in zip(ends - counts, ends)]
                tokens = pa.array([each(x) for x in runs] if each else runs)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(runs), pa.int32()), pa.array([block.as_py()] * len(runs), pa.int32()), keys.values, pa.array(ends - counts), pa.array(counts), tokens if each else tokens.cast(pa.list_(pa.int64()))], names=["part", "block", id_col, "before", "n_tokens", "tokens"])

    rows = blocks.select("part", "block", "n_tokens", "ids", "counts", "control", "data").mapInArrow(unpack, schema)
    index = spark.read.parquet(f"{path}/index").drop("n_tokens")
    return rows.join(index, ["part", "block"]).select(id_col, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "tokens")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1)
    out = read_token_files(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long")
    return out.select("doc_id", "start", "n_tokens", F.col("tokens").alias("ids_crc32"))

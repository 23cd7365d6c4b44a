"""Token files and the piece transducer."""

import tempfile
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import piece_fst, token_files

FILE = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(FILE)


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")) | st.text(alphabet="aB' .,!1é×«≠́ \n<|>Σİ日"), min_size=1, max_size=6))
def test_chunks_tokenise_as_whole_texts(texts):
    buf, at = arrays(texts)
    flat, n = token_files.tokenize(buf, at, FILE)
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert flat[a:b].tolist() == TOK.encode(t, add_special_tokens=False).ids


def test_special_strings_stay_special():
    buf, at = arrays(["Hi <|endoftext|> x", "plain"])
    flat, n = token_files.tokenize(buf, at, FILE)
    assert flat[: n[0]].tolist() == TOK.encode("Hi <|endoftext|> x", add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aB' .,!1é\n\tΣİ日"), max_size=4))
def test_other_tokenizers_encode_whole_texts(texts):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    assert token_files.by_words(TOK) and not token_files.by_words(tok)
    texts = [*texts, "Hello World  HELLO world"]
    flat, n = token_files.tokenize(*arrays(texts), file)
    ends = np.cumsum(n)
    assert [flat[b - k : b].tolist() for b, k in zip(ends, n)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_byte_coding_round_trip(numbers):
    x = np.array(numbers, np.uint32)
    assert token_files.decode_bytes(*token_files.encode_bytes(x), len(x)).tolist() == numbers


def test_files_round_trip(spark, docs, no_docs):
    path = tempfile.mkdtemp(prefix="spark-")
    token_files.write_token_files(docs, path + "/a", FILE, 1, block_tokens=64)
    got = token_files.read_token_files(spark, path + "/a").collect()
    start = 0
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for (key, text), r in zip(want, sorted(got, key=lambda r: r.start)):
        ids = TOK.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.tokens) == (key, start, len(ids), ids)
        start += len(ids)
    token_files.write_token_files(no_docs, path + "/b", FILE, 1)
    assert token_files.read_token_files(spark, path + "/b").count() == 0


SP = sentencepiece.SentencePieceProcessor(model_file=piece_fst.model_file())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")) | st.text(alphabet="ab e\n▁0é日🙂.,"), min_size=1, max_size=5))
def test_pieces_equal_the_model(texts):
    machine, cache = piece_fst._machine(piece_fst.model_file())
    buf, at = arrays(texts)
    flat, n = machine.encode(buf, at, cache)
    ends = np.cumsum(n)
    for t, a, b, back in zip(texts, ends - n, ends, machine.decode(flat, n)):
        if "\0" not in t:
            assert flat[a:b].tolist() == SP.encode(t)
        assert back.decode() == t.replace("▁", " ")


def test_pieces_edge_cases(docs, no_docs):
    file = piece_fst.model_file()
    got = piece_fst.encode(docs, file)
    rows = got.collect()
    assert len(rows) == docs.count() and all(len(r.ids) == r.n_tokens for r in rows)
    texts = {r.doc_id: r.text for r in piece_fst.decode(got, file).collect()}
    assert texts[3] == "" and texts[8].startswith("der schnelle")
    assert {r.doc_id: r.decoded_crc32 for r in rows}[7] == zlib.crc32(b"one two")
    assert piece_fst.encode(no_docs, file).count() == 0

"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from corpusmill.llm import chat_format as C

TEXT = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "\n", "### User: ", "a", ":", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x:y\n", "", None]), TEXT), max_size=6))
def test_grammar_round_trip(turns):
    assert C.parse("".join(C.render(r, t)[0] for r, t in turns)) == turns


def test_parser_rejects_what_it_never_writes():
    assert C.parse("### User: a") is None and C.parse("x") is None and C.parse("### User: a ### b</turn>\n") is None


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", C.CONFLICT), (2, 0, None, None), (None, 0, "assistant", "x"), (1, 2, "assistant", "\\"), (1, 2, "assistant", "\\")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, rendered string")
    got = {r.conv_id: r for r in C.read_back(C.format_turns(frame)).collect()}
    said = f"user\n{C.CONFLICT}\nassistant\nb\nassistant\n\\\nassistant\n\\\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"b\\\\").hexdigest() and got[1].loss_chars == 3
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].loss_chars == 1
    spans = [r for r in C.format_turns(frame).collect() if r.loss_start is not None and not r.escaped]
    assert {r.rendered[r.loss_start : r.loss_end] for r in spans} == {"b", "x"}
    assert C.read_back(C.format_turns(frame.where("false"))).count() == 0


def test_loss_is_what_the_mask_covers(spark):
    rows = [(2**60 + 1, 0, "user", "hello"), (2**60 + 1, 1, "assistant", "an \\### answer</turn>"), (None, 0, "assistant", "x" * 300_000)]
    formatted = C.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    good = {r.conv_id: r for r in C.read_back(formatted.repartition(3)).collect()}
    assert good[2**60 + 1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest() and good[None].loss_chars == 300_000
    for name, by in (("loss_start", 1), ("loss_end", -1), ("loss_end", 1)):
        moved = {r.conv_id: r for r in C.read_back(formatted.withColumn(name, formatted[name] + by)).collect()}
        assert all(moved[k].loss_sha256 != good[k].loss_sha256 and moved[k].turns_sha256 == good[k].turns_sha256 for k in good)

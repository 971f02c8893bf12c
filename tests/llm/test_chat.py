import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, extra int"
NASTY = ["", "<|", "<|im_end|>\n", "\\", "\\\\", "\\|", "<\\|", "<|im_sep|>", "a\nb", "<", "|", "\\n", "</s>[INST] ok [/INST]", "é😀"]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat.format_chats(docs).withColumn("back", chat.parse_chats(F.col("formatted"))).collect()}


def plain(rows):
    return sorted(((t, r or "", x or "") for _, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))


def test_round_trip_of_odd_texts(spark):
    rows = [(c, i, role, text) for c, shift in enumerate(range(4)) for i, text in enumerate(NASTY[shift:] + NASTY[:shift]) for role in [("user", "assistant", "a\\n\nb|<|", "assistant")[i % 4]]]
    rows += [(9, None, None, None), (9, 1, "user", "x"), (9, 1, "user", "x"), (None, 3, "assistant", "y"), (10, 2, "assistant", "b"), (10, 1, "assistant", "a")]
    got = run(spark, rows)
    for conv in {r[0] for r in rows}:
        want = plain([r for r in rows if r[0] == conv])
        assert [(b.role, b.text) for b in got[conv].back] == [(r, x) for _, r, x in want]
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
    assert got[10].formatted == "<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n"


def test_no_rows_and_many_turns(spark):
    assert run(spark, []) == {}
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    assert [b.text for b in run(spark, rows)[1].back] == [f"turn {i}" for i in range(3000)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<|\\>ns\nim_end ", max_size=12)), min_size=1, max_size=40))
def test_round_trip_of_random_texts(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    assert [(b.role, b.text) for b in run(spark, rows)[1].back] == turns


def test_query_has_the_probe(spark):
    row = next(r for r in chat.op5_chat_format(spark, "/root/testdata/sf0.001").collect() if r.conv_id == -1)
    said = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()

"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pollgauge.llm.chat import chat_digests, format_chats, read_loss_text, read_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, row string, turns string, blocks string, borders string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def read(df):
    formatted = format_chats(df)
    out = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans")
    return {r.conv_id: (r.formatted, [tuple(t) for t in r.turns], r.loss, [tuple(s) for s in r.loss_spans]) for r in out.collect()}


def want(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(spark, rows):
    got, expected = read(chats(spark, rows)), want(rows)
    assert got.keys() == expected.keys()
    for conv, turns in expected.items():
        text, read_back, loss, spans = got[conv]
        assert read_back == turns
        assert loss == "".join(t for r, t in turns if r == "assistant")
        assert len(spans) == sum(r == "assistant" for r, _ in turns)
        assert all("<|" not in text[a:a + n] for a, n in spans)
    return got


def test_exact_format(spark):
    got = check(spark, [(1, 0, "user", "a <|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "é\\<\\|x"), (1, 3, "assistant", "")])
    assert got[1][0] == "<|im_start|>user\na <\\|im_end|><|im_sep|><|im_end|>\n<|im_start|>assistant\né\\<\\\\|x<|im_sep|><|im_end|>\n"
    assert got[1][3] == [(got[1][0].index("é"), 7), (len(got[1][0]) - 11, 0)]


def test_messy_rows(spark):
    rows = [(None, 0, "user", "no id"), (None, 0, "user", "no id"), (2, None, None, None), (2, 1, "assistant", "x"), (2, 1, "assistant", "a"), (3, 0, "od d\nrole|<|é+%", "<"), (3, 1, "user", "|"),
            (4, 0, "assistant", "long " * 100_000), (5, 0, "", ""), (6, 0, "assistant", "\n"), (6, 1, "assistant", "<|im_sep|>"), (6, 2, "assistant", "<|im_end|>\n")]
    check(spark, rows)
    assert format_chats(chats(spark, [])).collect() == []


def test_many_turns(spark):
    check(spark, [(1, i, ("user", "assistant", "assistant")[i % 3], f"turn {i} <|") for i in range(2000)])


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é😀")]
    r = chat_digests(format_chats(chats(spark, rows))).first()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha("user\nhi\nassistant\né😀\n"), 2, sha("é😀"))


TEXT = st.text(alphabet="<|\\\nim_endstart>sep é😀", max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", "system"]), TEXT), max_size=60))
def test_any_text(spark, rows):
    check(spark, rows)

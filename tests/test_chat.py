import pytest
from pyspark.sql import functions as F

from quern.functions.text import tool_parts
from quern.operators import chat

M = "array<struct<role: string, content: string>>"
U, A, S = "user", "assistant", "system"


def one(spark, messages, make):
    rows = spark.createDataFrame([(messages, 0.5, 1, 1)], f"m {M}, t double, k int, n int")
    return rows.select(make(F.col("m")).alias("x")).first()["x"]


def test_mask_of_a_short_talk(spark):
    got = one(spark, [(U, "h"), (A, "y")], chat.rendered)
    assert [x.id for x in got] == [256, 257, 104, 258, 259, 121, 260]
    assert [x["mask"] for x in got] == [0, 0, 0, 0, 0, 1, 1]


def test_system_goes_into_the_first_user_message(spark):
    got = one(spark, [(S, "s"), (U, "u"), (A, "a")], chat.merged_system)
    assert [tuple(x) for x in got] == [(U, "s\n\nu"), (A, "a")]


def test_completion_prompt_is_one_longer_than_the_cut(spark):
    got = one(spark, [(U, "x" * 100), (A, "y")], lambda m: chat.for_completion(m, 50))
    assert len(got) == 51 and got[-1] == chat.ASSISTANT_START


def test_calls_are_trained_and_outputs_not(spark):
    row = spark.createDataFrame([("<<1=1>>.",)], "t string").select(chat.rendered_parts(tool_parts(F.col("t"))).alias("x")).first()
    assert [(x.id, x["mask"]) for x in row.x] == [(261, 1), (49, 1), (262, 1), (263, 0), (49, 0), (264, 0), (46, 1)]


@pytest.mark.parametrize(
    ("messages", "fault"),
    [(None, "empty"), ([], "empty"), ([(S, "s")], "system alone"), ([(S, "s"), (A, "a")], "roles"), ([(U, "u"), (U, "u")], "roles"), ([(None, "u")], "roles"), ([(U, None)], "content"), ([(U, "u"), (A, "a")], None)],
)
def test_why_it_cannot_be_rendered(spark, messages, fault):
    assert one(spark, messages, chat.renderable) == fault


@pytest.mark.parametrize(("messages", "good"), [(None, False), ([(U, "a")], False), ([(U, "a"), (A, "b")], True), ([(A, "a"), (U, "b")], False), ([(U, "a"), (A, None)], False)])
def test_taking_turns(spark, messages, good):
    assert one(spark, messages, chat.alternates) is good


@pytest.mark.parametrize(
    ("messages", "t", "k", "n", "fault"),
    [
        (None, 1.0, 1, 1, "none"), ([], 1.0, 1, 1, "none"), ([(U, "a")] * 501, 1.0, 1, 1, "many"), ([(U, "a"), (A, "")], 1.0, 1, 1, "empty 1"), ([(U, "a" * 8001)], 1.0, 1, 1, "long 0"), ([(U, "a" * 8000)] * 5, 1.0, 1, 1, "total"),
        ([(S, "a")], 1.0, 1, 1, "role"), ([(U, "a")], 2.5, 500, 0, "temperature"), ([(U, "a")], 2.0, 201, 0, "top_k"), ([(U, "a")], None, None, 0, "max_tokens"), ([(U, "a")], None, 0, 4096, None),
    ],
)
def test_first_limit_broken(spark, messages, t, k, n, fault):
    rows = spark.createDataFrame([(messages, t, k, n)], f"m {M}, t double, k int, n int")
    assert rows.select(chat.request_fault(F.col("m"), F.col("t"), F.col("k"), F.col("n")).alias("x")).first()["x"] == fault


def test_targets_end_where_padding_begins(spark):
    rows = spark.createDataFrame([([1, 2, 3, 9, 9], [0, 1, 1, 1, 1])], "t array<int>, m array<int>")
    inputs, targets = chat.inputs_and_targets(F.col("t"), F.col("m"), F.lit(3))
    got = rows.select(inputs.alias("i"), targets.alias("t")).first()
    assert got.i == [1, 2, 3, 9] and got.t == [2, 3, -1, -1]


TALKS = "k int, m array<struct<role: string, content: string, parts: array<struct<type: string, text: string>>>>"


def render(spark, talks, **options):
    df = spark.createDataFrame([(k, [(r, *((None, c) if isinstance(c, list) else (c, None))) for r, c in t] if t is not None else None) for k, t in enumerate(talks)], TALKS)
    return {r.k: (r.ids, r["mask"]) for r in chat.render_tokens(df, "k", "m", **options).collect()}


def test_tokens_of_talks(spark):
    parts = [("text", "a"), ("python", "1"), ("python_output", "2"), ("text", "b")]
    got = render(spark, [[(U, "h"), (A, "y")], [(S, "s"), (U, "u"), (A, parts)], [(U, "é")], [(U, ""), (A, "")]])
    assert got[0] == ([256, 257, 104, 258, 259, 121, 260], [0, 0, 0, 0, 0, 1, 1])
    assert got[1] == ([256, 257, 115, 10, 10, 117, 258, 259, 97, 261, 49, 262, 263, 50, 264, 98, 260], [0] * 8 + [1, 1, 1, 1, 0, 0, 0, 1, 1])
    assert got[2] == ([256, 257, 195, 169, 258], [0] * 5) and got[3] == ([256, 257, 258, 259, 260], [0, 0, 0, 0, 1])


def test_talks_that_have_no_tokens(spark):
    bad = [None, [], [(S, "s")], [(S, "s"), (A, "a")], [(A, "a")], [(U, "u"), (U, "u")], [(U, None)], [(S, None), (U, "u")], [(None, "u")], [(U, "u"), (A, [("image", "x")])], [(U, [("python", "1")])]]
    assert set(render(spark, bad).values()) == {(None, None)}
    assert set(render(spark, [[(U, "u")], [], None], completion=True).values()) == {(None, None)}


def test_tokens_by_merges_and_cuts(spark):
    merges = [(104, 104), (256, 104)]  # hh, hhh
    got = render(spark, [[(U, "hhhhh"), (A, "h")]], merges=merges)
    assert got[0] == ([258, 259, 256, 257, 260, 261, 104, 262], [0, 0, 0, 0, 0, 0, 1, 1])
    assert render(spark, [[(U, "x" * 100), (A, "y")]], most=50, completion=True)[0][0][-2:] == [120, 259]
    assert len(render(spark, [[(U, "x" * 100), (A, "y")]], most=50)[0][0]) == 50


def test_messages_are_gathered_once(spark):
    rows = spark.createDataFrame([(1, 1, A, "b"), (1, 0, U, "a"), (1, 0, U, "a"), (2, 0, U, None), (None, 0, U, "x"), (3, None, U, "x")], "conv_id int, turn int, role string, content string")
    assert {r.conv_id: [tuple(m) for m in r.messages] for r in chat.gathered(rows).collect()} == {1: [(U, "a"), (A, "b")], 2: [(U, None)]}

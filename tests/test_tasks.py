import pytest
from pyspark.sql import functions as F

from quern.operators import bpe, series, tasks
from quern.sources.schemas import TASKS


def rows(spark, kind, *values):
    return spark.createDataFrame(list(values), TASKS[kind][0])


def test_conversations_of_each_kind(spark):
    got = tasks.labelled_conversations(rows(spark, "labelled_choice", ("q", (["x", "y"], ["1", "2"]), "2"))).first()
    assert got.messages[1].content == "2" and got.messages[0].content.startswith("Multiple Choice question: q\n- x=1\n- y=2\n")
    with pytest.raises(Exception, match="no such letter"):
        tasks.labelled_conversations(rows(spark, "labelled_choice", ("q", (["x"], ["1"]), "9"))).collect()
    got = tasks.indexed_conversations(rows(spark, "indexed_choice", ("q", list("wxyz"), 2, "s"))).first()
    assert got.messages[1].content == "C" and got.subject == "s"
    with pytest.raises(Exception, match="four choices"):
        tasks.indexed_conversations(rows(spark, "indexed_choice", ("q", ["w"], 0, "s"))).collect()
    assert tasks.program_conversations(rows(spark, "program", ("p", "s", "e", "t"))).first().messages[1].content == "p\ns"
    assert [p.type for p in tasks.problem_conversations(rows(spark, "word_problem", ("q", "a <<1=1>>"))).first().parts] == ["text", "python", "python_output", "text"]


def test_few_shots_never_hold_the_item(spark):
    items = spark.createDataFrame([(k, k % 3) for k in range(20)] + [(99, 9)], "item_id int, task int")
    got = tasks.few_shot(items, "item_id", "task", 3).collect()
    assert len(got) == 60 and all(r.item_id != r.other and r.item_id % 3 == r.other % 3 for r in got)
    assert len({(r.item_id, r.other) for r in got}) == 60


def test_accumulation_needs_a_multiple():
    assert series.accumulation(524288, 32, 2048, 8) == 1
    with pytest.raises(ValueError):
        series.accumulation(1000, 32, 2048, 8)


def test_interpolation_is_level_beyond_the_ends(spark):
    points = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 20.0)], "g int, x double, y double")
    wanted = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 1.0), (1, 5.0)], "g int, at double")
    assert {r["at"]: r.y for r in series.interpolated(points, wanted, "g", "x", "y", "at").collect()} == {-1.0: 10.0, 0.0: 10.0, 1.0: 15.0, 5.0: 20.0}


def test_special_ids_and_colours(spark):
    assert bpe.special_id([(97, 98)], "<|bos|>") == 257
    shown = spark.range(1).select(bpe.visualized(F.array(F.lit(97), F.lit(98)), F.array(F.lit(1), F.lit(0)), []).alias("x")).first().x
    assert shown == "\x1b[92ma\x1b[0m|\x1b[91mb\x1b[0m"
    assert bpe.vocabulary_table(spark, [], zero_specials=False).where("special").first().n_bytes == 7
    specials, merges = bpe.byte_fallback_vocabulary([(97, 98)])
    assert specials["<|bos|>"] == 0 and merges == [(106, 107)]


def test_attention_windows(spark):
    row = spark.range(1).select(series.windows(F.lit(6), "SSSL", 2048).alias("w")).first()
    assert row.w == [512, 512, 512, 2048, 512, 2048]
    with pytest.raises(ValueError):
        series.windows(F.lit(6), "SX", 2048)


def test_examples_stand_before_each_item(spark):
    from quern.operators import scoring

    rows = [(k, "m", "multiple_choice", f"q{k}?", ["a", "b"], k % 2, None, None, None) for k in range(3)]
    rows += [(10 + k, "s", "schema", None, None, 1, None, ["x", f"y{k}"], "go") for k in range(2)]
    rows += [(20 + k, "l", "language_modeling", None, None, None, f" c{k} ", None, f"e{k}") for k in range(2)]
    items = spark.createDataFrame(rows, "item_id long, task string, icl_task_type string, query string, choices array<string>, gold int, context string, context_options array<string>, continuation string")
    settings = spark.createDataFrame([("m", 2, ": "), ("s", 5, " "), ("l", 1, "-")], "label string, num_fewshot int, continuation_delimiter string")
    got = {(r.item_id, r.option): (bytes(r.ids[1:]).decode(), r.start) for r in scoring.option_rows(items, settings=settings).collect()}
    order = [r.other for r in tasks.few_shot(items, "item_id", "task", 2).where("item_id = 0").orderBy("shot").collect()]
    head = "".join(f"q{k}?: {'ab'[k % 2]}\n\n" for k in order)
    assert sorted(order) == [1, 2] and got[0, 1] == (head + "q0?: b", len(head) + 6)
    assert got[10, 0][0] == "y1 go\n\nx go"
    assert got[20, 1] == ("c1-e1\n\nc0-e0", 11)

import pytest
from pyspark.sql import functions as F

from quern.operators import protocol as P
from quern.operators import tasks

TALK = "messages array<struct<role: string, content: string>>, letters array<string>, k int"


class Fixed:
    """Scores tokens by a table, and says the same to every prompt."""

    def __init__(self, scores, says):
        self.scores, self.says = scores, says

    def score(self, ids, token):
        return F.create_map(*(F.lit(x) for pair in self.scores.items() for x in pair))[token]

    def complete(self, prompts, n):
        return prompts.select("idx", F.posexplode(F.array(*map(F.lit, self.says[:n]))).alias("sample", "completion"))


def talk(question, answer):
    return [("user", question), ("assistant", answer)]


def choices(spark, *answers):
    return P.task_of("labelled_choice", spark.createDataFrame([(talk(f"q{k}", a), ["A", "B"], k) for k, a in enumerate(answers)], TALK), [F.col("k")])


def test_letters_in_order_on_ties(spark):
    task = choices(spark, "A", "B", "B")
    same = P.evaluate_letters(task, P.BytePairs(), Fixed({65: 1, 66: 1}, [])).collect()
    assert {r.idx: (r.letter, r.correct) for r in same} == {0: ("A", 1), 1: ("A", 0), 2: ("A", 0)}
    assert P.evaluate(task, P.BytePairs(), Fixed({65: 1, 66: 2}, [])).first().accuracy == pytest.approx(2 / 3)


def test_slices_are_views(spark):
    task = choices(spark, *"ABABAB").sliced(1, None, 2)
    assert sorted((r.idx, r.k) for r in task.view().collect()) == [(0, 1), (1, 3), (2, 5)]
    with pytest.raises(ValueError):
        task.sliced(-1).view()
    with pytest.raises(ValueError):
        P.task_of("unknown", task.rows, [])


def test_any_of_the_completions(spark):
    rows = spark.createDataFrame([(talk("1+1", "so #### 2"), None, 0), (talk("?", "none"), None, 1), ([("user", "open")], None, 2)], TALK)
    task = P.task_of("word_problem", rows, [F.col("k")])
    got = {r.idx: (r.passed, r.right) for r in P.evaluate_samples(task, P.BytePairs(), Fixed({}, ["no", "#### 2", "#### 2.0"]), 3).collect()}
    assert got == {0: (1, 1), 1: (1, 1)}
    assert P.evaluate(task, P.BytePairs(), Fixed({}, ["no", "#### 2"]), 1).first().passed == 1


def test_letters_must_be_tokens():
    assert P.BytePairs([(65, 66)]).token("AB") == 256
    with pytest.raises(ValueError):
        P.BytePairs().token("AB")


def test_tasks_mixed_and_in_turn(spark):
    a, b = choices(spark, "A", "B"), choices(spark, "A")
    turn = [(r.position, r.idx) for r in P.in_turn([a, b, b]).orderBy("position").collect()]
    assert turn == [(0, 0), (1, 1), (2, 0), (3, 0)]
    assert sorted(r.position for r in P.mixed([a, b, b]).collect()) == [0, 1, 2, 3]


def test_empty_task(spark):
    task = P.task_of("labelled_choice", spark.createDataFrame([], TALK), [F.col("k")])
    assert P.evaluate_letters(task, P.BytePairs(), Fixed({65: 1}, [])).collect() == []


def test_word_problems_are_rendered_with_their_calls(spark):
    rows = spark.createDataFrame([("q", "a <<1=1>>")], "question string, answer string")
    own = tasks.problem_conversations(rows).withColumn("k", F.lit(1))
    from quern.operators.chat import render_tokens

    ids = render_tokens(own, "k", "messages").first().ids
    assert ids == [256, 257, 113, 258, 259, 97, 32, 261, 49, 262, 263, 49, 264, 260]


def test_categories_are_as_likely(spark):
    got = tasks.diverse_by_category(spark.range(3000), "id", "t", {"a": ["x"], "b": [str(k) for k in range(50)]})
    n = {r[0]: r[1] for r in got.groupBy("t_category").count().collect()}
    assert abs(n["a"] - 1500) < 150 and got.where("t_category = 'a' and t <> 'x'").count() == 0

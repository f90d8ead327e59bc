import pytest
from pyspark.sql import functions as F

from quern.functions import nn
from quern.functions import text as T
from quern.operators import evals, order, tasks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "tokens"), [("12345", ["12", "34", "5"]), ("x　　!", ["x", "　", "　", "!"]), ("a  b \n\n c", ["a", " ", " b", " \n\n", " c"]), ("", [])])
def test_pretokens(spark, text, tokens):
    assert one(spark, T.pretokens(F.lit(text))) == tokens


def test_null_text(spark):
    assert one(spark, T.pretokens(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("text", "answer"), [("#### -1,234.5 ok", "-1234.5"), ("no marker", None), ("####5", None), ("a #### 3 #### 4", "3")])
def test_final_answer(spark, text, answer):
    assert one(spark, T.final_answer(F.lit(text))) == answer


@pytest.mark.parametrize(("text", "parts"), [("x <<1+2=3>>3", [("text", "x "), ("python", "1+2"), ("python_output", "3"), ("text", "3")]), ("<<7>>", [("text", ""), ("python", "7"), ("python_output", ""), ("text", "")]), ("<<a=b=c>>", [("text", ""), ("python", "a=b"), ("python_output", "c"), ("text", "")])])
def test_tool_parts(spark, text, parts):
    assert [tuple(p) for p in one(spark, T.tool_parts(F.lit(text)))] == parts


def test_programs(spark):
    assert one(spark, T.program_of(F.lit("so\n```python\n a = 1\n```\n```\nb\n```"))) == "a = 1"
    assert one(spark, T.program_of(F.lit(" plain "))) == "plain"
    assert one(spark, T.leading_imports(F.lit("import a\n# c\n\nfrom b import c\nx = 1\nimport d"))) == "import a\nfrom b import c"


def test_grading_and_spelling(spark):
    assert one(spark, tasks.grade_number(F.lit("none"), F.lit("nothing"))) == 1
    assert one(spark, tasks.grade_number(F.lit("#### 1,000"), F.lit("#### 1000"))) == 1
    assert one(spark, tasks.grade_number(F.lit("#### 1"), F.lit("x"))) == 0
    assert one(spark, tasks.spelling_transcript(F.lit("abca"), F.lit("a"))) == "1:a hit! count=1\n2:b\n3:c\n4:a hit! count=2"
    assert len(tasks.TEMPLATES) == 51


@pytest.mark.parametrize(("a", "b", "head", "tail"), [([1, 2, 3], [1, 2, 4, 5], 2, 0), ([1, 9], [2, 9], 0, 1), ([1, 2], [1, 2, 3], 2, 0), ([], [1], 0, 0)])
def test_common_ends(spark, a, b, head, tail):
    x, y = (F.array(*map(F.lit, v)).cast("array<int>") for v in (a, b))
    assert one(spark, tasks.common_prefix(x, y)) == head and one(spark, tasks.common_suffix(x, y)) == tail


@pytest.mark.parametrize(("text", "value"), [("1,000+1", "1001"), ("2**3", None), ("'aba'.count('a')", "2"), ("__import__", None), ("1/0", None), ("(2+3)*4-1", "19"), ("7//2", "3"), ("'a'*3", None), ("", None), ("'a,b'.count(',')", "3"), (None, None), ("9" * 5000 + "*1", None), ("'x'.count", None)])
def test_calculator(text, value):
    assert evals.calculate(text) == value


def test_programs_run_apart():
    assert evals.run_program("print(1 + 1)")[:2] == (True, "2\n")
    assert evals.run_program("raise ValueError('no')")[2] == "ValueError: no"
    assert evals.run_program("while True: pass", seconds=1)[3]
    assert evals.run_program("x = bytearray(10 ** 9)")[4]


def test_execute_in_batches(spark):
    rows = spark.createDataFrame([(1, "print('a')"), (2, "1/0"), (3, None)], "id bigint, code string")
    got = {r.id: r for r in evals.execute(rows, "id", "code").collect()}
    assert got[1].stdout == "a\n" and not got[2].success and got[3].success


def test_ties_in_sampling(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.0)], "r int, t int, x double")
    count = lambda **k: evals.top_k_probabilities(rows, "r", "t", "x", temperature=k.pop("temperature", 1.0), **k).count()
    assert count(k=2) == 2 and count(k=2, keep_ties=True) == 3 and count(k=0) == 4 and count(k=9) == 4 and count(k=2, temperature=0) == 1


def test_safe_prefix():
    assert evals.safe_prefix("ab�", 1) == ("", 1) and evals.safe_prefix("abé", 1) == ("bé", 3)


def test_slices(spark):
    rows = spark.range(10).withColumnRenamed("id", "i")
    assert sorted(r.i for r in order.slice_view(rows, "i", 5, 10, 2).collect()) == [5, 7, 9]
    assert order.slice_length(5, 10, 2) == 3 and order.slice_length(5, 50, 2) == 23
    with pytest.raises(ValueError):
        order.slice_view(rows, "i", -1)


def test_budget_takes_the_crossing_row(spark):
    rows = spark.createDataFrame([(k, "abcd") for k in range(3)], "k int, t string")
    assert sorted(r.k for r in order.char_budget(rows, "t", [F.col("k")], 10, 7).collect()) == [0, 1]
    assert order.char_budget(rows.limit(0), "t", [F.col("k")], 10, 7).collect() == []


def test_running_over_many_partitions(spark):
    rows = spark.range(1000).repartition(7)
    got = order.running(rows, [-F.col("id")], F.col("id")).collect()
    assert all(r.pos == 999 - r.id for r in got)
    assert {r.id: r.upto for r in got}[998] == 999 + 998


def test_array_formulas(spark):
    import math

    x = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert one(spark, nn.cross_entropy(x, F.lit(2))) == pytest.approx(math.log(sum(math.exp(v - 3) for v in (1, 2, 3))))
    assert one(spark, nn.cross_entropy(x, F.lit(-1))) is None
    assert one(spark, nn.rms_norm(x)) == pytest.approx([v / math.sqrt(14 / 3) for v in (1, 2, 3)])
    assert one(spark, nn.relu_squared(F.array(F.lit(-1.0), F.lit(3.0)))) == [0.0, 9.0]


def test_matrix_formulas():
    import numpy as np

    rng = np.random.default_rng(0)
    g = rng.normal(size=(8, 5))
    singular = np.linalg.svd(nn.orthogonal(g), compute_uv=False)
    assert singular.min() > 0.6 and singular.max() < 1.4
    v = rng.normal(size=16)
    assert np.linalg.norm(nn.rotated(v, 9)) == pytest.approx(np.linalg.norm(v)) and (nn.rotated(v, 0) == v).all()
    assert nn.windowed_mask(4, 1).sum() == 7 and nn.windowed_mask(4, -1).sum() == 10
    p, first, second = nn.adamw(np.ones(3), np.ones(3), np.zeros(3), np.zeros(3), 1, 0.1, (0.9, 0.99), 1e-10, 0.0)
    assert p == pytest.approx([0.9] * 3)
    q, scale = nn.quantised(g)
    assert np.abs(q * scale - g).max() <= np.abs(g).max() / 8
    p, *_ = nn.muon(np.zeros((8, 5)), g, np.zeros((8, 5)), np.zeros((8, 1)), 0.02, 0.95, 0.9, 0.0)
    assert p.shape == (8, 5) and np.isfinite(p).all()


def test_training_on_the_cluster_keeps_every_word(spark):
    from quern.operators import bpe

    texts = ["aaaa abab the then", "zq zq zr qz aba", "he hen then other 12 34", "ab ba ab ba", "xyxyxy xyx aaa"] + [f"w{chr(97 + k)}x{chr(97 + k)}" for k in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = bpe.train(df, 256 + len(bpe.SPECIALS) + 60)
    assert len(whole) > 30 and bpe.train(df, 256 + len(bpe.SPECIALS) + 60, most_words=3) == whole


def test_rounds_of_merges_are_those_one_by_one():
    import random
    from collections import Counter

    from quern.operators import bpe

    rng = random.Random(3)
    for _ in range(300):
        counts = {"".join(rng.choice("aaabcd") for _ in range(rng.randint(1, 9))): rng.randint(1, 4) for _ in range(rng.randint(1, 12))}
        words, out = [(list(w.encode()), n) for w, n in counts.items()], []
        while len(out) < 25:
            totals = Counter()
            for ids, n in words:
                for pair in zip(ids, ids[1:], strict=False):
                    totals[pair] += n
            top = sorted(((*p, n) for p, n in totals.items()), key=lambda x: (-x[2], x[:2]))
            few = rng.choice([3, 1000])
            own = bpe.first_merges(top[:few], 25 - len(out), len(top) < few)
            if not own:
                break
            for pair in own:
                words = [(bpe.merge(ids, pair, 256 + len(out)), n) for ids, n in words]
                out.append(pair)
        assert out == bpe.learn_merges(counts, 25)


def test_steps_of_the_matrix_optimizer():
    import math

    import numpy as np

    from quern.functions import nn

    ahead, mean = nn.nesterov(np.array([1.0, 2.0]), np.array([0.0, 4.0]), 0.5)
    assert mean.tolist() == [0.5, 3.0] and ahead.tolist() == [0.75, 2.5]
    update = np.array([[3.0, 4.0], [0.6, 0.8], [0.3, 0.4]])
    even, second = nn.even_variance(update, np.zeros((3, 1)), 0.0)
    assert second.ravel().tolist() == pytest.approx([12.5, 0.5, 0.125])
    assert np.linalg.norm(even) == pytest.approx(np.linalg.norm(update)) and np.linalg.norm(even, axis=1) == pytest.approx([np.linalg.norm(update) / math.sqrt(3)] * 3)
    assert nn.even_variance(update.T, np.zeros((1, 3)), 0.5)[1].ravel().tolist() == pytest.approx([6.25, 0.25, 0.0625])
    assert nn.cautious(np.array([1.0, 1.0, 0.0]), np.array([2.0, -2.0, 1.0]), 0.1, 0.5).tolist() == pytest.approx([0.75, 1.2, -0.1])
    p, buffer, second = nn.muon(np.zeros((4, 2)), np.ones((4, 2)), np.zeros((4, 2)), np.zeros((4, 1)), 1.0, 0.0, 0.0, 0.0)
    assert buffer.tolist() == np.ones((4, 2)).tolist() and np.ptp(p) < 1e-9 and p[0, 0] < 0


def test_pieces_of_the_forward_pass():
    import numpy as np

    from quern.functions import nn

    v = nn.with_value_embedding(np.ones((2, 1, 3)), np.full((2, 1, 3), 2.0), np.array([[0.0], [100.0]]))
    assert v[0].ravel().tolist() == pytest.approx([4.0] * 3) and v[1].ravel().tolist() == pytest.approx([7.0] * 3)
    assert nn.smeared(np.array([[1.0], [2.0], [4.0]]), np.array([9.0, 0.0, 0.0]), 0.5).ravel().tolist() == pytest.approx([1.0, 2.25, 4.5])
    out = nn.trunk(np.array([1.0]), [lambda x: x + 1, lambda x: x * 2, lambda x: x], [1.0, 1.0, 0.5], [0.0, 1.0, 0.0], 0.25)
    assert out.tolist() == [1.5]  # 2, 6 (half-way), 3; less a quarter of 6
    assert nn.trunk(np.array([1.0]), [], [], [], 0.5).tolist() == [1.0] and nn.initial_bound(3) == 1.0 and nn.initial_bound(12, 0.4) == pytest.approx(0.2)

"""Operators that work by ranges and blocks, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bpe, order, series, tasks, vectors


@pytest.mark.parametrize(("beta", "late"), [(0.9, 0), (0.99, 1)])
def test_means_of_long_runs_in_many_ranges(spark, beta, late):
    rng = random.Random(3)
    rows = [(run, step, rng.choice([None, rng.uniform(-5, 5), rng.uniform(-5, 5)]), step) for run, n in (("hot", 3000), ("b", 1), ("c", 40), (None, 5)) for step in range(n)]
    want, held = {}, {}
    for run, step, x, _ in rows:
        total, n = held.get(run, (0.0, 0))
        if x is not None:
            total, n = beta * total + (1 - beta) * x, n + 1
            held[run] = total, n
        want[run, step] = None if x is None else total / (1 - beta ** (n + late))
    df = spark.createDataFrame(rows, "run string, step int, value double, _p int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = series.smoothed(df.drop("_p"), ["run"], "step", "value", beta, late).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    for r in got:
        assert r.ema == pytest.approx(want[r.run, r.step]) if want[r.run, r.step] is not None else r.ema is None
    assert series.smoothed(df.drop("_p").limit(0), ["run"], "step", "value").collect() == []


@pytest.mark.parametrize("at_once", [2, 1000])
def test_nearest_in_blocks(spark, at_once):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(size=6).round(2).tolist() for k in range(60)} | {60: [0.0] * 6, 61: None, 62: [1.0] * 6, 63: [2.0] * 6}
    rows = [(k, v, "x") for k, v in data.items()]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, query string").repartition(5)
    got = vectors.nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 4, at_once).collect()
    unit = {k: (np.array(v) / np.linalg.norm(v) if v and any(v) else np.zeros(6)) for k, v in data.items()}
    for q in (0, 20, 40, 60):
        best = sorted((k for k in data if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]) * 1e6), k))[:4]
        assert [r.vec_id for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == best
    assert vectors.nearest(df.limit(0), df.limit(0), "vec_id", "embedding", 4).collect() == []


def test_fits_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(x), float(2 * x * x - 3 * x + 5 + g + rng.normal() * 0.01)) for g in range(3) for x in rng.uniform(90, 110, 200)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    for r in series.quadratic_fit(df, "g", F.col("x"), F.col("y")).collect():
        xs, ys = zip(*[(x, y) for g, x, y in rows if g == r.g], strict=True)
        assert [r.a, r.b, r.c] == pytest.approx(np.polyfit(xs, ys, 2), rel=1e-3)
    one = series.quadratic_fit(df.limit(1), "g", F.col("x"), F.col("y")).first()
    assert one.a is None
    first, second = series.ridge(df, ["x", "g"], "y", [0.0, 10.0])
    a = np.array([[1, x, g] for g, x, _ in rows])
    assert first == pytest.approx(np.linalg.lstsq(a, np.array([y for *_, y in rows]), rcond=None)[0], rel=1e-6) and abs(second[2]) < abs(first[2])


def test_boundaries_of_shards(spark):
    rng = random.Random(4)
    sizes = [rng.randint(0, 9) for _ in range(503)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, n int").repartition(6)
    shard = held = 0
    want, open_ = {}, []
    for k, n in enumerate(sizes):
        held += n
        open_.append(k)
        if (k + 1) % 8 == 0 and held >= 60:
            want |= dict.fromkeys(open_, shard)
            shard, held, open_ = shard + 1, 0, []
    got = {r.id: r.shard for r in order.shard_boundaries(df, [F.col("id")], F.col("n"), 60, 8).collect()}
    assert got == want and len(want) < 503
    assert order.shard_boundaries(df.limit(0), [F.col("id")], F.col("n"), 60, 8).collect() == []


def test_word_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_HELD", 3)
    texts = [("en", "a b a"), (None, "a b c d e f"), ("en", ""), ("de", None), (None, "a a"), ("en", "b")]
    df = spark.createDataFrame(texts * 20, "lang string, text string")
    got = {(r.lang, r.word): r.n for r in bpe.word_counts(df, by=("lang",)).collect()}
    want: Counter = Counter()
    for lang, t in texts * 20:
        for k, w in enumerate((t or "").split()):
            want[lang, (" " if k else "") + w] += 1
    assert got == dict(want)
    assert bpe.word_counts(df.limit(0)).collect() == []


def test_shots_of_one_group_that_holds_most(spark):
    items = spark.createDataFrame([(k, "hot" if k % 5 else f"g{k}") for k in range(400)] + [(900, None)], "item_id int, task string").repartition(6)
    got = tasks.few_shot(items, "item_id", "task", 2).collect()
    hot = [r for r in got if r.item_id % 5]
    assert len(hot) == 640 and all(r.item_id != r.other and r.other % 5 for r in hot) and len(got) == 640
    assert Counter(r.other for r in hot) == Counter({k: 2 for k in range(400) if k % 5})


def test_mean_centered_needs_all_tasks(spark):
    from quern.operators.evals import mean_centered

    rows = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 1.0), ("y", "a", 0.25), ("x", "c", 0.0)], "m string, t string, acc double")
    got = mean_centered(rows, ["m"], "t", F.col("acc"), F.lit(0.25), ["a", "b"]).collect()
    assert [(r.m, round(r["mean"], 6)) for r in got] == [("x", round((1 / 3 + 1) / 2, 6))]
    assert math.isclose(mean_centered(rows, ["m"], "t", F.col("acc"), F.lit(0.0), ["a"]).where("m = 'y'").first()["mean"], 0.25)

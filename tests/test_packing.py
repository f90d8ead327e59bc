import random

import pytest
from pyspark.sql import functions as F

from quern.operators import packing as P


def naive(lengths, capacity, policy, buffer_size, refill=1):
    """The same policy by scanning the whole buffer."""
    source, buffer, open_ = iter(enumerate(lengths)), [], True
    row = used = 0
    while True:
        while open_ and len(buffer) < buffer_size:
            for _ in range(refill):
                item = next(source, None)
                open_ = item is not None
                if open_ and (policy == "crop" or item[1] <= capacity):
                    buffer.append(item)
        if not buffer:
            return
        fitting = [x for x in buffer if x[1] <= capacity - used]
        if fitting:
            best = max(x[1] for x in fitting)
            item = next(x for x in buffer if x[1] == best)
            yield row, item[0], used, item[1]
            used += item[1]
        elif policy == "crop":
            least = min(x[1] for x in buffer)
            item = next(x for x in buffer if x[1] == least)
            yield row, item[0], used, capacity - used
            used = capacity
        else:
            item, used = None, capacity
        if item:
            buffer.remove(item)
        if used == capacity:
            row, used = row + 1, 0


@pytest.mark.parametrize("policy", ["crop", "pad"])
def test_same_as_scanning_the_buffer(policy):
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(1, 25) for _ in range(rng.randint(0, 80))]
        assert list(P.pack(iter(lengths), 20, policy, 7)) == list(naive(lengths, 20, policy, 7))
        assert list(P.pack(iter(lengths), 20, policy, 7, 5)) == list(naive(lengths, 20, policy, 7, 5))


def test_golden_rows():
    rows = list(P.pack(iter([4, 7, 6, 6, 12]), 10, "crop", 100))
    assert rows[:2] == [(0, 1, 0, 7), (0, 0, 7, 3)]
    assert next(iter(P.pack(iter([4, 7, 6, 6, 12]), 10, "pad", 100))) == (0, 1, 0, 7)


def test_first_fit_never_overfills():
    rng = random.Random(2)
    lengths = [rng.randint(1, 40) for _ in range(200)]
    rows = {}
    for row, _, start, used in P.pack(iter(lengths), 30, "first_fit", 0):
        assert rows.get(row, 0) == start
        rows[row] = start + used
    assert max(rows.values()) <= 30


def test_first_fit_is_the_first_row_with_room():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 70))]
        rows = []
        for row, arrival, start, used in P.pack(iter(lengths), 30, "first_fit", 0):
            assert used == lengths[arrival] and row == next((k for k, r in enumerate(rows) if r + used <= 30), len(rows))
            rows += [0] * (row == len(rows))
            assert start == rows[row]
            rows[row] += used


def test_rows_themselves(spark):
    df = spark.createDataFrame([(0, 1, [7, 7, 7], [0, 1, 1]), (0, 2, [8] * 6, [1] * 6), (0, 3, [9] * 2, [0, 1]), (1, 4, [5], [1])], "shard int, key int, t array<int>, m array<int>")
    sized = df.withColumn("n", F.size("t"))
    pad = P.assembled(P.packed(sized, "shard", "key", "n", 8, "pad"), df, "key", "t", "m", 8, 0)
    assert {(r.shard, r.row): (r.tokens, r["mask"], r.content) for r in pad.collect()} == {(0, 0): ([8] * 6 + [9] * 2, [1] * 6 + [0, 1], 8), (0, 1): ([7] * 3 + [0] * 5, [0, 1, 1] + [0] * 5, 3), (1, 0): ([5] + [0] * 7, [1] + [0] * 7, 1)}
    crop = P.assembled(P.packed(sized, "shard", "key", "n", 7, "crop"), df, "key", "t", None, 7, 0)
    assert {(r.shard, r.row): r.tokens for r in crop.where("content = 7").collect()} == {(0, 0): [8] * 6 + [9]}


def test_bad_policy(spark):
    with pytest.raises(ValueError):
        P.packed(spark.range(1), "id", "id", "id", 4, "other")


def test_pad_counts_what_it_leaves_out(spark):
    df = spark.createDataFrame([(0, 1, 6), (0, 2, 30), (0, 3, 4), (1, 4, 20)], "shard int, key int, n int")
    rows = P.packed(df, "shard", "key", "n", 10, "pad")
    assert {(r.key, r.length, r.used) for r in rows.where("row is null").collect()} == {(2, 30, 0), (4, 20, 0)}
    got = P.waste(rows, 10).first()
    assert got.rows == 1 and got.utilisation == 100 and abs(got.cropped - 50 / 60 * 100) < 1e-9

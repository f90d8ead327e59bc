import itertools
import random
from collections import Counter, defaultdict

import pytest

from quern.llm import pack

SPECS = "spec_id int, unit string, capacity bigint"


def test_fill_one_reaches_the_best_sum():
    rng = random.Random(1)
    for _ in range(300):
        counts = dict(Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9))))
        lengths = sorted(counts, reverse=True)
        chosen = pack.fill_one(40, lengths, counts)
        items = list(Counter(counts).elements())
        items.remove(lengths[0])
        best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= 40 - lengths[0])
        assert sum(k * n for k, n in chosen.items()) == lengths[0] + best
        assert all(counts[k] >= n for k, n in chosen.items())


@pytest.mark.parametrize("broadcast", [2_000_000, 3])
def test_every_text_once_whole_and_in_order(spark, broadcast):
    rng = random.Random(2)
    texts = ["é日a👍"[rng.randint(0, 3)] * rng.randint(1, 70) for _ in range(200)] + [None, "", " ", "ok."] + ["same"] * 40 + ["aé日👍" * 30]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, spec_id int")
    specs = spark.createDataFrame([(1, "chars", 20), (2, "bytes", 50), (2, "bytes", 50)], SPECS)
    got = pack.fill_containers(rows, specs, broadcast_steps=broadcast).collect()
    whole = defaultdict(list)
    fill = Counter()
    for r in got:
        whole[r.spec_id, r.doc_id].append((r.piece, r.start, r.size))
        fill[r.spec_id, r.container_id] += r.size
    for spec, unit, cap in ((1, "chars", 20), (2, "bytes", 50)):
        assert max(n for (s, _), n in fill.items() if s == spec) <= cap
        for i, text in enumerate(texts):
            data = text if unit == "chars" else (text or "").encode()
            own = sorted(whole.pop((spec, i), []))
            if not text:
                assert not own
                continue
            parts = [data[start : start + size] for _, start, size in own]
            assert b"".join(parts) == data if unit == "bytes" else "".join(parts) == data
            assert len(own) == 1 or len(data) > cap
            assert all(p.decode() for p in parts) if unit == "bytes" else all(parts)
    assert not whole
    usage = {r.spec_id: r for r in pack.unused_space(pack.fill_containers(rows, specs), specs).collect()}
    assert usage[1].containers == len({c for s, c in fill if s == 1})
    assert usage[1].unused_share < 0.1 and usage[2].unused_share < 0.1


def test_places_depend_on_the_rows_alone(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([7, 7, 7, 5, 3, 30])) for i in range(900)]
    specs = spark.createDataFrame([(1, "chars", 20), (2, "bytes", 13)], SPECS)
    results = []
    for parts, shuffled, steps in ((1, "1", pack.BROADCAST_STEPS), (7, "9", pack.BROADCAST_STEPS), (3, "5", 0)):
        rng.shuffle(rows)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        results.append({tuple(r) for r in pack.fill_containers(df, specs, broadcast_steps=steps).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1] == results[2]


def test_cuts_are_linear_and_at_characters():
    text = "é日a👍" * 50_000
    at = pack.cuts(text.encode(), 10)
    assert all(6 < b - a <= 10 for a, b in zip(at, at[1:-1])) and at[-1] == len(text.encode())
    assert pack.cuts("abcde", 2) == [0, 2, 4, 5] and pack.cuts("ab", 2) == [0, 2]


def test_empty_tables_and_bad_sizes(spark):
    rows = spark.createDataFrame([], "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, "chars", 20)], SPECS)
    assert pack.fill_containers(rows, specs).collect() == []
    assert pack.fill_containers(rows, specs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack.read_specs(spark.createDataFrame([(1, "lines", 20)], SPECS))

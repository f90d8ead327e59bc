from collections import Counter

import pyarrow.parquet as pq
import pytest

from quern.llm import mix as m

MESSAGES = "conv_id bigint, turn int, role string, content string, task string, language string"
TARGETS = "task string, target_share double, max_repeats int"


def test_shortage_goes_to_siblings_before_ancestors():
    root = m.Node()
    root.add(("a", "en", "x"), 0.3, 10.0)  # short
    root.add(("a", "en", "y"), 0.2, 1000.0)
    root.add(("b", "en", "z"), 0.5, 1000.0)
    root.spend(100.0)
    leaf = {k: n.budget for d in root.children.values() for k, n in d.children["en"].children.items()}
    assert leaf == pytest.approx({"x": 10.0, "y": 40.0, "z": 50.0})
    root.spend(1500.0)  # a and its sibling are full: the rest goes up
    leaf = {k: n.budget for d in root.children.values() for k, n in d.children["en"].children.items()}
    assert leaf["x"] == 10.0 and leaf["y"] == pytest.approx(740.0) and leaf["z"] == pytest.approx(750.0)


def test_no_material_and_no_weight():
    root, total = m.budgets([("t", "en", 0.0)], {"t": (0.0, 3), "u": (0.5, 2)}, "material", {})
    assert total == 0.0 and root.budget == 0.0


@pytest.mark.parametrize("total", ["material", "held", 50_000.0])
def test_shares_repeats_and_whole_table(spark, data, total):
    uses, shares = m.mix(spark.read.parquet(f"{data}/chat_messages.parquet"), spark.read.parquet(f"{data}/mixture_targets.parquet"), total)
    rows, per = uses.collect(), {r.task: r for r in shares.collect()}
    raw = {(r["conv_id"], r["turn"]): r for r in pq.read_table(f"{data}/chat_messages.parquet").to_pylist()}
    chars = Counter()
    for (conv, _), r in raw.items():
        chars[conv] += len(r["content"] or "")
    assert {r.conv_id: r.chars for r in rows} == dict(chars)
    assert len(rows) == len(chars)
    for r in rows:
        assert 0 <= r.uses <= (per[r.task].max_repeats if r.task in per else 0)
    assert sum(r.actual_share for r in per.values()) == pytest.approx(1.0)
    got = Counter()
    for r in rows:
        got[r.task] += r.uses * r.chars
    assert all(got[t] == r.mix_chars for t, r in per.items())
    if total == "held":  # each language of a task is off by half a conversation at most
        longest = max(chars.values())
        whole = sum(r.mix_chars for r in per.values())
        assert all(abs(r.actual_share - r.target_share) * whole <= 4 * longest for r in per.values())
    again, _ = m.mix(spark.read.parquet(f"{data}/chat_messages.parquet").repartition(7), spark.read.parquet(f"{data}/mixture_targets.parquet"), total)
    assert {(r.conv_id, r.uses) for r in again.collect()} == {(r.conv_id, r.uses) for r in rows}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, "A b", "q"), (2, 0, "user", "", "a-B", "q"), (3, 0, "user", "xy" * 40, "A_B", "q"), (3, 0, "user", "xy" * 40, "A_B", "q"), (4, 0, None, "hello", None, "q"), (5, 0, "user", "hi", "other", None)], MESSAGES)
    targets = spark.createDataFrame([("a b", 1.0, 2), ("a b", 1.0, 2), (None, 0.5, 1), ("none", None, None)], TARGETS)
    uses, shares = m.mix(rows, targets, 200.0)
    assert {(r.conv_id, r.uses) for r in uses.collect()} == {(1, 0), (2, 0), (3, 2), (4, 0), (5, 0)}
    assert {(r.task, r.mix_chars) for r in shares.collect()} == {("a_b", 160), ("none", 0)}
    uses, shares = m.mix(rows.limit(0), targets.limit(0))
    assert uses.collect() == [] and shares.collect() == []
    with pytest.raises(ValueError):
        m.read_targets(spark.createDataFrame([("a", 1.0, 2), ("A", 0.5, 2)], TARGETS))


def test_domains_from_a_column_of_the_targets(spark):
    rows = spark.createDataFrame([(k, 0, "user", "the cat is on the mat " * 4, task, "q") for k, task in enumerate(["a"] + ["b"] * 40 + ["c"] * 40)], MESSAGES)
    share = {}
    for name, domains in (("near", ["x", "x", "y"]), ("far", ["x", "y", "x"]), ("none", [None] * 3)):
        targets = spark.createDataFrame([(t, s, 1, d) for t, s, d in zip("abc", (0.4, 0.3, 0.3), domains)], TARGETS + ", domain string")
        share[name] = {r.task: r.actual_share for r in m.mix(rows, targets, 40 * 88.0)[1].collect()}
    assert share["near"]["b"] > 0.6 > 0.35 > share["near"]["c"] and share["far"]["c"] > 0.6 > 0.35 > share["far"]["b"]
    assert share["none"]["b"] == pytest.approx(share["none"]["c"], abs=0.03)

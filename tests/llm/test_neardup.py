import random
import re
from itertools import combinations

import numpy as np
import pytest

from quern.llm import neardup as nd


def shingles(text, size, least):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= max(least, size) else set()


def brute(texts, threshold, size, least):
    sets = {i: s for i, t in texts.items() if (s := shingles(t, size, least))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            n += rng.randint(1, 9)
            texts[n] = " ".join(own)
    for extra in (None, "", "   ", "one two three", texts[n], texts[n], texts[n].upper().replace(" ", ", ")):
        n += 1
        texts[n] = extra
    return texts


def test_pairs_against_brute_force(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, id int").repartition(5)
    truth = brute(texts, 0.6, 3, 30)
    got = [(r.a, r.b) for r in nd.pairs(rows, 0.6, 3, 30).collect()]
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(got) >= 0.97 * len(truth) > 50


def roots(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [nd.BUCKET, 2])
def test_groups_are_components(spark, bucket):
    texts = corpus(4)
    rows = spark.createDataFrame(list(texts.items()) + list(texts.items())[-3:] + [(None, "one two three")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in nd.groups(rows, 0.6, 3, 30, bucket=bucket).collect()}
    want = roots(texts, brute(texts, 0.6, 3, 30))
    assert {i: r.group_id for i, r in got.items()} == want
    assert all(r.group_id <= r.class_id <= i for i, r in got.items())


def test_short_texts_are_classed_by_all_their_words(spark):
    texts = {1: "Ok, done", 2: "ok done!", 3: "done ok", 4: "ok", 5: "OK", 6: None, 7: "", 8: "?!", 9: "one two three four five", 10: "one two three four five."}
    got = {r.doc_id: r.class_id for r in nd.groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9}


def test_a_template_filled_many_ways_is_one_group(spark, monkeypatch):
    words = [f"word{k}" for k in range(120)]
    rows = [(k, " ".join([*words[:60], f"x{k}", *words[60:]])) for k in range(1500)]
    sizes = []
    kept = nd._linked
    monkeypatch.setattr(nd, "_linked", lambda pairs, *a: (sizes.append(pairs.count()), kept(pairs, *a))[1])
    got = nd.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert got.where("group_id <> 0 or class_id <> doc_id").count() == 0 and got.count() == 1500
    assert sum(sizes) < 150 * 1500  # of 1.1 million pairs


def test_members_left_by_the_few_are_compared_with_all(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(70):  # a drifting template: neighbours are alike, ends are not
        base[rng.randrange(60)] = f"v{k}"
        texts[k] = " ".join(base)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.group_id for r in nd.groups(rows, 0.6, 3, 1, bucket=3).collect()}
    assert got == roots(texts, brute(texts, 0.6, 3, 1))


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.rep: r.root for r in nd.components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id bigint, text string")
    assert nd.pairs(rows, 0.6, 3, 30).collect() == [] and nd.groups(rows).collect() == []


def test_registers_keep_order_of_magnitude_and_estimate_is_unbiased():
    assert nd.registers(np.array([0x80000000, 0xFFFFFFFF, 1], np.uint32)).tolist() == [0, 1023, 31 << 10]
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, np.uint64)
    k, got = 240, []
    for _ in range(30):
        base = rng.permutation(pool)[:900]
        x, y = (nd.registers(nd.least_hashes(np.sort(s), k)) for s in (base[:600], base[150:750]))
        got.append(nd.estimate(np.array([(x == y).sum()]), k, np.array([600]), np.array([600]))[0])
    assert np.mean(got) == pytest.approx(450 / 750, abs=0.03)

import random

import pytest

from quern.llm import leaks as lk

ITEMS = "item_id bigint, task string, query string, choices array<string>, context string, context_options array<string>, continuation string"
P = "Near Drovna before the tide turned the bell founder handed the sheets of vellum to the map seller because it rained"


def brute(passage, text, least):
    """The same tiles by comparing all places in each round."""
    marks = [set(), set()]
    out = []
    while True:
        best = (0, 0, 0)
        for i in range(len(passage)):
            for j in range(len(text)):
                n = 0
                while i + n < len(passage) and j + n < len(text) and passage[i + n] == text[j + n] >= 0 and i + n not in marks[0] and j + n not in marks[1]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((i, j, n))
        marks[0] |= set(range(i, i + n))
        marks[1] |= set(range(j, j + n))


def test_tiles_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        passage = [rng.randrange(4) for _ in range(rng.randint(1, 18))]
        text = [rng.randrange(-1, 4) for _ in range(rng.randint(0, 25))]
        tiles, slow = lk.tile(passage, text, 3), brute(passage, text, 3)
        assert max((n for *_, n in tiles), default=0) == max((n for *_, n in slow), default=0)
        for i, j, n in tiles:
            assert n >= 3 and passage[i : i + n] == text[j : j + n]
        for side, words in ((0, passage), (1, text)):
            covered = [k for t in tiles for k in range(t[side], t[side] + t[2])]
            assert len(covered) == len(set(covered)) <= len(words)


def test_reordered_halves_are_two_tiles():
    words = list(range(24))
    assert sorted(lk.tile(words, [-1, *words[12:], -1, *words[:12]])) == [(0, 14, 12), (12, 1, 12)]


@pytest.mark.parametrize(
    "text",
    [
        P.upper(),
        P.replace("e", "е").replace("o", "о"),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in P),
        P.replace(" ", "&nbsp;"),
        P.replace(" ", "%20"),
        P.replace("tide", "<b>tide</b>").replace(" the ", "<br/>the "),
        P.replace("tide", "ti​de").replace("founder", "fou­nder"),
        P.replace(" the ", "\\nthe "),
        P.replace("founder", "foun-\nder"),
        P.replace("e", "é"),
        "x " * 3000 + P,
    ],
)
def test_reads_as_a_person(text):
    words = lk.fold_words(P)
    known = lk.Passages([(1, words)], 10)
    ids = known.numbers(lk.fold_words(text))
    assert known.leaks(ids, known.sharing(ids)) == {1: (len(words), 1.0)}


@pytest.mark.parametrize("words", [lk.BROADCAST_WORDS, 0])
def test_both_ways(spark, words):
    own = P.split()
    docs = [(1, "a " + P), (1, "a " + P), (2, None), (3, ""), (4, " ".join(own[:9]) + " x " + " ".join(own[9:18])), (5, "so " + " ".join(own[3:13])), (6, "seven eight " + "one two three four five six seven eight nine ten"), (7, "<p> & % \\"), (None, P)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "doc_id as item_id")
    items = spark.createDataFrame([(7, "t", P, ["z"], None, None, None), (7, "t", P, ["z"], None, None, None), (8, "t", None, None, "one two three four five six", None, "seven eight nine ten"), (9, "t", None, None, None, ["q " + P, None], None), (10, None, None, None, None, None, None), (None, "t", P, None, None, None, None)], ITEMS)
    got = lk.find_leaks(rows, items, broadcast_words=words)
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(found) == {(1, 7), (1, 9), (5, 7), (5, 9), (6, 8)}
    assert found[1, 7].longest == len(own) and found[5, 7].longest == 10 and found[6, 8].coverage == 1.0
    assert {(r.item_id, r.documents) for r in lk.leaked_items(got, items).collect()} == {(7, 2), (8, 1), (9, 2)}
    assert lk.find_leaks(rows.limit(0), items.limit(0), broadcast_words=words).collect() == []


@pytest.mark.parametrize("words", [lk.BROADCAST_WORDS, 0])
def test_reordered_passages_by_coverage(spark, words):
    long = [f"w{k}" for k in range(45)]
    pieces = [long[k : k + 9] for k in range(0, 45, 9)]
    docs = [(1, " and ".join(" ".join(x) for x in reversed(pieces))), (2, " x ".join(" ".join(x) for x in pieces[:3])), (3, " ".join(long)), (4, " ".join(long[:12])), (5, " ".join(w for x in zip(long, long) for w in x)), (6, "w0 w1 w2 " * 30), (7, None), (8, "")]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "t", " ".join(long), None, None, None, None), (8, "t", "w0 w1 w2", None, None, None, None)], ITEMS)
    got = {r.doc_id: (r.item_id, r.longest, round(r.coverage, 3)) for r in lk.find_leaks(rows, items, broadcast_words=words, covered=0.6).collect()}
    assert got == {1: (7, 9, 1.0), 2: (7, 9, 0.6), 3: (7, 45, 1.0)}


def test_repeated_words_cost_no_squares_of_squares():
    tiles = lk.tile([1] * 60, [1] * 20_000)
    assert sorted(tiles) == [(0, 0, 60)]

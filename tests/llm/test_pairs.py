import random

import pytest
from pyspark.sql import functions as F

from quern.llm import pairs as pr

REQUESTS = "request_id bigint, received_at timestamp, messages array<struct<role string, content string>>"
MESSAGES = "conv_id bigint, turn int, role string, content string, task string"


@pytest.mark.parametrize("text", [None, "", " \n", "﻿", "—", "...", "```\n```", "<p></p>", "<br>", '""', "&nbsp;", "* \n* "])
def test_says_nothing(text):
    assert pr.is_empty(text)


@pytest.mark.parametrize("text", ["0", "No.", "<b>D</b>", "👍", "分"])
def test_says_something(text):
    assert not pr.is_empty(text)


def test_a_long_tag_says_nothing():
    assert pr.is_empty("<a " + "x" * 500 + ">") and pr.is_empty("<p>" * 3000)


def test_copies():
    copies = pr.Copies()
    q = "When should the lazy learning rate be reset, and does it depend on the smaller probe?"
    for a in (q, q.upper(), f"> {q}", f"**{q}**", q[5:], q[:-1], q.replace(" ", "  "), q + " ?"):
        assert copies.is_copy(q, a), a
    for a in (f"{q}\n{q}", f"You asked:\n{q}", f"{q} {q}\n{q}"):
        assert copies.is_copy(q, a), a
    context = "For context: the loader reads every shard of the second mirror in order, and the sampler never waits for the disk. "
    assert copies.is_copy(context + q, q) and copies.is_copy(context + q, context + q) and not copies.is_copy(context + q, context + q + " It is reset after each epoch, as far as we can tell.")
    for a in (q + " Yes.", q + " It should be reset after each epoch, and no, it does not depend on it at all.", "The learning rate is reset after each epoch.", "", "the smaller probe"):
        assert not copies.is_copy(q, a), a


def test_languages():
    de = "Wir haben die Ausgabe mit der halben Datenmenge gemessen und die Wortliste notiert."
    assert pr.is_wrong_language("What does the loader do, and why is it so slow?", "Sure. " + de)[0]
    assert not pr.is_wrong_language("Please reply in German. What does the loader do?", de)[0]
    assert not pr.is_wrong_language("Was macht das Modell mit der Ausgabe?", de)[0]
    assert pr.is_wrong_language("Explique la mesure en deux phrases.", de)[0] and not pr.is_wrong_language("Explica la memoria en dos frases.", "Sí. La memoria carga la respuesta en cuanto el archivo reduce la lista.")[0]
    assert pr.is_wrong_language("What does the German tokenizer do with this?", de)[0] and not pr.is_wrong_language("How does this read in German?", de)[0]
    assert not pr.is_wrong_language("", de)[0]
    assert not pr.is_wrong_language("Was macht das Modell mit der Ausgabe?", "```\nfor the row in the batch and of the\n```\nNein.")[0]


def test_words_beside_punctuation_count():
    hits = pr.language.count_hits("¿qué (der **the** and, nicht. l'est y\n mystery: 1:y 2:y \"und\"")
    assert hits[1] == {"en": 2, "de": 3, "fr": 1, "es": 2}
    assert pr.is_wrong_language("¿Cómo puedo cambiar la recompensa?", "**Die** Ausgabe, (und) \"nicht\" mehr.")[0]
    assert not pr.is_wrong_language("How many y are in the word mystery?", "mystery: 1:m 2:y 3:s 4:t 5:e 6:r 7:y\n#### 2")[0]


def test_pairs_of_both_tables(spark):
    rng = random.Random(1)
    nouns = "loader sampler batch tokenizer window schedule gradient buffer".split()
    full = lambda: " ".join(f"The {rng.choice(nouns)} {rng.choice(['reads', 'splits'])} every {rng.choice(nouns)} after step {rng.randint(1, 999)}." for _ in range(5))
    ask = "What does the loader do with every batch?"
    messages, truth = [], set()
    for i in range(600):
        a = full()
        if i % 10 == 0:
            a = a[: len(a) - rng.randint(9, 30)].rstrip(". 0123456789")
            truth.add(i)
        messages += [(i, 0, "system", "s", "t"), (i, 1, " User ", ask, "t"), (i, 2, "ASSISTANT", a, "t"), (i, 3, "user", ask, None)]
    messages += messages[8:12] + [(700, 0, "user", ask, "t"), (700, 1, "assistant", None, "t"), (701, 0, "user", None, "t"), (701, 1, "assistant", full(), "t"), (702, 1, "assistant", "", "t"), (None, 1, "assistant", "", "t"), (703, 0, "user", ask, "t"), (703, 2, "assistant", "", "t")]
    said = spark.createDataFrame(messages, MESSAGES)
    m = lambda *x: [{"role": r, "content": c} for r, c in x]
    own = m(("user", ask), ("Assistant", ask), ("user", ask), ("assistant ", "Sorry, I can't help with that."), ("user", "open?"))
    asked = spark.createDataFrame([(1, None, own), (1, None, own), (2, None, None), (3, None, []), (4, None, m(("user", ask), (None, "x"), ("assistant", ""))), (5, None, [None])], REQUESTS).withColumnRenamed("received_at", "origin")
    got = [tuple(r) for r in pr.find_defects(asked, said).collect()]
    assert len(got) == len(set(got))
    cut = {i for o, i, t, d in got if d == "truncated" and o == "chat_messages"}
    assert len(cut & truth) >= 0.9 * len(truth) and len(cut - truth) <= 6
    rest = {x for x in got if x[3] != "truncated"}
    assert rest == {("chat_requests", 1, 1, "copy"), ("chat_requests", 1, 3, "refusal"), ("chat_messages", 700, 1, "empty")}


def test_repeated_rows_and_extra_columns(spark):
    ask, own = "What does the loader do?", "It reads."
    m = [{"role": "user", "content": ask}, {"role": "assistant", "content": "Sorry, I can't help with that."}]
    other = [{"role": "user", "content": ask}, {"role": "assistant", "content": own}]
    asked = spark.createDataFrame([(k, None, m) for k in (1, 1, 2)] + [(2, None, other)], REQUESTS).withColumn("defect", F.lit("x")).withColumn("turn", F.lit(7)).withColumn("body", F.lit(0))
    said = spark.createDataFrame([(5, 0, "user", ask, "t"), (5, 1, "assistant", "", "t"), (5, 1, "assistant", "", "t"), (5, 1, "assistant", None, "t"), (6, 0, "user", ask, "t"), (6, 1, "assistant", "", None), (6, 1, "assistant", own, None)], MESSAGES).withColumn("origin", F.lit(1)).withColumn("rows", F.lit("r"))
    once, twice = ([tuple(r) for r in pr.find_defects(asked.repartition(n), said.repartition(n)).collect()] for n in (1, 4))
    assert sorted(once) == sorted(twice) and len(set(once)) == len(once)
    assert {x for x in once if x[1] != 2} == {("chat_requests", 1, 1, "refusal"), ("chat_messages", 5, 1, "empty")}


def test_empty_tables(spark):
    assert pr.find_defects(spark.createDataFrame([], REQUESTS), spark.createDataFrame([], MESSAGES)).collect() == []

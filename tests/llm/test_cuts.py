import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import cuts


@pytest.mark.parametrize(
    ("text", "own"),
    [("a wor...", "a wor"), ("a wor [truncated]", "a wor"), ("a wor�", "a wor"), ("x.\n</body></html>\r\n", "x."), ("a wor... (more)", "a wor"), ("see [29]", "see [29]"), ("...", ""), ("done.", "done."), ("w" + " " * 900, "w"), ("<connection reset>", "")],
)
def test_body(text, own):
    assert cuts.body(text) == own


def test_contexts_depend_on_the_text_alone():
    bodies = ["One line.\n\nTags: a, b", "x", "Step 12 and 345\nlast", "日本 ok"]
    whole = cuts.Texts(bodies)
    together = whole.contexts(whole.ends, whole.first)
    for k, body in enumerate(bodies):
        single = cuts.Texts([body])
        assert (single.contexts(single.ends, single.first)[0] == together[k]).all()
    assert len(np.unique(together[:, 8])) == 4 and (together != 0).any()


def corpus(n, seed=1):
    rng = random.Random(seed)
    nouns = "loader sampler batch tokenizer window schedule gradient buffer manifest checkpoint".split()
    verbs = "reads writes splits checks delays restores measures replaces".split()
    out = []
    for i in range(n):
        text = " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} every {rng.choice(nouns)} after step {rng.randint(1, 9999)}." for _ in range(rng.randint(3, 12)))
        cut = i % 9 == 0
        if cut:
            at = rng.randint(len(text) // 2, len(text) - 3)
            while text[at - 1] in ". ":
                at -= 1
            text = text[:at] + ["", "...", " [truncated]", "�"][i % 4]
        elif i % 5 == 0:
            text += "\n\nTags: " + rng.choice(nouns)
        out.append((i, text, ["en", "EN", None][i % 3], f"s{i % 2}", cut))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus(4500) + [(50000 + k, t, "en", None, False) for k, t in enumerate([None, "", "  \n", "...", "ok.", "ok.", "x" * 300_000 + "."])]
    df = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, lang string, source string, context boolean").repartition(3)
    return rows, df, cuts.find_cut(df)


def test_planted_cuts_come_out(found):
    rows, _, got = found
    ids = [r.doc_id for r in got.collect()]
    truth = {r[0] for r in rows if r[4]}
    assert len(ids) == len(set(ids))
    hits = len(truth & set(ids))
    assert hits >= 0.93 * len(truth) and hits >= 0.93 * len(set(ids) - {50006})
    assert not {50000, 50001, 50002, 50003} & set(ids)


def test_share_by_source(found):
    rows, df, got = found
    per = {r.source: r for r in cuts.cut_by_source(df, got).collect()}
    assert per["s0"].texts == 2250 and 0.05 < per["s1"].share < 0.2 and per[None].texts == 4


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert cuts.find_cut(rows).collect() == []


ROWS = "key bigint, text string"


def test_one_rule_for_few_and_many_texts(spark):
    spread = [-3.0] * 20 + [-0.4, -0.1, 0.1, 0.4, 0.6] * 4 + [1.1] + [3.0] * 60
    rows = [(lang, "c", x) for lang, times in (("en", 30), ("de", 19), ("xx", 1)) for x in spread * times]
    got = cuts.thresholds(spark.createDataFrame(rows, "language string, column string, odds double"))
    assert set(got) == {("en", "c"), ("de", "c"), ("xx", "c")}
    assert len(set(got.values())) == 1 and got["en", "c"] > 0.8


def test_spellings_of_a_language_are_one(spark):
    names = {"en": ["en", " EN", "en-US", "English", "anglais"], "de": ["de_DE", "ger", "German", "deu", "Deutsch"], "fr": ["fra", "fre", "French"], "es": ["es-ES", "spa", "Spanish", "español"], "und": [None, " "]}
    df = spark.createDataFrame([(k, v) for k, own in names.items() for v in own], "want string, lang string")
    assert [tuple(r) for r in df.where(cuts.normal_language(df.lang) != df.want).collect()] == []


def test_every_position_counts():
    bodies = ["One line.\n\nTags: a, b", "x", "Step 12 and 345\nlast", "日本 ok\n\n\nb: c\n\n d", "Tags\n"]
    texts = cuts.Texts(bodies)
    at = texts.inside()
    assert len(at) == sum(len(re.sub("[0-9]+", "0", b)) - 1 for b in bodies)
    every = texts.contexts(at, texts.first[np.searchsorted(texts.ends, at, side="right")]).ravel()
    values, counts, positions = texts.continued(np.full(1 << 12, -1, np.int64).view(np.uint64))
    got: dict = {}
    for v, n in zip(values.tolist(), counts.tolist(), strict=True):
        got[v] = got.get(v, 0) + n
    assert positions == len(at) and got == dict(zip(*(x.tolist() for x in np.unique(every[every != 0], return_counts=True)), strict=True))


def test_continuations_in_short_texts_count(spark):
    rows = [(0, "qz")] + [(k, f"qz{chr(97 + k % 20)}{chr(97 + k // 20)}") for k in range(1, 200)]
    odds = {r.key: r.odds for r in cuts.log_odds(spark.createDataFrame(rows, ROWS)).collect()}
    assert odds[0] < -1


def test_copies_of_a_text_count_once(spark):
    own = [r for r in corpus(900) if not r[4]]
    cut = own[0][1] + " The loader reads every sampl"
    rows = [(i, text) for i, text, *_ in own]
    once = {r.key: r.odds for r in cuts.log_odds(spark.createDataFrame([*rows, (5000, cut)], ROWS)).collect()}
    many = [(5000 + k, cut + ["", "...", " [truncated]"][k % 3]) for k in range(400)]
    many = {r.key: r.odds for r in cuts.log_odds(spark.createDataFrame([*rows, *many, many[0]], ROWS).repartition(4)).collect()}
    assert len(many) == len(rows) + 400
    assert all(abs(many[k] - once[min(k, 5000)]) < 1e-9 for k in many) and many[5000] < -1


def test_short_texts_are_written_again(spark):
    rows = [(i, text) for i, text, *_, cut in corpus(900) if not cut] + [(5000 + k, "n/a") for k in range(60)]
    odds = {r.key: r.odds for r in cuts.log_odds(spark.createDataFrame(rows, ROWS)).collect()}
    assert odds[5000] > 1


def test_classes_before_a_position():
    bodies = ["It is slow because", "a (see note 5", "It is slow, which", "```\nx = 1", "It is done.", "no", "a\n\n**lock file", "x = <<3*", "It is so, (as said) ok", "Größe und", "```\nx\n```"]
    texts = cuts.Texts(bodies)
    leads, open_, whole, part = texts.class_contexts(texts.ends, texts.first)
    assert (leads > 0).tolist() == [True, False, True, False, False, False, False, False, False, True, False]
    assert (open_ > 0).tolist() == [False, True, False, True, False, False, True, True, False, False, False]
    assert (whole > 0).tolist() == (part > 0).tolist() == [True, False, True, False, False, False, True, False, True, True, False]
    for k, body in enumerate(bodies):
        single = cuts.Texts([body])
        assert [x[0] for x in single.class_contexts(single.ends, single.first)] == [x[k] for x in (leads, open_, whole, part)]


def test_classes_of_ends_and_of_positions_are_the_same():
    rng = random.Random(4)
    bodies = ["".join(rng.choice(["a", "b c", "\n", "because", "Und", "```", "``", "7", "(", "]", "<<", ">", "**", "*", ". ", "é", "²", "👍", "日"]) for _ in range(rng.choice([3, 30, 200]))).strip() or "x" for _ in range(500)]
    texts = cuts.Texts(bodies)
    for x, y in zip(texts.class_contexts(texts.ends, texts.first), cuts.end_classes(bodies), strict=True):
        assert [b for b, same in zip(bodies, x == y, strict=True) if not same] == []


def test_classes_at_every_position():
    bodies = ["The cat is on the mat, and a dog (of\nthe) sits.", "x", "", "the (the", "Zähle 12 345, die die"] * 3 + ["long " * 40000]
    texts = cuts.Texts(bodies)
    names, counts = texts.continued_classes(np.full(1 << 12, -1, np.int64).view(np.uint64))
    want: dict = {}
    at = texts.inside()
    first = texts.first[np.searchsorted(texts.ends, at, side="right")]
    leads, open_, whole, part = texts.class_contexts(at, first)
    follows = texts.letter[at]
    for x in (leads[~(follows & texts.letter[at - 1])], open_, whole[~follows], part[follows]):
        for v in x[x > 0].tolist():
            want[v] = want.get(v, 0) + 1
    got: dict = {}
    for v, n in zip(names.tolist(), counts.tolist(), strict=True):
        got[v] = got.get(v, 0) + n
    assert got == want


def test_parts_of_words_are_no_ends(spark):
    rows = [(k, f"The window is open. This means that step {k} is fine.") for k in range(200)] + [(1000 + k, f"The window is open after {k}. This mea") for k in range(30)] + [(2000 + k, f"The step {k} is a good mean") for k in range(30)]
    df = spark.createDataFrame(rows, ROWS)
    def ends(batches):
        own = cuts.Ends(classes=True)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *own.columns(b.column(1).to_pylist())], ["key", *cuts.END_NAMES])

    found = df.mapInArrow(ends, f"key bigint, {cuts.ENDS}").withColumn("rows", F.lit(1))
    scored = cuts.score(found, found, df, classes=True)
    odds = {r.key: r.odds for r in cuts.with_odds(found.select("key", "final"), scored, len(rows)).collect()}
    assert max(odds[1000 + k] for k in range(30)) < -1 < 0 < min(odds[k] for k in range(200))

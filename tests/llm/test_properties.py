"""Properties that must hold for any text."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import cuts, encode, leaks, pack, pairs

TEXTS = st.one_of(st.text(), st.text(alphabet=" \n\t\r\x1c\x85\xa0　aZé9²٣'.<>&%\\u{}[]-\"…�日👍"))


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    ranks = encode.read_ranks(encode.DEFAULT_VOCABULARY)
    return encode.Lexicon(ranks), tiktoken.Encoding("t", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXTS, max_size=4))
def test_encoding_equals_the_public_one(encoders, texts):
    lexicon, peer = encoders
    flat, sizes = lexicon.encode(texts)
    ids, at = flat.tolist(), 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n] == peer.encode_ordinary(text)
        at += n
    assert at == len(ids)


@settings(max_examples=200, deadline=None)
@given(capacity=st.integers(1, 60), sizes=st.lists(st.integers(1, 60), max_size=60))
def test_plans_place_every_length_once(capacity, sizes):
    histogram = Counter(s for s in sizes if s <= capacity)
    fill, ranks = Counter(), {}
    for length, rank, need, container, times in pack.plan_containers(capacity, dict(histogram)):
        assert ranks.get(length, 0) == rank
        ranks[length] = rank + need * times
        for k in range(times):
            fill[container + k] += length * need
    assert ranks == dict(histogram)
    assert all(v <= capacity for v in fill.values()) and sorted(fill) == list(range(len(fill)))


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_texts_of_any_kind_are_read(text):
    own = cuts.body(text)
    assert text.startswith(own) and cuts.body(own) == own
    if own:
        row = cuts.Texts([own])
        assert row.contexts(row.ends, row.first).shape == (1, cuts._LEVELS)
        assert [x.tolist() for x in row.class_contexts(row.ends, row.first)] == [x.tolist() for x in cuts.end_classes([own])]
    leaks.fold_words(text)
    pairs.is_empty(text)
    pairs.is_refusal(text)
    pairs.asks_for(text, "en")


@settings(max_examples=150, deadline=None)
@given(question=TEXTS, answer=TEXTS)
def test_pairs_of_any_kind_are_read(question, answer):
    pairs.is_wrong_language(question, answer)
    copies = pairs.Copies()
    copies.is_copy(question, answer)
    if len(pairs._squeezed(question)) >= 8:
        assert copies.is_copy(question, question) or not set(question.lower().split())

import pyarrow.parquet as pq
import pytest

from quern.llm import encode


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(encode.DEFAULT_VOCABULARY), special_tokens={})


ODD = [None, "", " ", "  a  b \n\n c ", "<|endoftext|> x", "x　　!", "aaaaaaaaaaaaaaa" * 2000, "é" * 501, "a\x1cb c  d", "it's  we'll 12345.67", "👩‍💻🚀 分词器 ภาษาไทย", "a\n b", "\n \n x", " lead", "tail "]


def test_same_as_public_encoder(spark, peer, data):
    texts = pq.read_table(f"{data}/documents.parquet").column("text").to_pylist() + ODD
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode_documents(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == peer.encode_ordinary(text or ""), text


def test_lexicon_starts_afresh_beyond_its_limit(peer):
    lexicon = encode.Lexicon(encode.read_ranks(encode.DEFAULT_VOCABULARY), limit=3)
    for text in ("one two three four", "five six", "one seven"):
        flat, sizes = lexicon.encode([text, None])
        assert flat.tolist() == peer.encode_ordinary(text) and sizes.tolist() == [len(flat), 0]


def test_empty_table(spark):
    assert encode.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_a_large_lexicon_grows_in_place(peer):
    lexicon = encode.Lexicon(encode.read_ranks(encode.DEFAULT_VOCABULARY))
    texts = [" ".join(f"w{k}q{j}" for k in range(60)) for j in range(300)]
    for at in range(0, 300, 50):
        flat, sizes = lexicon.encode(texts[at : at + 50])
        ends = sizes.cumsum()
        assert flat[: ends[0]].tolist() == peer.encode_ordinary(texts[at]) and flat[ends[-2] :].tolist() == peer.encode_ordinary(texts[at + 49])
    assert len(lexicon.place) > 1 << 12

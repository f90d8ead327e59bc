"""Pre-tokens, byte-pair training, compression and bits per byte."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import pretokens
from quern.operators import bpe
from quern.session import table

_W = r"\s\x0b\x{85}\p{Z}"
_B = r"\t\x0b\f \x{85}\p{Z}"
_M = r"\x{E000}"
#: The split pattern for engines without lookahead: a mark before the last blank of a run takes its place.
_R = rf"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}{_M}]?\p{{L}}+|\p{{N}}{{1,2}}| ?[^{_W}\p{{L}}\p{{N}}{_M}]+[\r\n]*|[{_W}]*[\r\n]|[{_W}]+"
_TOKENS = rf"regexp_extract_all(regexp_replace(text, '([{_B}])([^{_W}])', chr(57344) || '\1\2', 'g'), '{_R}')"
_WORDS = f"(SELECT doc_id, lang, unnest({_TOKENS}) AS word FROM documents)"
_BYTES = "octet_length(encode(word))"


def _words(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.explode(pretokens(F.col("text"))).alias("word"))


def _counts(spark, d):
    return bpe.word_counts(table(spark, d, "documents"), by=("lang",))


def tok_pretok_counts(spark, d):
    own = bpe.pretoken_counts(table(spark, d, "documents"))
    return own.groupBy("doc_id").agg(F.sum("pretokens").alias("pretokens"), F.sum("bytes").alias("bytes"))


def tok_word_freq(spark, d):
    return bpe.word_counts(table(spark, d, "documents")).select(F.hex(F.encode("word", "UTF-8")).alias("word"), "n")


def tok_pair_counts(spark, d):
    return bpe.pair_counts(bpe.word_counts(table(spark, d, "documents")))


def tok_first_merge(spark, d):
    return tok_pair_counts(spark, d).orderBy(F.desc("n"), "left", "right").limit(1)


def tok_merges(spark, d):
    merges = bpe.train(table(spark, d, "documents"), 256 + len(bpe.SPECIALS) + 128)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left int, right int")


def tok_roundtrip(spark, d):
    """Documents that encoding and decoding changes: none."""
    docs = table(spark, d, "documents")
    merges = bpe.train(docs, 256 + len(bpe.SPECIALS) + 64)
    back = bpe.encode(docs, merges).select("doc_id", bpe.decode(F.col("ids"), merges).alias("back"))
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("back")).select("doc_id")


def tok_ids(spark, d):
    """Each document's ids by 64 merges of the corpus: how many, and a digest of them."""
    docs = table(spark, d, "documents")
    merges = bpe.train(docs, 256 + len(bpe.SPECIALS) + 64)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return bpe.encode(docs, merges).select("doc_id", F.size("ids").alias("ids"), F.md5(ids.cast("binary")).alias("digest"))


def tok_encode_special(spark, d):
    """Lists of texts, each between two special tokens: the choices of the evaluation items."""
    items = table(spark, d, "eval_items").where("choices is not null")
    got = bpe.encode(items, [], "item_id", "choices", "<|bos|>", "<|user_end|>")
    return got.select("item_id", F.posexplode("ids").alias("option", "ids")).select("item_id", "option", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def tok_bytes_stats(spark, d):
    """Over the byte tokens: a byte that is no character alone counts as the three bytes of U+FFFD."""
    own = bpe.vocabulary_table(spark, []).where("n_bytes > 0")
    return own.agg(F.min("n_bytes").alias("least"), F.max("n_bytes").alias("most"), F.round(F.avg("n_bytes"), 6).alias("mean"), F.round(F.stddev_samp("n_bytes"), 6).alias("std"))


def tok_compression(spark, d):
    own = _counts(spark, d).groupBy("lang").agg(F.sum(F.octet_length("word") * F.col("n")).alias("bytes"), F.sum("n").alias("tokens"))
    return own.withColumn("ratio", F.round(F.col("bytes") / F.col("tokens"), 6))


def tok_compare(spark, d):
    """Pre-tokens against words between single blanks, by language: who compresses better, and by how much."""
    ours = _counts(spark, d).groupBy("lang").agg(F.sum("n").alias("ours"))
    base = table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("base")).withColumnRenamed("lang", "l")
    own = base.join(ours, F.col("l").eqNullSafe(F.col("lang")), "left").select(F.col("l").alias("lang"), F.coalesce("ours", F.lit(0)).cast("long").alias("ours"), F.col("base").cast("long").alias("base"))
    better = F.when(F.col("ours") < F.col("base"), "ours").when(F.col("ours") > F.col("base"), "base").otherwise("Tie")
    return own.select("lang", "ours", "base", F.round((F.col("base") - F.col("ours")) / F.col("base") * 100, 4).alias("relative"), better.alias("better"))


def tok_specials(spark, d):
    return bpe.vocabulary_table(spark, [(116, 104)]).where("special").select(F.col("token").cast("string").alias("name"), "token_id", "n_bytes")


def bpb_by_lang(spark, d):
    """Bits per byte of a unigram model of the pre-tokens of each language."""
    counts = _counts(spark, d)
    n = F.col("n")
    sums = counts.groupBy("lang").agg(F.sum(n).alias("pretokens"), F.sum(F.octet_length("word") * n).alias("bytes"), F.sum(n * F.log(n)).alias("s"))
    nats = F.col("pretokens") * F.log("pretokens") - F.col("s")  # the sum of n ln(total / n)
    return sums.select("lang", "pretokens", "bytes", F.round(nats / (F.log(F.lit(2.0)) * F.col("bytes")), 6).alias("bpb"))


def bits_per_byte(df, nll, n_bytes, keys=()):
    """Nats over targets that have bytes, by all their bytes; infinite where there are none."""
    own = df.groupBy(*keys).agg(F.sum(F.when(n_bytes > 0, nll)).alias("nats"), F.sum(F.when(n_bytes > 0, n_bytes)).alias("bytes"))
    return own.withColumn("bpb", F.when(F.coalesce("bytes", F.lit(0)) > 0, F.col("nats") / (F.log(F.lit(2.0)) * F.col("bytes"))).otherwise(F.lit(float("inf"))))


def bpb_uniform(spark, d):
    """A uniform model over 256 bytes has eight bits a byte, whatever is ignored: here every pre-token of blanks."""
    words = _words(spark, d).select("lang", F.octet_length("word").alias("n"), (F.octet_length("word") * F.log(F.lit(256.0))).alias("nll"), F.trim("word").alias("w"))
    masked = words.withColumn("n", F.when(F.length("w") > 0, F.col("n")).otherwise(0))
    return bits_per_byte(masked, F.col("nll"), F.col("n"), ["lang"]).select("lang", "bytes", F.round("bpb", 6).alias("bpb"))


def bpb_gather(spark, d):
    """Bits per byte of the bytes of each language under their own frequencies; a target's bytes are gathered from the vocabulary's table."""
    h = F.explode(F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit(".."), F.lit(0)))
    targets = _counts(spark, d).select("lang", "n", h.alias("h")).groupBy("lang", F.conv("h", 16, 10).cast("int").alias("token_id")).agg(F.sum("n").alias("n"))
    whole = targets.groupBy("lang").agg(F.sum("n").alias("whole")).withColumnRenamed("lang", "l")
    known = F.broadcast(bpe.vocabulary_table(spark, []).select("token_id", "n_bytes"))  # a vocabulary
    rows = targets.join(F.broadcast(whole), F.col("lang").eqNullSafe(F.col("l"))).join(known, "token_id")  # a row for each language and byte
    nats = -F.log(F.col("n") / F.col("whole")) * F.col("n")
    return bits_per_byte(rows.select("lang", nats.alias("nll"), (F.col("n_bytes") * F.col("n")).alias("b")), F.col("nll"), F.col("b"), ["lang"]).select("lang", "bytes", F.round("bpb", 6).alias("bpb"))


def tok_streamed(spark, d):
    """Of each item's text, byte by byte: how many steps show nothing, and that what is shown is the text."""
    items = table(spark, d, "eval_items").select("item_id", F.coalesce("query", "continuation").alias("text")).where("text is not null")
    got = bpe.encode(items, [], "item_id").select("item_id", bpe.streamed(F.col("ids"), []).alias("parts"))
    return got.select("item_id", F.size(F.filter("parts", lambda x: x == "")).alias("silent"), F.size("parts").alias("steps"), F.array_join("parts", "").alias("text"))


def nll_shift(spark, d):
    """Next-token targets: each pre-token's successor in its document, null at the end."""
    own = table(spark, d, "documents").select("doc_id", pretokens(F.col("text")).alias("w"))
    pairs = own.select("doc_id", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    same = F.sum((F.col("p.a") == F.col("p.b")).cast("long"))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("positions"), F.count("p.b").alias("targets"), F.sum(F.octet_length("p.b")).alias("target_bytes"), F.coalesce(same, F.lit(0)).alias("repeats"))


#: Code points that stand for ids in the SQL of merges.
_BASE = 0x4E00


def _merging(merges: int) -> str:
    """Tables b0, b1, ... with the pair of each merge, and w0, w1, ... with the words before it; an id is one character, so a merge is a replacement."""
    out = [f"w0 AS MATERIALIZED (SELECT word, list_aggregate(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: chr({_BASE} + ('0x' || h)::INT)), 'string_agg', '') AS w, count(*) AS n FROM {_WORDS} GROUP BY word)"]
    for k in range(merges):
        out.append(f"b{k} AS MATERIALIZED (SELECT p FROM (SELECT substr(w, i, 2) AS p, n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM w{k})) GROUP BY p ORDER BY sum(n) DESC, p LIMIT 1)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT word, replace(w, p, chr({_BASE + 256 + k})) AS w, n FROM w{k}, b{k})")
    return "WITH " + ", ".join(out)


_PAIRS = " UNION ALL ".join(f"SELECT {k} AS rank, p FROM b{k}" for k in range(128))

QUERIES = {
    "tok_ids": (tok_ids, f"""{_merging(64)}, t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t), s AS (SELECT doc_id, string_agg(w, '' ORDER BY i) AS s FROM p JOIN w64 USING (word) GROUP BY doc_id)
        SELECT doc_id, coalesce(length(s), 0)::INT AS ids, md5(coalesce(array_to_string(list_transform(string_split(s, ''), lambda c: ord(c) - {_BASE}), ','), '')) AS digest FROM documents LEFT JOIN s USING (doc_id)"""),
    "tok_encode_special": (tok_encode_special, "SELECT item_id, (i - 1)::INT AS option, '256,' || CASE WHEN c = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all(hex(encode(c)), '..'), lambda h: ('0x' || h)::INT), ',') || ',' END || '258' AS ids FROM (SELECT item_id, unnest(choices) AS c, generate_subscripts(choices, 1) AS i FROM eval_items WHERE choices IS NOT NULL)"),
    "tok_pretok_counts": (tok_pretok_counts, f"SELECT doc_id, count(*) AS pretokens, sum({_BYTES})::BIGINT AS bytes FROM {_WORDS} GROUP BY doc_id"),
    "tok_word_freq": (tok_word_freq, f"SELECT hex(encode(word)) AS word, count(*) AS n FROM {_WORDS} GROUP BY 1"),
    "tok_pair_counts": (tok_pair_counts, f"WITH w AS (SELECT hex(encode(word)) AS h, count(*) AS n FROM {_WORDS} GROUP BY 1), p AS (SELECT h, n, unnest(range(0, length(h) // 2 - 1)) AS i FROM w WHERE length(h) > 2) SELECT ('0x' || h[2 * i + 1 : 2 * i + 2])::INT AS left, ('0x' || h[2 * i + 3 : 2 * i + 4])::INT AS right, sum(n)::BIGINT AS n FROM p GROUP BY 1, 2"),
    "tok_first_merge": (tok_first_merge, f"WITH w AS (SELECT hex(encode(word)) AS h, count(*) AS n FROM {_WORDS} GROUP BY 1), p AS (SELECT h, n, unnest(range(0, length(h) // 2 - 1)) AS i FROM w WHERE length(h) > 2) SELECT ('0x' || h[2 * i + 1 : 2 * i + 2])::INT AS left, ('0x' || h[2 * i + 3 : 2 * i + 4])::INT AS right, sum(n)::BIGINT AS n FROM p GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1"),
    "tok_merges": (tok_merges, f"{_merging(128)} SELECT rank::INT AS rank, (ord(p[1]) - {_BASE})::INT AS left, (ord(p[2]) - {_BASE})::INT AS right FROM ({_PAIRS})"),
    "tok_roundtrip": (tok_roundtrip, "SELECT doc_id FROM documents WHERE text <> coalesce(text, '')"),
    "tok_bytes_stats": (tok_bytes_stats, "SELECT min(n)::INT AS least, max(n)::INT AS most, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std FROM (SELECT CASE WHEN range < 128 THEN 1 ELSE 3 END AS n FROM range(256))"),
    "tok_compression": (tok_compression, f"SELECT lang, sum({_BYTES})::BIGINT AS bytes, count(*) AS tokens, round(sum({_BYTES}) / count(*), 6) AS ratio FROM {_WORDS} GROUP BY lang"),
    "tok_compare": (tok_compare, f"WITH t AS (SELECT lang, sum(len({_TOKENS}))::BIGINT AS ours, sum(len(string_split(text, ' ')))::BIGINT AS base FROM documents WHERE text IS NOT NULL GROUP BY lang) SELECT *, round((base - ours) / base * 100, 4) AS relative, CASE WHEN ours < base THEN 'ours' WHEN ours > base THEN 'base' ELSE 'Tie' END AS better FROM t"),
    "tok_specials": (tok_specials, "SELECT name, (257 + pos)::INT AS token_id, 0 AS n_bytes FROM (SELECT unnest(['<|bos|>', '<|user_start|>', '<|user_end|>', '<|assistant_start|>', '<|assistant_end|>', '<|python_start|>', '<|python_end|>', '<|output_start|>', '<|output_end|>']) AS name, unnest(range(9)) AS pos)"),
    "bpb_by_lang": (bpb_by_lang, f"WITH c AS (SELECT lang, word, count(*) AS n FROM {_WORDS} GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang) SELECT c.lang, max(total)::BIGINT AS pretokens, sum({_BYTES} * n)::BIGINT AS bytes, round(sum(-ln(n / total) * n) / (ln(2) * sum({_BYTES} * n)), 6) AS bpb FROM c JOIN t ON c.lang IS NOT DISTINCT FROM t.lang GROUP BY c.lang"),
    "bpb_uniform": (bpb_uniform, f"SELECT lang, sum({_BYTES}) FILTER (length(trim(word, ' ')) > 0)::BIGINT AS bytes, CASE WHEN count(*) FILTER (length(trim(word, ' ')) > 0) > 0 THEN 8.0::DOUBLE ELSE 'inf'::DOUBLE END AS bpb FROM {_WORDS} GROUP BY lang"),
    "bpb_gather": (bpb_gather, f"WITH b AS (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents), c AS (SELECT lang, ('0x' || h)::INT AS b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS whole FROM c) SELECT lang, sum(n * CASE WHEN b < 128 THEN 1 ELSE 3 END)::BIGINT AS bytes, round(sum(-ln(n / whole) * n) / (ln(2) * sum(n * CASE WHEN b < 128 THEN 1 ELSE 3 END)), 6) AS bpb FROM t GROUP BY lang"),
    "tok_streamed": (tok_streamed, "SELECT item_id, (octet_length(encode(t)) - length(t))::INT AS silent, octet_length(encode(t))::INT AS steps, t AS text FROM (SELECT item_id, coalesce(query, continuation) AS t FROM eval_items) WHERE t IS NOT NULL"),
    "nll_shift": (nll_shift, f"WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT doc_id, count(*) AS positions, count(w[i + 1]) AS targets, sum(octet_length(encode(w[i + 1])))::BIGINT AS target_bytes, coalesce(sum((w[i] = w[i + 1])::INT), 0)::BIGINT AS repeats FROM p GROUP BY doc_id"),
}

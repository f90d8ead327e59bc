"""Byte-pair encoding: training on word counts, encoding, decoding, token bytes."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions.text import SPLIT_PATTERN
from quern.operators.evals import safe_prefix
from quern.session import cut_lineage

#: The special tokens, whose ids follow the merges.
SPECIALS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")
#: Distinct words the driver's merge loop takes, the bound of its memory; more are merged on the cluster, with the same result.
MOST_WORDS = 2_000_000

#: Distinct words that a task counts before it hands them on.
WORDS_HELD = 500_000
#: Most frequent pairs that reach the driver in each round on the cluster.
MOST_PAIRS = 10_000

Merges = list[tuple[int, int]]


def _splitter():
    import regex

    return regex.compile(SPLIT_PATTERN).findall


def word_counts(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, word, n): pre-tokens of all texts, counted in each task before they are shuffled.

    The split runs in Arrow batches, since its pattern takes the JVM's engine ten times as long.
    """
    source = df.select(*by, text)
    kinds = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in by]
    arrow = to_arrow_schema(source.select(*by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts, held = _splitter(), {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, own in counts.items():
                n = len(own)
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, f.type) for v, f in zip(key, arrow, strict=True)), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], [*by, "word", "n"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True) if by else repeat(())
            for key, t in zip(keys, batch.column(len(by)).to_pylist(), strict=False):
                if not t:
                    continue
                own = counts.get(key)
                if own is None:
                    own = counts[key] = Counter()
                held -= len(own)
                own.update(split(t))
                held += len(own)
                if held > WORDS_HELD:
                    yield from flushed()
                    counts, held = {}, 0
        yield from flushed()

    return source.mapInArrow(run, ", ".join([*kinds, "word string", "n bigint"])).groupBy(*by, "word").agg(F.sum("n").alias("n"))


def pretoken_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, pretokens, bytes) of each text that isn't empty; pre-tokens lose nothing, so their bytes are the text's."""
    source = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.octet_length(text).cast("long").alias("b"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(split(t)) for t in batch.column(2).to_pylist()], pa.int64()), batch.column(1)], ["k", "pretokens", "bytes"])

    return source.mapInArrow(run, f"k {kind}, pretokens bigint, bytes bigint").select(F.col("k").alias(key), "pretokens", "bytes")


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): adjacent bytes of the words, weighted by their counts."""
    data = F.hex(F.encode("word", "UTF-8"))
    pairs = words.withColumn("h", data).where("length(h) > 2").select("n", "h", F.explode(F.sequence(F.lit(0), F.expr("cast(length(h) div 2 as int) - 2"))).alias("i"))
    byte = lambda k: F.conv(F.substring("h", F.col("i") * 2 + 1 + 2 * k, F.lit(2)), 16, 10).cast("int")
    return pairs.groupBy(byte(0).alias("left"), byte(1).alias("right")).agg(F.sum("n").alias("n"))


def learn_merges(counts: dict[str, int], merges: int) -> Merges:
    """Merges the most frequent pair, the least (left, right) on ties, until there are enough or none occurs twice."""
    words = [(list(w.encode()), n) for w, n in counts.items()]
    totals: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = {}
    for k, (ids, n) in enumerate(words):
        for pair in zip(ids, ids[1:], strict=False):
            totals[pair] += n
            where.setdefault(pair, set()).add(k)
    heap = [(-n, pair) for pair, n in totals.items()]
    heapq.heapify(heap)
    out: Merges = []
    while heap and len(out) < merges:
        n, pair = heapq.heappop(heap)
        if totals.get(pair, 0) != -n:
            continue
        if -n < 1:
            break
        new = 256 + len(out)
        out.append(pair)
        touched = set()
        for k in where.pop(pair):
            ids, weight = words[k]
            for old in zip(ids, ids[1:], strict=False):
                totals[old] -= weight
                touched.add(old)
            joined, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    joined.append(new)
                    i += 2
                else:
                    joined.append(ids[i])
                    i += 1
            words[k] = (joined, weight)
            for own in zip(joined, joined[1:], strict=False):
                totals[own] += weight
                where.setdefault(own, set()).add(k)
                touched.add(own)
        for own in touched:
            if totals[own] > 0:
                heapq.heappush(heap, (-totals[own], own))
            else:
                del totals[own]
    return out


def merge(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """The ids with each occurrence of the pair, from the left, as one."""
    joined, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            joined.append(new)
            i += 2
        else:
            joined.append(ids[i])
            i += 1
    return joined


def first_merges(pairs: list[tuple[int, int, int]], most: int, whole: bool) -> Merges:
    """Of (left, right, n), most frequent first, those that are next whatever the merges before them change.

    A merge changes only totals of pairs that share an id with it, and no new pair occurs more often than such a
    pair did. So the list holds up to the first pair that shares an id with one taken, or that ties with such a pair.
    """
    out: Merges = []
    used: set[int] = set()
    for i, (a, b, n) in enumerate(pairs):
        ties = [p for p in pairs[i + 1 :] if p[2] == n] if out and i + 1 < len(pairs) and pairs[i + 1][2] == n else []
        unseen = not whole and pairs[-1][2] == n
        if len(out) == most or out and (used & {a, b} or unseen or any(used & {x, y} for x, y, _ in ties)):
            break
        out.append((a, b))
        used |= {a, b}
        if a == b:  # its own overlaps become new pairs
            break
    return out


def _merges_on_cluster(words: DataFrame, merges: int) -> Merges:
    """``learn_merges`` over words that stay on the cluster; a round takes as many merges as don't touch each other."""
    out: Merges = []
    rows = words.select("word", "n").mapInArrow(_replayed([], 0), "ids array<int>, n bigint")
    while len(out) < merges:
        state = cut_lineage(rows)
        pairs = state.select("n", F.explode(F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids") - 1).alias("b"))).alias("p"))
        totals = pairs.groupBy(F.col("p.a").alias("left"), F.col("p.b").alias("right")).agg(F.sum("n").alias("n"))
        top = [(r.left, r.right, r.n) for r in totals.orderBy(F.desc("n"), "left", "right").limit(MOST_PAIRS).collect()]
        own = first_merges(top, merges - len(out), len(top) < MOST_PAIRS)
        if not own:
            break
        rows = state.mapInArrow(_replayed(own, 256 + len(out)), "ids array<int>, n bigint")
        out += own
    return out


def _replayed(own: Merges, new: int):
    """Applies merges to words, or to their ids; words of one id have no pair and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = [], []
            for word, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = list(word.encode()) if isinstance(word, str) else word
                for k, pair in enumerate(own):
                    if pair[0] in known:
                        known = merge(known, pair, new + k)
                if len(known) > 1:
                    ids.append(known)
                    n.append(weight)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64())], ["ids", "n"])

    return run


def train(df: DataFrame, vocabulary: int, text: str = "text", most_words: int = MOST_WORDS) -> Merges:
    """Merges for a vocabulary of that size, specials and bytes included, of all words, which are counted on the cluster."""
    if vocabulary < 256 + len(SPECIALS):
        raise ValueError("a vocabulary holds 256 bytes and the special tokens")
    merges = vocabulary - 256 - len(SPECIALS)
    words = cut_lineage(word_counts(df, text))
    if words.count() > most_words:
        return _merges_on_cluster(words, merges)
    return learn_merges({r.word: r.n for r in words.collect()}, merges)


def token_bytes(merges: Merges) -> list[bytes]:
    out = [bytes([b]) for b in range(256)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def vocabulary_table(spark, merges: Merges, zero_specials: bool = True) -> DataFrame:
    """(token_id, token, special, n_bytes): bytes of each token's decoded string; 0 for specials, unless they are counted as text."""
    rows = [(i, t, False) for i, t in enumerate(token_bytes(merges))] + [(256 + len(merges) + k, s.encode(), True) for k, s in enumerate(SPECIALS)]
    table = spark.createDataFrame(rows, "token_id int, token binary, special boolean")
    return table.withColumn("n_bytes", F.when(F.col("special") & F.lit(zero_specials), 0).otherwise(F.octet_length(F.make_valid_utf8(F.col("token").cast("string")))))


def encode_word(word: bytes, ranks: dict[tuple[int, int], int]) -> list[int]:
    ids = list(word)
    while len(ids) > 1:
        best = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        pair = (ids[best[1]], ids[best[1] + 1])
        joined, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                joined.append(best[0])
                i += 2
            else:
                joined.append(ids[i])
                i += 1
        ids = joined
    return ids


class Encoder:
    """Encodes texts in a Python worker; words it has met are remembered up to a limit."""

    def __init__(self, merges: Merges, limit: int = 300_000):
        self.ranks = {p: 256 + k for k, p in enumerate(merges)}
        self.split = _splitter()
        self.known: dict[str, list[int]] = {}
        self.limit = limit

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) > self.limit:
                self.known.clear()
            ids = self.known[word] = encode_word(word.encode("utf-8", "surrogatepass"), self.ranks)
        return ids

    def text(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.ranks:
            return list(text.encode("utf-8", "surrogatepass"))
        return [i for word in self.split(text) for i in self.word(word)]


def encode(df: DataFrame, merges: Merges, key: str = "doc_id", text: str = "text", prepend: int | str | None = None, append: int | str | None = None) -> DataFrame:
    """(``key``, ids); each distinct word is encoded once per task. Null gives an empty list.

    A column of lists of texts gives a list of lists. ``prepend`` and ``append``, an id or a special token's name, go around each text's ids.
    """
    shared = df.sparkSession.sparkContext.broadcast(merges)
    before, after = ([] if x is None else [special_id(merges, x) if isinstance(x, str) else x] for x in (prepend, append))
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind, many = source.schema["k"].dataType.simpleString(), source.schema["t"].dataType.simpleString() == "array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        one = lambda t: [*before, *encoder.text(t), *after]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [[one(t) for t in x or []] for x in texts] if many else [one(t) for t in texts]
            item = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(item) if many else item)], ["k", "ids"])

    return source.mapInArrow(run, f"k {kind}, ids {'array<array<int>>' if many else 'array<int>'}").select(F.col("k").alias(key), "ids")


def decode(ids: Column, merges: Merges) -> Column:
    """The text of token ids; invalid UTF-8 becomes U+FFFD. Ids of specials give their names, ids outside the vocabulary nothing."""
    tokens = [*token_bytes(merges), *(s.encode() for s in SPECIALS)]

    @F.pandas_udf("string")
    def run(own: pd.Series) -> pd.Series:
        n = len(tokens)
        return own.map(lambda x: None if x is None else b"".join(tokens[i] for i in x if i is not None and 0 <= i < n).decode("utf-8", "replace"))

    return run(ids)


def streamed(ids: Column, merges: Merges) -> Column:
    """What each token of an array adds to the text that may be shown: nothing while it ends inside a character, then all that was held back."""
    tokens = [*token_bytes(merges), *(s.encode() for s in SPECIALS)]

    def parts(own: list[int] | None) -> list[str] | None:
        if own is None:
            return None
        out, held, sent = [], b"", 0
        for i in own:
            held += tokens[i]
            text, sent = safe_prefix(held.decode("utf-8", "replace"), sent)
            out.append(text)
            if text:
                held, sent = b"", 0  # what was sent needs not be decoded again
        return out

    @F.pandas_udf("array<string>")
    def run(own: pd.Series) -> pd.Series:
        return own.map(parts)

    return run(ids)


def special_id(merges: Merges, name: str) -> int:
    """The id of a special token."""
    return 256 + len(merges) + SPECIALS.index(name)


def byte_fallback_vocabulary(merges: Merges) -> tuple[dict[str, int], Merges]:
    """The same merges numbered as trainers do that put the special tokens first: their ids, and the merges moved up by them."""
    up = len(SPECIALS)
    return {name: k for k, name in enumerate(SPECIALS)}, [(a + up, b + up) for a, b in merges]


def visualized(ids: Column, mask: Column, merges: Merges, with_ids: bool = False) -> Column:
    """The tokens between bars, green where they are trained, red where not; ``with_ids`` puts each id, gray, behind its token."""
    green, red, gray, reset = "\x1b[92m", "\x1b[91m", "\x1b[90m", "\x1b[0m"
    names = [t.decode("utf-8", "replace") for t in token_bytes(merges)] + list(SPECIALS)

    @F.pandas_udf("string")
    def run(own: pd.Series, marks: pd.Series) -> pd.Series:
        def shown(i: int, m: int) -> list[str]:
            token = f"{green if m == 1 else red}{names[i]}{reset}"
            return [token, f"{gray}({i}){reset}"] if with_ids else [token]

        return pd.Series([None if x is None or y is None else "|".join(part for i, m in zip(x, y, strict=False) for part in shown(i, m)) for x, y in zip(own, marks, strict=True)])

    return run(ids, mask)

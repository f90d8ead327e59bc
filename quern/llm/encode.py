"""Corpus encoding with a byte-level BPE vocabulary by merge replay.

Method: merge replay over a corpus of words. The distinct pre-tokens that a
block of the corpus still lacks are laid out as one linked sequence of byte
symbols; an inverted index maps each adjacent token pair to its positions, and a
heap replays the vocabulary's merges in rank order, each over all its positions
at once, touching only the neighbours of what it joins. Words never share
symbols, so replaying the merges over the words of a block gives exactly what a
replay over the words of the whole corpus gives; blocks need no shuffle and no
broadcast that grows with the data.

Results: one row per row; null and empty texts give an empty list; strings that
look like special tokens are ordinary text; repeated rows are repeated.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lexicon entries a Python worker keeps before it starts afresh; bounds memory, not results.
LEXICON_LIMIT, LEXICON_CHARS = 400_000, 30_000_000
#: Characters encoded at a time, so that a batch of huge texts needs no huge arrays.
SLICE_CHARS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay_merges(words: list[bytes], ranks: dict[bytes, int], memo: dict) -> list[list[int]]:
    """Token ids of each word, all words merged together in rank order.

    ``memo`` keeps the merge of each pair of ids met so far: the joined id, or -1.
    """
    if "tokens" not in memo:
        memo["tokens"] = {r: t for t, r in ranks.items()}
        memo["bytes"] = [ranks[bytes([b])] for b in range(256)]
        memo["pairs"] = {}
    tokens, base, pairs = memo["tokens"], memo["bytes"], memo["pairs"]
    ids: list[int] = []
    starts = []
    for word in words:
        starts.append(len(ids))
        ids.extend([base[b] for b in word])
        ids.append(-1)  # a wall between words
    n = len(ids)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[tuple[int, int], list[int]] = {}
    heap: list[tuple[int, int, int]] = []

    def joined(a: int, b: int) -> int:
        got = pairs.get((a, b))
        if got is None:
            got = pairs[(a, b)] = ranks.get(tokens[a] + tokens[b], -1)
        return got

    def note(a: int, b: int, at: int) -> None:
        places = index.get((a, b))
        if places is None:
            new = joined(a, b)
            if new < 0:
                return
            index[(a, b)] = [at]
            heapq.heappush(heap, (new, a, b))
        else:
            places.append(at)

    for at in range(n - 1):
        a, b = ids[at], ids[at + 1]
        if a >= 0 and b >= 0:
            note(a, b, at)
    while heap:
        new, a, b = heapq.heappop(heap)
        places = index.pop((a, b))
        places.sort()  # left to right, as overlapping runs need it
        for at in places:
            right = following[at]
            if ids[at] != a or right >= n or ids[right] != b:
                continue  # a neighbour was merged away meanwhile
            after, left = following[right], before[at]
            ids[at], ids[right] = new, -2
            following[at] = after
            if after < n:
                before[after] = at
                if ids[after] >= 0:
                    note(new, ids[after], at)
            if left >= 0 and ids[left] >= 0:
                note(ids[left], new, left)
    out = []
    for start in starts:
        word, at = [], start
        while ids[at] != -1:
            word.append(ids[at])
            at = following[at]
        out.append(word)
    return out


#: A blank between two visible characters: no pre-token reaches across its left side.
_GAP = re.compile(r" (?=\S)(?<=\S )")


def _roomy(held: np.ndarray, n: int) -> np.ndarray:
    """``held``, or a copy of twice the length that has room for ``n``."""
    if n <= len(held):
        return held
    out = np.zeros(max(n, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class Lexicon:
    """Chunk of text (a word with its leading blank) to token ids, as offsets into one array."""

    def __init__(self, ranks: dict[bytes, int], limit: int = LEXICON_LIMIT):
        import regex

        self.ranks, self.limit, self.memo = ranks, limit, {}
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.ends = 0  # ids held; the arrays beyond it are room
        self.starts, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def learn(self, chunks: list[str]) -> None:
        pieces = [self.split(chunk) for chunk in chunks]
        words = list({piece: None for own in pieces for piece in own})
        ids = dict(zip(words, replay_merges([w.encode() for w in words], self.ranks, self.memo), strict=True))
        flat, sizes = [], []
        for own in pieces:
            before = len(flat)
            for piece in own:
                flat.extend(ids[piece])
            sizes.append(len(flat) - before)
        first = len(self.place)
        self.chars += sum(map(len, chunks))
        self.place.update((chunk, first + k) for k, chunk in enumerate(chunks))
        last = first + len(chunks)
        self.starts, self.flat = _roomy(self.starts, last + 1), _roomy(self.flat, self.ends + len(flat))
        self.starts[first + 1 : last + 1] = self.ends + np.cumsum(np.array(sizes, np.int64))
        self.flat[self.ends : self.ends + len(flat)] = flat
        self.ends += len(flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.place) > self.limit or self.chars > LEXICON_CHARS:
            self.clear()
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            own = _GAP.split(text)
            counts[k] = len(own)
            chunks.append(own[0])
            chunks += [" " + x for x in own[1:]]
        place = self.place
        missing = [x for x in dict.fromkeys(chunks) if x not in place]
        if missing:
            self.learn(missing)
        at = np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        spread = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[spread], np.diff(edges)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


def _worker_lexicon(ranks: dict[bytes, int], name: str) -> Lexicon:
    """Kept by the Python worker between tasks; workers are reused."""
    kept = sys.modules.setdefault("_quern_lexicons", SimpleNamespace(by_name={})).by_name
    if name not in kept:
        kept[name] = Lexicon(ranks)
    return kept[name]


def encode_documents(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(``key``, ``out``): the token ids of each row's text, in one pass without a shuffle.

    The vocabulary (a fixed file under 1 MB) is read on the driver and travels as a broadcast variable.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _worker_lexicon(shared.value, vocabulary)
        for batch in batches:
            keys, done = batch.column(0), 0
            for own in _slices(batch.column(1).to_pylist()):
                flat, sizes = lexicon.encode(own)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(done, len(own)), ids], ["k", "ids"])
                done += len(own)

    return source.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), F.col("ids").alias(out))

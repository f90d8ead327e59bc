"""Evaluation passages inside training texts, by greedy string tiling.

Method: greedy string tiling. Texts and passages become word sequences read as a
person reads them (``fold``). A text that shares a seed, a run of ``run`` words,
with a passage is tiled against it: rounds of running Karp-Rabin hashes find the
longest unmarked matches, which are marked as tiles and never overlap, until none
of ``least`` words is left; so passages come out even where their parts were
reordered. A tile of ``run`` words or more is a leak; coverage is the share of
the passage's words under tiles, and with a threshold for it (``covered``) a text that
holds so much of a passage, in whatever order, is a leak too. The seed is then as
short as the least tile, and a text is tiled only if the shared seeds cover enough.

The passages travel as a broadcast variable while they have at most
``BROADCAST_WORDS`` words, which are folded and counted; a larger set meets the texts in a
shuffled join on seed hashes, and each text is then tiled with its own candidates.

Results: null and empty texts leak nothing; passages shorter than ``run`` words
cannot leak; an item without any passage is ignored; items repeated in the table
and repeated rows of a text count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 10
LEAST_TILE = 3
#: Words of all passages up to which they are broadcast (under 100 MB as Python objects).
BROADCAST_WORDS = 1_000_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ѡ": "w",
}
#: Tags that stand inside a line of text.
INLINE_TAGS = "a abbr b code del em font i ins kbd mark q s small span strong sub sup tt u var wbr".split()

_TABLE = str.maketrans(LOOKALIKES)
_ODD = re.compile("[­ıɐ-֏᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_UNSEEN = re.compile("[­̀-ͯ҃-҇᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_MARKS = re.compile("[̀-ͯ]")
_HEX = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\+[nrtbf]")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_INLINE = re.compile(rf"</?(?:{'|'.join(INLINE_TAGS)})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_BROKEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n[ \t]*(?=[a-z])")
_WORDS = re.compile(r"[^\W_]+").findall


def fold(text: str) -> str:
    """The text without what a reader doesn't see: escapes, entities, tags, compatibility forms, accents, look-alikes, case."""
    if "\\" in text:
        text = _ESCAPE.sub(" ", _HEX.sub(lambda m: chr(int(m[1], 16)), text))
    if "%" in text and _PERCENT.search(text):
        text = unquote(text, errors="replace")
        if "\\" in text:
            text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "\n" in text and ("-\n" in text or _BROKEN.search(text)):
        text = _BROKEN.sub("", text)
    if text.isascii():
        return text.lower()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _UNSEEN.sub("", text).translate(_TABLE) if _ODD.search(text) else text


def fold_words(text: str | None) -> list[str]:
    return _WORDS(fold(text)) if text else []


def tile(passage: list[int], text: list[int], least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """(place in passage, place in text, length) of the tiles, longest first; negative words match nothing."""
    base, prime = 1_000_003, (1 << 61) - 1
    marked = [[x < 0 for x in passage], [x < 0 for x in text]]
    tiles = []

    def windows(words: list[int], mark: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """Place and running hash of each window of unmarked words."""
        top = pow(base, size - 1, prime)
        value = held = 0
        for k, word in enumerate(words):
            if mark[k]:
                value = held = 0
                continue
            if held == size:
                value = (value - words[k - size] * top) % prime
                held -= 1
            value = (value * base + word) % prime
            held += 1
            if held == size:
                yield k - size + 1, value

    size = max(least, min(len(passage), len(text)))
    while True:
        index: dict[int, list[int]] = {}
        for at, value in windows(passage, marked[0], size):
            index.setdefault(value, []).append(at)
        found: list[tuple[int, int, int]] = []
        for at, value in windows(text, marked[1], size) if index else ():
            for place in index.get(value, ()):
                if place and at and passage[place - 1] == text[at - 1] and not marked[0][place - 1] and not marked[1][at - 1]:
                    continue  # part of a match that starts before
                n = 0
                while place + n < len(passage) and at + n < len(text) and passage[place + n] == text[at + n] and not marked[0][place + n] and not marked[1][at + n]:
                    n += 1
                if n >= size:
                    found.append((n, place, at))
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        for n, place, at in found:
            if any(marked[0][place : place + n]) or any(marked[1][at : at + n]):
                continue  # overlaps a longer tile; what is left of it is found in a later round
            marked[0][place : place + n] = [True] * n
            marked[1][at : at + n] = [True] * n
            tiles.append((place, at, n))
        if size == least:
            if not found:
                return tiles
        else:
            size = max(least, size // 2)


def passages(items: DataFrame) -> DataFrame:
    """(item_id, passage): each item's query, or context or context option with the continuation after a blank."""
    tail = F.when(F.col("continuation").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), "continuation"))
    own = F.concat(F.array("query"), F.array(F.concat("context", tail)), F.transform(F.coalesce("context_options", F.array().cast("array<string>")), lambda x: F.concat(x, tail)))
    return items.where("item_id is not null").select("item_id", F.explode(own).alias("passage")).where("passage is not null").distinct()


def _hash(windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(windows), np.uint64)
    for k in range(windows.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(31)
    return out


def _seed_places(ids: np.ndarray, run: int) -> np.ndarray:
    """Where a window of ``run`` known words starts."""
    if len(ids) < run:
        return np.zeros(0, np.int64)
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    return np.flatnonzero(unknown[run:] == unknown[:-run])


class Passages:
    """The passages as word numbers, with their seeds: of ``run`` words, or with a threshold of coverage of the least tile's."""

    def __init__(self, rows: list[tuple[int, list[str]]], run: int, covered: float | None = None):
        self.run, self.covered, self.seed = run, covered, run if covered is None else LEAST_TILE
        self.number: dict[str, int] = {}
        rows = [r for r in rows if len(r[1]) >= run]
        self.items = [i for i, _ in rows]
        self.words = [[self.number.setdefault(w, len(self.number)) for w in own] for _, own in rows]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        seeds, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, own in enumerate(self.words):
            seeds.append(_hash(np.lib.stride_tricks.sliding_window_view(np.array(own), self.seed)))
            of.append(k + (np.arange(len(seeds[-1])) << 32))
        self.seeds, self.of = np.concatenate(seeds), np.concatenate(of)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.of = self.seeds[order], self.of[order]

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def sharing(self, ids: np.ndarray) -> list[int]:
        """The passages that share a seed with the text, or seeds that cover enough."""
        at = _seed_places(ids, self.seed)
        if not len(at):
            return []
        own = np.unique(_hash(np.lib.stride_tricks.sliding_window_view(ids, self.seed)[at]))
        low, high = (np.searchsorted(self.seeds, own, side=s) for s in ("left", "right"))
        n = high - low
        hits = self.of[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        if self.covered is None or not len(hits):
            return np.unique(hits & 0xFFFFFFFF).tolist()
        words = np.unique((hits[:, None] + (np.arange(self.seed) << 32)).ravel()) & 0xFFFFFFFF
        which, under = np.unique(words, return_counts=True)
        return which[under >= self.covered * self.sizes[which] - 1e-9].tolist()

    def leaks(self, ids: np.ndarray, which: list[int]) -> dict[int, tuple[int, float]]:
        """Item to (longest tile, coverage), the best of its passages, for those with a tile of ``run`` words, or with enough coverage where there is a threshold."""
        out: dict[int, tuple[int, float]] = {}
        text = ids.tolist()
        for p in which:
            tiles = tile(self.words[p], text)
            got = (max((n for _, _, n in tiles), default=0), sum(n for _, _, n in tiles) / len(self.words[p]))
            if got[0] >= self.run if self.covered is None else got[1] >= self.covered - 1e-9:
                out[self.items[p]] = max(out.get(self.items[p], got), got)
        return out


_OUT = "doc_id bigint, item_id bigint, longest int, coverage double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "longest", "coverage"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(fold_words(x)) for x in batch.column(0).to_pylist()], pa.int64())], ["n"])


def find_leaks(df: DataFrame, items: DataFrame, run: int = RUN, text: str = "text", key: str = "doc_id", broadcast_words: int = BROADCAST_WORDS, covered: float | None = None) -> DataFrame:
    """(doc_id, item_id, longest, coverage) of each text that holds a run of ``run`` words of an item's passage.

    With ``covered``: instead, of each text of which tiles cover that share of a passage of ``run`` words or more.
    """
    spark = df.sparkSession
    own = passages(items)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and length(t) > 0")
    size = own.select("passage").mapInArrow(_count_words, "n bigint").agg(F.sum("n")).first()[0] or 0
    if size <= broadcast_words:
        known = Passages([(r.item_id, fold_words(r.passage)) for r in own.orderBy("item_id", "passage").collect()], run, covered)
        shared = spark.sparkContext.broadcast(known)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = known.numbers(fold_words(t.as_py()))
                    which = known.sharing(ids)
                    if which:
                        rows += [(doc, item, *got) for item, got in known.leaks(ids, which).items()]
                yield _batch(rows)

        return docs.mapInArrow(near, _OUT).distinct()

    seed = run if covered is None else LEAST_TILE

    def seeds(name: str):
        import xxhash

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in fold_words(t.as_py())), np.uint64)
                    if len(ids) >= seed:
                        own = np.unique(_hash(np.lib.stride_tricks.sliding_window_view(ids, seed))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own)], [name, "seed"])

        return emit

    places = own.withColumn("p", F.xxhash64("item_id", "passage"))
    of_items = places.select("p", "passage").mapInArrow(seeds("p"), "p bigint, seed bigint")
    of_docs = docs.mapInArrow(seeds("doc_id"), "doc_id bigint, seed bigint")
    pairs = of_docs.join(of_items, "seed").select("doc_id", "p").distinct()

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, t, item, passage in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                known = Passages([(item, fold_words(passage))], run, covered)
                ids = known.numbers(fold_words(t))
                rows += [(doc, i, *got) for i, got in known.leaks(ids, known.sharing(ids)).items()]
            yield _batch(rows)

    both = pairs.join(places, "p").join(docs.distinct(), "doc_id").select("doc_id", "t", "item_id", "passage")
    return both.mapInArrow(far, _OUT).groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))


def leaked_items(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, task, documents, longest, coverage) of each item that leaked."""
    per = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
    return per.join(items.groupBy("item_id").agg(F.max("task").alias("task")), "item_id", "left").select("item_id", "task", "documents", "longest", "coverage")

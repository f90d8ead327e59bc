"""Texts that were cut off, by a backward character model.

Method: a backward character n-gram model. The last characters of every text,
read backwards and with what was put behind a cut taken off, are contexts of
growing length; so are the characters before every position within the texts.
For each context the model knows how often a text ended there and how often it went on,
copies of a text counting once unless it is no longer than ``SHORT_LINE``: so short a
text ("n/a") is written again, not copied. From the shortest context to the longest, the share of
ends is refined by the counts (without the text itself); its log-odds against
continuation are compared with a threshold per language and column, which lies
where the fewest texts are. The head of the last line belongs to the contexts,
so that a sentence inside a record's line is no end, and a list's or a
signature's last word is one.

Where asked for (``classes``), contexts of classes back the characters up, since the same
cut end may occur often: whether the last word is of a class that leads on to others
(``LEADING_ON``) or the last mark is, what brackets and fences are open, and whether the
letters since the start of the word are, elsewhere, a whole word or go on. The least of
their shares and of the longest context's counts.

Scale: of texts that occur more than once (a Bloom filter of bounded size) one copy each
is shuffled. Contexts are counted per task before they are shuffled, and only contexts
that end some text are sent at all (a Bloom filter of bounded size; a context it
doesn't hold is not grown further, since no longer one can end a text). Contexts and
texts that are more than one in ``HEAVY`` of all join by broadcast, of which
there can be no more than ``HEAVY`` per length; the rest join by shuffle.

Results: null, empty and blank texts, and those that hold nothing but what is put
behind cuts, are never cut; a repeated row gives its key once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

#: Weight, in texts, of the shorter context's share.
PRIOR = 5.0
#: Where a threshold may lie, which of equally empty places it prefers, and the weight, in texts, of all languages' histogram in that of one.
VALLEY, THRESHOLD, ALL_TEXTS = (-0.5, 1.5), 0.4, 2000
HEAVY = 1000
#: Least and most bits of a Bloom filter, as a power of two: eight for each hash, 32 MB at most.
BLOOM_BITS = (18, 28)
SHORT_LINE = 60
_SIZES = (1, 2, 3, 4, 6, 8)
_LEVELS = 1 + len(_SIZES) + 4
#: Levels of the contexts of classes: leading words and marks, what is open, the word as a whole and as a part.
_CLASS, _OPEN, _WHOLE, _PART = range(_LEVELS, _LEVELS + 4)
#: Share of whole words among ends with a letter, and its weight in occurrences.
WHOLE_WORDS, WHOLE_PRIOR = 0.97, 10.0
#: Characters handled at a time.
_SLICE = 500_000
#: Positions whose contexts are grown at a time, so that they stay in the processor's cache.
_BLOCK = 1 << 15
#: Zeros before each text, as many as the longest context has characters.
_GAP = max(_SIZES)

#: Notes that a transfer or a preview puts behind a cut.
CUT_NOTES = "truncated|cut|cut off|snip|snipped|more|read more|continued|to be continued|clipped|message clipped|connection reset|connection closed|connection lost|timeout|timed out|transfer aborted|incomplete|…|\\.\\.\\."
_BEHIND = re.compile(rf"(?:\s|\.{{3,}}|…|�|[\[(<]\s?(?:{CUT_NOTES})\s?[\])>]|</(?:body|html|div|p|span)>|[​﻿])+$", re.IGNORECASE)
#: Spellings of languages, besides those that begin with the two letters.
LANGUAGE_NAMES = {"en": "anglais ingles inglés", "de": "ger german allemand aleman alemán", "es": "spa spanish spanisch castellano castilian"}
#: Words that lead on to others, by language, and marks that do.
LEADING_ON = {
    "en": "the of and to that for with from which have has had when why every than while because although whereas if but at as into about until a an or whose where so unless".split(),
    "de": "der die das und ein eine einen einem einer dem den für von zu zum zur wie weil wenn bei dass über solange sobald obwohl damit sowie seit trotz oder aber wobei während deren dessen welche welcher indem sodass denn im am".split(),
    "fr": "le la les l et un une du de des dans pour par sur avec que qui dont ce cette ces parce puisque tandis dès malgré sans sous leur mais ou où quand si lorsque comme à au aux".split(),
    "es": "el la los las y un una del de por para con que cuyo cuya su sus lo porque aunque mientras sin sobre desde hasta según pero o si cuando como a al en cuanto".split(),
}
LEADING_MARKS = ",;:([{="
_TAIL = 200
_INWARD, _OUTWARD, _STARS = re.compile("(?<=<)<"), re.compile("(?<=>)>"), re.compile(r"(?<!\*)\*\*")
_FENCES = re.compile(r"(?<!`)```")
#: Code points below this are looked up; those between it and the pictographs are taken for letters.
_LOOKED_UP, _PICTOGRAPHS = 0x3000, 0x1F000


def body(text: str) -> str:
    """The text without what was put behind its end."""
    while text:
        last = text[-1]
        if last.isalnum() or (last == "." and not text.endswith("...")):
            return text
        tail = text[-_TAIL:]
        found = _BEHIND.search(tail)
        if not found:
            return text
        text = text[: len(text) - len(tail) + found.start()]
        if found.start():
            return text
    return text


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below ``_LOOKED_UP``: whether it is a letter, and its lower case."""
    chars = [chr(k) for k in range(_LOOKED_UP)]
    return np.array([c.isalpha() for c in chars]), np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint64)


#: Odd multipliers that make a word's hash that of the word as a whole, and as a part.
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BASE, _STRIDE_BITS = 0x5851F42D4C957F2D, 16
_STRIDE = 1 << _STRIDE_BITS


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64: the first ``_STRIDE``, and each ``_STRIDE``-th up to the ``n``-th."""
    small, large = np.full(_STRIDE, base, np.uint64), np.full(n // _STRIDE + 1, pow(base, _STRIDE, 1 << 64), np.uint64)
    for x in (small, large):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return small, large


@cache
def _leading() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the leading words, sorted, the class of each: the languages that it leads on in; and a table that tells most others from them."""
    words = sorted({w for own in LEADING_ON.values() for w in own})
    powers = _powers(_BASE, 0)[0]
    hashes = np.array([sum(ord(c) * int(p) for c, p in zip(w, powers, strict=False)) % (1 << 64) for w in words], np.uint64)
    classes = np.array([sum(1 << k for k, own in enumerate(LEADING_ON.values()) if w in own) for w in words])
    order = np.argsort(hashes)
    near = np.zeros(1 << 12, bool)
    near[(hashes * _FACTORS[0]) >> np.uint64(52)] = True
    return hashes[order], classes[order], near


def _hash(x: np.ndarray, c: np.ndarray | int) -> np.ndarray:
    x = (x ^ np.asarray(c, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: Whether a character below 128 is a leading mark.
_MARKS = np.array([chr(k) in LEADING_MARKS for k in range(128)])
#: 1 for brackets that open, 2 for those that close, 3 and 4 for angles, which do so if doubled, 5 and 6 for stars and ticks.
_SIGNS = np.zeros(_LOOKED_UP, np.uint8)
_SIGNS[[ord(c) for c in "([{)]}<>*`"]] = [1, 1, 1, 2, 2, 2, 3, 4, 5, 6]


def _leads(words: np.ndarray) -> np.ndarray:
    """The class of each hash of a word, 0 for words that lead on to nothing."""
    hashes, classes, near = _leading()
    out = np.zeros(len(words), np.int64)
    some = np.flatnonzero(near[(words * _FACTORS[0]) >> np.uint64(52)])
    place = np.minimum(np.searchsorted(hashes, words[some]), len(hashes) - 1)
    out[some] = np.where(hashes[place] == words[some], classes[place], 0)
    return out


def _named(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of small numbers; 0 for 0."""
    return np.where(x > 0, _hash(_hash(np.zeros(len(x), np.uint64), x), salt) | np.uint64(1), np.uint64(0))


class Texts:
    """Bodies of a batch as one array of characters, digits collapsed."""

    def __init__(self, bodies: list[str]):
        gap = "\0" * _GAP
        chars = np.frombuffer((gap + gap.join(bodies)).encode("utf-32-le", "surrogatepass"), np.uint32)
        digits = (chars >= 48) & (chars <= 57)
        kept = np.ones(len(chars), bool)
        kept[1:] = ~(digits[1:] & digits[:-1])
        places = np.concatenate([[0], np.cumsum(kept)])
        ends = np.cumsum(np.array([len(b) + _GAP for b in bodies], np.int64))
        self.ends = places[ends]
        self.first = places[np.concatenate([[0], ends[:-1]])[: len(ends)] + _GAP]
        self.chars = np.where(digits, np.uint32(48), chars)[kept]
        n = len(self.chars)
        starts = np.zeros(n + 1, np.int64)
        after = np.flatnonzero(self.chars == 10) + 1
        starts[after] = after
        starts[self.first] = self.first
        self.lines = np.maximum.accumulate(starts)
        small = self.chars | 32
        letters = (self.chars > 127) | ((small >= 97) & (small <= 122))
        self.shape = np.where(letters, np.uint32(97), self.chars)

    def inside(self) -> np.ndarray:
        """Every position within the texts: characters before it and after it."""
        within = np.ones(len(self.chars), bool)
        within[(self.first[:, None] - np.arange(_GAP + 1)).ravel()] = False
        return np.flatnonzero(within)

    def _classes(self) -> None:
        """What the contexts of classes need: letters, word starts, running hashes, running counts of fences and brackets."""
        isalpha, lower = _letters()
        known = np.minimum(self.chars, _LOOKED_UP - 1)
        self.letter, low = isalpha[known], lower[known]
        above = np.flatnonzero(self.chars >= _LOOKED_UP)
        self.letter[above], low[above] = self.chars[above] < _PICTOGRAPHS, self.chars[above]
        n = len(self.chars)
        starts = np.flatnonzero(self.letter[1:] & ~self.letter[:-1]) + 1  # a gap comes first
        self.word = np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
        self.runs = starts, np.flatnonzero(np.append(self.letter[:-1] & ~self.letter[1:], self.letter[-1])) + 1
        self.running = np.zeros(n + 1, np.uint64)
        small, large = _powers(_BASE, n)
        for k in range(0, n, _STRIDE):
            low[k : k + _STRIDE] *= large[k // _STRIDE] * small[: min(_STRIDE, n - k)]
        np.cumsum(low, out=self.running[1:])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)
        marks = np.flatnonzero(_SIGNS[known])  # few: brackets, stars and ticks
        kind, char = _SIGNS[known[marks]], self.chars[marks]
        same = [char == self.chars[marks - k] for k in (1, 2, 3)]
        steps = np.zeros((3, len(marks)), np.int64)  # brackets, fences, stars
        steps[0] = np.where((kind == 1) | (kind == 3) & same[0], 1, np.where((kind == 2) | (kind == 4) & same[0], -1, 0))
        steps[1] = (kind == 6) & same[0] & same[1] & ~same[2]
        steps[2] = (kind == 5) & same[0] & ~same[1]
        some = steps.any(axis=0)
        self.marks, self.steps = marks[some], np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(steps[:, some], axis=1)], axis=1)

    def _word(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of the letters before each position."""
        start = self.word[at - 1]
        return start, (self.running[at] - self.running[start]) * self.inverse[0][start & (_STRIDE - 1)] * self.inverse[1][start >> _STRIDE_BITS]

    def _opened(self, at: np.ndarray, line: np.ndarray, first: np.ndarray) -> np.ndarray:
        """1 where a bracket or a pair of stars is open in the line, or a fence in the text."""
        now, of_line, of_text = (self.steps[:, np.searchsorted(self.marks, x)] for x in (at, line, first))
        odd = (now[1] - of_text[1] | now[2] - of_line[2]) & 1
        return ((now[0] > of_line[0]) | (odd == 1)).astype(np.int64)

    def _open_positions(self) -> int:
        """How many positions within are ``_opened``, which changes only at marks and new lines."""
        lines = np.unique(self.lines[:-1])
        events = np.unique(np.concatenate([self.first + 1, lines[lines > 0] + 1, self.marks + 1, self.ends]))
        text = np.searchsorted(self.first, events - 1, side="right") - 1
        inside = (text >= 0) & (events < self.ends[text])
        events, text, until = events[inside], text[inside], np.append(events, 0)[1:][inside]
        line = np.maximum(self.lines[events - 1], self.first[text])
        return int(((until - events) * self._opened(events, line, self.first[text])).sum())

    def class_contexts(self, at: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashes of the contexts of classes before the positions: leading word or mark, what is open, the word so far, unless it begins its line, as a whole and as a part; 0 where there is none."""
        if not hasattr(self, "letter"):
            self._classes()
        line = np.maximum(self.lines[at - 1], first)
        start, word = self._word(at)
        letter = self.letter[at - 1] & (start > line)
        leads = np.where(letter, _leads(word), 0)
        leads = np.where(_MARKS[np.minimum(self.chars[at - 1], 127)], 1 << len(LEADING_ON), leads)
        return [_named(leads, 600), _named(self._opened(at, line, first), 700), *(np.where(letter, word * factor | np.uint64(1), np.uint64(0)) for factor in _FACTORS)]

    def contexts(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hashes of the contexts before the positions, shortest first; 0 where there is none. ``first``: where their texts start."""
        seed = np.zeros(len(at), np.uint64)

        def char(k: int) -> np.ndarray:
            where = at - k
            return np.where(where >= first, self.chars[np.maximum(where, 0)], 0)

        def grown(x: np.ndarray, sizes: tuple[int, ...], salt: int) -> list[np.ndarray]:
            out = []
            for k in range(1, max(sizes) + 1):
                x = _hash(x, char(k))
                if k in sizes:
                    out.append(_hash(x, salt + k) | np.uint64(1))
            return out

        line = self.lines[np.maximum(at - 1, 0)]
        line = np.maximum(line, first)

        def head(k: int, values: np.ndarray) -> np.ndarray:
            where = line + k
            return np.where(where < at, values[np.minimum(where, len(values) - 1)], 0)

        out = grown(seed, (1,), 100)
        kind = _hash(_hash(seed, head(0, self.shape)), head(1, self.shape))
        out += grown(kind, _SIZES, 200)
        alone = line == first
        apart = alone | ((self.chars[np.maximum(line - 1, 0)] == 10) & (self.chars[np.maximum(line - 2, 0)] == 10) & (line - 2 >= first))
        short = apart & (at - line < SHORT_LINE)
        word = head(0, self.shape) == 97
        name = _hash(_hash(seed, head(0, self.chars)), np.where(word, head(1, self.chars), head(1, self.shape)))
        name = np.where(word, _hash(_hash(name, head(2, self.chars)), head(3, self.chars)), name)
        name = np.where(alone, np.uint64(12345), name)
        out += [np.where(short, x, np.uint64(0)) for x in [_hash(name, 300) | np.uint64(1), *grown(name, (1, 3, 6), 300)]]
        return np.stack(out, axis=1)

    def continued_classes(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of classes at every position within that the filter holds, and how often each occurs; a word is whole where no letter follows."""
        if not hasattr(self, "letter"):
            self._classes()
        at = self.inside()
        leading = np.zeros(2 << len(LEADING_ON), np.int64)
        leading[1 << len(LEADING_ON)] = _MARKS[np.minimum(self.chars[at - 1], 127)].sum()
        # words that don't begin their line, and every position behind one of their letters but the end of a text
        starts, stops = self.runs
        good = self.lines[starts] < starts
        starts, stops = starts[good], np.minimum(stops[good], self.ends[np.searchsorted(self.first, starts[good], side="right") - 1] - 1)
        sizes = np.maximum(stops - starts, 0)
        places = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + 1
        words = self.running[places]
        words -= np.repeat(self.running[starts], sizes)
        words *= np.repeat(self.inverse[0][starts & (_STRIDE - 1)] * self.inverse[1][starts >> _STRIDE_BITS], sizes)
        part = self.letter[places]
        leading += np.bincount(_leads(words[~part]), minlength=len(leading))
        words *= _FACTORS[part.view(np.int8)]
        words |= np.uint64(1)
        values, counts = np.unique(words[_held(bits, words)], return_counts=True)
        names = np.concatenate([values, _named(np.arange(len(leading)), 600), _named(np.ones(1, np.int64), 700)])
        counts = np.concatenate([counts, leading, [self._open_positions()]])
        kept = (counts > 0) & (names > 0)
        return names[kept], counts[kept]

    def continued(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Contexts of ``contexts`` at every position within that a Bloom filter holds, how often each occurs, and the number of positions."""
        at = self.inside()
        found: list[list[np.ndarray]] = [[] for _ in range(_LEVELS)]
        chars = self.chars.astype(np.uint64)
        zero = np.zeros(1, np.uint64)
        # a line's kind and name, as of its first, second, third and fourth character on
        starts = np.flatnonzero(np.diff(self.lines[:-1], prepend=-1))
        starts = self.lines[starts]
        number = np.zeros(len(self.chars) + 1, np.int64)
        number[starts[1:]] = 1
        number = np.cumsum(number)
        char = lambda k: self.chars[np.minimum(starts + k, len(self.chars) - 1)]
        shape = lambda k: self.shape[np.minimum(starts + k, len(self.chars) - 1)]
        kinds = [_hash(_hash(zero, shape(0)), shape(1) if k > 1 else 0) for k in (1, 2)]
        word = shape(0) == 97
        alone = np.isin(starts, self.first)
        apart = alone | ((self.chars[starts - 1] == 10) & (self.chars[starts - 2] == 10) & ~np.isin(starts - 1, self.first))
        names = []
        for k in (1, 2, 3, 4):
            name = _hash(_hash(zero, char(0)), np.where(word, char(1), shape(1)) if k > 1 else 0)
            name = np.where(word, _hash(_hash(name, char(2) if k > 2 else 0), char(3) if k > 3 else 0), name)
            names.append(np.where(alone, np.uint64(12345), name))
        kinds, names = np.stack(kinds, axis=1).ravel(), np.stack(names, axis=1).ravel()

        def grow(own: np.ndarray, x: np.ndarray, sizes: tuple[int, ...], salt: int, level: int) -> None:
            for k in range(1, max(sizes) + 1):
                x = _hash(x, chars[own - k])
                if k not in sizes:
                    continue
                full = _hash(x, salt + k) | np.uint64(1)
                if k > 2:  # nearly every shorter one ends some text
                    kept = np.flatnonzero(_held(bits, full))
                    own, x, full = own[kept], x[kept], full[kept]
                found[level].append(full)
                level += 1

        for i in range(0, len(at), _BLOCK):
            own = at[i : i + _BLOCK]
            line = number[own - 1]
            into = own - starts[line]
            grow(own, kinds[line * 2 + (into > 1)], _SIZES, 200, 1)
            short = np.flatnonzero((into < SHORT_LINE) & apart[line])
            own, line, into = own[short], line[short], into[short]
            x = names[line * 4 + np.minimum(into, 4) - 1]
            full = _hash(x, 300) | np.uint64(1)
            kept = np.flatnonzero(_held(bits, full))
            found[1 + len(_SIZES)].append(full[kept])
            grow(own[kept], x[kept], (1, 3, 6), 300, 2 + len(_SIZES))
        values, counts = np.unique(self.chars[at - 1], return_counts=True)
        parts = [(_hash(_hash(np.zeros(len(values), np.uint64), values), 101) | np.uint64(1), counts)]
        parts += [np.unique(np.concatenate(x), return_counts=True) for x in found if x]
        values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts])
        kept = _held(bits, values)
        return values[kept], counts[kept], len(at)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and bodies, some at a time; texts without a body are left out."""
    for batch in batches:
        keys, bodies, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = body(text.as_py() or "")
            if not own:
                continue
            keys.append(key)
            bodies.append(own)
            size += len(own)
            if size >= _SLICE:
                yield keys, bodies
                keys, bodies, size = [], [], 0
        if keys:
            yield keys, bodies


def _identity(own: str) -> int:
    """A signed 64-bit hash of a body."""
    try:
        value = xxhash.xxh3_64_intdigest(own)
    except UnicodeEncodeError:
        value = xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def _bloom(hashes: DataFrame, name: str) -> np.ndarray:
    """A filter of a column of hashes, of a size by their number; beyond the largest size it only lets more through."""
    log = min(BLOOM_BITS[1], max(BLOOM_BITS[0], (8 * hashes.count()).bit_length()))
    place = F.shiftrightunsigned(name, 64 - log)
    words = hashes.groupBy((F.shiftright(place, 6)).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - log}) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (log - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _held(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the filter holds each hash."""
    place = x >> np.uint64(65 - 6 - len(bits).bit_length())
    return (bits[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


#: What is known of the end of a body: hashes of the body and of its contexts, the contexts themselves where a task meets them first, whether it ends with a letter and is short.
ENDS = "body bigint, final bigint, contexts array<bigint>, open boolean, short boolean"


@lru_cache(maxsize=100_000)
def _word_hash(word: str) -> int:
    """The hash that ``Texts`` gives a word."""
    lower = _letters()[1]
    chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(chars < _LOOKED_UP, lower[np.minimum(chars, _LOOKED_UP - 1)], chars)
    return int((low * _word_powers(len(word))).sum())


@cache
def _word_powers(n: int) -> np.ndarray:
    small, large = _powers(_BASE, n)
    return np.multiply.outer(large, small).ravel()[:n]


def _is_letter(c: str) -> bool:
    return c.isalpha() if (k := ord(c)) < _LOOKED_UP else k < _PICTOGRAPHS


def end_classes(bodies: list[str]) -> list[np.ndarray]:
    """``class_contexts`` of the ends of bodies, from their last lines and fences."""
    words, leads, opened = (np.zeros(len(bodies), t) for t in (np.uint64, np.int64, np.int64))
    for k, body in enumerate(bodies):
        line = body[body.rfind("\n") + 1 :]
        at = len(line)
        while at and _is_letter(line[at - 1]):
            at -= 1
        if 0 < at < len(line):
            words[k] = _word_hash(line[at:])
        elif line and line[-1] in LEADING_MARKS:
            leads[k] = 1 << len(LEADING_ON)
        depth = line.count("(") - line.count(")") + line.count("[") - line.count("]") + line.count("{") - line.count("}")
        if "<<" in line or ">>" in line:
            depth += len(_INWARD.findall(line)) - len(_OUTWARD.findall(line))
        opened[k] = depth > 0 or ("**" in line and len(_STARS.findall(line)) % 2 > 0) or ("```" in body and len(_FENCES.findall(body)) % 2 > 0)
    leads = np.where(words > 0, _leads(words), leads)
    return [_named(leads, 600), _named(opened, 700), *(np.where(words > 0, words * factor | np.uint64(1), np.uint64(0)) for factor in _FACTORS)]


class Ends:
    """The columns of ``ENDS`` for the bodies of a task."""

    def __init__(self, classes: bool = False):
        self.classes = classes
        self.met: set[int] = set()

    def columns(self, bodies: list[str]) -> list[pa.Array]:
        """Null for empty bodies."""
        full = [b for b in bodies if b]
        texts = Texts(full)
        there = np.array([bool(b) for b in bodies], bool)
        flat = texts.contexts(texts.ends, texts.first)
        if self.classes:
            flat = np.concatenate([flat, np.stack(end_classes(full), axis=1)], axis=1)
        final = np.zeros(len(full), np.uint64)
        for k in range(flat.shape[1]):
            final = _hash(final, flat[:, k])
        new = np.zeros(len(bodies), bool)
        for at, name in zip(np.flatnonzero(there).tolist(), final.tolist(), strict=True):
            if name not in self.met:
                new[at] = True
                self.met.add(name)
        own = flat[new[there]].view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(new * flat.shape[1])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel()), mask=pa.array(~new))
        names = np.zeros(len(bodies), np.int64)
        names[there] = final.view(np.int64)
        return [pa.array([_identity(b) if b else None for b in bodies], pa.int64()), pa.array(names, mask=~there), lists, pa.array([b[-1].isalpha() if b else None for b in bodies], pa.bool_()), pa.array([len(b) <= SHORT_LINE if b else None for b in bodies], pa.bool_())]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = Ends()
    for keys, bodies in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *ends.columns(bodies)], ["key", *END_NAMES])


END_NAMES = [x.split()[0] for x in ENDS.split(", ")]


def _joined(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of unique keys on the right; heavy ones, at most ``HEAVY`` a level, are broadcast."""
    least = max(2, total // HEAVY)
    heavy, light = right.where(F.col(weight) >= least), right.where(F.col(weight) < least)
    return left.join(F.broadcast(heavy), key).unionByName(left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def log_odds(df: DataFrame) -> DataFrame:
    """(key, odds) of the rows (key bigint, text): log-odds of an end against continuation, once for each key."""
    texts = df.where("key is not null and length(text) > 0").select("key", "text")
    found = cut_lineage(texts.mapInArrow(_ends, f"key bigint, {ENDS}"))
    ends = cut_lineage(found.groupBy("key", "body").agg(F.count("*").alias("rows"), F.first("final").alias("final"), F.first("short").alias("short")))
    return with_odds(ends.select("key", "final").dropDuplicates(["key"]), score(found, ends, texts), ends.count()).select("key", "odds")


def with_odds(rows: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows (final, ...) with the odds of their final contexts."""
    return _joined(rows, scored, "final", "texts", n)


def score(found: DataFrame, ends: DataFrame, texts: DataFrame, classes: bool = False) -> DataFrame:
    """(final, texts, odds): log-odds of an end against continuation for each list of contexts, by its hash.

    ``found``: ``ENDS`` as the tasks gave them, with each list of contexts at least once. ``ends``: (body, final, short, rows), a row for each text and
    in how many rows of ``texts`` it stands. ``texts``: (.., text), in which continuations are counted.
    ``classes`` takes the least share from contexts of four characters on, for texts that end with a letter, and from the contexts of classes.
    """
    spark = ends.sparkSession
    bodies = cut_lineage(ends.groupBy("body").agg(F.sum("rows").alias("rows"), F.count("*").alias("texts"), F.first("final").alias("final"), F.first("short").alias("short")))
    counted = F.when(F.col("short"), F.col("texts")).otherwise(1)
    per = bodies.groupBy("final").agg(F.sum("texts").alias("texts"), F.sum(counted).alias("counted"))
    shapes = found.where("contexts is not null").groupBy("final").agg(F.first("contexts").alias("contexts"), F.first("open").alias("open"))
    finals = cut_lineage(per.join(shapes, "final"))
    total = finals.agg(F.sum("counted")).first()[0] or 0
    ended = cut_lineage(finals.select("counted", F.explode("contexts").alias("context")).where("context <> 0").groupBy("context").agg(F.sum("counted").alias("ended")))
    shared = spark.sparkContext.broadcast((_bloom(ended, "context"), _bloom(bodies.where("rows > 1 and not short"), "body")))
    schema = "context bigint, n bigint, body bigint, own string"

    def counted(slices: Iterator[tuple[list[str], dict[int, str]]]) -> Iterator[pa.RecordBatch]:
        """Counts of the contexts of some bodies, and other bodies as they are."""
        bits = shared.value[0]
        kept, held, seen = [], 0, 0

        def rows(contexts: np.ndarray, n: np.ndarray, copies: dict[int, str]) -> pa.RecordBatch:
            own, none = len(copies), len(contexts)
            columns = [pa.array([*contexts.tolist(), *[None] * own], pa.int64()), pa.array([*n.tolist(), *[None] * own], pa.int64()), pa.array([*[None] * none, *copies], pa.int64()), pa.array([*[None] * none, *copies.values()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["context", "n", "body", "own"])

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            sums = np.bincount(counts, weights=np.concatenate([n for _, n in kept]), minlength=len(values))
            return rows(values.view(np.int64), sums.astype(np.int64), {})

        for single, copies in slices:
            if copies:
                yield rows(np.zeros(0, np.int64), np.zeros(0, np.int64), copies)
            if not single:
                continue
            some = Texts(single)
            values, counts, positions = some.continued(bits)
            seen += positions
            if classes:
                more = some.continued_classes(bits)
                values, counts = np.concatenate([values, more[0]]), np.concatenate([counts, more[1]])
            kept.append((values, counts))
            held += len(values)
            if held > 4_000_000:
                yield flush()
                kept, held = [], 0
        if kept:
            yield flush()
        yield rows(np.zeros(1, np.int64), np.array([seen]), {})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value[1]

        def parted() -> Iterator[tuple[list[str], dict[int, str]]]:
            for _, own in _slices(batches):
                names = np.array([_identity(b) for b in own], np.int64)
                many = _held(repeated, names.view(np.uint64))
                yield [b for b, m in zip(own, many, strict=True) if not m], {n: b for n, b, m in zip(names.tolist(), own, many, strict=True) if m}

        return counted(parted())

    def inside_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parted() -> Iterator[tuple[list[str], dict[int, str]]]:
            for batch in batches:
                own, size = [], 0
                for b in batch.column(0).to_pylist():
                    own.append(b)
                    size += len(b)
                    if size >= _SLICE:
                        yield own, {}
                        own, size = [], 0
                if own:
                    yield own, {}

        return counted(parted())

    once = cut_lineage(texts.select(F.lit(0), "text").mapInArrow(inside, schema))
    copies = once.where("own is not null").groupBy("body").agg(F.first("own").alias("own")).select("own").mapInArrow(inside_copies, schema)
    went_on = cut_lineage(once.where("own is null").unionByName(copies).groupBy("context").agg(F.sum("n").alias("inside")))
    positions = went_on.where("context = 0").agg(F.sum("inside")).first()[0] or 0
    weight = total / positions if positions else 1.0  # ends and continuations are equally likely beforehand
    model = ended.join(went_on, "context", "left").select("context", "ended", F.coalesce("inside", F.lit(0)).alias("inside"))
    model = cut_lineage(model)
    levels = finals.select("final", "open", F.posexplode("contexts").alias("level", "context")).where("context <> 0")
    known = _joined(levels, model, "context", "ended", total)

    def refine(state, x):
        level, own = x["level"], x["ended"] - 1  # without the text itself
        share = lambda before: (own + PRIOR * before) / (own + x["inside"] * weight + PRIOR)
        characters = level < _LEVELS
        refined = F.when(characters, share(state["share"])).otherwise(state["share"])
        least = F.when(level.between(4, len(_SIZES)) & state["open"], F.least(state["least"], refined)).when(level.isin(_CLASS, _OPEN), F.least(state["least"], share(F.lit(0.5)))).otherwise(state["least"])
        counts = [F.when(level == k, x["inside"]).otherwise(state[name]).alias(name) for name, k in (("whole", _WHOLE), ("part", _PART))]
        return F.struct(refined.alias("share"), least.alias("least"), state["open"].alias("open"), *counts)

    steps = F.array_sort(F.collect_list(F.struct("level", "ended", "inside")))
    start = F.struct(F.lit(0.5).alias("share"), F.lit(1.0).alias("least"), F.any_value("open").alias("open"), *(F.lit(0).cast("long").alias(c) for c in ("whole", "part")))
    shares = known.groupBy("final").agg(steps.alias("steps"), start.alias("start")).select("final", F.aggregate("steps", F.col("start"), refine).alias("got"))
    share = F.col("got.share")
    if classes:
        word = (F.col("got.whole") + WHOLE_PRIOR * WHOLE_WORDS) / (F.col("got.whole") + F.col("got.part") + WHOLE_PRIOR)
        share = F.least(share, "got.least", word)
    odds = F.log((share + 1e-9) / (1 - share + 1e-9))
    return cut_lineage(finals.select("final", "texts").join(shares, "final").select("final", "texts", odds.alias("odds")))


def thresholds(scored: DataFrame) -> dict[tuple[str, str], float]:
    """The threshold of each (language, column): the emptiest place of the histogram of log-odds.

    To a language's own texts come ``ALL_TEXTS`` spread as those of all languages in the column, so that
    few texts take the threshold of all, many their own, and no number of them switches the rule.
    """
    width = 0.25
    bins = scored.groupBy("language", "column", F.floor(F.col("odds") / width).alias("bin")).agg(F.count("*").alias("n")).where(F.col("bin").between(-400, 400)).collect()
    out: dict[tuple[str, str], float] = {}
    for key in {(r.language, r.column) for r in bins}:
        every: Counter = Counter()
        for r in bins:
            if r.column == key[1]:
                every[r.bin] += r.n
        own = {b: n * ALL_TEXTS / every.total() for b, n in every.items()}
        for r in bins:
            if (r.language, r.column) == key:
                own[r.bin] += r.n
        near = [math.floor(VALLEY[0] / width) + k for k in range(int((VALLEY[1] - VALLEY[0]) / width) + 1)]
        smooth = {b: sum(own.get(b + d, 0) * w for d, w in ((-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1))) for b in near}
        out[key] = width / 2 + width * min(near, key=lambda b: (smooth[b], abs(b * width + width / 2 - THRESHOLD)))
    return out


def below_threshold(scored: DataFrame) -> DataFrame:
    """The rows of (key, odds, language, column, ...) whose log-odds are below their threshold."""
    limits = thresholds(scored)
    limit = F.lit(THRESHOLD)
    for (lang, column), value in limits.items():
        limit = F.when((F.col("language") == lang) & (F.col("column") == column), value).otherwise(limit)
    return scored.where(F.col("odds") < limit)


def normal_language(lang: Column) -> Column:
    """Two letters of a language column however it is spelled, ``und`` for null and blank."""
    name = F.lower(F.trim(lang))
    word = F.regexp_extract(name, r"^\p{L}+", 0)
    out = F.when(name == "", "und")
    for two, names in LANGUAGE_NAMES.items():
        out = out.when(word.isin(names.split()), two)
    return F.coalesce(out.otherwise(F.substring(name, 1, 2)), F.lit("und"))


def find_cut(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key,): the keys of the rows whose text was cut."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), normal_language(F.col(lang)).alias("language")).where("key is not null").dropDuplicates(["key"])
    scored = log_odds(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).dropDuplicates(["key"])
    scored = cut_lineage(scored.join(rows.select("key", "language"), "key").withColumn("column", F.lit(text)))
    return below_threshold(scored).select(F.col("key").alias(key))


def cut_by_source(df: DataFrame, found: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(source, texts, cut, share) over the texts that aren't blank; a null source is a source."""
    rows = df.where(F.col(text).rlike(r"(?U)\S")).groupBy(F.col(key).cast("long").alias(key)).agg(F.max(source).alias("source"))
    flagged = rows.join(found.withColumn("cut", F.lit(1)), key, "left")
    return flagged.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.coalesce("cut", F.lit(0))).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))

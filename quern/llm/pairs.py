"""Broken pairs of a user message and the assistant message after it.

Method: an answer that compresses to almost nothing with its question as the
zstandard dictionary is a copy; dictionaries of function words find wrong languages,
and dictionaries of words that deny, answer or forbid find refusals (``stance``); the
backward character model of ``cuts``, trained on all answers, finds truncated ones,
with contexts for words that lead on, for open brackets and fences, and for parts of words.

A pair is an assistant message directly after a user message, roles compared
without case and outer blanks. It has one defect at most, the first of: empty,
refusal, copy, wrong_language, truncated.

Results: a repeated row or request counts once (of rows with the same key and
different texts the greatest text, of requests the one with the greatest hash); null, empty and open conversations have no
pair; a null question is an empty one; a null answer is empty.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import cuts, language
from quern.llm.stance import is_refusal
from quern.session import cut_lineage

#: Share of an answer that its question as dictionary may leave, and the least and most share of the question that a copy covers.
COPY_COST, COPY_LEAST, COPY_MOST = 0.34, 0.6, 1.3
#: Function words an answer needs in another language, and how many times as many as it has in the question's; a single one is too often a word of either.
#: The languages of a question are those with that share of the function words of the first.
WRONG_LEAST, WRONG_MARGIN, ASKED_MARGIN = 2, 2.0, 1.2

#: The names of the languages in each other.
NAMES = {"en": r"english|englisch\w*|anglais\w*|ingl[ée]s\w*", "de": r"german|deutsch\w*|allemand\w*|alem[aá]n\w*", "fr": r"french|französisch\w*|fran[çc]ais\w*|franc[ée]s\w*", "es": r"spanish|spanisch\w*|espagnol\w*|espa[ñn]ol\w*|castellano"}
#: Characters of pairs handled at a time.
SLICE_CHARS = 2_000_000
DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")

#: What asks for a language, before its name or in its sentence.
IN = r"(?:in|into|to|auf|ins|en|al)"
ASKING = r"answer|repl(?:y|ies)|respon|write|writ|speak|talk|say|translat|practi[sc]|learn|switch|use|antwort|schreib|sprech|sprich|sag|übersetz|übe|lern|wechs|répon|écri|parl|dis|tradui|appren|exer|contest|escrib|habl|di(?:me|lo)|traduc|aprend|practic"
_TAGS = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_SAYS = re.compile(r"[^\W_]")
_SYMBOLS = re.compile(r"[^\W\d_]|\d|[\U0001F300-\U0001FAFF☀-➿]")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<!:)\n+")
_NAMES = {lang: re.compile(rf"\b(?:{names})\b") for lang, names in NAMES.items()}
_IN = {lang: re.compile(rf"\b{IN}\s+(?:{names})\b") for lang, names in NAMES.items()}
_ASKING = re.compile(rf"\b(?:{ASKING})")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.DOTALL)
_CHARS = re.compile(r"[\W_]+")


def is_empty(answer: str | None) -> bool:
    """Whether nothing but markup, blanks and punctuation is there."""
    if answer is None:
        return True
    if _SAYS.search(answer[:40]) and "<" not in answer[:40] and "&" not in answer[:40]:
        return False
    return not _SYMBOLS.search(html.unescape(_TAGS.sub(" ", answer)).replace("﻿", ""))


def _squeezed(text: str) -> bytes:
    return _CHARS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def _may_be_copy(asked: list[str], said: list[str]) -> bool:
    """Whether half of the words, as blanks part them, are in the question, or there are too few to tell; what has fewer is no slight alteration."""
    if len(said) < 6:
        return True
    known = set(asked)
    return sum(map(known.__contains__, said)) * 2 >= len(said)


class Copies:
    """Compresses answers with their questions as dictionaries."""

    def __init__(self):
        import zstandard

        self.zstd = zstandard

    def costs(self, question: bytes, parts: list[bytes]) -> list[float]:
        """Bytes that each part of an answer adds to its question, as a share of its own."""
        shared = self.zstd.ZstdCompressionDict(question, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        params = self.zstd.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=self.zstd.FORMAT_ZSTD1_MAGICLESS)
        squeeze = self.zstd.ZstdCompressor(dict_data=shared, compression_params=params).compress
        return [max(0, len(squeeze(x)) - 6) / max(1, len(x)) for x in parts]

    def is_copy(self, question: str, answer: str, asked: list[str] | None = None, said: list[str] | None = None) -> bool:
        """Whether each sentence of the answer, however often it stands there, is one of the question's, and together they cover it or its last sentence; ``asked`` and ``said`` as in ``is_wrong_language``."""
        if len(answer) > COPY_MOST * len(question) + 24 and answer.find(answer[:32], 1) < 0:
            return False
        if not _may_be_copy(question.lower().split() if asked is None else asked, answer.lower().split() if said is None else said):
            return False
        parts = list(dict.fromkeys(filter(None, map(_squeezed, _SENTENCES.split(answer)))))
        size = sum(map(len, parts)) + len(parts) - 1
        if not parts:
            return False
        whole = _squeezed(question)
        known, said = set(whole.split()), [w for x in parts for w in x.split()]
        if sum([w in known for w in said]) * 4 < len(said):
            return False  # with a quarter of its words the question can't be given back
        last = _squeezed(_SENTENCES.split(question.strip())[-1])
        if not any(len(asked) >= 8 and COPY_LEAST * len(asked) <= size <= COPY_MOST * len(asked) + 16 for asked in (whole, last)):
            return False
        if b" ".join(parts) in (whole, last):
            return True
        short = [x for x in parts if len(x) < 8]
        long = [x for x in parts if len(x) >= 8]
        return all(x in whole for x in short) and all(c <= COPY_COST for c in self.costs(whole, long))


def is_wrong_language(question: str, answer: str, asked: list[str] | None = None, said: list[str] | None = None) -> tuple[bool, str]:
    """Whether the answer is in another language than the question and none that it asks for; the answer's language. ``asked`` and ``said``: both in lower case, parted at blanks.

    A question whose words leave several languages open is in all of them.
    """
    letters = language.hit_letters(said if said is not None and "`" not in answer else _CODE.sub(" ", answer).lower().split())
    hits = language.counted(letters)
    most = max(hits)
    if not most or hits.count(most) > 1:
        return False, language.UNKNOWN
    place = hits.index(most)
    own = language.LANGUAGES[place]
    if most < WRONG_LEAST:
        return False, own
    theirs = language.counted(language.hit_letters(question.lower().split() if asked is None else asked))
    top = max(theirs)
    if not top or ASKED_MARGIN * theirs[place] >= top:
        return False, own
    alone = language.counted(letters, alone=True)
    if alone[place] < WRONG_MARGIN * max(a for a, n in zip(alone, theirs, strict=True) if ASKED_MARGIN * n >= top):
        return False, own
    return not asks_for(question, own), own


def asks_for(question: str, lang: str) -> bool:
    """Whether a question asks to be answered in a language: with "in" before its name, or a word like "write" in the name's sentence."""
    asked = question.lower()
    if not _NAMES[lang].search(asked):
        return False
    return bool(_IN[lang].search(asked)) or any(_NAMES[lang].search(x) and _ASKING.search(x) for x in _SENTENCES.split(asked))


def _role(role: Column) -> Column:
    return F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))


def request_pairs(requests: DataFrame) -> DataFrame:
    """(record_id, turn, question, answer, rows) of the messages arrays, once for each row of the table."""
    pairs = F.transform("messages", lambda m, i: F.struct(i.alias("turn"), F.when(i > 0, F.get("messages", i - 1)).alias("before"), m.alias("own")))
    rows = requests.where("request_id is not null").select(F.col("request_id").alias("record_id"), F.explode(pairs).alias("x"))
    return rows.where((_role(F.col("x.own.role")) == "assistant") & (_role(F.col("x.before.role")) == "user")).select("record_id", "x.turn", F.col("x.before.content").alias("question"), F.col("x.own.content").alias("answer"), F.lit(1).cast("long").alias("rows"))


def message_pairs(messages: DataFrame) -> DataFrame:
    """The same of a table of messages, once for each answer; each row is shuffled once, by the place of the answer."""
    rows = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("record_id"), "turn", _role(F.col("role")).alias("role"), "content")
    asked = rows.where("role = 'user'").groupBy("record_id", (F.col("turn") + 1).alias("turn")).agg(F.max("content").alias("question"))
    said = rows.where("role = 'assistant'").groupBy("record_id", "turn").agg(F.max("content").alias("answer"), F.count("*").alias("rows"))
    return asked.join(said, ["record_id", "turn"]).select("record_id", "turn", "question", "answer", "rows")


def defect_of(copies: Copies, question: str, answer: str | None) -> tuple[str | None, str]:
    """The defect that shows in the pair itself, and the answer's language."""
    if is_empty(answer):
        return "empty", language.UNKNOWN
    if is_refusal(answer):
        return "refusal", language.UNKNOWN
    asked, said = question.lower().split(), answer.lower().split()
    if copies.is_copy(question, answer, asked, said):
        return "copy", language.UNKNOWN
    wrong, lang = is_wrong_language(question, answer, asked, said)
    return "wrong_language" if wrong else None, lang


def classify(pairs: DataFrame) -> DataFrame:
    """(origin, record_id, turn, rows, defect, language) of (origin, record_id, turn, rows, question, answer), and ``cuts.ENDS`` of the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, ends = Copies(), cuts.Ends(classes=True)
        for batch in batches:
            questions, answers = (batch.column(k).to_pylist() for k in (4, 5))
            for start, end in _slices(questions, answers):
                found = [defect_of(copies, q or "", a) for q, a in zip(questions[start:end], answers[start:end], strict=True)]
                columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), *ends.columns([cuts.body(a or "") for a in answers[start:end]])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start) for k in range(4)), *columns], names)

    names = ["origin", "record_id", "turn", "rows", "defect", "language", *cuts.END_NAMES]
    rows = pairs.select("origin", F.col("record_id").cast("long"), F.col("turn").cast("int"), "rows", "question", "answer")
    return rows.mapInArrow(run, f"origin string, record_id bigint, turn int, rows bigint, defect string, language string, {cuts.ENDS}")


def _slices(questions: list[str | None], answers: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of some pairs, so that what is made of long texts doesn't stand in memory all at once."""
    start = size = 0
    for k, (q, a) in enumerate(zip(questions, answers, strict=True)):
        size += len(q or "") + len(a or "")
        if size >= SLICE_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(questions):
        yield start, len(questions)


def find_defects(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """(origin, record_id, turn, defect) of each defective pair."""
    key = ["origin", "record_id", "turn"]
    asked = classify(request_pairs(requests).withColumn("origin", F.lit("chat_requests")))
    said = classify(message_pairs(messages).withColumn("origin", F.lit("chat_messages")))
    found = cut_lineage(said.unionByName(asked))
    # repeated requests: of different answers in one place the one with the greatest hash
    own = F.struct("defect", "language", "body", "final", "short")
    repeated = found.where("origin = 'chat_requests'").groupBy(*key).agg(F.max_by(own, F.coalesce("body", F.lit(-(1 << 63)))).alias("x"), F.sum("rows").alias("rows")).select(*key, "rows", "x.*")
    both = cut_lineage(repeated.unionByName(found.where("origin <> 'chat_requests'").select(repeated.columns)))
    ends = both.where("body is not null").select("body", "final", "short", "rows")
    # continuations are counted where the answers stand, without pairing them
    answers = request_pairs(requests).select(F.col("answer").alias("text")).unionByName(messages.where(_role(F.col("role")) == "assistant").select(F.col("content").alias("text"))).where("length(text) > 0")
    scored = cuts.score(found, ends, answers, classes=True)
    whole = both.where("defect is null and body is not null").select(*key, "language", F.col("origin").alias("column"), "final")
    open_ = cut_lineage(cuts.with_odds(whole, scored, both.count()))
    cut = cuts.below_threshold(open_).select(*key, F.lit("truncated").alias("defect"))
    return both.where("defect is not null").select(*key, "defect").unionByName(cut)

"""Tasks, tokenizers and models as protocols, and the evaluations that only know these."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import bpe, chat, tasks
from quern.operators.order import running, slice_view
from quern.operators.tasks import KINDS, grade_number

Grade = Callable[[Column, Column], Column]


def same_letter(messages: Column, completion: Column) -> Column:
    """1 if the completion is the last message's letter."""
    return F.coalesce(F.element_at(messages, -1)["content"].eqNullSafe(completion), F.lit(False)).cast("int")


def same_number(messages: Column, completion: Column) -> Column:
    """1 if the completion's final answer is the last message's, or neither has one."""
    return grade_number(F.element_at(messages, -1)["content"], completion)


@dataclass(frozen=True)
class Task:
    """Conversations (idx, messages, ...) with the way they are evaluated; a slice of them is a view."""

    name: str
    kind: str
    rows: DataFrame
    grade: Grade
    start: int = 0
    stop: int | None = None
    step: int = 1

    def view(self) -> DataFrame:
        """The slice's rows, with a new idx from 0."""
        own = slice_view(self.rows, "idx", self.start, self.stop, self.step)
        return own.drop("idx").withColumnRenamed("slice_index", "idx")

    def sliced(self, start: int = 0, stop: int | None = None, step: int = 1) -> Task:
        return Task(self.name, self.kind, self.rows, self.grade, start, stop, step)

    def reward(self, messages: Column, completion: Column) -> Column:
        return self.grade(messages, completion).cast("double")


def task_of(kind: str, rows: DataFrame, order: list[Column], name: str | None = None) -> Task:
    """The task of a table of one of the ``KINDS``, indexed in an order."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {sorted(KINDS)}")
    indexed = running(rows, order, index="idx").drop("upto")
    return Task(name or kind, KINDS[kind], indexed, same_letter if KINDS[kind] == "categorical" else same_number)


class Tokenizer(Protocol):
    """Conversations to tokens, and tokens to text."""

    def prompts(self, rows: DataFrame, key: str, messages: str) -> DataFrame: ...

    def token(self, text: str) -> int: ...

    def decode(self, ids: Column) -> Column: ...


@dataclass(frozen=True)
class BytePairs:
    """A tokenizer by merges; without any its tokens are bytes."""

    merges: list[tuple[int, int]] = field(default_factory=list)
    most: int = 2048

    def prompts(self, rows: DataFrame, key: str, messages: str) -> DataFrame:
        """(``key``, ids): each conversation without its last message, and the start of an answer."""
        return chat.render_tokens(rows, key, messages, self.merges, self.most, completion=True).select(key, "ids")

    def token(self, text: str) -> int:
        ids = bpe.Encoder(self.merges).text(text)
        if len(ids) != 1:
            raise ValueError(f"{text!r} is not a single token")
        return ids[0]

    def decode(self, ids: Column) -> Column:
        return bpe.decode(ids, self.merges)


class NextToken(Protocol):
    """The score of a token behind others; only its order among tokens matters."""

    def score(self, ids: Column, token: Column) -> Column: ...


class Sampler(Protocol):
    """``n`` completions of each prompt (idx, ids, ...): (idx, sample, completion), sample from 0."""

    def complete(self, prompts: DataFrame, n: int) -> DataFrame: ...


def evaluate_letters(task: Task, tokenizer: Tokenizer, model: NextToken) -> DataFrame:
    """(idx, letter, correct): of the letters a problem has, the one that scores best at the end of its prompt, the first on ties."""
    view = task.view()
    prompts = tokenizer.prompts(view, "idx", "messages").where("ids is not null")
    every = sorted({r.letter for r in view.select(F.explode("letters").alias("letter")).distinct().limit(1000).collect()})  # letters are few
    known = F.create_map(*(F.lit(x) for letter in every for x in (letter, tokenizer.token(letter)))) if every else F.create_map().cast("map<string,int>")
    options = view.select("idx", "messages", F.posexplode("letters").alias("place", "letter")).join(prompts, "idx")
    scored = options.withColumn("score", model.score(F.col("ids"), known[F.col("letter")]))
    best = scored.groupBy("idx").agg(F.max_by(F.struct("letter", "messages"), F.struct("score", -F.col("place"))).alias("x"))
    return best.select("idx", F.col("x.letter").alias("letter"), task.grade(F.col("x.messages"), F.col("x.letter")).alias("correct"))


def evaluate_samples(task: Task, tokenizer: Tokenizer, model: Sampler, n: int) -> DataFrame:
    """(idx, passed, right): whether any of ``n`` completions is right, and how many are."""
    view = task.view()
    done = model.complete(tokenizer.prompts(view, "idx", "messages").where("ids is not null"), n)
    graded = done.join(view.select("idx", "messages"), "idx").select("idx", task.grade(F.col("messages"), F.col("completion")).alias("correct"))
    return graded.groupBy("idx").agg(F.max("correct").alias("passed"), F.sum("correct").alias("right"))


def evaluate(task: Task, tokenizer: Tokenizer, model: NextToken | Sampler, n: int = 1) -> DataFrame:
    """(task, problems, passed, accuracy) by the task's kind."""
    if task.kind == "categorical":
        got = evaluate_letters(task, tokenizer, model).select("idx", F.col("correct").alias("passed"))
    else:
        got = evaluate_samples(task, tokenizer, model, n)
    return got.agg(F.lit(task.name).alias("task"), F.count("*").alias("problems"), F.sum("passed").alias("passed"), F.avg("passed").alias("accuracy"))


def mixed(members: list[Task], seed: int = 42) -> DataFrame:
    """(position, task, idx, messages): the conversations of all tasks in a seeded order; a task given twice counts twice."""
    return _joined(tasks.mixture([t.view() for t in members], "idx", seed), members)


def in_turn(members: list[Task]) -> DataFrame:
    """The same one task after the other."""
    return _joined(tasks.sequence([t.view() for t in members], "idx"), members)


def _joined(places: DataFrame, members: list[Task]) -> DataFrame:
    rows = None
    for k, t in enumerate(members):
        own = t.view().select(F.lit(k).alias("task_idx"), F.lit(t.name).alias("task"), F.col("idx").alias("local"), "messages")
        rows = own if rows is None else rows.unionByName(own)
    return places.join(rows, ["task_idx", "local"]).select("position", "task", F.col("local").alias("idx"), "messages")


def listed_samples(prompts: DataFrame, tokenizer: Tokenizer, model: Sampler, unconditioned: int = 8) -> DataFrame:
    """(kind, idx, sample, text): a completion of each prompt (idx, ids) behind it, and several of nothing."""
    given = prompts.select("idx", "ids")
    nothing = given.sparkSession.createDataFrame([(0, [])], "idx bigint, ids array<int>")
    out = model.complete(given, 1).join(given, "idx").select(F.lit("prompt").alias("kind"), "idx", "sample", F.concat(tokenizer.decode(F.col("ids")), F.col("completion")).alias("text"))
    return out.unionByName(model.complete(nothing, unconditioned).select(F.lit("nothing").alias("kind"), "idx", "sample", F.col("completion").alias("text")))

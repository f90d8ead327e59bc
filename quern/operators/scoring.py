"""Scoring evaluation items with a pluggable model of byte tokens: render, find spans, score, decide."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import chat, tasks
from quern.operators.evals import option_choice


class Scorer(Protocol):
    """Nats of each token of an array given those before it, and the token it would say there."""

    def nll(self, ids: Column) -> Column: ...

    def greedy(self, ids: Column) -> Column: ...


class Unigram:
    """Token frequencies, whatever comes before; with equal counts the uniform model."""

    def __init__(self, counts: dict[int, int] | None = None, vocabulary: int = 265):
        import math

        weights = [(counts or {}).get(i, 0) + 1 for i in range(vocabulary)]
        total = sum(weights)
        self.table = F.array(*(F.lit(-math.log(w / total)) for w in weights))
        self.best = max(range(vocabulary), key=lambda i: (weights[i], -i))

    @classmethod
    def fitted(cls, docs: DataFrame, text: str = "text") -> Unigram:
        """From the bytes of all texts: 256 counts reach the driver."""
        from quern.operators.bpe import word_counts

        words = word_counts(docs, text)
        rows = words.select("n", F.explode(chat.byte_ids(F.col("word"))).alias("b")).groupBy("b").agg(F.sum("n").alias("n")).collect()
        return cls({r.b: r.n for r in rows})

    def nll(self, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.get(self.table, i))

    def greedy(self, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.lit(self.best))


def with_examples(items: DataFrame, settings: DataFrame) -> DataFrame:
    """``items`` with the examples and the delimiter of their task; ``settings`` (label, num_fewshot, continuation_delimiter), else none and a blank."""
    own = F.broadcast(settings.select(F.col("label").alias("task"), "num_fewshot", F.col("continuation_delimiter").alias("delimiter")))
    marked = items.join(own, "task", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(" ")))
    most = settings.agg(F.max("num_fewshot")).first()[0] or 0
    if most < 1:
        return marked.withColumn("examples", F.lit(""))
    shots = tasks.few_shot(items, "item_id", "task", most).join(marked.select("item_id", "num_fewshot"), "item_id").where("shot <= num_fewshot").drop("num_fewshot")
    return marked.join(tasks.examples(marked, shots, "item_id", F.col("delimiter")), "item_id", "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def option_rows(items: DataFrame, delimiter: str = " ", settings: DataFrame | None = None) -> DataFrame:
    """(item_id, task, kind, gold, option, ids, start): token ids of each option's prompt and where its scored span starts; it ends with the prompt.

    With ``settings`` each prompt begins with its task's number of examples and has its task's delimiter.
    """
    before: Column | str = ""
    if settings is not None:
        items, before, delimiter = with_examples(items, settings), F.col("examples"), F.col("delimiter")
    kind = F.col("icl_task_type")
    without, with_ = tasks.lm_prompts(F.col("context"), F.col("continuation"), delimiter, before)
    prompts = (
        F.when(kind == "multiple_choice", tasks.choice_prompts(F.col("query"), F.col("choices"), delimiter, before))
        .when(kind == "schema", tasks.schema_prompts(F.col("context_options"), F.col("continuation"), delimiter, before))
        .when(kind == "language_modeling", F.array(without, with_))
    )
    ids = F.transform(prompts, lambda p: F.concat(F.array(F.lit(chat.BOS)), chat.byte_ids(p)))
    rows = items.select("item_id", "task", kind.alias("kind"), F.coalesce("gold", F.lit(0)).alias("gold"), ids.alias("all")).where("all is not null")
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    head = F.array_min(F.transform(rest, lambda x: tasks.common_prefix(F.get("all", 0), x)))
    tail = F.array_min(F.transform(rest, lambda x: tasks.common_suffix(F.get("all", 0), x)))
    rows = rows.withColumn("head", head).withColumn("tail", tail)
    rows = rows.select("item_id", "task", "kind", "gold", "head", "tail", F.size(F.get("all", 0)).alias("first"), F.posexplode("all").alias("option", "ids")).where("kind <> 'language_modeling' or option = 1")
    start = F.when(F.col("kind") == "multiple_choice", F.col("head")).when(F.col("kind") == "schema", F.size("ids") - F.col("tail")).otherwise(F.col("first"))
    return rows.select("item_id", "task", "kind", "gold", "option", "ids", start.alias("start"))


def left_cut(rows: DataFrame, most: int) -> DataFrame:
    """Only the last ``most`` tokens of each prompt, the span moved with them."""
    gone = F.greatest(F.size("ids") - most, F.lit(0))
    return rows.withColumn("start", F.greatest(F.col("start") - gone, F.lit(0))).withColumn("ids", F.slice("ids", gone + 1, F.lit(most)))


def evaluate(items: DataFrame, scorer: Scorer, most: int = 2048, settings: DataFrame | None = None) -> DataFrame:
    """(item_id, task, correct), few-shot by ``settings``: least mean loss among options; for a continuation, every token as the model would say it."""
    rows = left_cut(option_rows(items, settings=settings), most)
    span = lambda c: F.slice(c, F.col("start") + 1, F.greatest(F.size("ids") - F.col("start"), F.lit(0)))
    scored = rows.withColumn("nll", span(scorer.nll(F.col("ids")))).withColumn("said", F.forall(F.zip_with(span(scorer.greedy(F.col("ids"))), span(F.col("ids")), lambda a, b: a == b), lambda ok: ok))
    mean = F.aggregate("nll", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("nll"), F.lit(1))
    scored = scored.select("item_id", "task", "kind", "gold", "option", mean.alias("loss"), "said")
    best = option_choice(scored.where("kind <> 'language_modeling'"), "item_id", "option", "loss").withColumnRenamed("option", "best").drop("loss")
    chosen = scored.where("kind <> 'language_modeling'").select("item_id", "task", "gold").distinct().join(best, "item_id").select("item_id", "task", (F.col("best") == F.col("gold")).cast("int").alias("correct"))
    return chosen.unionByName(scored.where("kind = 'language_modeling'").select("item_id", "task", F.col("said").cast("int").alias("correct")))


def by_task(graded: DataFrame) -> DataFrame:
    return graded.groupBy("task").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("items"))

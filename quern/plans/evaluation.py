"""Evaluation items scored end to end with byte models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import render_choices
from quern.operators import bpe, chat, tasks
from quern.operators import protocol as P
from quern.operators import scoring as S
from quern.plans.chat import _FAULT, _TALKS
from quern.session import table


def _settings(items):
    """The test tables have no task settings: each task gets three examples, as ``fewshot_pick``."""
    return items.select(F.col("task").alias("label")).distinct().select("label", F.lit(3).alias("num_fewshot"), F.lit(" ").alias("continuation_delimiter"))


def core_items(spark, d):
    """Few-shot; a unigram model's losses don't depend on the examples, so the SQL needs none."""
    items = table(spark, d, "eval_items")
    return S.evaluate(items, S.Unigram.fitted(table(spark, d, "documents")), settings=_settings(items))


def core_tasks(spark, d):
    return S.by_task(core_items(spark, d)).select("task", F.round("accuracy", 6).alias("accuracy"), "items")


def core_uniform(spark, d):
    """A uniform model finds all options alike and takes the first."""
    got = S.evaluate(table(spark, d, "eval_items").where("icl_task_type <> 'language_modeling'"), S.Unigram())
    return S.by_task(got).select("task", F.round("accuracy", 6).alias("accuracy"), "items")


def option_tokens(spark, d):
    return S.option_rows(table(spark, d, "eval_items")).groupBy("task").agg(F.count("*").alias("prompts"), F.sum(F.size("ids")).alias("tokens"))


class _Drawn:
    """A model for the tests: scores and completions drawn from lengths and hashes, so that SQL can repeat them."""

    def __init__(self, answers=None):
        self.answers = answers

    def score(self, ids, token):
        return F.pmod(F.size(ids) * 7919 + token * 104729, F.lit(1009))

    def complete(self, prompts, n):
        drawn = prompts.select("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
        good = tasks.pick("s", F.concat_ws("/", "idx", "sample"), 3) == 0
        return drawn.join(self.answers, "idx").select("idx", "sample", F.when(good, F.col("answer")).otherwise("#### -1").alias("completion"))


def _choices(spark, d):
    items = table(spark, d, "eval_items").where("icl_task_type = 'multiple_choice' and gold is not null")
    letters = F.slice(F.array(*map(F.lit, "ABCDEF")), F.lit(1), F.size("choices"))
    talk = F.array(F.struct(F.lit("user").alias("role"), render_choices(F.col("query"), letters, F.col("choices")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.get(letters, F.col("gold")).alias("content")))
    return P.task_of("indexed_choice", items.select("item_id", talk.alias("messages"), letters.alias("letters")), [F.col("item_id")])


def eval_letters(spark, d):
    """Each multiple-choice item rendered, scored at the end of its prompt over its letters, and graded."""
    task = _choices(spark, d)
    got = P.evaluate_letters(task, P.BytePairs(most=100_000), _Drawn())
    return got.join(task.view().select("idx", "item_id"), "idx").select("item_id", "letter", "correct")


def eval_accuracy(spark, d):
    return P.evaluate(_choices(spark, d).sliced(1, None, 2), P.BytePairs(most=100_000), _Drawn()).select("task", "problems", F.round("accuracy", 6).alias("accuracy"))


def _problems(spark, d):
    talks = chat.gathered(table(spark, d, "chat_messages")).where(chat.renderable(F.col("messages")).isNull())
    last = F.element_at("messages", -1)
    return P.task_of("word_problem", talks.where((last["role"] == "assistant") & last["content"].contains("####")), [F.col("conv_id")])


def eval_samples(spark, d):
    """Each word problem with four completions, of which any may be right."""
    task = _problems(spark, d)
    answers = task.view().select("idx", F.element_at("messages", -1)["content"].alias("answer"))
    got = P.evaluate_samples(task, P.BytePairs(), _Drawn(answers), 4)
    return got.join(task.view().select("idx", "conv_id"), "idx").select("conv_id", "passed", "right")


def eval_mixture(spark, d):
    """The conversations of both tasks in one seeded order, the word problems twice."""
    problems = _problems(spark, d)
    got = P.mixed([_choices(spark, d).sliced(0, 40), problems, problems])
    return got.select("position", "task", "idx", F.size("messages").alias("messages"))


def sample_listing(spark, d):
    """A completion behind the query of each item, and eight of nothing."""
    items = table(spark, d, "eval_items").where("query is not null").select(F.col("item_id").cast("long").alias("idx"), "query")
    prompts = bpe.encode(items, [], "idx", "query")
    answers = items.select("idx", F.concat(F.lit(" -> "), F.col("idx").cast("string")).alias("answer")).unionByName(spark.createDataFrame([(0, " -> 0")], "idx bigint, answer string")).dropDuplicates(["idx"])
    got = P.listed_samples(prompts, P.BytePairs(), _Drawn(answers))
    return got.groupBy("kind").agg(F.count("*").alias("samples"), F.sum(F.length("text")).alias("chars"))


_P = "(SELECT task, unnest(list_transform(choices, lambda c: query || ' ' || c)) AS p FROM eval_items WHERE icl_task_type = 'multiple_choice' UNION ALL SELECT task, unnest(list_transform(context_options, lambda c: c || ' ' || continuation)) FROM eval_items WHERE icl_task_type = 'schema' UNION ALL SELECT task, trim(context) || ' ' || continuation FROM eval_items WHERE icl_task_type = 'language_modeling')"

_PREFIX = "list_min(list_transform({r}[2:], lambda x: coalesce(list_filter(range(1, least(length(x), length({r}[1])) + 1), lambda i: x[i] <> {r}[1][i])[1] - 1, least(length(x), length({r}[1])))))"
_SCORED = f"""WITH b AS (SELECT ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT AS b FROM documents), n AS (SELECT b, count(*) AS n FROM b GROUP BY b), t AS (SELECT sum(n) + 265 AS total, arg_max(b, (n, -b)) AS best FROM n),
    v AS (SELECT list(-ln((coalesce(n, 0) + 1) / total) ORDER BY range) AS nll, any_value(best) AS best FROM range(265) LEFT JOIN n ON b = range, t),
    o AS (SELECT item_id, task, gold, list_transform(choices, lambda c: query || ' ' || c) AS p FROM eval_items WHERE icl_task_type = 'multiple_choice'), s AS (SELECT item_id, task, gold, list_transform(context_options, lambda c: c || ' ' || continuation) AS p FROM eval_items WHERE icl_task_type = 'schema'),
    w AS (SELECT item_id, task, gold, unnest(p) AS x, unnest(range(0, len(p))) AS option, {_PREFIX.format(r='p')} AS start FROM o UNION ALL SELECT item_id, task, gold, x, option, length(x) - tail FROM (SELECT item_id, task, gold, unnest(p) AS x, unnest(range(0, len(p))) AS option, {_PREFIX.format(r='list_transform(p, lambda c: reverse(c))')} AS tail FROM s)),
    l AS (SELECT item_id, task, gold, option, round(coalesce(list_avg(list_transform(range(start + 1, length(x) + 1), lambda i: nll[ascii(x[i]) + 1])), 0), 9) AS loss FROM w, v),
    g AS (SELECT item_id, any_value(task) AS task, (arg_min(option, (loss, option)) = any_value(gold))::INT AS correct FROM l GROUP BY item_id UNION ALL SELECT item_id, task, (replace(' ' || continuation, chr(best), '') = '')::INT FROM eval_items, v WHERE icl_task_type = 'language_modeling')"""

_ABC = "['A', 'B', 'C', 'D', 'E', 'F']"
_LETTERS = f"""WITH i AS (SELECT item_id, gold, choices, 'Multiple Choice question: ' || query || chr(10) || list_aggregate(list_transform(range(1, len(choices) + 1), lambda i: '- ' || choices[i] || '=' || {_ABC}[i] || chr(10)), 'string_agg', '') || chr(10) || 'Respond only with the letter of the correct answer.' AS p FROM eval_items WHERE icl_task_type = 'multiple_choice' AND gold IS NOT NULL),
    s AS (SELECT item_id, gold, k, ((octet_length(encode(p)) + 4) * 7919 + (64 + k) * 104729) % 1009 AS score FROM (SELECT *, unnest(range(1, len(choices) + 1)) AS k FROM i)),
    b AS (SELECT item_id, {_ABC}[arg_max(k, (score, -k))] AS letter, (arg_max(k, (score, -k)) = any_value(gold) + 1)::INT AS correct FROM s GROUP BY item_id)"""
_SUMS = f"(SELECT conv_id, messages, row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM {_TALKS} WHERE {_FAULT} IS NULL AND messages[-1].role = 'assistant' AND contains(messages[-1].content, '####'))"
_GIVEN = "nullif(replace(regexp_extract(messages[-1].content, '#### (-?[0-9.,]+)', 1), ',', ''), '')"

QUERIES = {
    "eval_letters": (eval_letters, f"{_LETTERS} SELECT item_id, letter, correct FROM b"),
    "eval_accuracy": (eval_accuracy, f"{_LETTERS}, r AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i FROM b) SELECT 'indexed_choice' AS task, count(*) AS problems, round(avg(correct), 6) AS accuracy FROM r WHERE i % 2 = 1"),
    "eval_samples": (eval_samples, f"WITH s AS (SELECT conv_id, (('0x' || substr(md5('s:' || idx || '/' || k), 1, 7))::BIGINT % 3 = 0 OR {_GIVEN} IS NOT DISTINCT FROM '-1')::INT AS good FROM {_SUMS}, range(4) r(k)) SELECT conv_id, max(good) AS passed, sum(good)::BIGINT AS right FROM s GROUP BY conv_id"),
    "eval_mixture": (eval_mixture, f"WITH c AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx FROM eval_items WHERE icl_task_type = 'multiple_choice' AND gold IS NOT NULL), u AS (SELECT 0 AS t, 'indexed_choice' AS task, idx, 2 AS messages FROM c WHERE idx < 40 UNION ALL SELECT t, 'word_problem', idx, len(messages)::INT FROM {_SUMS}, range(1, 3) r(t)) SELECT row_number() OVER (ORDER BY md5('42:' || t || '/' || idx), t, idx) - 1 AS position, task, idx, messages FROM u"),
    "sample_listing": (sample_listing, "WITH i AS (SELECT item_id, query, (('0x' || substr(md5('s:' || item_id || '/0'), 1, 7))::BIGINT % 3 = 0) AS good FROM eval_items WHERE query IS NOT NULL), n AS (SELECT ('0x' || substr(md5('s:0/' || k), 1, 7))::BIGINT % 3 = 0 AS good FROM range(8) r(k)) SELECT 'prompt' AS kind, count(*) AS samples, sum(length(query) + CASE WHEN good THEN length(' -> ' || item_id) ELSE 7 END)::BIGINT AS chars FROM i UNION ALL SELECT 'nothing', count(*), sum(CASE WHEN good THEN 5 ELSE 7 END)::BIGINT FROM n"),
    "core_items": (core_items, f"{_SCORED} SELECT item_id, task, correct FROM g"),
    "core_tasks": (core_tasks, f"{_SCORED} SELECT task, round(avg(correct), 6) AS accuracy, count(*) AS items FROM g GROUP BY task"),
    "core_uniform": (core_uniform, "SELECT task, round(avg((gold = 0)::INT), 6) AS accuracy, count(*) AS items FROM eval_items WHERE icl_task_type <> 'language_modeling' GROUP BY task"),
    "option_tokens": (option_tokens, f"SELECT task, count(*) AS prompts, sum(octet_length(encode(p)) + 1)::BIGINT AS tokens FROM {_P} GROUP BY task"),
}

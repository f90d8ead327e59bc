"""Evaluation metrics on events, orders and line items. A problem is a user, a sample one of its events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import evals as E
from quern.session import table

_SAMPLES = "(SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS sample, (event_type = 'purchase')::INT AS correct, value FROM events)"


def _samples(spark, d):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", (F.row_number().over(own) - 1).alias("sample"), (F.col("event_type") == "purchase").cast("int").alias("correct"), "value")


def passk(spark, d):
    got = E.pass_at_k(_samples(spark, d), "user_id", "sample", "correct", 8)
    return got.select("k", "solved", F.round("share", 6).alias("share"))


def any_of_n(spark, d):
    return _samples(spark, d).where("sample < 5").groupBy("user_id").agg(F.max("correct").alias("passed"))


def advantage(spark, d):
    got = E.advantages(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return got.select("event_id", F.round("advantage", 4).alias("advantage"))


def rollout_stats(spark, d):
    per = _samples(spark, d).groupBy("user_id").agg(F.avg("value").alias("reward"), F.count("*").alias("length"))
    return per.agg(F.round(F.avg("reward"), 5).alias("mean_reward"), F.round(F.avg("length"), 5).alias("mean_length"))


def token_norm(spark, d):
    """Sum of value times advantage by valid rows, at least one, per type; a value below 1 is not valid."""
    got = E.advantages(table(spark, d, "events").select("event_type", "user_id", "value"), "user_id", "value")
    valid = F.sum((F.col("value") >= 1).cast("int"))
    return got.groupBy("event_type").agg(F.round(F.sum(F.when(F.col("value") >= 1, F.col("value") * F.col("advantage"))) / F.greatest(valid, F.lit(1)), 4).alias("loss"))


def _tasks(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), (F.col("o_orderstatus") == "F").cast("double").alias("correct"))


def _baselines(spark):
    return spark.createDataFrame([("1-URGENT", 25.0), ("2-HIGH", 20.0), ("3-MEDIUM", 0.0), ("4-NOT SPECIFIED", 10.0)], "task string, percent double")


def core_centered(spark, d):
    """Centred accuracy by task; a task without a baseline has 0."""
    acc = _tasks(spark, d).groupBy("task").agg(F.avg("correct").alias("accuracy"))
    joined = acc.join(F.broadcast(_baselines(spark)), "task", "left")
    return joined.select("task", F.round("accuracy", 6).alias("accuracy"), F.round(E.centered(F.col("accuracy"), F.coalesce("percent", F.lit(0.0)) * 0.01), 6).alias("centered"))


def core_metric(spark, d):
    acc = _tasks(spark, d).groupBy("task").agg(F.avg("correct").alias("accuracy"))
    joined = acc.join(F.broadcast(_baselines(spark)), "task")
    return joined.agg(F.round(F.avg(E.centered(F.col("accuracy"), F.col("percent") * 0.01)), 6).alias("core"), F.count("*").alias("tasks"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _by_segment(spark, d, tasks):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    acc = orders.groupBy("c_mktsegment", F.col("o_orderpriority").alias("task")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("a"))
    return E.mean_centered(acc, ["c_mktsegment"], "task", F.col("a"), F.lit(0.25), tasks).select("c_mktsegment", F.round("mean", 6).alias("chatcore"))


def chatcore(spark, d):
    """Only where a market segment has orders of all five priorities."""
    return _by_segment(spark, d, _PRIORITIES)


def chatcore_categorical(spark, d):
    """The same of the priorities that stand for tasks answered by a letter."""
    return _by_segment(spark, d, ["1-URGENT", "3-MEDIUM"])


def option_argmin(spark, d):
    losses = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("option"), F.col("l_discount").alias("nll"))
    return E.option_choice(losses, "l_orderkey", "option", "nll").select("l_orderkey", "option", F.round("loss", 6).alias("loss"))


def exact_match(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("matched"))


def restricted_argmax(spark, d):
    """The best letter among those a problem has: the line with the largest quantity among the allowed flags."""
    own = table(spark, d, "lineitem").where(F.array_contains(F.array(F.lit("A"), F.lit("R")), F.col("l_returnflag")))
    return own.groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_quantity", -F.col("l_linenumber"), "l_returnflag")).alias("letter"))


def topk_probs(spark, d):
    logits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("logit"))
    return E.top_k_probabilities(logits, "l_orderkey", "l_linenumber", "logit", 3, 0.8).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"))


def topk_ties(spark, d):
    logits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 10).alias("logit"))
    got = E.top_k_probabilities(logits, "l_orderkey", "l_linenumber", "logit", 2, 1.0, keep_ties=True)
    return got.groupBy("l_orderkey").agg(F.count("*").alias("kept"))


def sample_hash(spark, d):
    """One draw per order by the inverse of the cumulated probabilities at a uniform from the order's hash."""
    probs = topk_probs(spark, d)
    cum = F.sum("p").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("l_orderkey").cast("string")).cast("binary")), 1, 7), 16, 10).cast("double") / float(16**7)
    return probs.withColumn("cum", cum).withColumn("u", u).where("cum > u").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("drawn"))


def terminal_cut(spark, d):
    stream = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", 259).otherwise(1).alias("token"))
    return E.before_terminal(stream, ["user_id"], "event_id", "token", [256, 259]).groupBy("user_id").agg(F.count("*").alias("tokens"))


def tool_spans(spark, d):
    stream = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", 261).when(F.col("event_type") == "purchase", 262).otherwise(F.col("event_id") % 256).cast("int").alias("token"))
    return E.tool_spans(stream, ["user_id"], "event_id", "token", 261, 262).select("user_id", "span", F.size("tokens").alias("tokens"))


def calc_eval(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("1,0"), F.col("l_linenumber").cast("string"), F.lit("*"), F.col("l_quantity").cast("int").cast("string"), F.lit("+(7-"), F.col("l_linenumber").cast("string"), F.lit(")")).alias("expr"))
    return E.calculator(own, "expr").select("l_orderkey", "l_linenumber", "value")


_P = "(SELECT l_orderkey, l_linenumber, round(e / sum(e) OVER (PARTITION BY l_orderkey), 6) AS p FROM (SELECT l_orderkey, l_linenumber, exp((l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY l_orderkey)) / 0.8) AS e FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 10 DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3))"
_ADV = "value - avg(value) OVER (PARTITION BY user_id)"
_TASKS = "(SELECT o_orderpriority AS task, avg((o_orderstatus = 'F')::INT) AS accuracy FROM orders GROUP BY 1)"
_BASE = "(VALUES ('1-URGENT', 25.0::DOUBLE), ('2-HIGH', 20.0), ('3-MEDIUM', 0.0), ('4-NOT SPECIFIED', 10.0)) b(task, percent)"

QUERIES = {
    "chatcore_categorical": (chatcore_categorical, "SELECT c_mktsegment, round(avg((a - 0.25) / 0.75), 6) AS chatcore FROM (SELECT c_mktsegment, o_orderpriority, avg((o_orderstatus = 'F')::INT) AS a FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2"),
    "passk": (passk, f"WITH f AS (SELECT user_id, min(sample) FILTER (correct = 1) AS first FROM {_SAMPLES} GROUP BY user_id) SELECT k::INT AS k, (count(*) FILTER (first < k))::BIGINT AS solved, round((count(*) FILTER (first < k)) / count(*), 6) AS share FROM f, range(1, 9) r(k) GROUP BY k"),
    "any_of_n": (any_of_n, f"SELECT user_id, max(correct) AS passed FROM {_SAMPLES} WHERE sample < 5 GROUP BY user_id"),
    "advantage": (advantage, f"SELECT event_id, round({_ADV}, 4) AS advantage FROM events"),
    "rollout_stats": (rollout_stats, "SELECT round(avg(r), 5) AS mean_reward, round(avg(n), 5) AS mean_length FROM (SELECT avg(value) AS r, count(*) AS n FROM events GROUP BY user_id)"),
    "token_norm": (token_norm, f"SELECT event_type, round(sum(value * a) FILTER (value >= 1) / greatest(count(*) FILTER (value >= 1), 1), 4) AS loss FROM (SELECT *, {_ADV} AS a FROM events) GROUP BY event_type"),
    "core_centered": (core_centered, f"SELECT t.task, round(accuracy, 6) AS accuracy, round((accuracy - coalesce(percent, 0) * 0.01) / (1 - coalesce(percent, 0) * 0.01), 6) AS centered FROM {_TASKS} t LEFT JOIN {_BASE} ON t.task = b.task"),
    "core_metric": (core_metric, f"SELECT round(avg((accuracy - percent * 0.01) / (1 - percent * 0.01)), 6) AS core, count(*) AS tasks FROM {_TASKS} t JOIN {_BASE} ON t.task = b.task"),
    "chatcore": (chatcore, "SELECT c_mktsegment, round(avg((a - 0.25) / 0.75), 6) AS chatcore FROM (SELECT c_mktsegment, o_orderpriority, avg((o_orderstatus = 'F')::INT) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1 HAVING count(*) = 5"),
    "option_argmin": (option_argmin, "SELECT l_orderkey, option, round(loss, 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY loss, option) AS r FROM (SELECT l_orderkey, l_linenumber AS option, round(avg(l_discount), 9) AS loss FROM lineitem GROUP BY ALL)) WHERE r = 1"),
    "exact_match": (exact_match, "SELECT l_orderkey, bool_and(l_quantity > 5) AS matched FROM lineitem GROUP BY 1"),
    "restricted_argmax": (restricted_argmax, "SELECT l_orderkey, arg_max(l_returnflag, (l_quantity, -l_linenumber, l_returnflag)) AS letter FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1"),
    "topk_probs": (topk_probs, f"SELECT * FROM {_P}"),
    "topk_ties": (topk_ties, "SELECT l_orderkey, count(*) AS kept FROM (SELECT l_orderkey, rank() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10) DESC) AS r FROM lineitem) WHERE r <= 2 GROUP BY 1"),
    "sample_hash": (sample_hash, f"SELECT l_orderkey, min(l_linenumber) AS drawn FROM (SELECT *, sum(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS cum, ('0x' || substr(md5('7:' || l_orderkey), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM {_P}) WHERE cum > u GROUP BY 1"),
    "terminal_cut": (terminal_cut, "SELECT user_id, count(*) AS tokens FROM (SELECT user_id, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events) WHERE seen = 0 GROUP BY 1"),
    "tool_spans": (tool_spans, "WITH s AS (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM events), e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, span ORDER BY event_id) AS done FROM s WHERE span > 0) SELECT user_id, span::INT AS span, (count(*) FILTER (done = 0 AND event_type <> 'signup'))::INT AS tokens FROM e GROUP BY user_id, span HAVING max(done) > 0"),
    "calc_eval": (calc_eval, "SELECT l_orderkey, l_linenumber, ((100 + l_linenumber) * l_quantity::INT + 7 - l_linenumber)::VARCHAR AS value FROM lineitem"),
}

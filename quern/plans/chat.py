"""Chat requests and conversations: limits, validity, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chat
from quern.session import table


def _requests(spark, d):
    """Each request once, as it came first: a repeat has the same id and content."""
    own = table(spark, d, "chat_requests")
    first = F.struct("received_at", "sent_at")
    return own.groupBy("request_id").agg(*(F.min_by(c, first).alias(c) for c in ("messages", "temperature", "top_k", "max_tokens")))


_R = "(SELECT request_id, any_value(messages) AS messages, any_value(temperature) AS temperature, any_value(top_k) AS top_k, any_value(max_tokens) AS max_tokens FROM chat_requests GROUP BY request_id)"
_N = "coalesce(len(messages), 0)"
_ROLE = "(CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)"
_IDX = f"range(0, {_N})"
_REST = "(CASE WHEN messages[1].role = 'system' THEN messages[2:] ELSE messages END)"
_ALT = "coalesce(len({m}) >= 2 AND len(list_filter(range(0, len({m})), lambda i: coalesce({m}[i + 1].role, '') <> (CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) OR {m}[i + 1].content IS NULL)) = 0, false)"


def chat_limits(spark, d):
    own = _requests(spark, d)
    return own.select("request_id", chat.request_fault(F.col("messages"), F.col("temperature"), F.col("top_k"), F.col("max_tokens")).alias("fault"))


def chat_validate(spark, d):
    own = _requests(spark, d)
    m = F.col("messages")
    spoken = F.coalesce(F.forall(m, lambda x: F.length(F.trim(x["content"])) > 0), F.lit(False))
    return own.select("request_id", chat.alternates(m).alias("alternates"), chat.alternates(chat.without_system(m)).alias("after_system"), (chat.alternates(m) & spoken).alias("spoken"))


def chat_renderable(spark, d):
    own = _requests(spark, d).select(chat.renderable(F.col("messages")).alias("fault"))
    return own.groupBy("fault").agg(F.count("*").alias("requests"))


def _good(spark, d):
    return _requests(spark, d).where(chat.renderable(F.col("messages")).isNull())


def chat_render(spark, d):
    """Length and trained length of each rendered request before the cut, from the tokens themselves."""
    return _lengths(chat.render_tokens(_good(spark, d), "request_id", "messages", most=None))


def _lengths(rendered):
    mask = F.transform("mask", lambda m: m.cast("int"))
    return rendered.select("request_id", F.size("ids").alias("ids"), F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("trained"))


def chat_render_talks(spark, d):
    """Tokens of the finetuning conversations, system messages merged: how many, how many are trained, and two sums that tell which."""
    own = chat.gathered(table(spark, d, "chat_messages"))
    got = chat.render_tokens(own.where(chat.renderable(F.col("messages")).isNull()), "conv_id", "messages", most=None)
    ids = F.transform("ids", lambda i: i.cast("long"))
    trained = F.transform(F.arrays_zip("ids", "mask"), lambda x: x["ids"].cast("long") * x["mask"])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("conv_id", F.size("ids").alias("ids"), total(F.transform("mask", lambda m: m.cast("long"))).alias("trained"), total(ids).alias("sum"), total(trained).alias("trained_sum"))


def chat_unrenderable(spark, d):
    """What can't be rendered comes out as null, and it is what the checks say."""
    own = chat.gathered(table(spark, d, "chat_messages"))
    got = chat.render_tokens(own, "conv_id", "messages").where("ids is null").select("conv_id")
    return own.join(got, "conv_id").groupBy(chat.renderable(F.col("messages")).alias("fault")).agg(F.count("*").alias("talks"))


def chat_truncate(spark, d):
    """Length and trained length of what a cut at 500 tokens leaves."""
    return _lengths(chat.render_tokens(_good(spark, d), "request_id", "messages", most=500))


def chat_mask_share(spark, d):
    own = chat_render(spark, d)
    return own.agg(F.sum("trained").alias("trained"), F.sum("ids").alias("ids"), F.round(F.sum("trained") / F.sum("ids"), 6).alias("share"))


def chat_completion(spark, d):
    own = _good(spark, d).where(F.element_at("messages", -1)["role"] == "assistant")
    return chat.render_tokens(own, "request_id", "messages", most=300, completion=True).select("request_id", F.size("ids").alias("ids"), F.element_at("ids", -1).alias("last"))


def chat_targets(spark, d):
    """Targets that count after the shift by one."""
    own = chat.render_tokens(_good(spark, d), "request_id", "messages")
    _, targets = chat.inputs_and_targets(F.col("ids"), F.col("mask"))
    return own.select("request_id", F.size(F.filter(targets, lambda t: t >= 0)).alias("targets"), F.size(targets).alias("positions"))


def chat_regenerate(spark, d):
    own = _requests(spark, d).where(F.size("messages") > 0)
    return own.select("request_id", chat.regenerated(F.col("messages"), F.expr("size(messages) div 2")).alias("m")).select("request_id", F.size("m").alias("messages"), F.aggregate("m", F.lit(0), lambda a, x: a + F.coalesce(F.length(x["content"]), F.lit(0))).alias("chars"))


def chat_jsonl(spark, d):
    """Conversations as JSON lines and back: message counts survive."""
    lines = _requests(spark, d).where(F.size("messages") > 0).select("request_id", F.to_json("messages").alias("line"))
    back = lines.select("request_id", F.from_json(F.trim("line"), "array<struct<role: string, content: string>>").alias("m"))
    return back.select("request_id", F.size("m").alias("messages"), F.get("m", 0)["role"].alias("first_role"))


_BYTES = "octet_length(encode({c}))"
_MERGED = "octet_length(encode(m.content))"
_GOOD = f"(SELECT * FROM {_R} WHERE {_N} > 0 AND len({_REST}) > 0 AND len(list_filter(range(0, len({_REST})), lambda i: coalesce({_REST}[i + 1].role <> (CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END), true))) = 0 AND len(list_filter(messages, lambda m: m.content IS NULL)) = 0)"
_SUMS = f"""(SELECT request_id, messages, (1 + list_sum(list_transform(messages, lambda m: {_MERGED} + 2)))::INT AS ids, coalesce(list_sum(list_transform(messages, lambda m: CASE WHEN m.role = 'assistant' THEN {_MERGED} + 1 ELSE 0 END)), 0)::INT AS trained FROM {_GOOD})"""

_CUT = f"""WITH m AS (SELECT request_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM {_GOOD}), o AS (SELECT request_id, m.role AS role, {_MERGED} AS b, 1 + sum({_MERGED} + 2) OVER (PARTITION BY request_id ORDER BY i) - ({_MERGED} + 2) AS start FROM m)
        SELECT request_id, least({{n}}, max(start + b + 2))::INT AS ids, sum(CASE WHEN role = 'assistant' THEN greatest(0, least({{n}}, start + b + 2) - (start + 1)) ELSE 0 END)::INT AS trained FROM o GROUP BY request_id"""

#: Conversations of single messages, and the same of those that can be rendered.
_TALKS = "(SELECT conv_id, list(m ORDER BY turn) AS messages FROM (SELECT conv_id, turn, max({'role': role, 'content': content}) AS m FROM chat_messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL) GROUP BY conv_id)"
_FAULT = f"CASE WHEN {_N} = 0 THEN 'empty' WHEN len({_REST}) = 0 THEN 'system alone' WHEN len(list_filter(range(0, len({_REST})), lambda i: coalesce({_REST}[i + 1].role <> (CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END), true))) > 0 THEN 'roles' WHEN len(list_filter(messages, lambda m: m.content IS NULL)) > 0 THEN 'content' END"
_BYTE_SUM = "coalesce(list_sum(list_transform(regexp_extract_all(hex(encode({c})), '..'), lambda h: ('0x' || h)::INT)), 0)"

QUERIES = {
    "chat_render_talks": (chat_render_talks, f"""WITH t AS (SELECT conv_id, messages FROM {_TALKS} WHERE {_FAULT} IS NULL), m AS (SELECT conv_id, unnest(messages) AS m FROM t), b AS (SELECT conv_id, m.role AS role, octet_length(encode(m.content)) AS n, {_BYTE_SUM.format(c='m.content')} AS s FROM m)
        SELECT conv_id, (1 + sum(n + 2))::INT AS ids, sum(CASE role WHEN 'assistant' THEN n + 1 ELSE 0 END)::BIGINT AS trained,
        (256 + sum(s + CASE role WHEN 'assistant' THEN 259 + 260 WHEN 'user' THEN 257 + 258 ELSE 20 END))::BIGINT AS sum, sum(CASE role WHEN 'assistant' THEN s + 260 ELSE 0 END)::BIGINT AS trained_sum FROM b GROUP BY conv_id"""),
    "chat_unrenderable": (chat_unrenderable, f"SELECT {_FAULT} AS fault, count(*) AS talks FROM {_TALKS} WHERE {_FAULT} IS NOT NULL GROUP BY 1"),
    "chat_limits": (chat_limits, f"""SELECT request_id, CASE WHEN {_N} = 0 THEN 'none' WHEN {_N} > 500 THEN 'many'
        WHEN len(list_filter(messages, lambda m: coalesce(length(m.content), 0) = 0 OR length(m.content) > 8000)) > 0 THEN
            list_filter(list_transform({_IDX}, lambda i: CASE WHEN coalesce(length(messages[i + 1].content), 0) = 0 THEN 'empty ' || i WHEN length(messages[i + 1].content) > 8000 THEN 'long ' || i END), lambda x: x IS NOT NULL)[1]
        WHEN list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))) > 32000 THEN 'total'
        WHEN len(list_filter(messages, lambda m: coalesce(m.role NOT IN ('user', 'assistant'), true))) > 0 THEN 'role'
        WHEN temperature IS NOT NULL AND NOT (temperature BETWEEN 0 AND 2) THEN 'temperature' WHEN top_k IS NOT NULL AND NOT (top_k BETWEEN 0 AND 200) THEN 'top_k'
        WHEN max_tokens IS NOT NULL AND NOT (max_tokens BETWEEN 1 AND 4096) THEN 'max_tokens' END AS fault FROM {_R}"""),
    "chat_validate": (chat_validate, f"SELECT request_id, {_ALT.format(m='messages')} AS alternates, {_ALT.format(m=_REST)} AS after_system, {_ALT.format(m='messages')} AND coalesce(len(list_filter(messages, lambda m: coalesce(length(trim(m.content, ' ')), 0) = 0)) = 0, false) AS spoken FROM {_R}"),
    "chat_renderable": (chat_renderable, f"SELECT CASE WHEN {_N} = 0 THEN 'empty' WHEN len({_REST}) = 0 THEN 'system alone' WHEN len(list_filter(range(0, len({_REST})), lambda i: coalesce({_REST}[i + 1].role <> (CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END), true))) > 0 THEN 'roles' WHEN len(list_filter(messages, lambda m: m.content IS NULL)) > 0 THEN 'content' END AS fault, count(*) AS requests FROM {_R} GROUP BY 1"),
    "chat_render": (chat_render, f"SELECT request_id, ids, trained FROM {_SUMS}"),
    "chat_truncate": (chat_truncate, _CUT.format(n=500)),
    "chat_mask_share": (chat_mask_share, f"SELECT sum(trained)::BIGINT AS trained, sum(ids)::BIGINT AS ids, round(sum(trained) / sum(ids), 6) AS share FROM {_SUMS}"),
    "chat_completion": (chat_completion, f"SELECT request_id, (least(300, ids - {_BYTES.format(c='messages[-1].content')} - 2) + 1)::INT AS ids, 259 AS last FROM {_SUMS} WHERE messages[-1].role = 'assistant'"),
    "chat_targets": (chat_targets, f"SELECT request_id, trained AS targets, ids - 1 AS positions FROM ({_CUT.format(n=2048)})"),
    "chat_regenerate": (chat_regenerate, f"SELECT request_id, (len(messages) // 2)::INT AS messages, coalesce(list_sum(list_transform(messages[1 : len(messages) // 2], lambda m: coalesce(length(m.content), 0))), 0)::INT AS chars FROM {_R} WHERE len(messages) > 0"),
    "chat_jsonl": (chat_jsonl, f"SELECT request_id, len(messages)::INT AS messages, messages[1].role AS first_role FROM {_R} WHERE len(messages) > 0"),
}

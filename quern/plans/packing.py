"""Packing documents and conversations; a token is a byte, and every sequence starts with one more."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import packing as P
from quern.operators.scoring import left_cut
from quern.plans.chat import _FAULT, _TALKS
from quern.session import cut_lineage, table

_CAPACITY = 2049


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr("doc_id div 20000").alias("shard"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("tokens"))


def _check(rows):
    """What must hold of each row: pieces that follow each other, and no more than the capacity."""
    return rows.groupBy("shard", "row").agg(F.sum("used").alias("used"), F.max(F.col("start") + F.col("used")).alias("end"))


def pack_crop(spark, d):
    """Every row but the last of its shard is full; nothing is used twice."""
    rows = P.packed(_docs(spark, d), "shard", "doc_id", "tokens", _CAPACITY, "crop")
    return rows.groupBy("shard").agg(F.count("*").alias("pieces"), F.countDistinct("key").alias("docs"), F.sum("length").alias("tokens"))


def pack_crop_rows(spark, d):
    """Rows that are neither full nor the last of their shard: none."""
    rows = _check(P.packed(_docs(spark, d), "shard", "doc_id", "tokens", _CAPACITY, "crop"))
    last = rows.groupBy("shard").agg(F.max("row").alias("last"))
    return rows.join(last, "shard").where((F.col("row") < F.col("last")) & ((F.col("used") != _CAPACITY) | (F.col("end") != F.col("used")))).select("shard", "row")


def pack_pad(spark, d):
    """The documents that have a row; ``pack_waste`` counts the others as cropped."""
    rows = P.packed(_docs(spark, d), "shard", "doc_id", "tokens", _CAPACITY, "pad", 100).where("row is not null")
    return rows.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("used").alias("tokens"))


def _layout(spark, d, policy, waiting):
    rows = P.packed(_docs(spark, d), "shard", "doc_id", "tokens", _CAPACITY, policy, waiting).where("row is not null")
    return rows.select("shard", "row", F.col("key").alias("doc_id"), "start", "used")


def pack_layout_crop(spark, d):
    """Where each document lies in the rows of a loader with 40 documents waiting, which come by 128."""
    return _layout(spark, d, "crop", 40)


def pack_layout_pad(spark, d):
    return _layout(spark, d, "pad", 40)


def pack_layout_fit(spark, d):
    return _layout(spark, d, "first_fit", 40)


def pack_rows_pad(spark, d):
    """The padded rows of finetuning conversations themselves: content, trained tokens and the sum of each row."""
    from quern.operators import chat

    talks = chat.gathered(table(spark, d, "chat_messages"))
    own = cut_lineage(chat.render_tokens(talks.where(chat.renderable(F.col("messages")).isNull()), "conv_id", "messages", most=_CAPACITY).withColumn("shard", F.lit(0)).withColumn("n", F.size("ids")))
    rows = P.assembled(P.packed(own, "shard", "conv_id", "n", _CAPACITY, "pad", 100), own.withColumn("mask", F.transform("mask", lambda m: m.cast("int"))), "conv_id", "ids", "mask", _CAPACITY, chat.BOS)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = rows.select(F.size("tokens").alias("width"), "content", total("mask").alias("trained"), total("tokens").alias("s"))
    return sums.groupBy("width").agg(F.sum("content").alias("content"), F.sum("trained").alias("trained"), F.sum(F.col("s") - (F.lit(_CAPACITY) - F.col("content")) * chat.BOS).alias("sum"))


def pack_waste(spark, d):
    docs = _docs(spark, d)
    out = None
    for policy in P.POLICIES:
        got = P.waste(P.packed(docs, "shard", "doc_id", "tokens", _CAPACITY, policy, 100 if policy == "pad" else 1000), _CAPACITY).withColumn("policy", F.lit(policy))
        out = got if out is None else out.unionByName(got)
    return out.select("policy", "rows", *(F.round(c, 4).alias(c) for c in ("utilisation", "cropped", "padded")))


def packing_floor(spark, d):
    """Tokens that no packing can keep: what exceeds a row."""
    own = _docs(spark, d)
    return own.agg(F.round(F.sum(F.greatest(F.col("tokens") - _CAPACITY, F.lit(0))) / F.sum("tokens") * 100, 4).alias("floor"), F.sum("tokens").alias("tokens"))


def left_truncate(spark, d):
    """Only the last 1,024 tokens stay, here their places; spans move with them."""
    own = _docs(spark, d).select("doc_id", F.sequence(F.lit(1), F.col("tokens")).alias("ids"), (F.col("tokens") - 10).alias("start"))
    got = left_cut(own, 1024)
    return got.select("doc_id", F.size("ids").alias("kept"), F.get("ids", 0).alias("first"), F.element_at("ids", -1).alias("last"), F.col("start").alias("span_start"))


def right_pad(spark, d):
    """Arrays padded to the longest of their batch."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("t")).withColumn("batch", F.expr("l_orderkey div 8"))
    longest = own.groupBy("batch").agg(F.max(F.size("t")).alias("n"))
    got = own.join(longest, "batch").select("l_orderkey", F.concat("t", F.array_repeat(F.lit(0), F.col("n") - F.size("t"))).alias("t"))
    return got.select("l_orderkey", F.array_join("t", ",").alias("padded"))


def consumed(spark, d):
    """How many conversations two ranks take in each epoch over one and a half passes, and when a run of one pass stops."""
    own = table(spark, d, "orders").agg(F.count("*").alias("n"))
    taken = own.select("n", F.explode(F.sequence(F.lit(0), F.expr("cast(n * 3 div 2 as bigint)"))).alias("i"))
    epoch, _, stop = P.progress(F.col("i"), F.col("n"))
    return taken.select(epoch.alias("epoch"), (F.col("i") % 2).alias("rank"), stop.cast("int").alias("stop")).groupBy("epoch", "rank").agg(F.count("*").alias("taken"), F.sum("stop").alias("stopped"))


_D = "(SELECT doc_id, doc_id // 20000 AS shard, coalesce(octet_length(encode(text)), 0) + 1 AS tokens FROM documents)"

def _buffered(crop: bool, waiting: int, refill: int) -> str:
    """The loader step by step: each step fills the buffer, takes the largest sequence that fits, else crops the shortest or ends the row."""
    fits = f"list_filter(w, lambda x: x.n <= {_CAPACITY} - used)"
    best = f"list_max(list_transform({fits}, lambda x: {{'n': x.n, 'k': -x.k}}))"
    take = f"greatest(0, least(len(l) - nxt, ({waiting} - len(w) + {refill - 1}) // {refill} * {refill}))"
    other = f"CASE WHEN len({fits}) = 0 THEN list_min(w) ELSE {{'n': ({best}).n, 'k': -({best}).k}} END" if crop else f"CASE WHEN len({fits}) > 0 THEN {{'n': ({best}).n, 'k': -({best}).k}} END"
    keep = "tokens > 0" if crop else f"tokens <= {_CAPACITY}"
    return f"""l AS (SELECT shard, list({{'n': tokens::BIGINT, 'k': doc_id}} ORDER BY doc_id) AS l FROM {_D} WHERE {keep} GROUP BY shard),
        s(shard, l, row, used, nxt, w, piece, start, size) AS (SELECT shard, l, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(n BIGINT, k BIGINT)[], NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM l UNION ALL
            SELECT shard, l, CASE WHEN c IS NULL OR used + c.n >= {_CAPACITY} THEN row + 1 ELSE row END, CASE WHEN c IS NULL OR used + c.n >= {_CAPACITY} THEN 0 ELSE used + c.n END, nxt, CASE WHEN c IS NULL THEN w ELSE list_filter(w, lambda x: x.k <> c.k) END, c.k, used, least(c.n, {_CAPACITY} - used)
            FROM (SELECT *, {other} AS c FROM (SELECT shard, l, row, used, nxt + {take} AS nxt, w || l[nxt + 1 : nxt + {take}] AS w FROM s WHERE nxt < len(l) OR len(w) > 0))),
        p AS (SELECT shard, CASE WHEN used = 0 THEN row - 1 ELSE row END AS row, piece AS doc_id, start, size AS used FROM s WHERE piece IS NOT NULL)"""


_FIT = f"""l AS (SELECT shard, list({{'n': least(tokens, {_CAPACITY})::BIGINT, 'k': doc_id}} ORDER BY least(tokens, {_CAPACITY}) DESC, doc_id) AS l FROM {_D} GROUP BY shard),
        s(shard, l, i, rows, row, had) AS (SELECT shard, l, 0::BIGINT, []::BIGINT[], NULL::BIGINT, 0::BIGINT FROM l UNION ALL
            SELECT shard, l, i + 1, CASE WHEN place > len(rows) THEN rows || [{_CAPACITY} - l[i + 1].n] ELSE rows[: place - 1] || [rows[place] - l[i + 1].n] || rows[place + 1 :] END, place - 1, CASE WHEN place > len(rows) THEN {_CAPACITY} ELSE rows[place] END
            FROM (SELECT *, coalesce(list_position(list_transform(rows, lambda r: r >= l[i + 1].n), true), len(rows) + 1)::BIGINT AS place FROM s WHERE i < len(l))),
        p AS (SELECT shard, row, l[i].k AS doc_id, {_CAPACITY} - had AS start, l[i].n AS used FROM s WHERE i > 0)"""
_LAYOUT = "SELECT shard, row, doc_id, start, used FROM p"


def _wasted(policy: str, steps: str) -> str:
    return f"""SELECT * FROM (WITH RECURSIVE {steps}, r AS (SELECT sum(n) AS rows FROM (SELECT max(row) + 1 AS n FROM p GROUP BY shard)), u AS (SELECT sum(used) AS used FROM p), t AS (SELECT sum(tokens) AS tokens FROM {_D})
        SELECT '{policy}' AS policy, rows::BIGINT AS rows, round(used / (rows * {_CAPACITY}) * 100, 4) AS utilisation, round((tokens - used) / tokens * 100, 4) AS cropped, round((rows * {_CAPACITY} - used) / (rows * {_CAPACITY}) * 100, 4) AS padded FROM r, u, t)"""


QUERIES = {
    "pack_layout_crop": (pack_layout_crop, f"WITH RECURSIVE {_buffered(True, 40, 128)} {_LAYOUT}"),
    "pack_layout_pad": (pack_layout_pad, f"WITH RECURSIVE {_buffered(False, 40, 1)} {_LAYOUT}"),
    "pack_layout_fit": (pack_layout_fit, f"WITH RECURSIVE {_FIT} {_LAYOUT}"),
    "pack_rows_pad": (pack_rows_pad, f"""WITH t AS (SELECT conv_id, messages FROM {_TALKS} WHERE {_FAULT} IS NULL), m AS (SELECT conv_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM t),
        x AS (SELECT conv_id, i, m.role AS role, [CASE m.role WHEN 'assistant' THEN 259 ELSE 257 END] || list_transform(regexp_extract_all(hex(encode(m.content)), '..'), lambda h: ('0x' || h)::INT) || [CASE m.role WHEN 'assistant' THEN 260 ELSE 258 END] AS ids FROM m),
        y AS (SELECT conv_id, i, CASE WHEN role = 'system' THEN ids[: -2] || [10, 10] WHEN i > 1 AND lag(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' THEN ids[2:] ELSE ids END AS ids, role FROM x),
        z AS (SELECT conv_id, [256] || flatten(list(ids ORDER BY i)) AS ids, [0] || flatten(list(list_transform(range(0, len(ids)), lambda k: CASE WHEN role = 'assistant' AND k > 0 THEN 1 ELSE 0 END) ORDER BY i)) AS mask FROM y GROUP BY conv_id)
        SELECT {_CAPACITY} AS width, sum(least(len(ids), {_CAPACITY}))::BIGINT AS content, sum(list_sum(mask[: {_CAPACITY}]))::BIGINT AS trained, sum(list_sum(ids[: {_CAPACITY}]))::BIGINT AS sum FROM z"""),
    "pack_crop": (pack_crop, f"SELECT shard, count(*) AS pieces, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM {_D} GROUP BY shard"),
    "pack_crop_rows": (pack_crop_rows, "SELECT 0::BIGINT AS shard, 0::BIGINT AS row WHERE false"),
    "pack_pad": (pack_pad, f"SELECT shard, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM {_D} WHERE tokens <= {_CAPACITY} GROUP BY shard"),
    "pack_waste": (pack_waste, " UNION ALL ".join([_wasted("crop", _buffered(True, 1000, 128)), _wasted("pad", _buffered(False, 100, 1)), _wasted("first_fit", _FIT)])),
    "packing_floor": (packing_floor, f"SELECT round(sum(greatest(tokens - {_CAPACITY}, 0)) / sum(tokens) * 100, 4) AS floor, sum(tokens)::BIGINT AS tokens FROM {_D}"),
    "left_truncate": (left_truncate, f"SELECT doc_id, least(tokens, 1024)::INT AS kept, (tokens - least(tokens, 1024) + 1)::INT AS first, tokens::INT AS last, greatest(tokens - 10 - greatest(tokens - 1024, 0), 0)::INT AS span_start FROM {_D}"),
    "right_pad": (right_pad, "WITH t AS (SELECT l_orderkey, l_orderkey // 8 AS batch, list_sort(list(l_linenumber)) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(t || list_transform(range(0, max(len(t)) OVER (PARTITION BY batch) - len(t)), lambda x: 0), ',') AS padded FROM t"),
    "consumed": (consumed, "WITH n AS (SELECT count(*) AS n FROM orders) SELECT i // n + 1 AS epoch, i % 2 AS rank, count(*) AS taken, count(*) FILTER (i >= n) AS stopped FROM (SELECT n, unnest(range(0, n * 3 // 2 + 1)) AS i FROM n) GROUP BY ALL"),
}

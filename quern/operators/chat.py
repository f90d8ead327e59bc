"""Conversations: validation, rendering to tokens with a training mask, cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a chat request.
LIMITS = {"messages": 500, "message_chars": 8000, "total_chars": 32000, "temperature": (0.0, 2.0), "top_k": (0, 200), "max_tokens": (1, 4096)}
#: Ids of the special tokens behind the 256 bytes.
BOS, USER_START, USER_END, ASSISTANT_START, ASSISTANT_END, PYTHON_START, PYTHON_END, OUTPUT_START, OUTPUT_END = range(256, 265)


def alternates(messages: Column, first: str = "user") -> Column:
    """At least two messages, roles taking turns from the user on, every content a string."""
    turn = F.transform(messages, lambda m, i: (F.coalesce(m["role"], F.lit("")) == F.when(i % 2 == 0, first).otherwise("assistant")) & m["content"].isNotNull())
    return F.coalesce((F.size(messages) >= 2) & F.forall(turn, lambda ok: ok), F.lit(False))


def without_system(messages: Column) -> Column:
    """The messages after a leading system message, if there is one."""
    return F.when(F.get(messages, 0)["role"] == "system", F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def merged_system(messages: Column) -> Column:
    """A leading system message joined to the user message after it, with a blank line between."""
    rest = without_system(messages)
    first = F.get(rest, 0)
    joined = F.struct(first["role"].alias("role"), F.concat(F.get(messages, 0)["content"], F.lit("\n\n"), first["content"]).alias("content"))
    return F.when((F.get(messages, 0)["role"] == "system") & (F.size(messages) > 1), F.concat(F.array(joined), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))))).otherwise(messages)


def renderable(messages: Column) -> Column:
    """Why a conversation can't be rendered, or null: no message, system not before a user, roles not taking turns, null content."""
    rest = without_system(messages)
    turns = F.forall(F.transform(rest, lambda m, i: F.coalesce(m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda ok: ok)
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "empty")
        .when(F.size(rest) == 0, "system alone")
        .when(~turns, "roles")
        .when(F.exists(messages, lambda m: m["content"].isNull()), "content")
    )


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of a text as token ids."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def rendered(messages: Column, most: int | None = 2048) -> Column:
    """Array of (id, mask): what the assistant says, and its end, has mask 1."""

    def one(m: Column) -> Column:
        said = F.when(m["role"] == "assistant", 1).otherwise(0)
        start = F.when(m["role"] == "assistant", ASSISTANT_START).otherwise(USER_START)
        end = F.when(m["role"] == "assistant", ASSISTANT_END).otherwise(USER_END)
        text = F.transform(byte_ids(m["content"]), lambda i: F.struct(i.alias("id"), said.alias("mask")))
        return F.concat(F.array(F.struct(start.alias("id"), F.lit(0).alias("mask"))), text, F.array(F.struct(end.alias("id"), said.alias("mask"))))

    whole = F.concat(F.array(F.struct(F.lit(BOS).alias("id"), F.lit(0).alias("mask"))), F.flatten(F.transform(merged_system(messages), one)))
    return whole if most is None else F.slice(whole, 1, most)


def for_completion(messages: Column, most: int = 2048) -> Column:
    """Ids of the conversation without its last message, and the start of an answer after the cut."""
    prompt = rendered(F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), most)
    return F.array_append(F.transform(prompt, lambda x: x["id"]), F.lit(ASSISTANT_START))


def rendered_parts(parts: Column) -> Column:
    """(id, mask) of an assistant message in parts; calls are trained with their delimiters, outputs are not."""

    def wrap(p: Column) -> Column:
        mask = F.when(p["type"] == "python_output", 0).otherwise(1)
        text = F.transform(byte_ids(p["text"]), lambda i: F.struct(i.alias("id"), mask.alias("mask")))
        fence = lambda t: F.array(F.struct(F.lit(t).alias("id"), mask.alias("mask")))
        return F.when(p["type"] == "python", F.concat(fence(PYTHON_START), text, fence(PYTHON_END))).when(p["type"] == "python_output", F.concat(fence(OUTPUT_START), text, fence(OUTPUT_END))).otherwise(text)

    return F.flatten(F.transform(parts, wrap))


def render_tokens(df: DataFrame, key: str, messages: str, merges: list[tuple[int, int]] | None = None, most: int | None = 2048, completion: bool = False) -> DataFrame:
    """(``key``, ids, mask) of conversations, in one Arrow pass; both are null for one that can't be rendered.

    A message has ``role`` and ``content``, and may have ``parts`` (type, text) instead of its content. A leading system message goes into
    the user message after it. Texts are encoded by the merges, by bytes without any; special tokens follow them. What the assistant says
    and its end has mask 1, the output of its calls 0. ``most`` cuts the tokens. ``completion`` leaves out the last message, which must
    be the assistant's, and puts the start of an answer after the cut.
    """
    from quern.operators.bpe import SPECIALS, Encoder

    merges = merges or []
    shared = df.sparkSession.sparkContext.broadcast(merges)
    bos, user_start, user_end, start, end, python_start, python_end, output_start, output_end = range(256 + len(merges), 256 + len(merges) + len(SPECIALS))
    around = {"text": ([], 1, []), "python": ([python_start], 1, [python_end]), "python_output": ([output_start], 0, [output_end])}
    source = df.select(F.col(key).alias("k"), F.col(messages).alias("m"))
    kind = source.schema["k"].dataType.simpleString()

    def parts_of(message: dict) -> list[dict] | None:
        if message.get("parts") is not None:
            return message["parts"]
        return None if message["content"] is None else [{"type": "text", "text": message["content"]}]

    def rendered(talk: list[dict] | None, encode) -> tuple[list[int], list[int]] | None:
        talk = list(talk or [])
        if completion and (not talk or not talk[-1] or talk.pop()["role"] != "assistant"):
            return None
        if len(talk) > 1 and talk[0] and talk[1] and talk[0]["role"] == "system" and talk[1]["role"] == "user":
            if talk[0]["content"] is None or talk[1]["content"] is None:
                return None
            talk = [{"role": "user", "content": talk[0]["content"] + "\n\n" + talk[1]["content"]}, *talk[2:]]
        if not talk:
            return None
        ids, mask = [bos], [0]
        for k, message in enumerate(talk):
            said = k % 2
            parts = parts_of(message) if message and message["role"] == ("assistant" if said else "user") else None
            if parts is None or not said and any(p["type"] != "text" for p in parts):
                return None
            ids.append(start if said else user_start)
            mask.append(0)
            for part in parts:
                if part["type"] not in around:
                    return None
                before, trained, after = around[part["type"]]
                own = [*before, *encode(part["text"]), *after]
                ids += own
                mask += [trained * said] * len(own)
            ids.append(end if said else user_end)
            mask.append(said)
        return (ids[:most] + ([start] if completion else []), mask[:most] + ([0] if completion else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value).text
        for batch in batches:
            rows = [rendered(talk, encode) or (None, None) for talk in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int8()))], ["k", "ids", "mask"])

    return source.mapInArrow(run, f"k {kind}, ids array<int>, mask array<tinyint>").select(F.col("k").alias(key), "ids", "mask")


def gathered(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(``key``, messages) of a table with a row for each message; repeated rows count once, of different ones in one place the greatest."""
    once = messages.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).groupBy(key, "turn").agg(F.max(F.struct("role", "content")).alias("m"))
    own = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("x"))  # a conversation, not a group of copies
    return own.select(key, F.transform("x", lambda x: x["m"]).alias("messages"))


def inputs_and_targets(tokens: Column, mask: Column, pad_from: Column | None = None) -> tuple[Column, Column]:
    """Inputs without the last token; targets one on, -1 where the mask is 0 or padding begins."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    targets = F.zip_with(F.slice(tokens, 2, n), F.slice(mask, 2, n), lambda t, m: F.when(m == 1, t).otherwise(-1))
    if pad_from is not None:
        targets = F.transform(targets, lambda t, i: F.when(i >= pad_from - 1, -1).otherwise(t))
    return F.slice(tokens, 1, n), targets


def request_fault(messages: Column, temperature: Column, top_k: Column, max_tokens: Column) -> Column:
    """The first limit that a chat request breaks, in the order of the checks, or null."""
    n = F.coalesce(F.size(messages), F.lit(0))
    faults = F.transform(
        messages,
        lambda m, i: F.when(F.coalesce(F.length(m["content"]), F.lit(0)) == 0, F.concat(F.lit("empty "), i.cast("string"))).when(F.length(m["content"]) > LIMITS["message_chars"], F.concat(F.lit("long "), i.cast("string"))),
    )
    total = F.aggregate(messages, F.lit(0), lambda acc, m: acc + F.coalesce(F.length(m["content"]), F.lit(0)))
    outside = lambda c, k: c.isNotNull() & ~c.between(*LIMITS[k])
    return (
        F.when(n <= 0, "none")
        .when(n > LIMITS["messages"], "many")
        .when(F.exists(faults, lambda f: f.isNotNull()), F.get(F.filter(faults, lambda f: f.isNotNull()), 0))
        .when(total > LIMITS["total_chars"], "total")
        .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False))), "role")
        .when(outside(temperature, "temperature"), "temperature")
        .when(outside(top_k, "top_k"), "top_k")
        .when(outside(max_tokens, "max_tokens"), "max_tokens")
    )


def regenerated(messages: Column, index: Column) -> Column:
    """The messages before the turn that is asked again."""
    return F.slice(messages, 1, index)

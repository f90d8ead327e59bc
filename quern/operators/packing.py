"""Packing token sequences into rows of fixed length, as a training loader does."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("crop", "pad", "first_fit")


class Buffer:
    """Waiting lengths: the largest that fits, first come first among equals, in logarithmic time."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int]] = []  # (length, minus arrival): the first of a length stands last

    def put(self, arrival: int, length: int) -> None:
        insort(self.items, (length, -arrival))

    def take_fitting(self, room: int) -> tuple[int, int] | None:
        at = bisect_right(self.items, (room, 1))
        return self._out(at - 1) if at else None

    def take_shortest(self) -> tuple[int, int]:
        shortest = self.items[0][0]
        return self._out(bisect_right(self.items, (shortest, 1)) - 1)

    def _out(self, at: int) -> tuple[int, int]:
        length, arrival = self.items.pop(at)
        return -arrival, length

    def __len__(self) -> int:
        return len(self.items)


class Room:
    """Free space of rows: the first with room for a length, in logarithmic time."""

    def __init__(self, rows: int, capacity: int):
        self.size = 1 << max(0, rows - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def take(self, length: int) -> tuple[int, int]:
        """The row, and the free space it had."""
        at = 1
        while at < self.size:
            at *= 2
            if self.free[at] < length:
                at += 1
        had = self.free[at]
        self.free[at] -= length
        row = at - self.size
        while at > 1:
            at //= 2
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])
        return row, had


def pack(lengths: Iterator[int], capacity: int, policy: str, buffer_size: int, refill: int = 1) -> Iterator[tuple[int, int, int, int]]:
    """(row, arrival, start in row, tokens used) of each piece.

    ``crop`` fills each row to the end, cropping the shortest waiting sequence when
    none fits; ``pad`` leaves the rest of a row empty instead and, since a sequence
    longer than a row would wait forever, drops such; ``first_fit`` takes sequences
    longest first into the first row with room, and crops those longer than a row.
    While fewer than ``buffer_size`` wait, ``refill`` more come at once.
    """
    if policy == "first_fit":
        sizes = [min(n, capacity) for n in lengths]
        room = Room(len(sizes), capacity)
        for length, arrival in sorted(((n, k) for k, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
            at, had = room.take(length)
            yield at, arrival, capacity - had, length
        return
    source = enumerate(n for n in lengths)
    waiting, open_ = Buffer(), True
    row = used = 0
    while True:
        while open_ and len(waiting) < buffer_size:
            for _ in range(refill):
                item = next(source, None)
                if item is None:
                    open_ = False
                    break
                if 0 < item[1] and (policy == "crop" or item[1] <= capacity):
                    waiting.put(*item)
        if not len(waiting):
            return
        got = waiting.take_fitting(capacity - used)
        if got:
            yield row, got[0], used, got[1]
            used += got[1]
        elif policy == "crop":
            arrival, _ = waiting.take_shortest()
            yield row, arrival, used, capacity - used
            used = capacity
        else:
            used = capacity
        if used == capacity:
            row, used = row + 1, 0


def packed(df: DataFrame, shard: str, key: str, length: str, capacity: int = 2049, policy: str = "crop", buffer_size: int = 1000, refill: int | None = None) -> DataFrame:
    """(shard, row, key, start, used, length): where each sequence lies; each shard is packed on its own, in the order of its keys.

    Documents come by batches of 128 (``refill``) to ``crop``, conversations one by one to ``pad``.
    A sequence that ``pad`` can't pack has one row with null for ``row`` and ``start`` and 0 for ``used``.

    A shard is what one loader reads, a file of bounded size, so a group is too.
    """
    if policy not in POLICIES:
        raise ValueError(f"a policy is one of {POLICIES}")
    refill = refill or (128 if policy == "crop" else 1)
    kind = df.schema[key].dataType.simpleString()
    shard_kind = df.schema[shard].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key, kind="stable")
        sizes, keys = pdf[length].tolist(), pdf[key].tolist()
        rows = [(pdf[shard].iloc[0], row, keys[k], start, used, sizes[k]) for row, k, start, used in pack(iter(sizes), capacity, policy, buffer_size, refill)]
        if policy == "pad":
            rows += [(pdf[shard].iloc[0], None, k, None, 0, n) for k, n in zip(keys, sizes, strict=True) if n > capacity]
        out = pd.DataFrame(rows, columns=["shard", "row", "key", "start", "used", "length"])
        return out.astype({"row": "Int64", "start": "Int64"})

    return df.select(shard, key, F.col(length).cast("long").alias(length)).groupBy(shard).applyInPandas(run, f"shard {shard_kind}, row bigint, key {kind}, start bigint, used bigint, length bigint")


def progress(taken: Column, size: Column, steps: int | None = None) -> tuple[Column, Column, Column]:
    """Epoch from 1, share done and whether to stop after a number of taken sequences: by ``steps`` if given, else after one pass over ``size``."""
    share = taken / F.lit(steps) if steps else taken / size
    return F.floor(taken / size) + 1, F.least(share, F.lit(1.0)), share >= 1


def waste(rows: DataFrame, capacity: int) -> DataFrame:
    """Share of row space used, of all tokens cropped or left out with their sequence, and of row space padded."""
    per = rows.groupBy("shard").agg(F.coalesce(F.max("row"), F.lit(-1)).alias("last"), F.sum("used").alias("used"), F.sum("length").alias("tokens"))
    total = per.agg(F.sum(F.col("last") + 1).alias("rows"), F.sum("used").alias("used"), F.sum("tokens").alias("tokens"))
    space = F.col("rows") * capacity
    return total.select("rows", (F.col("used") / space * 100).alias("utilisation"), ((F.col("tokens") - F.col("used")) / F.col("tokens") * 100).alias("cropped"), ((space - F.col("used")) / space * 100).alias("padded"))


def assembled(rows: DataFrame, sequences: DataFrame, key: str, tokens: str, mask: str | None, capacity: int, padding: int) -> DataFrame:
    """(shard, row, tokens, mask, content): the rows of ``packed`` themselves, padded on the right with mask 0; ``content`` tokens come before it.

    A row is bounded by the capacity, so is what is gathered of it. Without ``mask`` every token has 1.
    """
    own = F.col(mask) if mask else F.transform(tokens, lambda _: F.lit(1))
    given = sequences.select(F.col(key).alias("key"), F.col(tokens).alias("_t"), own.alias("_m"))
    cut = lambda c: F.slice(c, F.lit(1), F.col("used").cast("int"))
    pieces = rows.where("row is not null").join(given, "key").select("shard", "row", F.struct("start", cut("_t").alias("t"), cut("_m").alias("m")).alias("x"))
    whole = pieces.groupBy("shard", "row").agg(F.array_sort(F.collect_list("x")).alias("x"))
    flat = whole.select("shard", "row", F.flatten(F.transform("x", lambda x: x["t"])).alias("t"), F.flatten(F.transform("x", lambda x: x["m"])).alias("m"))
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(capacity) - F.size(c)))
    return flat.select("shard", "row", pad("t", padding).alias("tokens"), pad("m", 0).alias("mask"), F.size("t").alias("content"))

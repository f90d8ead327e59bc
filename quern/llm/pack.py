"""Filling fixed-capacity containers with texts by minimum bin slack.

Method: minimum bin slack. Each container is opened with the longest text left;
a bitset subset-sum over the multiset of remaining lengths then finds the texts
that bring it closest to its capacity, and is walked backwards to learn how many
of each length they are. The choice depends on lengths only, so it is made on
the histogram of lengths, which has at most ``capacity`` rows whatever the number
of texts, and one solution is applied to as many containers as the counts allow.
A step uses up, or at least halves, the count of one length, so a plan has at
most ``capacity * log2(texts)`` steps. Each container size is planned in a task of its own.
Texts then find their slot by their rank within their length, in the order of key and
piece: rows are range-partitioned by size, key and piece, numbered within their
partition, and moved up by what earlier partitions hold of the length, as one length may
hold a third of all rows. Plans are broadcast up to ``BROADCAST_STEPS`` steps, which are
counted; beyond that they are joined by length.

Results: every row with a non-empty text is placed exactly once for each
container size (a repeated row is another text to place); null and empty texts
are left out, blank ones are not. Only a text longer than the capacity is split,
into pieces of the capacity and a rest, which is packed with the others; in bytes
a cut moves back to the start of a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import cut_lineage

#: Steps of all plans up to which they are broadcast (24 bytes each).
BROADCAST_STEPS = 2_000_000
#: Container sizes are parameters of a job, not data.
MOST_SPECS = 1000


def fill_one(capacity: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths for one container: the longest, and what fills the rest best."""
    first = lengths[0]
    room = capacity - first
    if room == 0:
        return {first: 1}
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    full = 1 << room
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - (length == first), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for length, take, before in reversed(steps):
        if not (before >> total) & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_containers(capacity: int, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, need per container, first container, containers) for each length of each step."""
    counts = dict(histogram)
    lengths = sorted(counts, reverse=True)
    used = dict.fromkeys(lengths, 0)
    out, container = [], 0
    while lengths:
        chosen = fill_one(capacity, lengths, counts)
        times = min(counts[length] // need for length, need in chosen.items())
        gone = False
        for length, need in chosen.items():
            out.append((length, used[length], need, container, times))
            used[length] += need * times
            counts[length] -= need * times
            gone |= counts[length] == 0
        container += times
        if gone:
            lengths = [x for x in lengths if counts[x]]
    return out


def cuts(data: bytes | str, capacity: int) -> list[int]:
    """Where the pieces of a long text start, and its end; in bytes each starts at a character."""
    out = [0]
    while len(data) - out[-1] > capacity:
        at = out[-1] + capacity
        if isinstance(data, bytes):
            while 0x80 <= data[at] < 0xC0:
                at -= 1
        out.append(at)
    return [*out, len(data)]


def pieces(df: DataFrame, specs: list[tuple], text: str, key: str) -> DataFrame:
    """One row per text or piece and container size: spec, key, piece, start, size. Only texts longer than a capacity leave the JVM."""
    kind = df.schema[key].dataType.simpleString()
    base = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"), F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"))
    whole = F.array(*(F.struct(F.lit(place).alias("spec"), F.col(unit).alias("size")) for place, (_, unit, _) in enumerate(specs)))
    limit = F.array(*(F.lit(capacity) for *_, capacity in specs))
    fitting = base.select("k", F.explode(F.filter(whole, lambda x: x["size"] <= F.get(limit, x["spec"]))).alias("x")).select("x.spec", "k", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "x.size")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                whole = {"chars": t.as_py(), "bytes": t.as_py().encode()}
                for place, (_, unit, capacity) in enumerate(specs):
                    if len(whole[unit]) <= capacity:
                        continue
                    at = np.array(cuts(whole[unit], capacity), np.int64)
                    n = len(at) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, place, np.int32)), pa.repeat(k, n), pa.array(np.arange(n, dtype=np.int32)), pa.array(at[:-1]), pa.array(np.diff(at))], ["spec", "k", "piece", "start", "size"])

    long = F.lit(False)
    for _, unit, capacity in specs:
        long |= F.col(unit) > capacity
    return fitting.unionByName(base.where(long).select("k", "t").mapInArrow(split, f"spec int, k {kind}, piece int, start bigint, size bigint"))


def read_specs(specs: DataFrame) -> list[tuple[int, str, int]]:
    """Container sizes as a list; repeated rows count once."""
    rows = sorted({(r.spec_id, r.unit, r.capacity) for r in specs.select("spec_id", "unit", "capacity").limit(MOST_SPECS + 1).collect()}, key=str)
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    for spec_id, unit, capacity in rows:
        if spec_id is None or unit not in ("chars", "bytes") or capacity is None or capacity < (4 if unit == "bytes" else 1):
            raise ValueError(f"no usable container size: {spec_id}, {unit}, {capacity}")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a spec_id has two container sizes")
    return rows


def fill_containers(df: DataFrame, specs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_steps: int = BROADCAST_STEPS) -> DataFrame:
    """(spec_id, ``key``, piece, start, size, container_id): where each text or piece lies.

    ``start`` and ``size`` are in the container's unit. Container ids count from 0 within a spec.
    """
    spark = df.sparkSession
    sizes = read_specs(specs)
    kind = df.schema[key].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"spec_id bigint, {key} {kind}, piece int, start bigint, size bigint, container_id bigint")
    items = cut_lineage(pieces(df, sizes, text, key))
    histogram = items.groupBy("spec", "size").agg(F.count("*").alias("n"))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)  # a histogram has no more rows than the capacity
        for spec, own in pd.concat(rows).groupby("spec") if rows else ():
            steps = plan_containers(sizes[spec][2], dict(zip(own["size"].tolist(), own["n"].tolist(), strict=True)))
            out = pd.DataFrame(steps, columns=["size", "rank", "need", "container", "times"])
            out.insert(0, "spec", spec)
            yield out.drop(columns="times")

    steps = cut_lineage(histogram.repartitionById(len(sizes), F.col("spec")).mapInPandas(plan, "spec int, size bigint, rank bigint, need bigint, container bigint"))
    order = ["spec", "size", "k", "piece"]
    placed = cut_lineage(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("spec", "size").orderBy("part")) - F.col("n")
    offsets = placed.groupBy("spec", "size", "part").agg(F.count("*").alias("n")).withColumn("offset", before).where("offset > 0").select("part", "offset")  # of the first length of a partition
    few = steps.count() <= broadcast_steps
    own = steps.orderBy("spec", "size", "rank").toPandas() if few else None
    table = own.to_numpy(np.int64) if few else np.zeros((0, 5), np.int64)
    shared = spark.sparkContext.broadcast((dict(map(tuple, offsets.collect())), table))
    ids = np.array([s[0] for s in sizes], np.int64)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        held = None  # specification and size of the last row, and the rank after it
        for batch in batches:
            if not batch.num_rows:
                continue
            spec, size = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4))
            if held is None:
                held = (spec[0], size[0], shared.value[0].get(batch.column(5)[0].as_py(), 0))
            new = np.ones(len(spec), bool)
            new[0] = (spec[0], size[0]) != held[:2]
            new[1:] = (spec[1:] != spec[:-1]) | (size[1:] != size[:-1])
            at = np.arange(len(spec))
            start = np.maximum.accumulate(np.where(new, at, -1))
            ranks = np.where(start < 0, at + held[2], at - start)
            held = (spec[-1], size[-1], int(ranks[-1]) + 1)
            yield batch, spec, size, ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[1]
        if few and len(table):
            far, wide = int(table[:, 2].max()) + 1, int(table[:, 1].max()) + 1
            group = table[:, 0] * wide + table[:, 1]
            names = np.unique(group)
            edges = np.searchsorted(names, group) * far + table[:, 2]
        for batch, spec, size, ranks in rank(batches):
            if few:
                at = np.searchsorted(edges, np.searchsorted(names, spec * wide + size) * far + np.minimum(ranks, far - 1), side="right") - 1
                last = table[at, 4] + (ranks - table[at, 2]) // table[at, 3]
            else:
                last = ranks
            yield pa.RecordBatch.from_arrays([pa.array(ids[spec]), *(batch.column(k) for k in (1, 2, 3, 4)), pa.array(last), batch.column(0)], ["spec_id", "k", "piece", "start", "size", "container_id", "spec"])

    out = placed.mapInArrow(place, f"spec_id bigint, k {kind}, piece int, start bigint, size bigint, container_id bigint, spec int")
    if not few:
        plans = steps.groupBy("spec", "size").agg(F.array_sort(F.collect_list(F.struct("rank", "need", "container"))).alias("steps"))
        step = F.element_at(F.filter("steps", lambda x: x["rank"] <= F.col("container_id")), -1)
        out = out.join(plans, ["spec", "size"]).withColumn("step", step).withColumn("container_id", F.expr("step.container + (container_id - step.rank) div step.need"))
    return out.select("spec_id", F.col("k").alias(key), "piece", "start", "size", "container_id")


def unused_space(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, items, unused_share) over the containers of ``fill_containers``."""
    wide = specs.select("spec_id", "capacity").dropDuplicates()
    filled = placed.groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.count("*").alias("items"), F.sum("size").alias("used"))
    return filled.join(F.broadcast(wide), "spec_id").select("spec_id", "containers", "items", (1 - F.col("used") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))

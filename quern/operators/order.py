"""Order-dependent operators without a global sort in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import cut_lineage


def seeded_order(seed: int, key: Column) -> Column:
    """A shuffle's sort key: the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def running(df: DataFrame, order: list[Column], value: Column | None = None, index: str = "pos", total: str = "upto") -> DataFrame:
    """Adds the position in a global order, from 0, and the running total of ``value`` up to and with the row.

    Rows are range-partitioned by the order and each partition is summed on its own;
    the partitions' totals, one row each, give the offsets. Nothing is sorted in one task.
    """
    value = F.lit(0) if value is None else value
    names = [f"_o{k}" for k in range(len(order))]
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)), value.cast("long").alias("_v"))
    parts = cut_lineage(keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_p").orderBy(*names)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "_p")
    return out.withColumn(index, F.col("_n0") + F.row_number().over(inside) - 1).withColumn(total, F.col("_s0") + F.sum("_v").over(up_to)).drop("_p", "_v", "_n0", "_s0", *names)


def char_budget(df: DataFrame, text: str, order: list[Column], cap: int, most: int) -> DataFrame:
    """(the order's columns, chars) of the rows until the running total of capped lengths exceeds ``most``; the row that crosses it stays.

    Texts don't travel: what is chosen is joined back where it is needed.
    """
    kept = df.select(*order, F.least(F.length(text), F.lit(cap)).alias("chars"))
    return running(kept, order, F.col("chars")).where(F.col("upto") - F.col("chars") <= most).drop("upto")


def slice_view(df: DataFrame, index: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows ``start, start + step, ...`` before ``stop``, with a new index from 0."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("start >= 0, stop >= start and step >= 1 are needed")
    inside = (F.col(index) >= start) & ((F.col(index) - start) % step == 0)
    if stop is not None:
        inside &= F.col(index) < stop
    return df.where(inside).withColumn("slice_index", F.floor((F.col(index) - start) / step))


def slice_length(start: int, stop: int, step: int) -> int:
    """Length of a slice, which trusts ``stop`` past the end of the data."""
    return max(0, -(-(stop - start) // step))


def shard_boundaries(df: DataFrame, order: list[Column], size: Column, least_size: int, multiple: int) -> DataFrame:
    """Adds ``shard``: a shard closes at the first multiple of ``multiple`` rows where it holds ``least_size``; an unfinished last shard is dropped.

    Blocks of ``multiple`` rows are summed in parallel; only the fold over block
    sums, one row per block, is sequential: a stream through one task, which holds
    a shard's number and its size so far.
    """
    rows = running(df, order, size)
    rows = rows.withColumn("block", F.floor(F.col("pos") / multiple)).drop("upto")
    blocks = rows.groupBy("block").agg(F.sum(size).cast("long").alias("s"), F.count("*").alias("n"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = 0
        for batch in batches:
            shards, closes = [], []
            for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held += s or 0
                shards.append(shard)
                closes.append(n == multiple and held >= least_size)
                if closes[-1]:
                    shard, held = shard + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.int64()), pa.array(closes, pa.bool_())], ["block", "shard", "closes"])

    folded = cut_lineage(blocks.repartition(1).sortWithinPartitions("block").mapInArrow(fold, "block bigint, shard bigint, closes boolean"))
    done = folded.agg(F.coalesce(F.max(F.when(F.col("closes"), F.col("shard"))), F.lit(-1)).alias("done"))
    closed = folded.join(F.broadcast(done), F.col("shard") <= F.col("done")).select("block", "shard")
    return rows.join(closed, "block").drop("block")

"""Nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.order import running

#: Queries that travel at once, counted; more take several passes over the rows.
QUERIES_AT_ONCE = 50_000
#: Rows and queries whose products stand in memory at once.
_ROWS, _QUERIES = 1024, 2048


def _unit(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length one; null and zero vectors as zeros."""
    lists = column.to_pylist()
    width = max((len(x) for x in lists if x), default=0)
    out = np.array([x if x and len(x) == width else [0.0] * width for x in lists], np.float64).reshape(len(lists), width)
    out = np.nan_to_num(out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, millionths of the cosine, id) the ``k`` best of each query, the least ids on ties."""
    found = found[np.lexsort((found[:, 2], -found[:, 1], found[:, 0]))]
    first = np.flatnonzero(np.r_[True, found[1:, 0] != found[:-1, 0]]) if len(found) else np.zeros(0, np.int64)
    place = np.arange(len(found)) - np.repeat(first, np.diff(np.r_[first, len(found)]))
    return found[place < k]


def nearest(df: DataFrame, asked: DataFrame, key: str, vector: str, k: int, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query, rank, ``key``): the ``k`` rows of ``df`` nearest by cosine, to six places, to each row of ``asked`` but itself.

    Queries are broadcast in chunks of a counted size; each task multiplies blocks of rows and queries and keeps the best ``k`` of
    each query, so what is shuffled is ``k`` rows a query and task. A vector that is null, zero or of another length has cosine 0.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    wanted = running(asked.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null").dropDuplicates(["id"]), [F.col("id")])
    chunks = -(-wanted.count() // at_once)
    out = None
    for chunk in range(max(1, chunks)):
        table = wanted.where(F.col("pos").between(chunk * at_once, (chunk + 1) * at_once - 1)).select("id", "v").toArrow()
        shared = spark.sparkContext.broadcast((table.column("id").to_numpy().astype(np.int64), _unit(table.column("v").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, units = shared.value
            kept = np.zeros((0, 3), np.int64)
            least = np.full(len(names), -2_000_000, np.int64)  # below which nothing is among the best
            for batch in batches:
                ids, own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _unit(batch.column(1))
                if own.shape[1] != units.shape[1]:
                    own = np.zeros((len(ids), units.shape[1]))
                for r in range(0, len(ids), _ROWS):
                    for q in range(0, len(names), _QUERIES):
                        scores = np.rint(units[q : q + _QUERIES] @ own[r : r + _ROWS].T * 1e6).astype(np.int64)
                        near = (scores >= least[q : q + _QUERIES, None]) & (names[q : q + _QUERIES, None] != ids[None, r : r + _ROWS])
                        a, b = np.nonzero(near)
                        kept = _best(np.concatenate([kept, np.stack([a + q, scores[a, b], ids[r + b]], axis=1)]), k)
                    full = np.flatnonzero(np.bincount(kept[:, 0], minlength=len(names)) >= k)
                    last = np.searchsorted(kept[:, 0], full, side="right") - 1
                    least[full] = kept[last, 1]
            yield pa.RecordBatch.from_arrays([pa.array(names[kept[:, 0]]), pa.array(kept[:, 1]), pa.array(kept[:, 2])], ["query", "score", "id"])

        part = rows.mapInArrow(run, "query bigint, score bigint, id bigint")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", F.col("id").alias(key))

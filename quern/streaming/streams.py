"""Structured Streaming: corpus streams, event windows, stateful generation, packing and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """The shards of a folder in order of their names, resumed exactly where the checkpoint of the sink left off."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(folder)


def event_time(df: DataFrame, column: str, late: str) -> DataFrame:
    """A zoneless time as a watermark's time, in UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(df: DataFrame, column: str, size: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return event_time(df, column, late).groupBy(F.window(column, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, column: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return event_time(df, column, late).groupBy(F.session_window(column, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def once_only(df: DataFrame, column: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Rows without the repeats that come within ``late``, how long the state is kept; a repeat after that is a new row."""
    return event_time(df, column, late).dropDuplicatesWithinWatermark(keys)


def smoothed(df: DataFrame, key: str, step: str, value: str, beta: float = 0.9) -> DataFrame:
    """The debiased exponential mean of each run's values as they come, those of a micro-batch by step: (key, step, ema). State: mean and count of a run."""

    def update(keys, batches: Iterator, state):
        import pandas as pd

        mean, n = state.get if state.exists else (0.0, 0)
        rows = []
        own = pd.concat(list(batches))  # one run's rows of one micro-batch, whose size the trigger bounds
        for at, x in own.sort_values(step)[[step, value]].itertuples(index=False):
            if x is None or x != x:
                continue
            mean, n = beta * mean + (1 - beta) * x, n + 1
            rows.append((keys[0], int(at), mean / (1 - beta**n)))
        yield pd.DataFrame(rows, columns=["key", "step", "ema"])
        state.update((mean, n))

    return df.select(key, step, value).groupBy(key).applyInPandasWithState(update, "key string, step bigint, ema double", "mean double, n bigint", "append", "NoTimeout")


class Automaton:
    """The tool-using state of one generated row: a call's result is forced in after its end."""

    def __init__(self, start: int, end: int, out_start: int, out_end: int, terminals: tuple[int, ...], tool: Callable[[str], str | None]):
        self.marks, self.terminals, self.tool = (start, end, out_start, out_end), terminals, tool

    def step(self, state: dict, sampled: int) -> tuple[int, int]:
        """The token to emit and its mask (0 for a forced one); updates the state: forced, expr, inside, done."""
        start, end, out_start, out_end = self.marks
        forced = state["forced"]
        token, mask = (forced.pop(0), 0) if forced else (sampled, 1)
        if token in self.terminals:
            state["done"] = True
        elif token == start:
            state["inside"], state["expr"] = True, []
        elif token == end and state["inside"]:
            state["inside"] = False
            value = self.tool(bytes(t for t in state["expr"] if t < 256).decode("utf-8", "replace")) if state["expr"] else None
            if value is not None:
                state["forced"] = [out_start, *value.encode(), out_end]
            state["expr"] = []
        elif state["inside"]:
            state["expr"].append(token)
        return token, mask


def generated(prompts: DataFrame, key: str, row: str, most: int, sample: Callable[[int, int, int], int], automaton: Automaton) -> DataFrame:
    """(key, row, step, token, mask) of each row of a batch or a stream; ``sample`` gives the token of (key, row, step)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, r in pdf[[key, row]].itertuples(index=False):
                state = {"forced": [], "expr": [], "inside": False, "done": False}
                for at in range(most):
                    token, mask = automaton.step(state, sample(int(k), int(r), at))
                    out.append((int(k), int(r), at, token, mask))
                    if state["done"]:
                        break
            yield pd.DataFrame(out, columns=["key", "row", "step", "token", "mask"])

    return prompts.select(key, row).mapInPandas(run, "key bigint, row bigint, step int, token int, mask int")


class TokenModel(Protocol):
    """A model that reads a prompt once and goes on from the state it then has; a state is never changed in place."""

    def prefill(self, ids: list[int]) -> object: ...

    def sample(self, state: object, row: int, step: int) -> int: ...

    def advance(self, state: object, token: int) -> object: ...


def continued(prompts: DataFrame, key: str, ids: str, samples: int, most: int, model: TokenModel, automaton: Automaton) -> DataFrame:
    """(key, row, step, token, mask) of ``samples`` continuations of each prompt, which share its prefill.

    Each step samples a token, which a result that a call forces in may override; the state goes on with the token that was emitted.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, own in pdf[[key, ids]].itertuples(index=False):
                first = model.prefill(list(own))
                for r in range(samples):
                    state, talk = first, {"forced": [], "expr": [], "inside": False, "done": False}
                    for at in range(most):
                        token, mask = automaton.step(talk, model.sample(state, r, at))
                        out.append((int(k), r, at, token, mask))
                        if talk["done"]:
                            break
                        state = model.advance(state, token)
            yield pd.DataFrame(out, columns=["key", "row", "step", "token", "mask"])

    return prompts.select(key, ids).mapInPandas(run, "key bigint, row bigint, step int, token int, mask int")


def to_lines(df: DataFrame, path: str, checkpoint: str, line: str):
    """A sink of text lines, one folder for each batch, written once whatever is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(line).write.mode("overwrite").text(f"{path}/{number:06d}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Parquet files, and reads them: each batch is a folder of its own, written anew if it is repeated.

    A complete result replaces the one before. Nothing of it passes through the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch=*")

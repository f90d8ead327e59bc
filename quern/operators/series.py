"""Time series of training metrics, fits and schedules."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.operators.order import running
from quern.session import cut_lineage


def once(metrics: DataFrame) -> DataFrame:
    """One row per (run, step, metric): the first to arrive; null and NaN values left out."""
    own = metrics.where("value is not null and not isnan(value)").groupBy("run", "step", "metric").agg(F.min(F.struct("arrived_at", "value")).alias("x"))
    return own.select("run", "step", "metric", "x.value")


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, beta: float = 0.9, late: int = 0) -> DataFrame:
    """Adds ``ema``: the debiased exponential mean up to each row, from 0 before the first; null for a null value, which counts for nothing.

    Rows are range-partitioned by keys and order and summed on their own; a run that goes on in the next partition hands
    its sum on, one row per partition, so that no run is in one task and nothing before is forgotten, whatever ``beta``.
    ``late`` is added to the exponent of the debiasing.
    """
    spark = df.sparkSession
    names = [*keys, order]
    parts = cut_lineage(df.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_p", F.spark_partition_id()))
    columns = df.columns
    places, at = [columns.index(k) for k in keys], columns.index(value)

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        """(key, from, to) of each stretch of one run."""
        own = list(zip(*(batch.column(k).to_pylist() for k in places), strict=True))
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k] != own[start]:
                yield own[start], start, k
                start = k

    def advance(held: tuple, key: tuple, values: list[float | None]) -> tuple[tuple, list[float | None]]:
        """(key, sum, count) after some values of a run, and their means."""
        total, n = held[1:] if held[0] == key else (0.0, 0)
        out: list[float | None] = []
        for x in values:
            if x is None:
                out.append(None)
                continue
            total, n = beta * total + (1 - beta) * x, n + 1
            out.append(total / (1 - beta ** (n + late)))
        return (key, total, n), out

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last run of a partition, with the last one's sum and count in it."""
        first, held = None, (None, 0.0, 0)
        number = 0
        for batch in batches:
            values, number = batch.column(at).to_pylist(), batch.column(len(columns))[0].as_py() if batch.num_rows else number
            for key, i, j in runs(batch):
                first = key if first is None else first
                held, _ = advance(held, key, values[i:j])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps((first, *held))], pa.binary())], ["p", "state"])

    carried, last = {}, (None, 0.0, 0)
    for r in sorted(parts.mapInArrow(ends, "p int, state binary").collect()):  # one row per partition
        first, key, total, n = pickle.loads(r.state)
        carried[r.p] = last
        whole = first == key == last[0]
        last = (key, total + beta**n * last[1], n + last[2]) if whole else (key, total, n)
    shared = spark.sparkContext.broadcast(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is None and batch.num_rows:
                held = shared.value[batch.column(len(columns))[0].as_py()]
            values, means = batch.column(at).to_pylist(), []
            for key, i, j in runs(batch):
                held, own = advance(held, key, values[i:j])
                means += own
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(means, pa.float64())], [*columns, "ema"])

    return parts.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ema", T.DoubleType())]))


def running_min(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def quadratic_fit(df: DataFrame, group: str, x: Column, y: Column, about: float | None = None) -> DataFrame:
    """(group, a, b, c) of y = a x² + b x + c by the normal equations, in one aggregate.

    Moments are taken about a constant, ``about`` or the mean of all x's ends, and moved to each group's mean, which keeps digits.
    """
    if about is None:
        ends = df.agg(F.min(x).alias("l"), F.max(x).alias("h")).first()
        about = ((ends["l"] or 0.0) + (ends["h"] or 0.0)) / 2
    u, v = x - F.lit(float(about)), y
    sums = df.groupBy(group).agg(F.count(u).cast("double").alias("n"), *(F.sum(F.pow(u, F.lit(k))).alias(f"p{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow(u, F.lit(k)) * v).alias(f"q{k}") for k in (0, 1, 2)))
    n, p1, p2, p3, p4, q0, q1, q2 = (F.col(c) for c in ("n", "p1", "p2", "p3", "p4", "q0", "q1", "q2"))
    m = p1 / n  # the group's mean: central moments follow by the binomial theorem
    s2 = p2 - n * m * m
    s3 = p3 - 3 * m * p2 + 2 * n * m * m * m
    s4 = p4 - 4 * m * p3 + 6 * m * m * p2 - 3 * n * m * m * m * m
    t1 = q1 - m * q0
    t2 = q2 - 2 * m * q1 + m * m * q0
    whole = s4 * s2 * n - s3 * s3 * n - s2 * s2 * s2
    a = F.try_divide(t2 * s2 * n - s3 * t1 * n - s2 * s2 * q0, whole)
    b1 = F.try_divide(s4 * t1 * n - t2 * s3 * n + s2 * (s3 * q0 - t1 * s2), whole)
    c1 = F.try_divide(s4 * s2 * q0 - s3 * (s3 * q0 - t1 * s2) - t2 * s2 * s2, whole)
    centred = sums.select(group, (m + F.lit(float(about))).alias("m"), a.alias("a"), b1.alias("b1"), c1.alias("c1"))
    return centred.select(group, "a", (F.col("b1") - 2 * F.col("a") * F.col("m")).alias("b"), (F.col("c1") - F.col("b1") * F.col("m") + F.col("a") * F.col("m") * F.col("m")).alias("c"))


def ridge(df: DataFrame, features: list[str], target: str, alphas: list[float]) -> list[list[float]]:
    """Intercept and weights of ridge regression for each penalty, the intercept unpenalised; one scan, of which only the Gram matrix reaches the driver."""
    import numpy as np

    names = [F.lit(1.0), *map(F.col, features)]
    k = len(names)
    cells = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)] + [F.sum(a * F.col(target)).alias(f"y{i}") for i, a in enumerate(names)]
    row = df.agg(*cells).first()
    gram = np.array([[row[f"g{i}_{j}"] for j in range(k)] for i in range(k)], float)
    right = np.array([row[f"y{i}"] for i in range(k)], float)
    return [np.linalg.solve(gram + alpha * np.diag([0.0] + [1.0] * (k - 1)), right).tolist() for alpha in alphas]


def weight_norm(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, norm): the Euclidean length of each fit's weights."""
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))


def ranked_fits(df: DataFrame, task: str, x: str, y: str) -> DataFrame:
    """(rank, ``task``, slope, intercept, r2): a line for each task, the best explained first, tasks by name on ties."""
    fits = df.groupBy(task).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.round(F.regr_r2(y, x), 9).alias("r2"))
    order = [-F.coalesce("r2", F.lit(-1.0)), F.col(task)]  # a group without an r2 comes last
    return running(fits, order).select((F.col("pos") + 1).alias("rank"), task, "slope", "intercept", "r2")


def averaged(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value): the mean of two estimates, the one that is there where the other is missing."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key, "full")
    return both.select(*key, ((F.coalesce("_a", "_b") + F.coalesce("_b", "_a")) / 2).alias(value))


def interpolated(points: DataFrame, wanted: DataFrame, group: str, x: str, y: str, at: str) -> DataFrame:
    """Adds ``y`` at each wanted ``at``, linear between the group's points, level beyond its ends."""
    marks = points.select(group, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(None).cast("double").alias(at)).unionByName(wanted.select(group, F.col(at).alias("_x"), F.lit(None).cast("double").alias("_y"), F.col(at).cast("double").alias(at)))
    own = Window.partitionBy(group).orderBy("_x", F.col("_y").isNull())
    point = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    before = F.last(point, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))
    got = marks.withColumn("_p", before).withColumn("_q", after).where(F.col("_y").isNull())
    p, q = F.col("_p"), F.col("_q")
    value = F.when(p.isNull(), q["_y"]).when(q.isNull() | (q["_x"] == p["_x"]), p["_y"]).otherwise(p["_y"] + (q["_y"] - p["_y"]) * (F.col(at) - p["_x"]) / (q["_x"] - p["_x"]))
    return got.select(group, at, value.alias(y))


def lr_multiplier(it: Column, steps: int, warmup: int, warmdown: int, final: float) -> Column:
    """Linear rise over ``warmup`` steps, level, linear fall over ``warmdown`` to ``final``."""
    left = (steps - it) / warmdown if warmdown else F.lit(1.0)
    rise = (it + 1) / warmup if warmup else F.lit(1.0)
    return F.when(it < warmup, rise).when(it <= steps - warmdown, 1.0).otherwise(left + (1 - left) * final)


def lr_by_progress(progress: Column, warmup: float, warmdown: float, final: float) -> Column:
    """The same over a share of the work from 0 to 1."""
    decay = (progress - (1.0 - warmdown)) / warmdown if warmdown else F.lit(0.0)
    rise = (progress + 1e-8) / warmup if warmup else F.lit(1.0)
    return F.when(progress < warmup, rise).when(progress <= 1.0 - warmdown, 1.0).otherwise((1 - decay) + decay * final)


def momentum(it: Column, steps: int, warmdown: int) -> Column:
    """0.85 to 0.97 over 400 steps, level, down to 0.90 in the warmdown."""
    rise = it / 400
    fall = (it - (steps - warmdown)) / warmdown if warmdown else F.lit(0.0)
    return F.when(it < 400, (1 - rise) * 0.85 + rise * 0.97).when(it >= steps - warmdown, 0.97 * (1 - fall) + 0.90 * fall).otherwise(0.97)


def weight_decay(it: Column, steps: int, start: float) -> Column:
    return start * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * it / steps))


#: The model whose settings others are scaled from.
REFERENCE_DEPTH, REFERENCE_BATCH, BATCH_POWER = 12, 2**19, 0.383


def with_shape(df: DataFrame, depth: str, aspect: int = 64, head: int = 128) -> DataFrame:
    """Adds width, a multiple of the head size, and heads of a depth."""
    width = F.ceil(F.col(depth) * aspect / head) * head
    return df.withColumn("width", width.cast("long")).withColumn("heads", (F.col("width") / head).cast("long"))


def with_parameters(df: DataFrame, depth: str, vocabulary: int = 32768, gate: int = 12, smear: int = 24) -> DataFrame:
    """Adds parameter counts by group. Every second layer, counted from the last, has value embeddings and a gate for them."""
    d, w = F.col(depth), F.col("width")
    with_values = F.floor((d + 1) / 2)
    out = df.withColumn("embedding", vocabulary * w).withColumn("value_embeddings", with_values * vocabulary * w).withColumn("head", vocabulary * w)
    out = out.withColumn("matrices", 12 * d * w * w + with_values * F.col("heads") * gate).withColumn("scalars", 2 * d + smear + 2)
    return out.withColumn("total", F.col("embedding") + F.col("value_embeddings") + F.col("head") + F.col("matrices") + F.col("scalars"))


def windows(depth: Column, pattern: str, length: int) -> Column:
    """Attention window of each layer: S a quarter of the length in tiles of 128, L the whole; the last layer L."""
    if set(pattern.upper()) - set("SL") or not pattern:
        raise ValueError("a pattern is made of S and L")
    short = -(-length // 4 // 128) * 128
    sizes = F.array(*(F.lit(length if c == "L" else short) for c in pattern.upper()))
    return F.transform(F.sequence(F.lit(0), depth.cast("int") - 1), lambda i: F.when(i == depth - 1, length).otherwise(F.get(sizes, i % len(pattern))))


def flops_per_token(windows_: Column, length: int) -> Column:
    """Six per matrix weight, and attention by each layer's window."""
    attention = F.aggregate(windows_, F.lit(0).cast("long"), lambda a, x: a + 12 * F.col("heads") * F.expr("width div heads") * F.least(x, F.lit(length)))
    return 6 * (F.col("matrices") + F.col("head")) + attention


def horizon(iterations: Column, flops: Column, ratio: Column, parameters: Column, flops_token: Column, batch: Column) -> Column:
    """Steps to train: given, else from a number of FLOPs, else from tokens per parameter; values that aren't positive aren't given."""
    return F.when(iterations > 0, iterations).when(flops > 0, F.bround(flops / (flops_token * batch), 0).cast("long")).when(ratio > 0, F.floor(F.floor(ratio * parameters) / batch))


#: The scalars of the first and of the last layer, of the residual and of the input.
RESIDUAL, INPUT = (1.15, 1.05), (0.20, 0.05)


def residual_ramps(depth: int, layer: Column) -> tuple[Column, Column]:
    """Start values of a layer's residual scalars, linear from the first layer to the last."""
    part = layer / max(1, depth - 1)
    return tuple(F.lit(a) + (b - a) * part for a, b in (RESIDUAL, INPUT))


def with_ratio(df: DataFrame, tokens: str = "tokens_trained", effective: Callable[[], Column] = lambda: F.col("matrices") + F.col("head")) -> DataFrame:
    """Adds effective_params, by default of matrices and head, and param_data_ratio, tokens for each of them; ``effective`` is the user's to change."""
    return df.withColumn("effective_params", effective()).withColumn("param_data_ratio", F.try_divide(F.col(tokens), F.col("effective_params")))


def whole_steps(tokens: Column, per_step: Column) -> Column:
    """The greatest multiple of a step's tokens."""
    return F.floor(tokens / per_step) * per_step


def accumulation(batch: int, per_device: int, length: int, world: int) -> int:
    """Steps whose gradients are summed; the batch must be a multiple of what all devices take at once."""
    at_once = per_device * length * world
    if batch % at_once:
        raise ValueError(f"{batch} is no multiple of {at_once}")
    return batch // at_once


#: Rate, betas and decay of each optimizer group; ``wide`` groups scale with width.
GROUPS = [("head", 0.004, True, 0.8, 0.96, 0.01), ("embedding", 0.2, True, 0.8, 0.995, 0.001), ("value_embeddings", 0.1, True, 0.8, 0.995, 0.01), ("residual", 0.005, False, 0.8, 0.95, 0.05), ("input", 0.5, False, 0.96, 0.95, 0.0), ("smear", 0.2, False, 0.8, 0.95, 0.0)]


def optimizer_groups(df: DataFrame) -> DataFrame:
    """(width, group, lr, beta1, beta2, decay) for each width: rates of wide groups fall with its square root from 768 on."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("group"), (F.lit(lr) * F.pow(F.col("width") / 768, F.lit(-0.5)) if wide else F.lit(lr)).alias("lr"), F.lit(b1).alias("beta1"), F.lit(b2).alias("beta2"), F.lit(wd).alias("decay")) for n, lr, wide, b1, b2, wd in GROUPS)))
    return df.select("width", rows.alias("g")).select("width", "g.*")


#: Rate, momentum and decay of the groups of matrices.
MATRIX_LR, MATRIX_BETA2, MATRIX_DECAY = 0.02, 0.9, 0.28


def matrix_groups(shapes: DataFrame, rows: str = "rows", columns: str = "columns", lr: float = MATRIX_LR) -> DataFrame:
    """(rows, columns, matrices, lr): matrices of one shape are one group; tall ones take a greater rate, the root of how tall they are."""
    own = shapes.groupBy(rows, columns).agg(F.count("*").alias("matrices"))
    return own.withColumn("lr", lr * F.sqrt(F.greatest(F.lit(1.0), F.col(rows) / F.col(columns))))


def layer_matrices(df: DataFrame, depth: str = "depth", width: str = "width") -> DataFrame:
    """(depth, layer, name, rows, columns) of the six matrices of each layer of models with a depth and a width."""
    w = F.col(width)
    kinds = [("query", 1, 1), ("key", 1, 1), ("value", 1, 1), ("projection", 1, 1), ("wide", 4, 1), ("narrow", 1, 4)]
    cells = F.array(*(F.struct(F.lit(n).alias("name"), (w * r).alias("rows"), (w * c).alias("columns")) for n, r, c in kinds))
    layers = F.explode(F.sequence(F.lit(0), F.col(depth).cast("int") - 1))
    return df.select(depth, width, layers.alias("layer")).select(depth, "layer", F.explode(cells).alias("m")).select(depth, "layer", "m.*")


def geometric_middle(df: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation and the geometric mean of the ends."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.sqrt(F.min(value) * F.max(value)).alias("middle"))

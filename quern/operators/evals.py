"""Evaluation: accuracies, pass@k, advantages, sampling, spans, generation streams."""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def centered(accuracy: Column, baseline: Column) -> Column:
    """Accuracy above chance: 0 at the baseline, 1 at perfection."""
    return (accuracy - baseline) / (1 - baseline)


def mean_centered(results: DataFrame, by: list[str], task: str, accuracy: Column, baseline: Column, tasks: list[str]) -> DataFrame:
    """(by, mean): the mean centred accuracy over the named tasks, only where there is a result of each of them."""
    own = results.where(F.col(task).isin(tasks)).groupBy(*by).agg(F.countDistinct(task).alias("n"), F.avg(centered(accuracy, baseline)).alias("mean"))
    return own.where(F.col("n") == len(set(tasks))).select(*by, "mean")


def pass_at_k(samples: DataFrame, problem: str, order: str, correct: str, most: int) -> DataFrame:
    """(k, share): problems of which one of the first ``k`` samples is right. One pass: each problem's first right sample."""
    first = samples.groupBy(problem).agg(F.min(F.when(F.col(correct) == 1, F.col(order))).alias("first"))
    counted = first.where(F.col("first") < most).groupBy("first").agg(F.count("*").alias("n"))  # at most ``most`` rows
    ks = samples.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("k"))
    total = first.agg(F.count("*").alias("problems"))
    hits = ks.join(F.broadcast(counted), F.col("first") < F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("solved"))
    return hits.crossJoin(F.broadcast(total)).select("k", "solved", (F.col("solved") / F.col("problems")).alias("share"))


def advantages(samples: DataFrame, problem: str, reward: str) -> DataFrame:
    """Adds each reward's distance from its problem's mean; the mean is aggregated before it is joined back."""
    means = samples.groupBy(problem).agg(F.avg(reward).alias("_mean"))
    return samples.join(means, problem).withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_mean")


def option_choice(losses: DataFrame, item: str, option: str, nll: str) -> DataFrame:
    """The option with the least mean loss, the first on ties; losses that differ by less than 1e-9 tie, as sums depend on their order."""
    means = losses.groupBy(item, option).agg(F.round(F.avg(nll), 9).alias("loss"))
    return means.groupBy(item).agg(F.min(F.struct("loss", option)).alias("best")).select(item, f"best.{option}", "best.loss")


def top_k_probabilities(logits: DataFrame, row: str, token: str, logit: str, k: int | None, temperature: float, keep_ties: bool = False) -> DataFrame:
    """Softmax over the ``k`` largest logits; exactly ``k``, the least tokens on ties, or all at the threshold with ``keep_ties``.

    Temperature 0 puts all on the first largest; ``k`` of None or 0 keeps the whole vocabulary.
    """
    best = Window.partitionBy(row).orderBy(F.desc(logit), *([] if keep_ties else [token]))
    ranked = logits.withColumn("_r", (F.rank() if keep_ties else F.row_number()).over(best))
    if temperature == 0:
        return ranked.where("_r = 1").select(row, token, F.lit(1.0).alias("p"))
    kept = ranked.where(F.col("_r") <= k) if k else ranked
    whole = Window.partitionBy(row)
    scaled = kept.withColumn("_e", F.exp((F.col(logit) - F.max(logit).over(whole)) / temperature))
    return scaled.select(row, token, (F.col("_e") / F.sum("_e").over(whole)).alias("p"))


def before_terminal(stream: DataFrame, key: list[str], pos: str, token: str, terminals: list[int]) -> DataFrame:
    """The tokens of each row before its first terminal one."""
    own = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("_seen", F.max(F.col(token).isin(terminals).cast("int")).over(own)).where("_seen = 0").drop("_seen")


def tool_spans(stream: DataFrame, key: list[str], pos: str, token: str, start: int, end: int) -> DataFrame:
    """(key, span, tokens): what stands between each start and the next end; an open span is dropped, a start inside starts anew."""
    own = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    marked = stream.withColumn("_s", F.sum((F.col(token) == start).cast("int")).over(own))
    inner = Window.partitionBy(*key, "_s").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_e", F.sum((F.col(token) == end).cast("int")).over(inner)).where("_s > 0")
    spans = marked.groupBy(*key, "_s").agg(F.max("_e").alias("closed"), F.sort_array(F.collect_list(F.when((F.col("_e") == 0) & (F.col(token) != start), F.struct(pos, token)))).alias("x"))
    return spans.where("closed > 0").select(*key, F.col("_s").cast("int").alias("span"), F.transform("x", lambda v: v[token]).alias("tokens"))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
#: Names that no expression may hold.
_FORBIDDEN = "__ import exec eval compile open file input raw_input globals locals vars dir getattr setattr delattr hasattr".split()
_ARITHMETIC = frozenset("0123456789*+-/.() ")
_STRINGS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'\"()._ ")


def calculate(expression: str | None) -> str | None:
    """The value of plain arithmetic or of a string's ``count``, as text; None for anything else or an error. Nothing is evaluated as code."""
    if expression is None:
        return None
    text = expression.replace(",", "")
    arithmetic = set(text) <= _ARITHMETIC
    if arithmetic and "**" in text:
        return None
    if not arithmetic and (not set(text) <= _STRINGS or ".count(" not in text or any(w in text.lower() for w in _FORBIDDEN)):
        return None

    def value(node):
        match node:
            case ast.Expression(body=body):
                return value(body)
            case ast.Constant(value=v) if isinstance(v, int | float | str) and not isinstance(v, bool):
                return v
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                a, b = value(a), value(b)
                if isinstance(a, str) != isinstance(b, str) or isinstance(a, str) and not isinstance(op, ast.Add):
                    raise ValueError
                return _BINARY[type(op)](a, b)
            case ast.UnaryOp(op=op, operand=a) if type(op) in _UNARY:
                return _UNARY[type(op)](value(a))
            case ast.Call(func=ast.Attribute(value=s, attr="count"), args=args, keywords=[]) if 1 <= len(args) <= 3:
                return value(s).count(*map(value, args))
        raise ValueError

    try:
        return str(value(ast.parse(text.strip(), mode="eval")))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, AttributeError, RecursionError, MemoryError):
        return None


def calculator(df: DataFrame, expression: str, out: str = "value") -> DataFrame:
    """Adds the value of each expression, in Arrow batches."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([calculate(x) for x in batch.column(names.index(expression)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"
    return df.mapInArrow(run, schema)


_SANDBOX = "import resource, sys\nresource.setrlimit(resource.RLIMIT_AS, ({m}, {m}))\nresource.setrlimit(resource.RLIMIT_CPU, ({t}, {t}))\nresource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))\nexec(compile(sys.stdin.read(), 'program', 'exec'), {{'__name__': '__main__'}})"


def run_program(code: str, seconds: float = 5.0, memory: int = 256 << 20) -> tuple[bool, str, str, bool, bool]:
    """(success, stdout, error, timed out, out of memory) of a program in a child process with limits. No security boundary."""
    import subprocess
    import sys
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        try:
            got = subprocess.run([sys.executable, "-I", "-c", _SANDBOX.format(m=memory, t=int(seconds) + 1)], input=code, capture_output=True, text=True, timeout=seconds, cwd=folder, env={}, check=False)
        except subprocess.TimeoutExpired:
            return False, "", "timeout", True, False
    last = got.stderr.strip().rpartition("\n")[2]
    return got.returncode == 0, got.stdout, last, False, "MemoryError" in last


def execute(df: DataFrame, key: str, code: str, seconds: float = 5.0) -> DataFrame:
    """(``key``, success, stdout, error, timed_out, out_of_memory) of each program."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [run_program(c or "", seconds) for c in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "success", "stdout", "error", "timed_out", "out_of_memory"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, code).mapInArrow(run, f"{key} {kind}, success boolean, stdout string, error string, timed_out boolean, out_of_memory boolean")


def safe_prefix(text: str, sent: int) -> tuple[str, int]:
    """What may be sent of a growing decoded text: nothing while it ends in U+FFFD."""
    return ("", sent) if text.endswith("�") else (text[sent:], len(text))

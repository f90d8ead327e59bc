"""Readers: shards, conversations, evaluation items, settings, word lists, checkpoints, tokenizers."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators.chat import alternates, without_system
from quern.operators.order import seeded_order
from quern.sources import fs, schemas


def base_dir(name: str = "quern", variable: str = "QUERN_BASE_DIR") -> str:
    """The folder of the variable, else one in the user's cache."""
    return os.environ.get(variable) or os.path.join(os.path.expanduser("~"), ".cache", name)


def shards(spark: SparkSession, folder: str, legacy: str | None = None) -> DataFrame:
    """The corpus under ``folder``, or ``legacy`` where that is missing, with each row's file; files that are still written don't count."""
    if legacy and not fs.exists(spark, folder) and fs.exists(spark, legacy):
        folder = legacy
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def shard_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a corpus' files in natural order, without those still written."""
    return [name for name, is_folder, _ in fs.listed(spark, folder) if name.endswith(".parquet") and not is_folder]


def split_shards(rows: DataFrame, part: str) -> DataFrame:
    """``val`` is the last file by name, ``train`` the rest."""
    if part not in ("train", "val"):
        raise ValueError("a split is train or val")
    last = rows.agg(F.max("file").alias("last"))
    return rows.join(F.broadcast(last), F.col("file") == F.col("last") if part == "val" else F.col("file") < F.col("last")).drop("last")


def conversations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(messages) of a JSON-lines file with one array a line, blank lines skipped. Invalid ones raise, or are left out."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")
    rows = lines.select("line", F.from_json("line", schemas.MESSAGES).alias("messages"))
    good = alternates(F.col("messages"))
    if not strict:
        return rows.where(good).select("messages")
    return rows.select(F.when(good, F.col("messages")).otherwise(F.raise_error(F.concat(F.lit("not a conversation: "), F.substring("line", 1, 200))).cast(schemas.MESSAGES)).alias("messages"))


def chat_table(rows: DataFrame) -> DataFrame:
    """Conversations that take turns after an optional system message."""
    return rows.where(alternates(without_system(F.col("messages"))))


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ITEM).json(path)


def task(spark: SparkSession, path: str, kind: str, part: str, seed: int = 42) -> DataFrame:
    """A task's table in its seeded order, with a dense index; the split must be one the task has."""
    schema, parts = schemas.TASKS[kind]
    if part not in parts:
        raise ValueError(f"{kind} has the splits {parts}")
    from quern.operators.order import running

    rows = spark.read.schema(schema).json(f"{path}/{part}")
    key = F.to_json(F.struct(*rows.columns))
    return running(rows, [seeded_order(seed, key), key], index="idx").drop("upto")


def task_settings(spark: SparkSession, path: str) -> DataFrame:
    """(label, task_type, dataset_uri, num_fewshot, continuation_delimiter) of a YAML file's ``icl_tasks``."""
    import yaml

    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]), t.get("continuation_delimiter", " ")) for t in yaml.safe_load(fs.read_text(spark, path))["icl_tasks"]]
    return spark.createDataFrame(rows, "label string, task_type string, dataset_uri string, num_fewshot int, continuation_delimiter string")


def baselines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("Eval Task").alias("label"), F.col("Random baseline").cast("double").alias("baseline"))


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("word"))


def sweep(spark: SparkSession, path: str) -> DataFrame:
    """A sweep's results that have a loss."""
    return spark.read.schema(schemas.SWEEP).option("header", True).csv(path).where("val_bpb is not null and val_bpb > 0")


def code_size(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("py", "md", "toml", "sh"), lock: str = "*.lock") -> DataFrame:
    """(files, lines, chars, tokens, lock_lines) of a source tree; lines of the files of locked dependencies count apart."""
    read = lambda pattern: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    lines = F.coalesce(F.sum(F.size(F.split("value", "\n"))), F.lit(0))
    own = read("*.{" + ",".join(extensions) + "}").agg(F.count("*").alias("files"), lines.alias("lines"), F.sum(F.length("value")).alias("chars")).withColumn("tokens", F.expr("chars div 4"))
    return own.crossJoin(F.broadcast(read(lock).agg(lines.alias("lock_lines"))))  # one row each


def last_step(spark: SparkSession, folder: str) -> int:
    """The greatest step of the model files of a folder."""
    steps = [int(m[1]) for name, *_ in fs.listed(spark, folder) if (m := re.fullmatch(r"model_(\d+)\.pt", name))]
    if not steps:
        raise FileNotFoundError(f"no checkpoint in {folder}")
    return max(steps)


def largest_model(spark: SparkSession, folder: str) -> str:
    """The folder ``d<depth>`` of greatest depth, else the one changed last."""
    found = [(name, changed) for name, is_folder, changed in fs.listed(spark, folder) if is_folder]
    if not found:
        raise FileNotFoundError(f"no model in {folder}")
    deep = [(int(m[1]), name) for name, _ in found if (m := re.fullmatch(r"d(\d+)", name))]
    return max(deep)[1] if deep else max(found, key=lambda x: x[1])[0]


#: Folder of each kind of model.
MODEL_FOLDERS = {"base": "base_checkpoints", "sft": "chatsft_checkpoints", "rl": "chatrl_checkpoints"}


def model_folder(spark: SparkSession, base: str, kind: str, tag: str | None = None, step: int | None = None) -> tuple[str, int]:
    """Folder and step of a model; the largest and last where none is named."""
    root = f"{base}/{MODEL_FOLDERS[kind]}"
    folder = f"{root}/{tag or largest_model(spark, root)}"
    return folder, last_step(spark, folder) if step is None else step


def completed_config(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Settings of older checkpoints with what they lack."""
    return rows.select(*[c for c in rows.columns if c not in defaults], *((F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v)).alias(k) for k, v in defaults.items()))


def tokenizer(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """Merges in rank order, as ``sinks.save_tokenizer`` wrote them; at most one vocabulary."""
    return [(r.left, r.right) for r in spark.read.parquet(f"{folder}/merges").orderBy("rank").collect()]


def decoded_source(rows: DataFrame, ids: str, merges: list[tuple[int, int]]) -> DataFrame:
    """A corpus that comes as token ids, as text."""
    from quern.operators.bpe import decode

    return rows.select(decode(F.col(ids), merges).alias("text"))

"""Writers: shards, result tables, conversations, report sections, tokenizers, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import slug
from quern.operators import bpe, order, reports
from quern.session import cut_lineage
from quern.sources import fs


def write_shards(df: DataFrame, folder: str, order_by: list[Column], chars: int = 250_000_000, rows: int = 1024, text: str = "text") -> DataFrame:
    """Shards of at least ``chars`` characters and whole groups of ``rows``: ``shard_00000.parquet`` and so on, of row groups of ``rows``.

    They are compressed by zstandard at level 3, without dictionaries; the rows of an unfinished last shard aren't written. Each task writes
    whole shards, which only get their names when all are there. Gives (shard, docs).
    """
    spark = df.sparkSession
    placed = cut_lineage(order.shard_boundaries(df, order_by, F.coalesce(F.length(text), F.lit(0)), chars, rows))
    count = placed.agg(F.max("shard")).first()[0]
    work = f"{folder}/_work"
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.enable.dictionary": "false", "parquet.block.row.count.limit": str(rows), "parquet.page.row.count.limit": str(rows)}
    placed.repartition(max(1, (count or 0) + 1), "shard").sortWithinPartitions("shard", "pos").select("shard", text).write.mode("overwrite").partitionBy("shard").options(**options).parquet(work)
    for shard in range((count if count is not None else -1) + 1):  # a rename each, no data
        own = f"{work}/shard={shard}"
        parts = [name for name, *_ in fs.listed(spark, own) if name.endswith(".parquet")]
        if len(parts) != 1:
            raise OSError(f"shard {shard} has {len(parts)} files")
        fs.move(spark, f"{own}/{parts[0]}", f"{folder}/shard_{shard:05d}.parquet")
    fs.remove(spark, work)
    return placed.groupBy("shard").agg(F.count("*").alias("docs"))


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key isn't there yet to a CSV folder with headers; how many there were."""
    spark = rows.sparkSession
    if any(name.endswith(".csv") for name, *_ in fs.listed(spark, path)):
        done = spark.read.schema(rows.schema).option("header", True).csv(path).select(*key)
        rows = rows.join(done, key, "left_anti")
    rows = cut_lineage(rows.dropDuplicates(key))
    n = rows.count()
    if n:
        rows.write.mode("append").option("header", True).csv(path)
    return n


def write_results(lines: DataFrame, path: str) -> None:
    """The lines (n, line) of a result table as one CSV file behind its header."""
    spark = lines.sparkSession
    header = F.concat(F.rpad(F.lit("Task"), 35, " "), F.lit(", "), F.rpad(F.lit("Accuracy"), 10, " "), F.lit(", "), F.rpad(F.lit("Centered"), 10, " "))
    whole = lines.select("n", "line").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("n"), header.alias("line")))
    work = f"{path}.work"
    whole.repartition(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(work)  # a row for each task
    fs.move(spark, next(f"{work}/{name}" for name, *_ in fs.listed(spark, work) if name.startswith("part")), path)
    fs.remove(spark, work)


def append_conversations(rows: DataFrame, path: str, with_metadata: bool = False) -> None:
    """One JSON line a conversation: its messages, or all its columns."""
    line = F.to_json(F.struct(*rows.columns)) if with_metadata else F.to_json("messages")
    rows.select(line.alias("value")).write.mode("append").text(path)


def write_section(spark: SparkSession, folder: str, title: str, parts: list, stamp: str) -> str:
    """A report's section as Markdown: texts as they are, mappings as bullets, empty parts left out."""

    def shown(value: object) -> str:
        if isinstance(value, float):
            return f"{value:.4f}"
        return f"{value:,}" if isinstance(value, int) and value >= 10_000 else str(value)

    lines = [f"## {title}\n", f"timestamp: {stamp}\n\n"]
    for part in filter(None, parts):
        lines += [part] if isinstance(part, str) else [f"- {k}: {shown(v)}\n" for k, v in part.items()]
    path = f"{folder}/{title.lower().replace(' ', '-')}.md"
    fs.write_text(spark, path, "".join(lines) + "\n")
    return path


def write_report(spark: SparkSession, folder: str, expected: list[str], stages: dict[str, tuple[str, list[str]]]) -> str:
    """``report.md`` of the header and the expected sections that are there, with a table of metrics and the wall clock.

    ``stages``: stage to the section's file and the metrics that are read from it. What isn't there is left out or shown as a dash.
    """
    there = {name for name, *_ in fs.listed(spark, folder)}
    sections = {name: fs.read_text(spark, f"{folder}/{name}") for name in ["header.md", *expected] if name in there}
    path = f"{folder}/report.md"
    fs.write_text(spark, path, reports.assembled(sections, expected, stages))
    return path


def reset_report(spark: SparkSession, folder: str, expected: list[str], header: str) -> None:
    """Removes a report and its sections, and writes the header of a new one."""
    for name in [*expected, "report.md"]:
        fs.remove(spark, f"{folder}/{name}")
    fs.write_text(spark, f"{folder}/header.md", header)


def section_names(rows: DataFrame, title: str) -> DataFrame:
    return rows.withColumn("file", F.concat(slug(F.col(title)), F.lit(".md")))


def save_tokenizer(spark, merges: list[tuple[int, int]], folder: str) -> None:
    """The merges, and the table of token bytes."""
    spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left int, right int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/merges")
    bpe.vocabulary_table(spark, merges).coalesce(1).write.mode("overwrite").parquet(f"{folder}/token_bytes")


def log_metrics(rows: DataFrame, path: str, every: int = 1) -> None:
    """Appends the metrics of each ``every``-th step."""
    rows.where(F.col("step") % every == 0).write.mode("append").partitionBy("run").parquet(path)


def events(token: Column, worker: Column) -> Column:
    """A line of a server-sent stream."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(token.alias("token"), worker.alias("gpu"))), F.lit("\n\n"))

"""Corpus scans, splits, strides, shards and budgets. A shard is 500 consecutive ids, a row group 16 rows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import order
from quern.session import table

_GROUPS = "SELECT doc_id, coalesce(length(text), 0) AS chars, doc_id // 500 AS shard, (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1) // 16 AS rg, (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1) % 16 AS row_in_rg FROM documents"


def row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Shard, row group and row of each document; windows stay within a shard."""
    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id")) - 1
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.expr("doc_id div 500").alias("shard"))
    return docs.withColumn("place", place).select("doc_id", "chars", "shard", F.expr("place div 16").alias("rg"), (F.col("place") % 16).alias("row_in_rg"))


def _last(df: DataFrame) -> DataFrame:
    return df.agg(F.max("shard").alias("last"))


def split(df: DataFrame, part: str) -> DataFrame:
    """``val``: the last shard; ``train``: all others, empty if there is only one."""
    if part not in ("train", "val"):
        raise ValueError("a split is train or val")
    marked = df.crossJoin(F.broadcast(_last(df)))  # one row
    return marked.where(F.col("shard") == F.col("last") if part == "val" else F.col("shard") < F.col("last")).drop("last")


def corpus_split(spark, d):
    rows = row_groups(spark, d)
    return rows.crossJoin(F.broadcast(_last(rows))).select("doc_id", F.when(F.col("shard") < F.col("last"), "train").otherwise("val").alias("split"))


def corpus_rowgroups(spark, d):
    return row_groups(spark, d).groupBy("shard", "rg").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))


def corpus_stride(spark, d):
    return split(row_groups(spark, d), "train").where("rg % 3 = 1").select("doc_id", "shard", "rg")


def corpus_batches(spark, d):
    rows = row_groups(spark, d).withColumn("batch", F.expr("row_in_rg div 5"))
    return rows.groupBy("shard", "rg", "batch").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def epochs(df: DataFrame, n: int, rank: int = 0, world: int = 1) -> DataFrame:
    """``n`` passes over the row groups of one rank, epochs from 1, ordered by (epoch, shard, rg, row_in_rg)."""
    return df.where(F.col("rg") % world == rank).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def resume(df: DataFrame, shard: int, rg: int, rank: int, world: int) -> DataFrame:
    """What one rank still reads after it stopped at (shard, rg): in that shard from its next row group on, then all later shards."""
    first = (rg // world + 1) * world + rank
    mine = df.where(F.col("rg") % world == rank)
    return mine.where((F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("rg") >= first)))


def corpus_epochs(spark, d):
    return epochs(split(row_groups(spark, d), "train"), 2, 1, 2).groupBy("epoch", "shard", "rg").agg(F.count("*").alias("docs"))


def cursors(df: DataFrame, size: int) -> DataFrame:
    """(number, epoch, shard, rg, batch, docs): the batches of ``epochs`` in order, with where a loader stands after each; to go on there, see ``resume``."""
    batches = df.groupBy("epoch", "shard", "rg", F.expr(f"row_in_rg div {size}").alias("batch")).agg(F.count("*").alias("docs"))
    return order.running(batches, [F.col(c) for c in ("epoch", "shard", "rg", "batch")], index="number").drop("upto")


def corpus_cursor(spark, d):
    return cursors(epochs(split(row_groups(spark, d), "train"), 2, 1, 2), 5)


def corpus_first_batch(spark, d):
    """What the first batch of a loader holds: the first rows of the first row group."""
    first = cursors(epochs(row_groups(spark, d), 1), 5).where("number = 0").select("shard", "rg", "batch")
    rows = row_groups(spark, d).withColumn("batch", F.expr("row_in_rg div 5"))
    return rows.join(F.broadcast(first), ["shard", "rg", "batch"]).select("doc_id", "chars")  # one row


def corpus_resume(spark, d):
    return resume(split(row_groups(spark, d), "train"), 1, 2, 1, 2).select("doc_id", "shard", "rg", "row_in_rg")


def shard_plan(spark, d):
    """Shards to fetch: the first ten and, always, the last one."""
    wanted = spark.range(10).select(F.col("id").alias("shard"))
    return wanted.union(_last(row_groups(spark, d)).select("last")).distinct().withColumn("file", F.format_string("shard_%05d.parquet", "shard"))


def _by_seed(seed=42):
    return [order.seeded_order(seed, F.col("doc_id")), F.col("doc_id")]


def repackage_shards(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return order.shard_boundaries(docs, _by_seed(), F.col("chars"), 50_000, 16).groupBy("shard").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))


def char_budget(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return order.char_budget(docs.select("doc_id", "text"), "text", [F.col("doc_id")], 1000, 200_000).select("doc_id", "chars")


def hash_shuffle(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return order.running(docs, _by_seed()).select("doc_id", F.col("pos").alias("position"))


def slice_view(spark, d):
    docs = order.running(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])
    return order.slice_view(docs, "pos", 5, 400, 7).select("doc_id", "slice_index")


def capped_head(spark, d):
    """The feature is a cap: the first 50 in shuffled order."""
    return table(spark, d, "documents").select("doc_id").orderBy(*_by_seed(1337)).limit(50)


def strided_ranks(spark, d):
    docs = order.running(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])
    return docs.groupBy((F.col("pos") % 8).alias("rank")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def trimmed_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where("length(line) > 0")
    return lines.groupBy(F.length("line").alias("chars")).agg(F.count("*").alias("lines"))


def source_size(spark, d):
    """Files, lines and characters per source, tokens as a quarter of the characters."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.length("text")).alias("chars")).withColumn("tokens", F.expr("chars div 4"))


def word_list(spark, d):
    docs = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,12}"), F.lit(0))).alias("word"))
    return docs.groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {
    "corpus_split": (corpus_split, f"WITH g AS ({_GROUPS}) SELECT doc_id, CASE WHEN shard < (SELECT max(shard) FROM g) THEN 'train' ELSE 'val' END AS split FROM g"),
    "corpus_rowgroups": (corpus_rowgroups, f"WITH g AS ({_GROUPS}) SELECT shard, rg, count(*) AS docs, sum(chars)::BIGINT AS chars FROM g GROUP BY ALL"),
    "corpus_stride": (corpus_stride, f"WITH g AS ({_GROUPS}) SELECT doc_id, shard, rg FROM g WHERE rg % 3 = 1 AND shard < (SELECT max(shard) FROM g)"),
    "corpus_batches": (corpus_batches, f"WITH g AS ({_GROUPS}) SELECT shard, rg, row_in_rg // 5 AS batch, count(*) AS docs, min(doc_id) AS first_doc FROM g GROUP BY ALL"),
    "corpus_epochs": (corpus_epochs, f"WITH g AS ({_GROUPS}) SELECT epoch::INT AS epoch, shard, rg, count(*) AS docs FROM g, range(1, 3) e(epoch) WHERE rg % 2 = 1 AND shard < (SELECT max(shard) FROM g) GROUP BY ALL"),
    "corpus_cursor": (corpus_cursor, f"WITH g AS ({_GROUPS}), b AS (SELECT epoch::INT AS epoch, shard, rg, row_in_rg // 5 AS batch, count(*) AS docs FROM g, range(1, 3) e(epoch) WHERE rg % 2 = 1 AND shard < (SELECT max(shard) FROM g) GROUP BY ALL) SELECT row_number() OVER (ORDER BY epoch, shard, rg, batch) - 1 AS number, * FROM b"),
    "corpus_first_batch": (corpus_first_batch, f"WITH g AS ({_GROUPS}) SELECT doc_id, chars FROM g WHERE shard = (SELECT min(shard) FROM g) AND rg = 0 AND row_in_rg < 5"),
    "corpus_resume": (corpus_resume, f"WITH g AS ({_GROUPS}) SELECT doc_id, shard, rg, row_in_rg FROM g WHERE rg % 2 = 1 AND shard < (SELECT max(shard) FROM g) AND (shard > 1 OR (shard = 1 AND rg >= (2 // 2 + 1) * 2 + 1))"),
    "shard_plan": (shard_plan, f"WITH g AS ({_GROUPS}), p AS (SELECT range AS shard FROM range(10) UNION SELECT max(shard) FROM g) SELECT shard, printf('shard_%05d.parquet', shard) AS file FROM p"),
    "repackage_shards": (repackage_shards, """WITH RECURSIVE o AS (SELECT coalesce(length(text), 0) AS chars, (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // 16 AS block FROM documents),
        b AS (SELECT block, sum(chars)::BIGINT AS s, count(*) AS n FROM o GROUP BY block),
        f AS (SELECT block, 0::BIGINT AS shard, s AS held, n FROM b WHERE block = 0 UNION ALL
              SELECT b.block, f.shard + CASE WHEN f.n = 16 AND f.held >= 50000 THEN 1 ELSE 0 END, CASE WHEN f.n = 16 AND f.held >= 50000 THEN b.s ELSE f.held + b.s END, b.n FROM f JOIN b ON b.block = f.block + 1)
        SELECT f.shard, sum(b.n)::BIGINT AS docs, sum(b.s)::BIGINT AS chars FROM f JOIN b USING (block) GROUP BY f.shard HAVING bool_or(f.n = 16 AND f.held >= 50000)"""),
    "char_budget": (char_budget, "SELECT doc_id, chars FROM (SELECT doc_id, chars, sum(chars) OVER (ORDER BY doc_id) - chars AS before FROM (SELECT doc_id, least(length(text), 1000)::INT AS chars FROM documents WHERE text IS NOT NULL)) WHERE before <= 200000"),
    "hash_shuffle": (hash_shuffle, "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents"),
    "slice_view": (slice_view, "SELECT doc_id, (pos - 5) // 7 AS slice_index FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos >= 5 AND pos < 400 AND (pos - 5) % 7 = 0"),
    "capped_head": (capped_head, "SELECT doc_id FROM documents ORDER BY md5('1337:' || doc_id), doc_id LIMIT 50"),
    "strided_ranks": (strided_ranks, "SELECT pos % 8 AS rank, count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1"),
    "trimmed_lines": (trimmed_lines, r"SELECT length(line)::INT AS chars, count(*) AS lines FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE length(line) > 0 GROUP BY 1"),
    "source_size": (source_size, "SELECT source, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS chars, (sum(length(text)) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source"),
    "word_list": (word_list, "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{4,12}')) AS word FROM documents) GROUP BY word"),
}

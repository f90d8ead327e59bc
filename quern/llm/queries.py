"""Queries of the training-data operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.pairs import find_defects

    return find_defects(table(spark, d, "chat_requests"), table(spark, d, "chat_messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.neardup import pairs

    return pairs(table(spark, d, "documents"), threshold=0.6, shingle=3, least_words=30).toDF("doc_id_a", "doc_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Classes, groups and links at five words and 0.8; copies are not expanded."""
    from quern.llm.neardup import groups

    return groups(table(spark, d, "documents"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.encode import encode_documents

    return encode_documents(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str, total: str) -> tuple[DataFrame, DataFrame]:
    from quern.llm.mix import mix

    return mix(table(spark, d, "chat_messages"), table(spark, d, "mixture_targets"), total)


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each conversation is used, in a mix as large as the targeted material."""
    return _mix(spark, d, "material")[0]


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "material")[1]


def p1_mix_held(spark: SparkSession, d: str) -> DataFrame:
    """The same in the largest mix in which every target with material holds its share."""
    return _mix(spark, d, "held")[0]


def p1_shares_held(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "held")[1]


def _mix_check(spark: SparkSession, d: str, total: str) -> DataFrame:
    uses, shares = _mix(spark, d, total)
    most = F.coalesce("max_repeats", F.lit(0))
    own = uses.join(F.broadcast(shares.select("task", "max_repeats")), "task", "left")  # one row per target
    return own.groupBy("task").agg(F.count("*").alias("conversations"), F.sum("chars").cast("long").alias("chars"), F.sum(((F.col("uses") > most) | (F.col("uses") < 0)).cast("int")).cast("int").alias("overused"))


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """The conversations of each task in the mix, and how many are used too often: none."""
    return _mix_check(spark, d, "material")


def p1_check_held(spark: SparkSession, d: str) -> DataFrame:
    return _mix_check(spark, d, "held")


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """The texts and their sizes in the containers; texts whose pieces don't join, and containers beyond their capacity: none."""
    from quern.session import cut_lineage

    specs = table(spark, d, "container_specs")
    placed = cut_lineage(p2_containers(spark, d))
    texts = placed.groupBy("spec_id", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("places"), F.max("piece").alias("last"), F.max(F.col("start") + F.col("size")).alias("end"))
    torn = (F.col("places") != F.col("pieces")) | (F.col("last") + 1 != F.col("pieces")) | (F.col("end") != F.col("size"))
    per_text = texts.groupBy("spec_id").agg(F.count("*").alias("texts"), F.sum("size").alias("size"), F.sum((F.col("pieces") > 1).cast("long")).alias("split"), F.sum(torn.cast("int")).cast("int").alias("torn"))
    filled = placed.groupBy("spec_id", "container_id").agg(F.sum("size").alias("held")).join(F.broadcast(specs.select("spec_id", "capacity").distinct()), "spec_id")
    over = filled.groupBy("spec_id").agg(F.sum((F.col("held") > F.col("capacity")).cast("int")).cast("int").alias("overfull"))
    return per_text.join(over, "spec_id")


def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.pack import fill_containers

    return fill_containers(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p2_unused(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.pack import unused_space

    return unused_space(p2_containers(spark, d), table(spark, d, "container_specs"))


def _leaks(spark: SparkSession, d: str, covered: float | None = None) -> DataFrame:
    from quern.llm.leaks import find_leaks

    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), covered=covered)


def p6_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least six tenths of a passage's words in pieces of three words or more, in whatever order."""
    return _leaks(spark, d, 0.6).select("doc_id", "item_id", "longest", F.round("coverage", 6).alias("coverage"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.leaks import leaked_items

    return leaked_items(_leaks(spark, d), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.cuts import find_cut

    return find_cut(table(spark, d, "documents"))


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.cuts import cut_by_source

    return cut_by_source(table(spark, d, "documents"), p7_found(spark, d))


def queries() -> dict:
    return {"p1_mix": p1_mix, "p1_shares": p1_shares, "p1_mix_held": p1_mix_held, "p1_shares_held": p1_shares_held, "p1_check": p1_check, "p1_check_held": p1_check_held, "p2_containers": p2_containers, "p2_check": p2_check, "p2_unused": p2_unused, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p5_ids": p5_ids, "p6_found": p6_found, "p6_items": p6_items, "p6_covered": p6_covered, "p7_found": p7_found, "p7_sources": p7_sources}


def oracle_sql() -> dict[str, str]:
    from quern.llm.oracle import oracle_sql

    return oracle_sql()

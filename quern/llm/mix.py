"""Mixing conversations of several sources to target shares.

Method: hierarchical budgeting. The targets are the leaves of a tree domain -
language - source; the domain of a task is a column of the targets or an argument, and one for all
where neither is given. A node's weight is the sum of its leaves' weights and its
capacity the sum of what they can give (material times allowed repeats). The
total size flows down by weight; a child that cannot use its part keeps its
capacity and its siblings share the rest by weight, so that a shortage reaches
another branch only when all siblings are full. A leaf's budget is spent as whole
epochs over its material plus a prefix of one more epoch in a seeded order.

The prefix is found by radix descent on the seeded hash: sums per leaf and hash
bucket, then an exact running sum inside the one bucket where the budget ends,
so no leaf is ever sorted as a whole, however large it is.

Results: every conversation comes out once with its number of uses, which is
0 for conversations without a target and for those without characters. Repeated
rows of a message count once; null content has no characters; a conversation's
task is the greatest spelling-normalised one among its rows, null tasks apart.
Targets: a null task is ignored, a null share counts as 0, null repeats as 1, a null domain as one of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import language
from quern.session import cut_lineage

#: Bits of the seeded hash that bucket a leaf's conversations.
RADIX_BITS = 14
#: Targets are a parameter table; more rows than this are taken for a mistake.
MOST_TARGETS = 10_000
#: The domain of tasks that none is given for.
OTHER_DOMAIN = "other"


@dataclass
class Node:
    """A node of the tree; leaves hold a weight, the material and the allowed repeats."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def add(self, path: tuple[str, ...], weight: float, capacity: float) -> Node:
        self.weight += weight
        self.capacity += capacity
        return self.children.setdefault(path[0], Node()).add(path[1:], weight, capacity) if path else self

    def spend(self, budget: float) -> None:
        """Gives the node ``budget``, or its capacity, and passes it on."""
        self.budget = min(budget, self.capacity)
        open_, left = list(self.children.values()), self.budget
        while open_:
            weights = sum(c.weight for c in open_)
            part = {id(c): left * c.weight / weights if weights > 0 else left / len(open_) for c in open_}
            full = [c for c in open_ if c.capacity <= part[id(c)]]
            if not full:
                for c in open_:
                    c.spend(part[id(c)])
                return
            for c in full:
                c.spend(c.capacity)
                left -= c.capacity
            open_ = [c for c in open_ if c not in full]


def normal_task(task: Column) -> Column:
    """Lower case, with one underscore for any run of blanks, dashes and underscores."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(task)), r"[\s_-]+", "_"), F.lit(""))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, task, language, chars), one row per conversation, language by its function words."""
    rows = messages.select("conv_id", "turn", normal_task(F.col("task")).alias("task"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"), *(n.alias(k) for k, n in language.word_hits(F.col("content")).items()))
    once = rows.groupBy("conv_id", "turn").agg(F.max("task").alias("task"), F.max(F.struct("chars", *language.LANGUAGES)).alias("x"))
    own = once.groupBy("conv_id").agg(F.max("task").alias("task"), F.sum("x.chars").alias("chars"), *(F.sum(f"x.{k}").alias(k) for k in language.LANGUAGES))
    return own.select("conv_id", "task", language.leading({k: F.col(k) for k in language.LANGUAGES}).alias("language"), "chars")


def read_domains(targets: DataFrame, column: str = "domain") -> dict[str, str]:
    """Task to domain, of targets that have such a column; the greatest of a task's domains."""
    if column not in targets.columns:
        return {}
    rows = targets.select(normal_task(F.col("task")).alias("task"), F.col(column).cast("string").alias("domain")).where("task is not null and domain is not null").groupBy("task").agg(F.max("domain").alias("domain")).limit(MOST_TARGETS + 1).collect()
    return {r.task: r.domain for r in rows}


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(normal_task(F.col("task")).alias("task"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).where("task is not null").dropDuplicates().limit(MOST_TARGETS + 1).collect()
    out = {r[0]: (r[1], r[2]) for r in rows}
    if len(rows) > MOST_TARGETS or len(out) < len(rows):
        raise ValueError("too many targets, or two for one task")
    return out


def budgets(material: list[tuple[str, str, float]], targets: dict[str, tuple[float, int]], total: float | str, domains: dict[str, str]) -> tuple[Node, float]:
    """The tree with the budgets of ``total`` characters; material: (task, language, characters).

    ``"material"``: as many characters as there are under the targets, each taken
    once. ``"held"``: as many as leave every target that has material its share.
    """
    held: dict[str, float] = {}
    for task, _, chars in material:
        held[task] = held.get(task, 0.0) + chars
    root = Node()
    for task, lang, chars in material:
        share, repeats = targets[task]
        root.add((domains.get(task, OTHER_DOMAIN), lang, task), share * chars / held[task] if held[task] else 0.0, chars * repeats)
    for task, (share, _) in targets.items():
        if not held.get(task):
            root.add((domains.get(task, OTHER_DOMAIN), language.UNKNOWN, task), share, 0.0)
    if total == "material":
        total = sum(held.values())
    elif total == "held":
        shares = sum(share for share, _ in targets.values()) or 1.0
        total = min((held[t] * targets[t][1] / (targets[t][0] / shares) for t in held if held[t] and targets[t][0] > 0 and targets[t][1] > 0), default=0.0)
    root.spend(float(total))
    return root, root.budget


def mix(messages: DataFrame, targets: DataFrame, total: float | str = "material", seed: int = 42, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Uses: (conv_id, task, chars, uses). Shares: (task, target_share, max_repeats, material_chars, mix_chars, actual_share)."""
    spark = messages.sparkSession
    wanted = read_targets(targets)
    domains = read_domains(targets) if domains is None else domains
    items = cut_lineage(conversations(messages))
    # at most targets x languages rows
    stats = items.where(F.col("task").isin(list(wanted)) & (F.col("chars") > 0)).groupBy("task", "language").agg(F.sum("chars").alias("chars")).collect()
    material = [(r.task, r.language, float(r.chars)) for r in stats]
    root, _ = budgets(material, wanted, total, domains)
    leaves = []
    for task, lang, chars in material:
        budget = root.children[domains.get(task, OTHER_DOMAIN)].children[lang].children[task].budget
        whole = min(int(budget // chars), wanted[task][1])
        rest = budget - whole * chars if whole < wanted[task][1] else 0.0
        leaves.append((task, lang, whole, rest))
    plan = F.broadcast(spark.createDataFrame(leaves, "task string, language string, whole int, rest double"))
    order = F.xxhash64(F.lit(seed), F.col("whole") + 1, "conv_id")
    placed = items.where("chars > 0").join(plan, ["task", "language"]).withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 64 - RADIX_BITS))
    per = placed.groupBy("task", "language", "bucket").agg(F.sum("chars").alias("chars"), F.max("rest").alias("rest"))
    before = F.sum("chars").over(Window.partitionBy("task", "language").orderBy("bucket")) - F.col("chars")
    ends = per.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("chars") >= F.col("rest")))
    ends = ends.select("task", "language", F.col("bucket").alias("last"), "before")  # one row per leaf
    placed = placed.join(F.broadcast(ends), ["task", "language"], "left")
    sure = placed.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).withColumn("extra", F.when(F.col("last").isNull(), F.lit(0)).otherwise((F.col("bucket") < F.col("last")).cast("int")))
    inside = Window.partitionBy("task", "language").orderBy("order", "conv_id")
    middle = F.col("before") + F.sum("chars").over(inside) - F.col("chars") / 2
    torn = placed.where(F.col("bucket") == F.col("last")).withColumn("extra", (middle <= F.col("rest")).cast("int"))
    used = sure.unionByName(torn).select("conv_id", "task", "chars", (F.col("whole") + F.col("extra")).alias("uses"))
    unused = items.where((F.col("chars") == 0) | F.col("task").isNull() | ~F.col("task").isin(list(wanted))).select("conv_id", "task", "chars", F.lit(0).alias("uses"))
    uses = used.unionByName(unused)
    per_task = uses.groupBy("task").agg(F.sum("chars").alias("material_chars"), F.sum(F.col("chars") * F.col("uses")).alias("mix_chars"))
    base = spark.createDataFrame([(t, float(s), int(r)) for t, (s, r) in sorted(wanted.items())], "task string, target_share double, max_repeats int")
    shares = F.broadcast(base).join(per_task, "task", "left").withColumn("mix_chars", F.coalesce("mix_chars", F.lit(0))).withColumn("material_chars", F.coalesce("material_chars", F.lit(0)))
    whole_mix = F.sum("mix_chars").over(Window.partitionBy())  # one row per target
    return uses, shares.withColumn("actual_share", F.when(whole_mix > 0, F.col("mix_chars") / whole_mix).otherwise(F.lit(0.0)))

"""Near-duplicate texts by HyperMinHash.

Method: HyperMinHash. A text's word shingles are hashed; each bucket keeps the
least hash in 16 bits, as its count of leading zeros and ten mantissa bits. Each
bucket has a hash function of its own instead of a share of one function's range,
since texts of thirty words would leave most buckets of a partitioned sketch
empty. Bands of registers are the join keys; candidates pass a Jaccard estimate
that is corrected for registers that agree by chance, and then an exact check of
their shingle sets. The chance that a pair at the threshold shares no band is
``(1 - threshold ** rows) ** bands``, 2 % with the defaults, and 0.3 % at 0.65.

Texts with equal shingle sets are one class and enter the join once, however
many copies there are. No group is collected; band keys meet in a sort-merge
join, which spills and whose large partitions adaptive execution splits. ``pairs``
gives every pair, as it must. ``groups`` needs not compare all of a bucket of more
than ``BUCKET`` classes, say of one template filled in a million ways: each member
is compared with a few of them, and then only those that are not yet connected with
most of their bucket with all of it, so that no connection is lost.

Results: null and empty texts and those without words or with fewer than ``least_words`` are
similar to nothing; a text of fewer words than a shingle has one shingle, all its words; a
repeated row (same key, same text) counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shingles import WordHashes, shingle_sets
from quern.session import as_table, cut_lineage

BANDS, ROWS = 48, 5
MANTISSA = 10
#: Standard deviations below the threshold down to which an estimate leads to the exact check.
SIGMAS = 4.0
#: Ids up to which a set of ids is broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Classes of a bucket of which ``groups`` compares all, and rounds of comparing those left of larger ones with a few of them.
BUCKET, STAR_ROUNDS = 64, 2
_LONG = 2048


@lru_cache(maxsize=4)
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, (k, 1), np.uint32), rng.integers(0, 2**32, (k, 1), np.uint32) | np.uint32(1)


def least_hashes(shingles: np.ndarray, k: int) -> np.ndarray:
    """The least value of each of ``k`` hash functions over the shingles."""
    flips, odds = _functions(k)
    short = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(k, 2**32 - 1, np.uint32)
    for at in range(0, short.shape[1], _LONG):
        np.minimum(best, ((short[:, at : at + _LONG] ^ flips) * odds).min(axis=1), out=best)
    return best


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 32-bit values, as 16 bits each."""
    wide = least.astype(np.uint64)
    exponent = np.frexp(np.maximum(wide, 1).astype(np.float64))[1].astype(np.uint64)  # of the leading one, from 1
    below = wide ^ np.where(wide > 0, np.uint64(1) << (exponent - np.uint64(1)), 0).astype(np.uint64)
    mantissa = (below << np.uint64(MANTISSA)) >> (exponent - np.uint64(1))
    return (((np.uint64(32) - exponent) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


@lru_cache(maxsize=4096)
def _chance(log_n: int, log_m: int) -> float:
    n, m = 2.0 ** (log_n / 2), 2.0 ** (log_m / 2)
    zeros = np.arange(32)[:, None]
    steps = np.arange(2**MANTISSA)[None, :]
    low = (2.0**MANTISSA + steps) / 2.0 ** (MANTISSA + 1 + zeros)
    high = low + 1 / 2.0 ** (MANTISSA + 1 + zeros)
    inside = [(1 - low) ** c - (1 - np.minimum(high, 1)) ** c for c in (n, m)]
    return float((inside[0] * inside[1]).sum())


def estimate(same: np.ndarray, k: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, without those expected to be equal by chance."""
    logs = [np.rint(2 * np.log2(np.maximum(x, 1))).astype(int) for x in (n, m)]
    chance = np.array([_chance(a, b) for a, b in zip(*map(np.ndarray.tolist, logs), strict=True)])
    return (same / k - chance) / (1 - chance)


def sketch(df: DataFrame, text: str, key: str, shingle: int, least_words: int, k: int) -> DataFrame:
    """(id, class, n, registers) of the texts that are long enough; registers only for the first of its class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, seen = WordHashes(), set()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for at in range(0, len(texts), 500):
                sets = shingle_sets(texts[at : at + 500], shingle, least_words, hashes)
                for own, s in zip(ids[at : at + 500], sets, strict=True):
                    if s is None:
                        continue
                    name = xxhash.xxh3_128_digest(s.tobytes())
                    rows.append((own, name, len(s), None if name in seen else registers(least_hashes(s, k)).tobytes()))
                    seen.add(name)
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["id", "class", "n", "registers"])

    return df.select(F.col(key).cast("long"), F.col(text)).where(F.col(key).isNotNull() & (F.length(text) >= 2 * least_words - 1)).mapInArrow(run, "id bigint, class binary, n int, registers binary")


def _keep(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the ids; they are broadcast only if counted few."""
    return df.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "id", how)


def band_keys(sketches: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, key): a key for each band of registers."""
    width = 2 * rows
    return sketches.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * width + 1, F.lit(width))))).alias("key"))


def sharing(keyed: DataFrame) -> DataFrame:
    """(a, b) with a < b that share a key."""
    left, right = keyed.select(F.col("id").alias("a"), "key"), keyed.select(F.col("id").alias("b"), "key")
    return left.hint("merge").join(right, "key").where("a < b").select("a", "b").distinct()


def _starred(members: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b), a < b: each of ``members`` (key, id, root) with three of the ids that ``of`` has of its key, if their roots differ."""
    other = F.xxhash64("key", "id")
    few = of.groupBy("key").agg(F.array_distinct(F.array(F.min(F.struct("id", "root")), F.max(F.struct("id", "root")), F.min_by(F.struct("id", "root"), other))).alias("few"))
    both = members.join(few, "key").select("id", "root", F.explode("few").alias("x")).where(F.col("root") != F.col("x.root"))
    return both.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, least: float) -> DataFrame:
    own = sketches.select("id", "n", "registers")
    both = pairs.join(own.toDF("a", "n_a", "registers_a"), "a").join(own.toDF("b", "n_b", "registers_b"), "b").select("a", "b", "n_a", "n_b", "registers_a", "registers_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, k) for c in (4, 5))
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            good = estimate((x == y).sum(axis=1), k, n, m) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 1)], ["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, key: str, shingle: int, threshold: float) -> DataFrame:
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                got = [b"" if s is None else s.tobytes() for s in shingle_sets(texts[at : at + 500], shingle, 0, hashes)]
                yield pa.RecordBatch.from_arrays([own.slice(at, len(got)), pa.array(got, pa.binary())], ["id", "s"])

    found = _keep(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), ids, "left_semi").mapInArrow(sets, "id bigint, s binary").dropDuplicates(["id"])
    found = cut_lineage(found)
    both = pairs.join(found.toDF("a", "s_a"), "a").join(found.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared / max(1, len(x) + len(y) - shared) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _classes(df: DataFrame, shingle: int, least_words: int, text: str, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The first of each class (id, n, registers), and the membership (id, rep) of every text that is long enough."""
    sketches = cut_lineage(sketch(df, text, key, shingle, least_words, k))
    reps = sketches.groupBy("class").agg(F.min(F.when(F.col("registers").isNotNull(), F.col("id"))).alias("rep"))
    members = cut_lineage(sketches.select("id", "class").distinct().join(reps, "class").select("id", "rep"))
    others = members.where("id <> rep").select("id")
    return _keep(sketches.where(F.col("registers").isNotNull()), others, "left_anti").select("id", "n", "registers"), members


def _linked(pairs: DataFrame, first: DataFrame, df: DataFrame, threshold: float, shingle: int, text: str, key: str, k: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough: by the estimate, then exactly."""
    pairs = cut_lineage(pairs)
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    near = _keep(first, ids, "left_semi").dropDuplicates(["id"])
    spread = (threshold * (1 - threshold) / k) ** 0.5
    likely = cut_lineage(_estimated(pairs, near, k, threshold - SIGMAS * spread))
    return cut_lineage(_verified(likely, df, text, key, shingle, threshold))


def links(df: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 1, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between representatives of classes, and the membership (id, rep) of every text that is long enough."""
    first, members = _classes(df, shingle, least_words, text, key, bands * rows)
    return _linked(sharing(band_keys(first, bands, rows)), first, df, threshold, shingle, text, key, bands * rows), members


def pairs(df: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(a, b), a < b: every pair of rows with a similarity of ``threshold`` or more, copies expanded."""
    found, members = links(df, threshold, shingle, least_words, text, key)
    own = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    of_a, of_b = members.toDF("x", "a"), members.toDF("y", "b")
    both = found.unionAll(own).join(of_a, "a").join(of_b, "b")
    return both.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(df: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 1, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """(``key``, class_id, group_id): one row per key that isn't null; copies share a class and are not expanded.

    ``group_id`` is the least id connected with the class by links between classes.
    """
    first, members = _classes(df, shingle, least_words, text, key, bands * rows)
    check = lambda pairs: _linked(pairs, first, df, threshold, shingle, text, key, bands * rows)
    keyed = band_keys(first, bands, rows)
    sizes = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    large = sizes.where(F.col("n") > bucket).select("key")
    found = check(sharing(keyed.join(sizes.where(F.col("n") <= bucket).select("key"), "key")))
    if large.limit(1).count():
        of = cut_lineage(keyed.join(large, "key").distinct())
        rooted = lambda: cut_lineage(of.join(components(found).withColumnRenamed("rep", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
        rest = whole = rooted()
        for _ in range(STAR_ROUNDS):
            found = found.unionByName(check(_starred(whole, rest)))
            whole = rooted()
            most = whole.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
            rest = cut_lineage(whole.join(most, "key").where("root <> most").select("key", "id", "root"))
            if not rest.limit(1).count():
                break
        left = rest.select("key", F.col("id").alias("x"), F.col("root").alias("rx")).hint("merge").join(whole.select("key", F.col("id").alias("y"), F.col("root").alias("ry")), "key").where("rx <> ry")
        found = found.unionByName(check(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    everyone = df.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    out = everyone.join(members, "id", "left").join(components(found), "rep", "left")
    return out.select(F.col("id").alias(key), F.coalesce("rep", "id").alias("class_id"), F.coalesce("root", "rep", "id").alias("group_id"))


def components(found: DataFrame) -> DataFrame:
    """(rep, root) of the linked representatives: the least id of each connected component.

    Every round gives each node the least of its own root, its neighbours' roots and the root
    of its root, so that long chains shrink by half; each round is written as a table.
    """
    edges = as_table(found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    state = as_table(edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("root")).select(F.col("a").alias("rep"), "root"))
    while True:
        own = state.select("rep", "root", F.col("root").alias("old"))
        no = F.lit(None).cast("long").alias("old")
        near = edges.join(state.toDF("b", "root"), "b").select(F.col("a").alias("rep"), "root", no)
        far = state.toDF("node", "rep").join(state, "rep").select(F.col("node").alias("rep"), "root", no)
        moved = as_table(own.unionByName(near).unionByName(far).groupBy("rep").agg(F.min("root").alias("root"), F.max("old").alias("old")))
        state = moved.select("rep", "root")
        if not moved.where("root <> old").limit(1).count():
            return state

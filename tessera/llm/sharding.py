"""Sharding by best-fit-decreasing bin packing.

Groups (equal texts) are indivisible and enter the shards in decreasing size,
each the one with the least remaining capacity that still holds it.  Which
group goes where depends on sizes alone, so the plan is made on the driver
from a histogram of sizes: exact below ``EXACT``, in classes 1/4096 wide above,
so it has at most about 200,000 rows however many groups there are.  A
balanced tree over the remaining capacities finds each tightest bin; groups
of one size are placed in bulk.  The plan is a list of runs over the groups'
positions in that order, which a range sort gives them.

Only a group that no shard can hold, of more bytes than both an even share and
the largest row, is cut: its rows (all of one size) in the order of their ids
into the fewest parts that fit.  Groups of more than 1/``PARTS`` of a share are
few; their shards are broadcast, so that none of them lands in one task.

Defined results: a null text is no bytes and a group of its own kind (all null
texts together); repeated rows are rows like any other; a null id is hashed
and sorted as null (first); an empty table gives an empty result; columns
other than the id and the text are left out, so none can clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.runtime import number_rows, settle

#: Sizes below this have a class of their own in the histogram.
EXACT = 1 << 16
#: The shards of a group of more than 1/PARTS of a share are broadcast.
PARTS = 8
#: Bytes that every row takes besides its text.
ROW_BYTES = 8


class TightestBin:
    """Bins by remaining capacity, as a treap: insert, and pop the tightest that holds a size, in O(log n)."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, priority, left, right]
        self._seed = 1

    def insert(self, remaining: int, name: int) -> None:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        below, above = self._split(self._root, (remaining, name))
        self._root = self._merge(self._merge(below, [(remaining, name), self._seed, None, None]), above)

    def pop(self, size: int) -> tuple[int, int] | None:
        """(remaining, name) of the tightest bin with remaining >= size, taken out; None if none has."""
        below, above = self._split(self._root, (size, -1))
        if above is None:
            self._root = below
            return None
        node = above
        while node[2] is not None:
            node = node[2]
        _, above = self._split(above, (node[0][0], node[0][1] + 1))
        self._root = self._merge(below, above)
        return node[0]

    @classmethod
    def _split(cls, node: list | None, key: tuple) -> tuple:
        """The nodes before ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], above = cls._split(node[3], key)
            return node, above
        below, node[2] = cls._split(node[2], key)
        return below, node

    @classmethod
    def _merge(cls, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = cls._merge(a[3], b)
            return a
        b[2] = cls._merge(a, b[2])
        return b


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, limit: int | None = None) -> tuple[list[tuple[int, int]], int] | None:
    """Runs (first position, bin) over items in decreasing size, and the number of bins.

    ``sizes`` are (size, number of items), sizes decreasing.  None if an item
    exceeds the capacity or more than ``limit`` bins would be needed.
    """
    tree, bins, runs, position = TightestBin(), 0, [], 0
    for size, items in sizes:
        if size > capacity:
            return None
        while items:
            found = tree.pop(size)
            if found is None:
                if bins == limit:
                    return None
                found, bins = (capacity, bins), bins + 1
            remaining, name = found
            taken = min(items, remaining // size) if size else items
            if not runs or runs[-1][1] != name:
                runs.append((position, name))
            tree.insert(remaining - taken * size, name)
            position, items = position + taken, items - taken
    return runs, bins


def least_capacity(sizes: list[tuple[int, int]], shards: int) -> tuple[int, list[tuple[int, int]]]:
    """A capacity within 1/65536 of the least with which ``shards`` bins suffice, and the runs."""
    total = sum(size * items for size, items in sizes)
    low = max(-(-total // shards), max((s for s, _ in sizes), default=0))
    tried = lambda c: best_fit_decreasing(sizes, c, shards)
    step, capacity = 0, low
    while (plan := tried(capacity)) is None:
        step = max(1, step * 4, low >> 20)
        low, capacity = capacity + 1, capacity + step
    while capacity - low > total // shards >> 16:
        middle = (low + capacity) // 2
        if (other := tried(middle)) is None:
            low = middle + 1
        else:
            capacity, plan = middle, other
    return capacity, plan[0]


def _class_top(size: str) -> str:
    """SQL for the largest size of a size's class."""
    return f"CASE WHEN {size} < {EXACT} THEN {size} ELSE shiftleft(shiftright({size}, cast(floor(log2({size})) as int) - 12) + 1, cast(floor(log2({size})) as int) - 12) - 1 END"


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for each row of ``docs``."""
    spark = docs.sparkSession
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
        F.when(F.col(text_col).isNotNull(), F.md5(raw)).alias("text_key"),
    )
    rows = settle(rows.withColumn("text_key", F.coalesce("text_key", F.lit("null"))), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return rows.select("id", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).withColumnsRenamed({"id": id_col, "crc": "text_crc32"})
    most = max(-(-total // shards), rows.agg(F.max("size")).first()[0])
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.max("size").alias("each"))
    # fewer than shards * PARTS groups can have that many bytes
    hot = groups.filter(F.col("bytes") > total // shards // PARTS).collect()
    keys = lambda found: F.broadcast(spark.createDataFrame([(g["text_key"], most // g["each"]) for g in found], "text_key string, held long"))
    cut = [g for g in hot if g["bytes"] > most]
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    if cut:
        inside = number_rows(rows.drop("part").join(keys(cut), "text_key"), [F.col("text_key"), F.col("id")], "shard-cut")
        first = inside.groupBy("text_key").agg(F.min("pos").alias("first"))
        inside = inside.join(F.broadcast(first), "text_key").withColumn("part", F.expr("(pos - first) div held"))
        rows = rows.join(keys(cut), "text_key", "left_anti").unionByName(inside.select(rows.columns))
    units = rows.groupBy("text_key", "part").agg(F.sum("size").alias("bytes"))
    units = units.withColumn("class", F.expr(_class_top("bytes")))
    placed = number_rows(units, [F.col("class").desc(), F.col("text_key"), F.col("part")], "shard-units")
    sizes = [(x["class"], x["count"]) for x in placed.groupBy("class").count().orderBy(F.desc("class")).collect()]
    _, runs = least_capacity(sizes, shards)
    sent = spark.sparkContext.broadcast(([r[0] for r in runs], [r[1] for r in runs]))

    def bin_of(positions: pd.Series) -> pd.Series:
        starts, bins = sent.value
        return positions.map(lambda p: bins[bisect.bisect_right(starts, p) - 1]).astype("int32")

    homes = placed.select("text_key", "part", F.pandas_udf(bin_of, "int")("pos").alias("shard"))
    few, unit = keys(hot), ["text_key", "part"]
    dealt = rows.join(few, "text_key", "left_anti").join(homes.join(few, "text_key", "left_anti"), unit)
    dealt = dealt.unionByName(rows.join(F.broadcast(homes.join(few, "text_key", "left_semi")), unit))
    dealt = number_rows(dealt.select("id", "size", "crc", "shard"), [F.col("shard"), F.col("id"), F.col("crc")], "shard-slots")
    starts = dealt.groupBy("shard").agg(F.min("pos").alias("start"))
    return dealt.join(F.broadcast(starts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("pos") - F.col("start")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Resampling without a random stream: draws come from a hash, so any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts in which positions are counted; no task orders the whole population.
PARTS = 64


def hash_index(n: Column, *parts: Column | int | str) -> Column:
    """A number in 0..n-1 from the hash of the parts."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def positions(ids: DataFrame, id_col: str = "space_id") -> DataFrame:
    """id, idx (0..n-1), n: by (id mod PARTS, id), each part numbered on its own and shifted by the parts before it."""
    part = F.pmod(F.col(id_col), F.lit(PARTS))
    rows = ids.select(id_col).distinct().withColumn("part", part)
    counts = rows.groupBy("part").agg(F.count("*").alias("k"))
    shifted = counts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("n"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(id_col)) - 1
    return rows.withColumn("within", within).join(F.broadcast(shifted), "part").select(id_col, (F.col("before") + F.col("within")).alias("idx"), "n")


def draws(placed: DataFrame, count: int, seed: int) -> DataFrame:
    """draw, idx, m: how often each of ``count`` resamples (n of n with replacement) takes a position."""
    slots = placed.select(F.col("idx").alias("slot"), "n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    taken = slots.select("draw", hash_index(F.col("n"), seed, F.col("draw"), F.col("slot")).alias("idx"))
    return taken.groupBy("draw", "idx").agg(F.count("*").alias("m"))


def permutations(placed: DataFrame, count: int, seed: int) -> DataFrame:
    """draw, idx, to: ``to`` runs through all positions in the order of a hash, for each of ``count`` permutations."""
    rows = placed.select("idx").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("idx").cast("string")))
    return rows.withColumn("to", F.row_number().over(Window.partitionBy("draw").orderBy(order, "idx")) - 1)


def interval(table: DataFrame, column: str, by: tuple[str, ...] = (), prefix: str | None = None) -> DataFrame:
    """The central 95 % of a column, linearly interpolated."""
    name = prefix or column
    return table.groupBy(*by).agg(F.percentile(column, F.lit(0.025)).alias(f"{name}_ci_low"), F.percentile(column, F.lit(0.975)).alias(f"{name}_ci_high"))

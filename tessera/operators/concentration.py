"""How concentrated a population's labels are: fractional weights, rankings and their indices.

Every function takes ``by``, columns that tell variants apart, so that any
number of frames or layers is estimated in one plan: a project's labels are
deduplicated, its weight split between them, and sums pre-aggregated before
the shuffle by label.  Only label tables (a taxonomy) are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(label: str = "provider") -> Column:
    """Rows with a label; null and blank count alike."""
    return F.coalesce(F.col(label), F.lit("")) != ""


def checked_weight(base: str | None) -> Column:
    """A project's weight: 1 where there is none; a negative or non-finite one fails the job."""
    if not base:
        return F.lit(1.0)
    w = F.col(base).cast("double")
    wrong = F.isnan(w) | (w < 0) | (w == float("inf"))
    return F.when(wrong, F.raise_error(F.lit(f"{base}: weights must be finite and not negative")).cast("double")).otherwise(F.coalesce(w, F.lit(1.0)))


def fractional_weights(edges: DataFrame, label: str = "provider", by: tuple[str, ...] = (), base: str | None = None) -> DataFrame:
    """by, space_id, label, w (the project's weight over its number of distinct labels), base."""
    columns = [*by, "space_id", label, *([base] if base else [])]
    distinct = edges.filter(named(label)).select(*columns).distinct()
    base_weight = checked_weight(base)
    labels = F.count("*").over(Window.partitionBy(*by, "space_id"))
    return distinct.select(*by, "space_id", F.col(label).alias("label"), base_weight.alias("base"), (base_weight / labels).alias("w"))


def ranking(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, project_count, weight, share."""
    sums = weights.groupBy(*by, "label").agg(F.count("*").alias("project_count"), F.sum("w").alias("weight"))
    return sums.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*(by or (F.lit(1),)))))


def indices(ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, providers, hhi, effective_number, top1_share, top3_share, gini, shannon, top_label of ranked labels."""
    group = Window.partitionBy(*(by or (F.lit(1),)))
    down = F.row_number().over(group.orderBy(F.desc("weight"), F.desc("project_count"), "label"))
    up = F.row_number().over(group.orderBy("weight", "label"))
    placed = ranked.withColumns({"down": down, "up": up})
    n, total = F.count("*"), F.sum("weight")
    return placed.groupBy(*by).agg(
        n.alias("providers"),
        F.sum(F.col("share") * F.col("share")).alias("hhi"),
        (1 / F.sum(F.col("share") * F.col("share"))).alias("effective_number"),
        F.max("share").alias("top1_share"),
        F.sum(F.when(F.col("down") <= 3, F.col("share"))).alias("top3_share"),
        (2 * F.sum(F.col("up") * F.col("weight")) / (n * total) - (n + 1) / n).alias("gini"),
        (-F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share")).otherwise(0.0))).alias("shannon"),
        F.max(F.when(F.col("down") == 1, F.col("label"))).alias("top_label"),
    )


def concentration(edges: DataFrame, label: str = "provider", by: tuple[str, ...] = (), base: str | None = None) -> DataFrame:
    """Indices per ``by``, with the number of projects that have a label."""
    weights = fractional_weights(edges, label, by, base)
    projects = weights.groupBy(*by).agg(F.countDistinct("space_id").alias("projects"))
    found = indices(ranking(weights, by), by)
    return found.join(projects, list(by)) if by else found.crossJoin(F.broadcast(projects))


def with_specs(edges: DataFrame, specs: dict[str, list[str]]) -> DataFrame:
    """Edges once for every analysis spec (overlapping sets of layers) they belong to, in column ``analysis``."""
    names = F.array_compact(F.array(*[F.when(F.col("layer").isin(layers), F.lit(name)) for name, layers in specs.items()]))
    return edges.withColumn("analysis", F.explode(names))

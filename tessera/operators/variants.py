"""The same estimand under many frames: each variant is a value of a column, and all run in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.concentration import named
from tessera.operators.paired import SERVICE


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def search_frames(rankings: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """variant, space_id: the union of all lists' first ranks, by cutoff."""
    best = rankings.groupBy("space_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("variant", F.explode(F.array(*[F.lit(c) for c in cutoffs]))).filter("rank <= variant").select("variant", "space_id")


def without_each(rankings: DataFrame, column: str) -> DataFrame:
    """variant, space_id: the union of all lists but those of one value, for each value."""
    values = rankings.select(F.col(column).alias("variant")).distinct()
    pairs = rankings.select(column, "space_id").distinct()
    return values.join(pairs, values["variant"] != pairs[column]).select("variant", "space_id").distinct()


def arm_overlap(rankings: DataFrame) -> DataFrame:
    """intersection, union, jaccard of the two arms' projects."""
    arms = rankings.groupBy("space_id").agg(F.countDistinct("arm").alias("arms"))
    both, either = F.count_if(F.col("arms") == 2), F.count("*")
    return arms.agg(both.alias("intersection"), either.alias("union_size"), (both / either).alias("jaccard"))


def leave_one_provider_out(edges: DataFrame) -> DataFrame:
    """Edges under each variant that leaves out one service provider's projects, from both layers.

    The definition, for edges of any use; ``paired.without_each_provider`` estimates the same without these rows.
    """
    service = edges.filter((F.col("layer") == SERVICE) & named())
    providers = service.select(F.col("provider").alias("variant")).distinct()
    exposed = service.select(F.col("provider").alias("variant"), "space_id").distinct()
    # the providers are a taxonomy of tens, and each variant keeps nearly all projects
    every = edges.crossJoin(F.broadcast(providers))
    return every.join(exposed, ["variant", "space_id"], "left_anti")


def evidence_filters(edges: DataFrame) -> DataFrame:
    """Edges by evidence variant; a filter on one layer keeps the other whole."""
    high = F.col("confidence") == "high"
    rules = {
        "all_evidence": F.lit(True),
        "high_confidence_service": high | (F.col("layer") != SERVICE),
        "high_confidence_model": high | (F.col("layer") != "model"),
        "high_confidence_both_layers": high,
    }
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return edges.withColumn("variant", F.explode(names))


def namespace_treatments(edges: DataFrame) -> DataFrame:
    """Edges by treatment of unmapped model namespaces: as they are, pooled under one label, or left out."""
    unmapped = (F.col("layer") == "model") & (F.col("provider_basis") == "unmapped_public_namespace")
    choices = [
        F.struct(F.lit("disaggregated").alias("variant"), F.col("provider").alias("provider")),
        F.struct(F.lit("pooled").alias("variant"), F.when(unmapped, "unmapped_namespaces").otherwise(F.col("provider")).alias("provider")),
        F.when(~unmapped, F.struct(F.lit("mapped_only").alias("variant"), F.col("provider").alias("provider"))),
    ]
    return edges.withColumn("v", F.explode(F.array_compact(F.array(*choices)))).drop("provider").select("*", "v.*").drop("v")


def evidence_types(edges: DataFrame, hub_linked: str, code_signature: str, package: str) -> DataFrame:
    """Edges by the study's evidence variants: high confidence in both layers, or one layer by one evidence type and the other whole."""
    of = lambda layer, kind: (F.col("layer") != layer) | (F.col("evidence_type") == kind)
    rules = {
        "high_confidence_both_layers": F.col("confidence") == "high",
        "hub_linked_model_only": of("model", hub_linked),
        "service_code_signature_only": of(SERVICE, code_signature),
        "service_package_only": of(SERVICE, package),
    }
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return edges.withColumn("variant", F.explode(names))


def immediate_namespace(edges: DataFrame) -> DataFrame:
    """Edges whose model providers are the text before the first slash of the evidence value."""
    value = F.coalesce("evidence_value", F.lit(""))
    space = F.concat(F.lit("namespace:"), F.when(F.contains(value, F.lit("/")), F.split_part(value, F.lit("/"), F.lit(1))).otherwise("unscoped"))
    return edges.withColumn("provider", F.when(F.col("layer") == "model", space).otherwise(F.col("provider"))).withColumn("variant", F.lit("immediate_public_namespace"))


def weighted_projects(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges under each variant of ``weights`` (variant, space_id, base_weight); a project without a weight has 1."""
    # the variants are a handful
    every = edges.crossJoin(F.broadcast(weights.select("variant").distinct()))
    return every.join(weights, ["variant", "space_id"], "left").fillna(1.0, ["base_weight"])


def unknown_boundary(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges by treatment of unmapped service candidates (space_id, candidate_type, identifier)."""
    distinct = candidates.select("space_id", "candidate_type", "identifier").distinct()
    labels = F.array(
        F.struct(F.lit("pooled").alias("variant"), F.lit("unmapped_service").alias("provider")),
        F.struct(F.lit("identifier").alias("variant"), F.concat_ws(":", F.lit("unmapped"), "candidate_type", "identifier").alias("provider")),
        F.struct(F.lit("project_unique").alias("variant"), F.concat(F.lit("unmapped_project:"), F.col("space_id").cast("string")).alias("provider")),
    )
    added = distinct.withColumn("v", F.explode(labels)).select("space_id", "v.*", F.lit(SERVICE).alias("layer")).distinct()
    known = edges.select("space_id", "provider", "layer").withColumn("variant", F.explode(F.array(*[F.lit(x) for x in ("known", "pooled", "identifier", "project_unique")])))
    return known.unionByName(added)


def ranges(results: DataFrame, by: str, value: str) -> DataFrame:
    """variants, median, least and largest of a value by family."""
    return results.groupBy(by).agg(F.count("*").alias("variants"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"))


def signal_intersections(edges: DataFrame) -> DataFrame:
    """Projects by the exact set of layers they signal."""
    signature = edges.filter(named()).groupBy("space_id").agg(F.array_join(F.array_sort(F.collect_set("layer")), "+").alias("signature"))
    return signature.groupBy("signature").agg(F.count("*").alias("projects"))


def mosaic(joint: DataFrame, services: int = 4, models: int = 6) -> DataFrame:
    """service, model, joint over the largest labels and Other, with every cell of the grid."""

    def largest(column: str, k: int) -> DataFrame:
        order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("total", 12)), column)
        return joint.groupBy(column).agg(F.sum("joint").alias("total")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(column, F.col(column).alias(f"{column}_name"))

    s, m = largest("service", services), largest("model", models)
    cells = joint.join(F.broadcast(s), "service", "left").join(F.broadcast(m), "model", "left")
    cells = cells.groupBy(F.coalesce("service_name", F.lit("Other")).alias("service"), F.coalesce("model_name", F.lit("Other")).alias("model")).agg(F.sum("joint").alias("joint"))
    grid = cells.select("service").distinct().crossJoin(cells.select("model").distinct())
    return grid.join(cells, ["service", "model"], "left").fillna(0.0, ["joint"])

"""Comparisons of sets and relations, and the gates that are built on them.

All are joins or aggregates by key, so none gathers a relation in one task; a
gate is one aggregate for all its checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules


def additional_rows(larger: DataFrame, smaller: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``larger`` whose composite key ``smaller`` doesn't hold; nulls of a key are equal."""
    other = smaller.select(*[F.col(c).alias(f"_other_{c}") for c in key]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in key]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return larger.join(other, condition, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side ('left' or 'right') of the ids that only one of two tables holds."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(True))
    one = a.join(b, key, "full_outer").filter("_l IS NULL OR _r IS NULL")
    return one.select(key, F.when(F.col("_l"), "left").otherwise("right").alias("side"))


def overlap(df: DataFrame, item: str, in_first: Column, in_second: Column) -> DataFrame:
    """item and where it occurs: 'both', 'first' or 'second'; one aggregate in place of three set operations."""
    seen = df.groupBy(item).agg(F.max(F.coalesce(in_first, F.lit(False))).alias("a"), F.max(F.coalesce(in_second, F.lit(False))).alias("b"))
    return seen.filter("a OR b").select(item, F.expr("CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END AS occurs"))


def is_subset(part: DataFrame, whole: DataFrame, key: str, name: str) -> DataFrame:
    """check and pass: whether each id of ``part`` is one of ``whole``."""
    lost = part.select(key).filter(F.col(key).isNotNull()).distinct().join(whole.select(key).distinct(), key, "left_anti")
    return lost.agg(F.lit(name).alias("check"), (F.count("*") == 0).alias("pass"))


def repository_projects(links: DataFrame, repository: str, project: str) -> DataFrame:
    """repository_key (lower case), repository (the spelling of its least project), projects (sorted, distinct)."""
    spelled = F.min_by(repository, F.struct(F.col(project), F.col(repository)))
    return links.filter(F.col(repository).isNotNull()).groupBy(F.lower(repository).alias("repository_key")).agg(spelled.alias("repository"), F.array_sort(F.collect_set(project)).alias("projects"))


def first_qualifying(revisions: DataFrame, project: str, at: str, revision: str, qualifies: Column) -> DataFrame:
    """Each project's earliest revision that qualifies, ties to the smaller revision id; projects without one have no row."""
    kept = revisions.filter(qualifies)
    return kept.groupBy(project).agg(F.min(F.struct(F.col(at).alias("at"), F.col(revision).alias("revision"))).alias("x")).select(project, "x.at", "x.revision")


def counted_files(files: DataFrame, path: str) -> DataFrame:
    """The files that count as sources: all but those with an excluded base name, whatever its case."""
    base = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    return files.filter(~F.coalesce(base.isin(*rules.EXCLUDED_NAMES), F.lit(False)))


def has_service_candidate(candidates: DataFrame, project: str, kind: str) -> DataFrame:
    """project and has_candidate: whether any of a project's signals is of a type that supports a service."""
    return candidates.groupBy(project).agg(F.coalesce(F.bool_or(F.col(kind).isin(*rules.SERVICE_CANDIDATES)), F.lit(False)).alias("has_candidate"))


def collection_status(df: DataFrame, code: str) -> DataFrame:
    """``df`` with collection_status: 'ok', 'unavailable' for answers that stand for a missing object, 'retry' for passing ones, else 'failed'."""
    c = F.col(code)
    status = F.when(c.between(200, 299), "ok").when(c.isin(*rules.GONE_CODES), "unavailable").when((c == 429) | c.between(500, 599), "retry").otherwise("failed")
    return df.withColumn("collection_status", status)


def deidentified(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only the released columns, in their order; what a table lacks is null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def reproduced(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """key and agrees: equal values within ``tolerance``, or both null; a key of one side alone doesn't agree."""
    a = left.select(F.col(key), F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(F.col(key), F.col(value).alias("b"), F.lit(True).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.col("a").isNull() & F.col("b").isNull())
    return a.join(b, key, "full_outer").select(key, (both & same).alias("agrees"))

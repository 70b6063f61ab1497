"""Deterministic samples, reviewers' agreement, weighted precision and recall, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bootstrap as B
from tessera.operators.resampling import hash_index

LABELS = ("yes", "no", "uncertain")


def stable_rank(value: Column, salt: str, seed: int = 20260831) -> Column:
    """The hash that orders a sample, whatever order its rows come in."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), value.cast("string")), 256)


def stable_sample(rows: DataFrame, targets: dict[str, int], stratum: str, identity: str, salt: str) -> DataFrame:
    """Each stratum's first rows by hash, with inclusion_probability n / N."""
    order = Window.partitionBy(stratum).orderBy("_rank", identity)
    target = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))])[F.col(stratum)]
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    placed = rows.withColumn("_rank", stable_rank(F.col(identity), salt)).withColumn("_place", F.row_number().over(order)).withColumn("_target", target)
    kept = placed.filter(F.col("_place") <= F.col("_target")).join(F.broadcast(sizes), stratum)
    return kept.withColumn("inclusion_probability", F.least("_n", "_target") / F.col("_n")).drop("_n", "_target", "_rank", "_place")


def balanced_sample(rows: DataFrame, count: int, group: str, identity: str, salt: str, least: int = 1) -> DataFrame:
    """``count`` rows with at least ``least`` of each group, the first by hash, filled up by hash."""
    ranked = rows.withColumn("_rank", stable_rank(F.col(identity), salt))
    placed = ranked.withColumn("_must", F.row_number().over(Window.partitionBy(group).orderBy("_rank", identity)) <= least)
    # a top-k over all rows: only ``count`` of them leave each task
    return placed.orderBy(F.desc("_must"), "_rank", identity).limit(count).drop("_rank", "_must")


def allocate(groups: DataFrame, total: int, size: str = "n") -> DataFrame:
    """allocation = max(1, round half to even(total n / N))."""
    share = F.lit(total) * F.col(size) / F.sum(size).over(Window.partitionBy(F.lit(1)))
    return groups.withColumn("allocation", F.greatest(F.lit(1), F.bround(share).cast("long")))


def blind_ids(rows: DataFrame, prefix: str, identity: str, salt: str) -> DataFrame:
    """blind_id: E001, E002, ... in the order of the hash."""
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(stable_rank(F.col(identity), salt), identity))
    return rows.withColumn("blind_id", F.format_string(f"{prefix}%03d", at))


def resolved(first: Column, second: Column, third: Column) -> Column:
    """Two reviewers' yes or no if they agree, else the adjudicator's, else ''."""
    sure = ("yes", "no")
    a, b, c = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (first, second, third))
    return F.when((a == b) & a.isin(*sure), a).when(c.isin(*sure), c).otherwise("")


def unresolved_ids(reviews: DataFrame) -> DataFrame:
    return reviews.filter(resolved(F.col("r1"), F.col("r2"), F.lit("")) == "").select("sample_id")


def cohen_kappa(reviews: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, items, observed, expected, kappa over pairs of valid labels; kappa is 1 if the expected agreement is."""
    valid = reviews.filter(F.col("r1").isin(*LABELS) & F.col("r2").isin(*LABELS))
    n = F.count("*")
    shares = [F.count_if(F.col("r1") == x) / n * (F.count_if(F.col("r2") == x) / n) for x in LABELS]
    got = valid.groupBy(*by).agg(n.alias("items"), (F.count_if(F.col("r1") == F.col("r2")) / n).alias("observed"), sum(shares[1:], shares[0]).alias("expected"))
    return got.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def weighted_quality(items: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """by, precision, recall, specificity of predicted (0/1) against actual (0/1), weighted by 1 / pi."""
    w = weight if weight is not None else 1 / F.col("pi")
    p, a = F.col("predicted") == 1, F.col("actual") == 1
    total = lambda *c: F.sum(F.when(*c, w).otherwise(0.0))
    return items.groupBy(*by).agg(
        F.try_divide(total(p & a), total(p)).alias("precision"), F.try_divide(total(p & a), total(a)).alias("recall"), F.try_divide(total(~p & ~a), total(~a)).alias("specificity"), F.sum(w).alias("weight")
    )


def stratified_draws(items: DataFrame, count: int, seed: int, stratum: str = "stratum", identity: str = "sample_id") -> DataFrame:
    """draw and the columns of ``items`` with m: resamples within each stratum."""
    placed = items.withColumn("idx", F.row_number().over(Window.partitionBy(stratum).orderBy(identity)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(stratum)))
    slots = placed.select(stratum, "n", F.col("idx").alias("slot")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    taken = slots.select(stratum, "draw", hash_index(F.col("n"), seed, F.col(stratum), F.col("draw"), F.col("slot")).alias("idx")).groupBy(stratum, "draw", "idx").agg(F.count("*").alias("m"))
    return taken.join(placed.drop("n"), [stratum, "idx"]).drop("idx")


def precision_table(items: DataFrame, count: int, seed: int, stratum: str = "stratum", identity: str = "sample_id") -> DataFrame:
    """draw, precision: ``weighted_quality`` of ``stratified_draws``, weighted by m / pi, for as many draws as the study has."""
    order = Window.partitionBy(stratum).orderBy(identity)
    hit = F.when(F.col("predicted") == 1, F.when(F.col("actual") == 1, "right").otherwise("wrong"))
    own = F.when(hit.isNull(), F.array()).otherwise(F.array(F.struct(hit.alias("label"), (1 / F.col("pi")).cast("double").alias("w"))))
    placed = items.select(F.col(stratum).alias("stratum"), (F.row_number().over(order) - 1).alias("idx"), own.alias("own"))
    # labels in order: "right" before "wrong"; a table without one of them has no such label
    some = placed.select(F.explode("own").alias("x")).select("x.label").distinct()
    names = sorted(r[0] for r in some.collect())

    def precision(sums: list) -> tuple[float]:
        of = dict(zip(names, sums[0].tolist(), strict=True))
        total = sum(of.values())
        return (of.get("right", 0.0) / total if total else float("nan"),)

    return B.table(placed, ("own",), count, seed, ("precision",), precision, "idx", strata=True)


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, pass: one aggregate over the table for all checks."""
    one = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("pass")) for n in checks])).alias("x")).select("x.*")

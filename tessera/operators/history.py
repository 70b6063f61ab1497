"""Two states of each project: transitions, change of concentration, span subsets, capped scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bootstrap as B
from tessera.sources.durable import settle


def commits_within(commits: DataFrame, snapshot: str) -> DataFrame:
    """Commits (committed_at, commit_id) up to the snapshot's day, in order of time and id."""
    limit = F.date_add(F.to_date(F.lit(snapshot)), 1)
    return commits.withColumn("committed_at", F.try_to_timestamp("committed_at")).filter(F.col("committed_at") < limit).orderBy("committed_at", "commit_id")


def transition(initial: str = "initial", current: str = "current"):
    a, b = F.col(initial), F.col(current)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), "no_signal").when(F.size(a) == 0, "added").when(F.size(b) == 0, "removed").when(a == b, "same").otherwise("changed")


def transitions(versions: DataFrame) -> DataFrame:
    return versions.groupBy(transition().alias("transition")).agg(F.count("*").alias("projects"))


def version_hhi(versions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, paired projects, both states' HHI and the change, over projects with a signal in both states."""
    both = versions.filter((F.size("initial") > 0) & (F.size("current") > 0))
    states = F.array(F.struct(F.lit("initial").alias("state"), F.col("initial").alias("labels")), F.struct(F.lit("current").alias("state"), F.col("current").alias("labels")))
    long = both.select(*by, "project", F.explode(states).alias("s")).select(*by, "project", "s.state", (1 / F.size("s.labels")).alias("w"), F.explode("s.labels").alias("label"))
    sums = long.groupBy(*by, "state", "label").agg(F.sum("w").alias("w"))
    shares = sums.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*by, "state")))
    hhi = shares.groupBy(*by).pivot("state", ["initial", "current"]).agg(F.sum(F.col("share") * F.col("share")))
    n = both.groupBy(*by).agg(F.count("*").alias("paired_projects"))
    joined = hhi.join(n, list(by)) if by else hhi.crossJoin(F.broadcast(n))
    return joined.select(*by, "paired_projects", F.col("initial").alias("initial_hhi"), F.col("current").alias("current_hhi"), (F.col("current") - F.col("initial")).alias("hhi_change"))


def version_draws(versions: DataFrame, count: int, seed: int) -> DataFrame:
    """draw, initial_hhi, current_hhi, hhi_change: one resample of the projects with a signal in both states for both."""
    both = versions.filter((F.size("initial") > 0) & (F.size("current") > 0))

    def side(state: str):
        return F.transform(F.array_sort(state), lambda x: F.struct(x.alias("label"), (1 / F.size(state)).alias("w"))).alias(state)

    columns = ("initial_hhi", "current_hhi", "hhi_change")
    return B.table(both.select("project", side("initial"), side("current")), ("initial", "current"), count, seed, columns, _change, "project")


def _change(sums: list) -> tuple[float, float, float]:
    initial, current = map(B.hhi, sums)
    return initial, current, current - initial


def version_bootstrap(versions: DataFrame, count: int, seed: int) -> DataFrame:
    """``version_hhi`` with the change's 95 % interval and the share of draws above 0; nulls where no project is paired."""
    versions = settle(versions, "versions")
    drawn = version_draws(versions, count, seed)
    # rounded, so that no order of summation puts a change of 0 above it
    above = (F.count_if(F.round("hhi_change", 12) > 0) / F.nullif(F.count("*"), F.lit(0))).alias("fraction_above_zero")
    ends = [F.percentile("hhi_change", F.lit(q)).alias(f"hhi_change_ci_{n}") for n, q in (("low", 0.025), ("high", 0.975))]
    return version_hhi(versions).crossJoin(F.broadcast(drawn.agg(*ends, above)))


def span_bootstrap(versions: DataFrame, days: tuple[int, ...], count: int, seed: int) -> DataFrame:
    """``version_bootstrap`` under each minimum history span, drawn with seed + days."""
    versions = settle(versions, "versions")
    found = [version_bootstrap(versions.filter(F.col("span_days") >= d), count, seed + d).withColumn("min_days", F.lit(d)) for d in days]
    return reduce(DataFrame.unionByName, found)


def by_span(versions: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """Versions under each minimum history span, in column ``min_days``."""
    return versions.withColumn("min_days", F.explode(F.array(*[F.lit(d) for d in days]))).filter("span_days >= min_days")


def capped(edges: DataFrame, caps: tuple[int, ...], file: str = "source_file") -> DataFrame:
    """Edges under each cap on the number of files scanned per project, in column ``cap``."""
    place = F.dense_rank().over(Window.partitionBy("space_id").orderBy(file))
    return edges.withColumn("place", place).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).filter("place <= cap").drop("place")

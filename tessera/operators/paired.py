"""Two layers of the same projects: contrasts, co-declaration, composition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bootstrap as B
from tessera.operators.concentration import checked_weight, fractional_weights, indices, named, ranking
from tessera.functions.digests import order
from tessera.operators.resampling import draws, permutations, positions
from tessera.sources.durable import settle

SERVICE, MODEL = "service", "model"
#: Positions that are packed in one row, and pairs of kinds of labels that are counted rather than weighed.
CHUNK, CELLS = 1 << 16, 1 << 20


def matched_projects(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, space_id of the projects that have a label in both layers."""
    both = edges.filter(F.col("layer").isin(SERVICE, MODEL) & named()).groupBy(*by, "space_id")
    return both.agg(F.countDistinct("layer").alias("layers")).filter("layers = 2").select(*by, "space_id")


def matched_weights(edges: DataFrame, by: tuple[str, ...] = (), base: str | None = None) -> DataFrame:
    """Fractional weights of both layers over matched projects: by, layer, space_id, label, base, w.

    The edges are read once and shuffled once by project, where both layers' labels are counted.
    """
    columns = [*by, "layer", "space_id", "provider", *([base] if base else [])]
    distinct = edges.filter(F.col("layer").isin(SERVICE, MODEL) & named()).select(*columns).distinct()
    project = Window.partitionBy(*by, "space_id")
    services, models = (F.sum((F.col("layer") == x).cast("long")).over(project) for x in (SERVICE, MODEL))
    weight = checked_weight(base)
    both = distinct.withColumns({"_s": services, "_m": models}).filter("_s > 0 AND _m > 0")
    labels = F.when(F.col("layer") == SERVICE, F.col("_s")).otherwise(F.col("_m"))
    return both.select(*by, "layer", "space_id", F.col("provider").alias("label"), weight.alias("base"), (weight / labels).alias("w"))


def paired_estimate(edges: DataFrame, by: tuple[str, ...] = (), base: str | None = None) -> DataFrame:
    """by, matched_projects and both layers' indices side by side, service minus model (entropy: model minus service)."""
    weights = matched_weights(edges, by, base)
    projects = weights.groupBy(*by).agg(F.countDistinct("space_id").alias("matched_projects"))
    return _side_by_side(ranking(weights, (*by, "layer")), projects, by)


def _side_by_side(ranked: DataFrame, projects: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The indices of ranked labels (by, layer, label), one row for both layers, with ``projects`` (by, matched_projects)."""
    found = indices(ranked, (*by, "layer"))

    def of(layer: str, column: str):
        return F.max(F.when(F.col("layer") == layer, F.col(column)))

    wide = found.groupBy(*by).agg(
        *[of(layer, c).alias(f"{layer}_{n}") for layer in (SERVICE, MODEL) for c, n in (("providers", "categories"), ("hhi", "hhi"), ("top1_share", "top_share"), ("shannon", "shannon"))]
    )
    wide = wide.withColumns(
        {
            "hhi_difference": F.col("service_hhi") - F.col("model_hhi"),
            "hhi_ratio": F.col("service_hhi") / F.col("model_hhi"),
            "top_share_difference": F.col("service_top_share") - F.col("model_top_share"),
            "entropy_difference": F.col("model_shannon") - F.col("service_shannon"),
        }
    )
    return wide.join(projects, list(by)) if by else wide.crossJoin(F.broadcast(projects))


def without_each_provider(edges: DataFrame) -> DataFrame:
    """``paired_estimate`` by variant, each leaving out one service provider's projects from both layers.

    Leaving whole projects out changes no other project's weights, so each
    variant is the totals less what its provider's own projects hold: the rows
    grow with a project's labels, not with edges times providers.  Variants
    meet labels in a table of label totals only, and a provider whose projects
    are all the matched ones has no row.
    """
    weights = matched_weights(edges)
    exposed = weights.filter(F.col("layer") == SERVICE).select("space_id", F.col("label").alias("variant"))
    variants = edges.filter((F.col("layer") == SERVICE) & named()).select(F.col("provider").alias("variant")).distinct()
    lost = weights.join(exposed, "space_id").groupBy("variant", "layer", "label").agg(F.count("*").alias("lost_projects"), F.sum("w").alias("lost_weight"))
    totals = weights.groupBy("layer", "label").agg(F.count("*").alias("all_projects"), F.sum("w").alias("all_weight"))
    # the providers are a taxonomy of tens, and a total is one row a label
    left = totals.crossJoin(F.broadcast(variants)).join(lost, ["variant", "layer", "label"], "left").fillna(0).filter("all_projects > lost_projects")
    left = left.select("variant", "layer", "label", (F.col("all_projects") - F.col("lost_projects")).alias("project_count"), (F.col("all_weight") - F.col("lost_weight")).alias("weight"))
    ranked = left.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("variant", "layer")))
    own = exposed.groupBy("variant").agg(F.count("*").alias("own"))
    every = weights.agg(F.countDistinct("space_id").alias("every"))
    projects = variants.join(own, "variant", "left").crossJoin(F.broadcast(every)).select("variant", (F.col("every") - F.coalesce("own", F.lit(0))).alias("matched_projects"))
    return _side_by_side(ranked, projects, ("variant",))


def paired_draws(edges: DataFrame, count: int, seed: int, base: str | None = None) -> DataFrame:
    """draw, service_hhi, model_hhi, hhi_difference: one resample of projects for both layers (rows keep their weights)."""
    weights = matched_weights(edges, base=base)
    placed = positions(weights)
    taken = draws(placed, count, seed).join(placed, "idx").select("draw", "space_id", "m")
    drawn = weights.join(taken, "space_id").withColumn("w", F.col("w") * F.col("m"))
    ranked = ranking(drawn, ("draw", "layer"))
    hhi = ranked.groupBy("draw").pivot("layer", [SERVICE, MODEL]).agg(F.sum(F.col("share") * F.col("share")))
    return hhi.select("draw", F.col(SERVICE).alias("service_hhi"), F.col(MODEL).alias("model_hhi"), (F.col(SERVICE) - F.col(MODEL)).alias("hhi_difference"))


METRICS = ("service_hhi", "model_hhi", "hhi_difference", "hhi_ratio", "service_top_share", "model_top_share", "top_share_difference", "service_shannon", "model_shannon", "entropy_difference")


def paired_metric_draws(edges: DataFrame, count: int, seed: int, base: str | None = None) -> DataFrame:
    """draw and METRICS of the same resamples as ``paired_draws``; projects keep their weights, shares are of the drawn weight."""
    weights = matched_weights(edges, base=base)
    placed = positions(weights)
    taken = draws(placed, count, seed).join(placed, "idx").select("draw", "space_id", "m")
    ranked = ranking(weights.join(taken, "space_id").withColumn("w", F.col("w") * F.col("m")), ("draw", "layer"))

    def of(layer: str, how, value):
        return how(F.when(F.col("layer") == layer, value))

    share = F.col("share")
    surprise = F.when(share > 0, -share * F.ln("share")).otherwise(0.0)
    parts = (("hhi", F.sum, share * share), ("top_share", F.max, share), ("shannon", F.sum, surprise))
    sides = ranked.groupBy("draw").agg(*[of(layer, how, value).alias(f"{layer}_{n}") for layer in (SERVICE, MODEL) for n, how, value in parts])
    return sides.select(
        "draw",
        "service_hhi",
        "model_hhi",
        (F.col("service_hhi") - F.col("model_hhi")).alias("hhi_difference"),
        (F.col("service_hhi") / F.col("model_hhi")).alias("hhi_ratio"),
        "service_top_share",
        "model_top_share",
        (F.col("service_top_share") - F.col("model_top_share")).alias("top_share_difference"),
        "service_shannon",
        "model_shannon",
        (F.col("model_shannon") - F.col("service_shannon")).alias("entropy_difference"),
    )


def metric_intervals(table: DataFrame) -> DataFrame:
    """metric, ci_low, ci_high and the share of draws above 0 of a ``paired_metric_draws`` table."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("v")).select("v.*")
    above = (F.count_if(F.col("x") > 0) / F.count("*")).alias("above_zero")
    return long.groupBy("metric").agg(F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"), above)


def hhi_draws(edges: DataFrame, count: int, seed: int) -> DataFrame:
    """draw, hhi over resampled projects of one set of layers."""
    weights = fractional_weights(edges)
    placed = positions(weights)
    taken = draws(placed, count, seed).join(placed, "idx").select("draw", "space_id", "m")
    drawn = weights.join(taken, "space_id").withColumn("w", F.col("w") * F.col("m"))
    return ranking(drawn, ("draw",)).groupBy("draw").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))


def hhi_table(edges: DataFrame, count: int, seed: int) -> DataFrame:
    """What ``hhi_draws`` gives, for as many draws as the study has."""
    projects = fractional_weights(edges).groupBy("space_id").agg(B.label_set("label", "w").alias("own"))
    return B.table(projects, ("own",), count, seed, ("hhi",), lambda sums: (B.hhi(sums[0]),))


def _paired_values(sums: list[np.ndarray]) -> tuple[float, ...]:
    """METRICS of both layers' sums by label; rounded, so that no order of summation puts a difference of 0 above it."""
    (sh, st, se), (mh, mt, me) = ((float((p * p).sum()), float(p.max()), float(-(p[p > 0] * np.log(p[p > 0])).sum()) if not np.isnan(p).any() else np.nan) for p in map(B.shares, sums))
    return tuple(round(x, 12) for x in (sh, mh, sh - mh, sh / mh, st, mt, st - mt, se, me, me - se))


def paired_table(edges: DataFrame, count: int, seed: int, base: str | None = None) -> DataFrame:
    """What ``paired_draws`` and ``paired_metric_draws`` give (draw and METRICS), for as many draws as the study has."""
    weights = matched_weights(edges, base=base)
    sides = [B.label_set(F.when(F.col("layer") == x, F.col("label")), "w").alias(x) for x in (SERVICE, MODEL)]
    return B.table(weights.groupBy("space_id").agg(*sides), (SERVICE, MODEL), count, seed, METRICS, _paired_values)


def codeclaration(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, service, model, joint share: the mean over projects of the product of both layers' weights."""
    s = weights.filter(F.col("layer") == SERVICE).select(*by, "space_id", F.col("label").alias("service"), F.col("w").alias("ws"))
    m = weights.filter(F.col("layer") == MODEL).select(*by, "space_id", F.col("label").alias("model"), F.col("w").alias("wm"))
    cells = s.join(m, [*by, "space_id"]).groupBy(*by, "service", "model").agg(F.sum(F.col("ws") * F.col("wm")).alias("mass"))
    return cells.withColumn("joint", F.col("mass") / F.sum("mass").over(Window.partitionBy(*(by or (F.lit(1),))))).drop("mass")


def mutual_information(joint: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, h_service, h_model, mi, nmi in nats."""
    group = lambda *c: Window.partitionBy(*by, *c)
    both = joint.withColumns({"ps": F.sum("joint").over(group("service")), "pm": F.sum("joint").over(group("model"))})
    entropies = both.groupBy(*by).agg(
        (-F.sum(F.col("joint") * F.ln("ps"))).alias("h_service"), (-F.sum(F.col("joint") * F.ln("pm"))).alias("h_model"), (-F.sum(F.col("joint") * F.ln("joint"))).alias("h_joint")
    )
    mi = F.col("h_service") + F.col("h_model") - F.col("h_joint")
    return entropies.withColumn("mi", mi).withColumn("nmi", F.try_divide("mi", F.sqrt(F.col("h_service") * F.col("h_model")))).drop("h_joint")


def permutation_null(weights: DataFrame, count: int, seed: int) -> DataFrame:
    """draw, mi with the model rows dealt anew among projects; both marginals stay."""
    placed = positions(weights)
    moved = permutations(placed, count, seed)
    source = placed.select(F.col("space_id"), "idx")
    s = weights.filter(F.col("layer") == SERVICE).join(source, "space_id").select(F.col("idx").alias("to"), "layer", "label", "w")
    m = weights.filter(F.col("layer") == MODEL).join(source, "space_id").join(moved, "idx").select("draw", F.col("to").alias("space_id"), "layer", "label", "w")
    s = s.join(moved.select("draw", "to"), "to").select("draw", F.col("to").alias("space_id"), "layer", "label", "w")
    return mutual_information(codeclaration(s.unionByName(m), ("draw",)), ("draw",)).select("draw", "mi")


def _packed(weights: DataFrame, kinds: dict[str, pd.DataFrame]) -> DataFrame:
    """chunk and, for each layer, how many labels each of its CHUNK positions has and their kinds, as bytes in order of position."""
    codes = weights.sparkSession.createDataFrame([(x, r.label, r.w, i) for x, found in kinds.items() for i, r in enumerate(found.itertuples())], "layer string, label string, w double, kind int")
    placed = weights.join(positions(weights).drop("n"), "space_id").join(F.broadcast(codes), ["layer", "label", "w"])
    types = {x: np.min_scalar_type(len(found)) for x, found in kinds.items()}

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["idx"].iloc[0]) // CHUNK
        rows = rows.sort_values(["idx", "kind"])
        found: list = [chunk]
        for x, t in types.items():
            own = rows[rows["layer"] == x]
            many = np.bincount(own["idx"] - chunk * CHUNK, minlength=int(rows["idx"].iloc[-1]) % CHUNK + 1)
            found += [many.astype(t).tobytes(), own["kind"].to_numpy().astype(t).tobytes()]
        return pd.DataFrame([found])

    by = F.floor(F.col("idx") / CHUNK).alias("chunk")
    schema = ", ".join(["chunk long", *(f"{x}_{c} binary" for x in kinds for c in ("many", "kinds"))])
    return placed.select("idx", "layer", "kind").groupBy(by).applyInPandas(pack, schema)


def _sets(many: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """A code for each position's set of kinds, larger sets first; how many sets; for each k the k-th kind of the sets that have one."""
    starts = np.cumsum(many, dtype=np.int64) - many
    codes, known = np.zeros(len(many), np.int64), 1
    for k in range(int(many.max())):
        has = np.flatnonzero(many > k)
        found, new = pd.factorize(codes[has] * (int(kinds.max()) + 1) + kinds[starts[has] + k])
        codes[has] = known + found
        known += len(new)
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    by_size = np.argsort(-many[first].astype(np.int64), kind="stable")
    place = np.empty(len(first), np.min_scalar_type(len(first)))
    place[by_size], first = np.arange(len(first)), first[by_size]
    sizes = many[first]
    return place[codes], len(first), [kinds[starts[first[sizes > k]] + k].astype(np.int64) for k in range(int(sizes[0]))]


def permutation_table(weights: DataFrame, count: int, seed: int) -> DataFrame:
    """draw, mi: what ``permutation_null`` gives, for as many draws as the study has; draw -1 is the unpermuted table.

    Each task deals whole permutations and holds every project for it: a byte
    or two for each project and service label, a code for each project's set of
    models, about 70 bytes for each project while sets are coded and 16 while
    one permutation is dealt.  The driver sees none of that, as the packed
    projects are shuffled to each task; it collects the kinds of labels, a kind
    being a label with a weight.
    """
    spark = weights.sparkSession
    kept = settle(weights.select("space_id", "layer", "label", "w"), "weights")
    every = kept.select("layer", "label", "w").distinct().toPandas().sort_values(["label", "w"])
    kinds = {x: every[every["layer"] == x] for x in (SERVICE, MODEL)}
    if any(found.empty for found in kinds.values()):
        return spark.createDataFrame([], "draw long, mi double")
    # a kind's label and weight, and the first kind of each label
    (ls, ws, fs), (lm, wm, fm) = ((c := pd.factorize(k["label"])[0], k["w"].to_numpy(), np.flatnonzero(np.diff(c, prepend=-1))) for k in kinds.values())
    a, b, types = len(fs), len(fm), {x: np.min_scalar_type(len(k)) for x, k in kinds.items()}
    counted = len(ws) * len(wm) <= CELLS

    def entropy(p: np.ndarray) -> float:
        p = p[p > 0]
        return float(-(p * np.log(p)).sum())

    def read(packs: pd.DataFrame, layer: str) -> tuple[np.ndarray, np.ndarray]:
        many, found = (np.frombuffer(b"".join(packs[f"{layer}_{c}"]), types[layer]) for c in ("many", "kinds"))
        return many, found

    def information(dealt: np.ndarray, service: tuple[np.ndarray, np.ndarray], model: tuple[np.ndarray, int, list[np.ndarray]]) -> float:
        (many, own), (codes, sets, tables), start = service, model, 0
        total = np.zeros(len(ws) * len(wm), np.int64) if counted else np.zeros(a * b)
        for low in range(0, len(dealt), CHUNK):
            met = np.repeat(codes[dealt[low : low + CHUNK]].astype(np.int64), many[low : low + CHUNK])
            s = own[start : start + len(met)].astype(np.int64)
            start += len(met)
            if counted:
                s *= len(wm)
            # each service row of a position meets the model rows dealt to it, the k-th of all at once
            for table, before in zip(tables, [sets, *map(len, tables)]):
                if len(table) < before:
                    has = np.flatnonzero(met < len(table))
                    s, met = s[has], met[has]
                m = table[met]
                if counted:
                    total += np.bincount(s + m, minlength=len(total))
                else:
                    total += np.bincount(ls[s] * b + lm[m], ws[s] * wm[m], len(total))
        joint = np.add.reduceat(np.add.reduceat(total.reshape(len(ws), -1) * ws[:, None] * wm, fs), fm, axis=1) if counted else total.reshape(a, b)
        joint = joint / joint.sum()
        return entropy(joint.sum(1)) + entropy(joint.sum(0)) - entropy(joint.ravel())

    parts = min(max(spark.sparkContext.defaultParallelism * 2, 1), count + 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packs = pd.concat([pd.DataFrame(), *batches])
        if packs.empty:
            return
        first, packs = int(packs["part"].iloc[0]) - 1, packs.sort_values("chunk")
        service, model = read(packs, SERVICE), _sets(*read(packs, MODEL))
        del packs
        n = len(service[0])
        for draw in range(first, count, parts):
            dealt = order(f"{seed}|{draw}|".encode(), n) if draw >= 0 else np.arange(n)
            yield pd.DataFrame({"draw": [draw], "mi": [information(dealt, service, model)]})

    sent = _packed(kept, kinds).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return sent.repartitionById(parts, "part").mapInPandas(deal, "draw long, mi double")


def permutation_test(table: DataFrame) -> DataFrame:
    """observed, permutations, p_value of a ``permutation_table``; a draw that equals the observed value counts, whatever the last digits."""
    observed = table.filter("draw < 0").select(F.round("mi", 12).alias("observed"))
    dealt = table.filter("draw >= 0").crossJoin(F.broadcast(observed))
    return dealt.groupBy("observed").agg(F.count("*").alias("permutations"), ((1 + F.count_if(F.round("mi", 12) >= F.col("observed"))) / (1 + F.count("*"))).alias("p_value"))


def service_diversity(joint: DataFrame) -> DataFrame:
    """service, its share, the effective number of models given it, and its top model with that one's share."""
    of = joint.withColumn("share", F.sum("joint").over(Window.partitionBy("service"))).withColumn("p", F.col("joint") / F.col("share"))
    first = F.row_number().over(Window.partitionBy("service").orderBy(F.desc(F.round("p", 12)), "model"))
    return of.withColumn("place", first).groupBy("service").agg(
        F.max("share").alias("service_share"),
        F.exp(-F.sum(F.col("p") * F.ln("p"))).alias("effective_models"),
        F.max(F.when(F.col("place") == 1, F.col("model"))).alias("top_model"),
        F.max("p").alias("top_model_share"),
    )


def composition(spaces: DataFrame, matched: DataFrame, continuous: tuple[str, ...], binary: tuple[str, ...]) -> DataFrame:
    """metric, metric_type, matched and other values, difference, standardized difference, counts."""
    flags = spaces.join(matched.select("space_id", F.lit(1).alias("in")), "space_id", "left").withColumn("in", F.coalesce("in", F.lit(0)))
    long = flags.select("in", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("continuous" if c in continuous else "binary").alias("metric_type"), F.col(c).cast("double").alias("x")) for c in (*continuous, *binary)])).alias("v")).select("in", "v.*")
    one, other = F.when(F.col("in") == 1, F.col("x")), F.when(F.col("in") == 0, F.col("x"))
    got = long.groupBy("metric", "metric_type").agg(F.avg(one).alias("a"), F.avg(other).alias("b"), F.var_samp(one).alias("va"), F.var_samp(other).alias("vb"), F.count(one).alias("matched_n"), F.count(other).alias("nonmatched_n"))
    spread = F.when(F.col("metric_type") == "binary", F.sqrt((F.col("a") * (1 - F.col("a")) + F.col("b") * (1 - F.col("b"))) / 2)).otherwise(F.sqrt((F.col("va") + F.col("vb")) / 2))
    return got.select("metric", "metric_type", F.col("a").alias("matched_value"), F.col("b").alias("nonmatched_value"), (F.col("a") - F.col("b")).alias("difference"), F.try_divide(F.col("a") - F.col("b"), spread).alias("standardized_difference"), "matched_n", "nonmatched_n")

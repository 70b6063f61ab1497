"""The registered queries: each operator bound to the roles of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import source_code, text as T
from tessera.operators import concentration as C, history as H, paired as P, resampling as R, similarity as S, validation as V, variants as X
from tessera.plans import derived
from tessera.plans.roles import CODE_SIGNATURE, CUTOFFS, HUB_LINKED, PACKAGE, SPECS, Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEED, DRAWS = 20260831, 20
#: The study's numbers of resamples and permutations, for the queries that no SQL fixes.
FULL_DRAWS, PERMUTATIONS = 2_000, 10_000
SPANS = (0, 365, 730, 1460)
THRESHOLDS = (85, 90, 95)
TARGETS = {"en": 40, "es": 30, "fr": 20, "de": 10}


def query(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
    return f


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, counts as longs: the same values in every engine."""
    kinds = {"double": lambda c: F.round(c, digits), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def layer(roles: Roles, name: str) -> DataFrame:
    return roles.edges().filter(F.col("layer") == name)


@query
def fractional_ranking_service(r):
    return tidy(C.ranking(C.fractional_weights(layer(r, "service"))))


@query
def fractional_ranking_combined(r):
    return tidy(C.ranking(C.fractional_weights(r.edges())))


@query
def fractional_ranking_weighted(r):
    weighted = layer(r, "service").join(r.spaces().select("space_id", "author_weight"), "space_id")
    return tidy(C.ranking(C.fractional_weights(weighted, base="author_weight")))


@query
def concentration_summary_specs(r):
    return tidy(C.concentration(C.with_specs(r.edges(), SPECS), by=("analysis",)), 7).drop("top_label")


@query
def gini_by_layer(r):
    return tidy(C.concentration(r.edges(), by=("layer",)).select("layer", "gini"), 7)


@query
def shannon_by_layer(r):
    return tidy(C.concentration(r.edges(), by=("layer",)).select("layer", "shannon", F.exp("shannon").alias("effective")), 7)


@query
def family_ranking(r):
    return tidy(C.ranking(C.fractional_weights(layer(r, "model"), label="evidence_type")))


@query
def hhi_bootstrap_ci(r):
    return tidy(R.interval(P.hhi_draws(layer(r, "service"), DRAWS, SEED), "hhi"))


@query
def hhi_bootstrap_ci_full(r):
    return tidy(R.interval(P.hhi_table(layer(r, "service"), FULL_DRAWS, SEED), "hhi"))


@query
def fractional_matrix_long(r):
    return tidy(C.fractional_weights(layer(r, "service")).select("space_id", "label", "w"))


@query
def matched_projects(r):
    return P.matched_projects(r.edges())


@query
def paired_layer_point(r):
    return tidy(P.paired_estimate(r.edges()), 7)


@query
def paired_layer_bootstrap_draws(r):
    return tidy(P.paired_draws(r.edges(), DRAWS, SEED))


@query
def paired_layer_bootstrap_ci(r):
    drawn = P.paired_draws(r.edges(), DRAWS, SEED)
    both = R.interval(drawn, "hhi_difference").crossJoin(drawn.agg((F.count_if(F.col("hhi_difference") > 0) / F.count("*")).alias("dominance")))
    return tidy(both)


@query
def paired_layer_bootstrap_ci_full(r):
    drawn = S.settle(P.paired_table(r.edges(), FULL_DRAWS, SEED), "paired-draws")
    return tidy(R.interval(drawn, "hhi_difference").crossJoin(drawn.agg((F.count_if(F.col("hhi_difference") > 0) / F.count("*")).alias("dominance"))))


@query
def paired_weighted_estimate(r):
    weighted = r.edges().join(r.spaces().select("space_id", "author_weight"), "space_id")
    return tidy(P.paired_estimate(weighted, base="author_weight"), 7)


@query
def codeclaration_joint(r):
    return tidy(P.codeclaration(P.matched_weights(r.edges())))


@query
def codeclaration_service_diversity(r):
    return tidy(P.service_diversity(P.codeclaration(P.matched_weights(r.edges()))), 7)


@query
def mutual_information(r):
    return tidy(P.mutual_information(P.codeclaration(P.matched_weights(r.edges()))))


@query
def permutation_null(r):
    return tidy(P.permutation_null(P.matched_weights(r.edges()), 5, SEED))


@query
def permutation_p(r):
    weights = P.matched_weights(r.edges())
    observed = P.mutual_information(P.codeclaration(weights)).select(F.col("mi").alias("observed"))
    null = P.permutation_null(weights, 5, SEED)
    return tidy(null.crossJoin(F.broadcast(observed)).groupBy("observed").agg(((1 + F.count_if(F.col("mi") >= F.col("observed"))) / (1 + F.count("*"))).alias("p_value")))


@query
def permutation_null_full(r):
    return tidy(P.permutation_table(P.matched_weights(r.edges()), PERMUTATIONS, SEED).filter("draw >= 0"))


@query
def permutation_p_full(r):
    return tidy(P.permutation_test(S.settle(P.permutation_table(P.matched_weights(r.edges()), PERMUTATIONS, SEED), "permutations")))


@query
def matched_composition(r):
    spaces = r.spaces().select(
        "space_id",
        F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("created_at")).alias("age_days"),
        F.log1p("likes").alias("log_likes"),
        (F.col("likes") >= 1).cast("int").alias("liked"),
        (F.col("runtime_stage") == "O").cast("int").alias("running"),
        (F.col("sdk") == "1-URGENT").cast("int").alias("urgent"),
    )
    return tidy(P.composition(spaces, P.matched_projects(r.edges()), ("age_days", "log_likes"), ("liked", "running", "urgent")), 7)


@query
def unknown_boundary(r):
    candidates = layer(r, "runtime").filter("provider_basis = 'unmapped_public_namespace'").select("space_id", F.col("evidence_type").alias("candidate_type"), F.col("provider").alias("identifier"))
    estimated = P.paired_estimate(X.unknown_boundary(r.edges(), candidates), by=("variant",))
    return tidy(estimated.select("variant", "matched_projects", "service_categories", "service_hhi", "model_hhi", "hhi_difference"))


@query
def namespace_variants(r):
    return tidy(P.paired_estimate(X.namespace_treatments(r.edges()), by=("variant",)).select("variant", "matched_projects", "model_categories", "service_hhi", "model_hhi", "hhi_difference"))


@query
def search_union_cutoffs(r):
    return tidy(X.search_frames(r.rankings(), CUTOFFS).groupBy("variant").agg(F.count("*").alias("projects")))


def _framed(r: Roles, frames: DataFrame) -> DataFrame:
    return r.edges().join(frames, "space_id")


@query
def search_cutoff_concentration(r):
    found = C.concentration(_framed(r, X.search_frames(r.rankings(), CUTOFFS)), by=("variant", "layer"))
    return tidy(found.select("variant", "layer", "projects", "providers", "hhi", "gini"), 7)


@query
def query_ablation(r):
    estimated = P.paired_estimate(_framed(r, X.without_each(r.rankings(), "query")), by=("variant",))
    return tidy(estimated.select("variant", "matched_projects", "service_hhi", "model_hhi", "hhi_difference"))


@query
def arm_overlap(r):
    return tidy(X.arm_overlap(r.rankings()))


@query
def leave_one_provider_out(r):
    return tidy(P.without_each_provider(r.edges()).select("variant", "matched_projects", "service_hhi", "model_hhi", "hhi_difference"))


def _with_each_provider_out(estimates: DataFrame, edges: DataFrame) -> DataFrame:
    return estimates.unionByName(P.without_each_provider(edges).withColumn("family", F.lit("leave_one_provider_out")))


def robustness(r: Roles) -> DataFrame:
    edges = r.edges()
    cols = ("family", "variant", "space_id", "provider", "layer")
    name = lambda df, family: df.withColumn("family", F.lit(family)).withColumn("variant", F.col("variant").cast("string")).select(*cols)
    rankings = r.rankings()
    arms = rankings.select(F.col("arm").alias("variant"), "space_id").distinct()
    runs = [
        name(edges.withColumn("variant", F.lit("primary")), "primary"),
        name(X.evidence_filters(edges), "evidence"),
        name(X.namespace_treatments(edges), "model_taxonomy"),
        name(_framed(r, X.search_frames(rankings, CUTOFFS)), "rank_cutoff"),
        name(_framed(r, X.without_each(rankings, "query")), "leave_one_query_out"),
        name(_framed(r, arms), "search_arm"),
    ]
    return _with_each_provider_out(P.paired_estimate(X.union_all(runs), by=("family", "variant")), edges)


@query
def robustness_matrix(r):
    return tidy(robustness(r).select("family", "variant", "matched_projects", "service_hhi", "model_hhi", "hhi_difference"))


@query
def robustness_ranges(r):
    return tidy(X.ranges(robustness(r), "family", "hhi_difference"))


@query
def exact_bundle_clusters(r):
    return tidy(_bundles(r))


def _bundles(r: Roles) -> DataFrame:
    files = r.table("documents").select(F.col("doc_id").alias("space_id"), F.explode(F.split("text", "\n")).alias("line"))
    return S.exact_bundles(files.select("space_id", F.sha2("line", 256).alias("sha256")))


def _base_weights(r: Roles) -> DataFrame:
    """family, variant, space_id, base_weight: likes, and the clusters of source reuse."""
    spaces = r.spaces()
    near = _source_assignments(r)
    one = lambda df, family, variant, weight: df.select(F.lit(family).alias("family"), F.lit(variant).alias("variant"), "space_id", weight.cast("double").alias("base_weight"))
    return X.union_all(
        [
            one(spaces, "weighting", "likes_plus_one", F.col("likes") + 1),
            one(_bundles(r), "source_reuse", "exact_multifile_cluster", F.col("cluster_weight")),
            near.select(F.lit("source_reuse").alias("family"), F.format_string("near_duplicate_jaccard_%03d", "threshold").alias("variant"), "space_id", F.col("cluster_weight").alias("base_weight")),
            one(spaces, "source_reuse", "author_cluster", F.col("author_weight")),
        ]
    )


def robustness_full(r: Roles) -> DataFrame:
    """The study's whole matrix: every family and variant, each with its projects' base weights."""
    edges, rankings = r.edges(), r.rankings()
    weights = S.settle(_base_weights(r), "base-weights")
    cols = ("family", "variant", "space_id", "provider", "layer", "base_weight")

    def name(df: DataFrame, family: str, weight: Column | None = None) -> DataFrame:
        return df.withColumns({"family": F.lit(family), "variant": F.col("variant").cast("string"), "base_weight": F.lit(1.0) if weight is None else weight}).select(*cols)

    arms = rankings.select(F.col("arm").alias("variant"), "space_id").distinct()
    weighted = [name(X.weighted_projects(edges, weights.filter(F.col("family") == f).drop("family")), f, F.col("base_weight")) for f in ("weighting", "source_reuse")]
    runs = [
        name(edges.withColumn("variant", F.lit("project_equal")), "primary"),
        name(_framed(r, X.search_frames(rankings, CUTOFFS)), "rank_cutoff"),
        name(_framed(r, X.without_each(rankings, "query")), "leave_one_query_out"),
        name(X.evidence_types(edges, HUB_LINKED, CODE_SIGNATURE, PACKAGE), "evidence"),
        name(_framed(r, arms), "search_arm"),
        name(X.immediate_namespace(edges), "model_taxonomy"),
        name(X.namespace_treatments(edges), "model_taxonomy"),
        *weighted,
    ]
    return _with_each_provider_out(P.paired_estimate(X.union_all(runs), by=("family", "variant"), base="base_weight"), edges)


@query
def robustness_matrix_full(r):
    return tidy(robustness_full(r).select("family", "variant", "matched_projects", "service_hhi", "model_hhi", "hhi_difference"))


@query
def robustness_ranges_full(r):
    return tidy(X.ranges(robustness_full(r), "family", "hhi_difference"))


def _shingles(r: Roles) -> DataFrame:
    return S.shingle_sets(r.table("documents").select(F.col("doc_id").alias("space_id"), "text"))


@query
def shingle_counts(r):
    return _shingles(r).groupBy("space_id").agg(F.count("*").alias("shingles"), (F.count("*") >= 50).alias("eligible"))


@query
def jaccard_pairs(r):
    return tidy(S.jaccard_pairs(_shingles(r), 0.85))


@query
def similarity_clusters(r):
    return tidy(S.similarity_clusters(S.settle(S.jaccard_links(_shingles(r), 0.85), "links"), (90,)))


@query
def similarity_sensitivity(r):
    found = S.similarity_clusters(S.settle(S.jaccard_links(_shingles(r), 0.85), "links"), (85, 90, 95))
    return tidy(found.groupBy("threshold").agg(F.count("*").alias("clustered"), F.countDistinct("component").alias("clusters"), F.max("cluster_size").alias("largest")))


def _source_shingles(r: Roles) -> DataFrame:
    """space_id, shingle of each source's normalised tokens."""
    return r.table("documents").select(F.col("doc_id").alias("space_id"), F.explode(source_code.token_shingles(F.col("text"))).alias("shingle"))


def _source_assignments(r: Roles) -> DataFrame:
    shingles = S.settle(_source_shingles(r), "source-shingles")
    pairs = S.settle(S.jaccard_links(shingles, 0.85), "links")
    return S.assignments(r.table("documents").select(F.col("doc_id").alias("space_id")), pairs, shingles.groupBy("space_id").agg(F.count("*").alias("shingles")), THRESHOLDS)


@query
def source_shingle_counts(r):
    projects = r.table("documents").select(F.col("doc_id").alias("space_id"))
    counted = projects.join(_source_shingles(r).groupBy("space_id").agg(F.count("*").alias("shingles")), "space_id", "left").fillna(0, ["shingles"])
    return counted.withColumn("eligible", F.col("shingles") >= 50)


@query
def source_jaccard_pairs(r):
    return tidy(S.jaccard_pairs(_source_shingles(r), 0.85))


@query
def source_similarity_clusters(r):
    return tidy(_source_assignments(r))


@query
def source_similarity_sensitivity(r):
    given = S.settle(_source_assignments(r), "assignments")
    many = F.col("cluster_size") > 1
    counts = given.groupBy("threshold").agg(F.count_if("eligible").alias("eligible_projects"), F.count_if(many).alias("clustered_projects"), F.countDistinct(F.when(many, F.col("cluster_id"))).alias("non_singleton_clusters"), F.max("cluster_size").alias("largest_cluster"), F.sum("cluster_weight").alias("effective_project_clusters"))
    weights = given.select(F.col("threshold").alias("variant"), "space_id", F.col("cluster_weight").alias("base_weight"))
    edges = X.weighted_projects(r.edges(), weights).withColumnRenamed("variant", "threshold")
    of = lambda df: C.indices(C.ranking(C.fractional_weights(df, by=("threshold",), base="base_weight"), ("threshold",)), ("threshold",))
    combined = of(edges).select("threshold", F.col("hhi").alias("combined_hhi"), F.col("top_label").alias("combined_top_provider"), F.col("top1_share").alias("combined_top_share"))
    providers = of(edges.filter(F.col("layer").isin("service", "model"))).select("threshold", F.col("hhi").alias("provider_only_hhi"))
    return tidy(counts.join(combined, "threshold").join(providers, "threshold"))


@query
def signal_intersections(r):
    return X.signal_intersections(r.edges())


@query
def topk_other_mosaic(r):
    return tidy(X.mosaic(P.codeclaration(P.matched_weights(r.edges()))))


@query
def evidence_source_audit(r):
    of = r.edges().groupBy("evidence_type", "space_id").agg(F.bool_or(F.col("confidence") == "high").alias("high"))
    return of.groupBy("evidence_type").agg(F.count("*").alias("projects"), F.count_if("high").alias("high_projects"), F.count_if(~F.col("high")).alias("medium_only_projects"))


@query
def selection_funnel(r):
    edges, spaces = r.edges(), r.spaces()
    stages = [("candidates", spaces), ("with_edge", spaces.join(edges, "space_id", "left_semi")), ("matched", P.matched_projects(edges))]
    return X.union_all([df.agg(F.count("*").alias("projects")).withColumn("stage", F.lit(name)) for name, df in stages])


@query
def license_summary(r):
    named = r.table("part").select(T.license_name(derived.license(F.col("p_partkey"))).alias("category"))
    classed = named.select(F.explode(F.array(F.struct(F.lit("name").alias("measure"), "category"), F.struct(F.lit("class").alias("measure"), T.license_class(F.col("category")).alias("category")))).alias("x")).select("x.*")
    counted = classed.groupBy("measure", "category").agg(F.count("*").alias("count"))
    return tidy(counted.withColumn("denominator", F.sum("count").over(Window.partitionBy("measure"))).withColumn("share", F.col("count") / F.col("denominator")))


@query
def activity_summary(r):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("created_at"))
    return tidy(r.spaces().agg(F.count("*").alias("projects"), F.count_if(age <= 180).alias("within_180"), F.count_if(age <= 365).alias("within_365"), F.count_if(F.col("runtime_stage") == "O").alias("running"), F.median("likes").alias("median_likes"), F.avg(age).alias("mean_age")))


@query
def coverage_gate(r):
    located = r.table("customer").withColumn("place", T.location(derived.location(F.col("c_custkey"))))
    shares = located.agg(F.count("*").alias("authors"), F.count_if(F.col("place.country_code") != "").alias("located"))
    return tidy(shares.withColumn("coverage", F.col("located") / F.col("authors")).withColumn("status", F.when(F.col("coverage") >= 0.2, "ESTIMABLE").otherwise("NOT_ESTIMABLE")))


@query
def version_transitions(r):
    return H.transitions(r.versions())


@query
def version_hhi_change(r):
    return tidy(H.version_hhi(r.versions()))


@query
def version_span_sensitivity(r):
    return tidy(H.version_hhi(H.by_span(r.versions(), (0, 365, 730, 1460)), by=("min_days",)))


@query
def version_hhi_change_full(r):
    return tidy(H.version_bootstrap(r.versions(), FULL_DRAWS, SEED))


@query
def version_span_sensitivity_full(r):
    return tidy(H.span_bootstrap(r.versions(), SPANS, FULL_DRAWS, SEED))


@query
def file_cap_sensitivity(r):
    return tidy(P.paired_estimate(H.capped(r.edges(), (1, 2, 3)), by=("cap",)).select("cap", "matched_projects", "service_hhi", "model_hhi", "hhi_difference"))


@query
def construct_match(r):
    return r.table("part").select("p_partkey", F.array_join(T.constructs(derived.phrase(F.col("p_partkey"))), ";").alias("strict"), F.array_join(T.constructs(derived.phrase(F.col("p_partkey")), broad=True), ";").alias("broad"))


@query
def model_provider_map(r):
    found = T.model_provider(derived.model(F.col("p_partkey")), derived.bases(F.col("p_partkey")))
    return r.table("part").select("p_partkey", found["provider"].alias("provider"), found["basis"].alias("basis"))


@query
def model_family_map(r):
    return r.table("part").select("p_partkey", T.model_family(derived.model(F.col("p_partkey")), derived.bases(F.col("p_partkey"))).alias("family"))


@query
def license_text_detect(r):
    return r.table("documents").select("doc_id", T.license_in_text(F.col("text")).alias("license"))


@query
def license_flag(r):
    app = T.license_class(T.license_name(derived.license(F.col("p_partkey"))))
    upstream = F.transform(derived.upstream(F.col("p_partkey")), lambda x: T.license_class(T.license_name(x)))
    return r.table("part").select("p_partkey", app.alias("app_class"), T.rights_flag(app, upstream).alias("flag"))


@query
def url_domain_candidates(r):
    return r.table("pages").select("page_id", F.array_join(T.api_domains(derived.code(F.col("page_id"))), ";").alias("domains"), F.array_join(T.credentials(derived.code(F.col("page_id"))), ";").alias("credentials"), T.is_placeholder_domain(F.regexp_extract("url", r"^https?://([^/:]+)", 1)).alias("placeholder"))


@query
def repo_links(r):
    return r.table("part").select("p_partkey", F.array_join(T.repositories(derived.prose(F.col("p_partkey"))), ";").alias("repositories"))


@query
def language_orientation(r):
    found = T.language_orientation(derived.tags(F.col("p_partkey")), F.array().cast("array<string>"))
    return r.table("part").select("p_partkey", found["language_class"].alias("language_class"), found["language_codes"].alias("language_codes"))


@query
def location_class(r):
    place = T.location(derived.location(F.col("c_custkey")))
    return r.table("customer").select("c_custkey", place["region_class"].alias("region_class"), place["country_code"].alias("country_code"))


@query
def requirements_packages(r):
    return r.table("part").select("p_partkey", F.array_join(T.requirement_packages(derived.requirements(F.col("p_partkey"))), ";").alias("packages"))


def _files(r: Roles) -> DataFrame:
    """project, path, text, app_file: three derived files for each part."""
    key = F.col("p_partkey")
    files = F.array(F.struct(F.lit("app.py").alias("path"), derived.code(key).alias("text")), F.struct(F.lit("requirements.txt").alias("path"), derived.requirements(key).alias("text")), F.struct(F.lit("pyproject.toml").alias("path"), derived.toml(key).alias("text")))
    return r.table("part").select(key.alias("project"), F.explode(files).alias("f"), F.lit("app.py").alias("app_file")).select("project", "f.*", "app_file")


@query
def provider_signals(r):
    return source_code.provider_signals(_files(r))


@query
def unmapped_candidates(r):
    return source_code.unmapped_candidates(_files(r))


@query
def executable_text(r):
    return source_code.executable_text(_files(r)).select("project", "path", F.length("code").alias("chars"), F.md5("code").alias("digest"))


@query
def selected_files(r):
    return source_code.select_files(_files(r), 2)


@query
def pyproject_groups(r):
    return r.table("part").select("p_partkey", source_code.toml_groups(derived.toml(F.col("p_partkey"))).alias("g")).select("p_partkey", "g.*")


@query
def decode_roundtrip(r):
    rows = r.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("content")).withColumn("d", source_code.decode_bytes("content"))
    return rows.select("doc_id", F.col("d.source_encoding").alias("source_encoding"), source_code.round_trips("d.text", "d.source_encoding", "content").alias("intact"))


@query
def stable_sample(r):
    docs = r.table("documents").select("doc_id", "lang")
    return tidy(V.stable_sample(docs, TARGETS, "lang", "doc_id", "relevance"))


@query
def balanced_sample(r):
    return V.balanced_sample(r.table("part").select("p_partkey", "p_brand"), 60, "p_brand", "p_partkey", "provider", least=2)


@query
def negative_allocation(r):
    return tidy(V.allocate(r.table("documents").groupBy("lang").agg(F.count("*").alias("n")), 80))


@query
def blind_ids(r):
    return V.blind_ids(r.table("nation").select("n_nationkey"), "E", "n_nationkey", "blind")


@query
def kappa(r):
    return tidy(V.cohen_kappa(r.reviews(), by=("stratum",)))


@query
def review_resolution(r):
    return r.reviews().select("sample_id", V.resolved(F.col("r1"), F.col("r2"), F.lit("")).alias("resolved"))


def _items(r: Roles) -> DataFrame:
    yes = lambda c: (F.col(c) == "yes").cast("int")
    return r.reviews().select("sample_id", "stratum", "pi", yes("r1").alias("predicted"), yes("r2").alias("actual"))


@query
def weighted_precision_recall(r):
    return tidy(V.weighted_quality(_items(r)), 7)


@query
def stratified_bootstrap(r):
    drawn = V.stratified_draws(_items(r), DRAWS, SEED)
    return tidy(R.interval(V.weighted_quality(drawn, by=("draw",), weight=F.col("m") / F.col("pi")), "precision"), 7)


@query
def stratified_bootstrap_full(r):
    return tidy(R.interval(V.precision_table(_items(r), FULL_DRAWS, SEED), "precision"), 7)


@query
def audit_checks(r):
    ranked = C.ranking(C.fractional_weights(r.edges(), by=("layer",)), ("layer",))
    total = ranked.groupBy("layer").agg(F.sum("share").alias("total"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.count("*").alias("k"))
    return V.gate(total, {"shares_sum_to_one": F.bool_and(F.abs(F.col("total") - 1) < 1e-9), "hhi_at_least_even": F.bool_and(F.col("hhi") >= 1 / F.col("k") - 1e-12), "hhi_at_most_one": F.bool_and(F.col("hhi") <= 1), "all_layers": F.count("*") == 3})


from tessera.plans import audits  # noqa: E402,F401  registers its queries

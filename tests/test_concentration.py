import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import concentration as C, history as H, paired as P, similarity as S, validation as V, variants as X

EDGES = "space_id long, provider string, layer string"


def one(df):
    return df.collect()[0]


def test_fractional_ranking_splits_a_project_between_its_labels(spark):
    edges = spark.createDataFrame([(1, "P1", "service"), (1, "P2", "service"), (1, "P2", "service"), (2, "P1", "service"), (3, "", "service"), (4, None, "service")], EDGES)
    got = {r.label: r for r in C.ranking(C.fractional_weights(edges)).collect()}
    assert (got["P1"].weight, got["P2"].weight) == (1.5, 0.5)
    row = one(C.concentration(edges))
    assert (row.projects, row.providers, row.hhi, row.top_label) == (2, 2, 0.625, "P1")


def test_empty_edges_have_no_indices(spark):
    row = one(C.concentration(spark.createDataFrame([], EDGES)))
    assert (row.projects, row.providers, row.hhi) == (0, 0, None)


def test_gini_and_entropy(spark):
    edges = spark.createDataFrame([(i, f"P{i}", "service") for i in range(4)], EDGES)
    row = one(C.concentration(edges))
    assert abs(row.gini) < 1e-12 and abs(row.shannon - math.log(4)) < 1e-12


def test_paired_layers(spark):
    edges = spark.createDataFrame([(i, "S", "service") for i in range(4)] + [(i, f"M{i}", "model") for i in range(4)] + [(9, "S", "service")], EDGES)
    row = one(P.paired_estimate(edges))
    assert (row.matched_projects, row.service_hhi, row.model_hhi, row.hhi_difference, row.model_top_share) == (4, 1.0, 0.25, 0.75, 0.25)


def test_leave_one_provider_out_removes_projects(spark):
    edges = spark.createDataFrame([(i, "S1" if i < 2 else "S2", "service") for i in range(4)] + [(i, f"M{i}", "model") for i in range(4)], EDGES)
    got = {r.variant: r for r in P.paired_estimate(X.leave_one_provider_out(edges), by=("variant",)).collect()}
    assert (got["S1"].matched_projects, got["S1"].service_hhi, got["S1"].model_hhi) == (2, 1.0, 0.5)


def test_leave_one_provider_out_by_subtraction(spark):
    rows = [(i, f"S{i % 3}", "service") for i in range(30)] + [(i, f"S{i % 4}", "service") for i in range(20)] + [(i, f"M{i % 5}", "model") for i in range(25)]
    rows += [(i, f"M{i % 2}", "model") for i in range(12)] + [(90, "alone", "service"), (91, "M9", "model"), (92, "", "service"), (92, "M1", "model"), (93, None, "model"), (1, "r", "runtime")]
    edges = spark.createDataFrame(rows, EDGES)
    want = {r.variant: r.asDict() for r in P.paired_estimate(X.leave_one_provider_out(edges), by=("variant",)).collect()}
    got = {r.variant: r.asDict() for r in P.without_each_provider(edges).collect()}
    assert got.keys() == want.keys() == {"S0", "S1", "S2", "S3", "alone"}
    for name, row in want.items():
        assert got[name].keys() == row.keys()
        assert all(abs(got[name][c] - v) < 1e-9 if isinstance(v, float) else got[name][c] == v for c, v in row.items()), name
    # a provider that all matched projects use leaves none
    assert P.without_each_provider(spark.createDataFrame([(1, "S", "service"), (1, "M", "model")], EDGES)).count() == 0


def test_codeclaration_sums_to_one(spark):
    edges = spark.createDataFrame([(1, "S1", "service"), (2, "S2", "service"), (1, "M1", "model"), (2, "M2", "model")], EDGES)
    joint = P.codeclaration(P.matched_weights(edges))
    assert joint.agg(F.sum("joint")).first()[0] == 1.0
    assert abs(one(P.mutual_information(joint)).nmi - 1) < 1e-12


def test_namespace_treatments(spark):
    edges = spark.createDataFrame([(i, "S", "service", "") for i in "abc"] + [("a", "M", "model", "model_namespace"), ("b", "x", "model", "unmapped_public_namespace"), ("c", "y", "model", "unmapped_public_namespace")], "space_id string, provider string, layer string, provider_basis string")
    got = {r.variant: r.matched_projects for r in P.paired_estimate(X.namespace_treatments(edges), by=("variant",)).collect()}
    assert got == {"disaggregated": 3, "pooled": 3, "mapped_only": 1}


def test_search_union(spark):
    rows = [(q, a, r, f"{q}{a}{r}" if r > 1 else "x") for q in "pq" for a in ("likes", "createdAt") for r in (1, 2, 3)]
    ranks = spark.createDataFrame(rows, "query string, arm string, rank int, space_id string")
    assert {r.variant: r.n for r in X.search_frames(ranks, (1, 3)).groupBy("variant").agg(F.count("*").alias("n")).collect()} == {1: 1, 3: 9}


def test_exact_bundles_and_similarity(spark):
    files = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"), ("c", "1")], "space_id string, sha256 string")
    assert {r.space_id: r.cluster_size for r in S.exact_bundles(files).collect()} == {"a": 2, "b": 2, "c": 1}
    sets = [("a", f"s{i}") for i in range(100)] + [("b", f"s{i}") for i in range(5, 105)] + [("c", f"t{i}") for i in range(60)]
    pairs = S.jaccard_pairs(spark.createDataFrame(sets, "space_id string, shingle string"), 0.85)
    assert [(r.left_id, r.right_id, r.intersection, r.union_size) for r in pairs.collect()] == [("a", "b", 95, 105)]
    assert S.jaccard_pairs(spark.createDataFrame(sets, "space_id string, shingle string"), 0.95).count() == 0


def test_transitions_and_version_hhi(spark):
    rows = [(1, [], []), (2, ["A"], ["A"]), (3, [], ["A"]), (4, ["A"], []), (5, ["A", "B"], ["B"])]
    v = spark.createDataFrame(rows, "project int, initial array<string>, current array<string>")
    assert {r.transition for r in H.transitions(v).collect()} == {"no_signal", "same", "added", "removed", "changed"}
    row = one(H.version_hhi(v))
    assert (row.paired_projects, row.initial_hhi, row.current_hhi) == (2, 0.625, 0.5)


def test_kappa_and_resolution(spark):
    r = spark.createDataFrame([("1", "yes", "yes"), ("2", "no", "no"), ("3", "uncertain", "uncertain")], "sample_id string, r1 string, r2 string")
    assert one(V.cohen_kappa(r)).kappa == 1.0
    assert [x.sample_id for x in V.unresolved_ids(r).collect()] == ["3"]


def test_stable_sample_ignores_row_order(spark):
    rows = [(i, "a") for i in range(50)]
    frames = [spark.createDataFrame(x, "id int, s string") for x in (rows, rows[::-1])]
    got = [sorted(r.id for r in V.stable_sample(f, {"a": 7}, "s", "id", "x").collect()) for f in frames]
    assert got[0] == got[1] and len(got[0]) == 7


def test_wrong_weights_fail(spark):
    rows = [(1, "S", "service", 1.0), (1, "M", "model", 1.0), (2, "S", "service", None), (2, "M", "model", None)]
    schema = f"{EDGES}, weight double"
    assert one(P.paired_estimate(spark.createDataFrame(rows, schema), base="weight")).matched_projects == 2
    for wrong in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            P.paired_estimate(spark.createDataFrame([*rows, (3, "S", "service", wrong), (3, "M", "model", wrong)], schema), base="weight").collect()


def test_equal_sets_are_pairs(spark):
    base = [f"t{i}" for i in range(100)]
    sets = {1: base, 2: base, 3: base, 4: [*base[:95], *"abcde"], 5: base[:85], 6: base[:84], 7: base[:40], 8: base[:40]}
    table = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "space_id long, shingle string")
    big = [i for i, s in sets.items() if len(s) >= 50]
    want = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a in big for b in big if a < b}
    want = {k: v for k, v in want.items() if v >= 0.85}
    assert {(r.left_id, r.right_id): r.jaccard for r in S.jaccard_pairs(table, 0.85).collect()} == want and (5, 6) in want and (1, 5) in want
    links = S.jaccard_links(table, 0.85).collect()
    assert {r.node for r in S.connected(S.jaccard_links(table, 0.85)).collect() if r.component == 1} == {1, 2, 3, 4, 5, 6} and len(links) < len(want)

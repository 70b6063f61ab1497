"""Queries without SQL, held against brute force on the smallest tables."""

import hashlib
import re
from collections import defaultdict

import pandas as pd
import pytest

from tessera.plans.queries import QUERIES
from tessera.plans.roles import Roles

DATA = "/root/testdata/sf0.001"


def brute_paired(edges, weight):
    """Matched projects, both layers' HHI; edges are (project, layer, provider)."""
    labels = defaultdict(set)
    for space, layer, provider in edges:
        labels[layer, space].add(provider)
    matched = {s for x, s in labels if x == "service"} & {s for x, s in labels if x == "model"}
    out = [len(matched)]
    for layer in ("service", "model"):
        sums = defaultdict(float)
        for s in matched:
            for p in labels[layer, s]:
                sums[p] += weight(s) / len(labels[layer, s])
        out.append(sum((v / sum(sums.values())) ** 2 for v in sums.values()))
    return (*out, out[1] - out[2])


@pytest.fixture(scope="module")
def roles(spark):
    return Roles(spark, DATA)


def test_robustness_full(spark, roles):
    got = {(r.family, r.variant): (r.matched_projects, r.service_hhi, r.model_hhi, r.hhi_difference) for r in QUERIES["robustness_matrix_full"](spark, DATA).collect()}
    sizes = pd.Series([f for f, _ in got]).value_counts().to_dict()
    assert {k: v for k, v in sizes.items() if k != "leave_one_provider_out"} == {"primary": 1, "rank_cutoff": 4, "leave_one_query_out": 5, "evidence": 4, "weighting": 1, "search_arm": 2, "source_reuse": 5, "model_taxonomy": 4}
    edges = roles.edges().toPandas()
    spaces = roles.spaces().toPandas().set_index("space_id")
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text
    lines = docs.fillna("").map(lambda t: frozenset(t.split("\n")))
    copies = lines.value_counts()
    rows = list(zip(edges.space_id, edges.layer, edges.provider))
    weights = {
        ("primary", "project_equal"): lambda s: 1,
        ("weighting", "likes_plus_one"): lambda s: spaces.likes[s] + 1,
        ("source_reuse", "author_cluster"): lambda s: 1 / (spaces.author == spaces.author[s]).sum(),
        ("source_reuse", "exact_multifile_cluster"): lambda s: 1 / copies[lines[s]] if s in lines.index and len(lines[s]) >= 2 else 1,
    }
    for key, weight in weights.items():
        assert got[key] == pytest.approx(brute_paired(rows, weight), abs=2e-8), key
    named = lambda e: f"namespace:{e.evidence_value.split('/')[0]}" if "/" in e.evidence_value else "namespace:unscoped"
    moved = [(e.space_id, e.layer, named(e) if e.layer == "model" else e.provider) for e in edges.itertuples()]
    assert got["model_taxonomy", "immediate_public_namespace"] == pytest.approx(brute_paired(moved, lambda s: 1), abs=2e-8)
    for variant, layer, kind in (("hub_linked_model_only", "model", "PROMO"), ("service_code_signature_only", "service", "STANDARD"), ("service_package_only", "service", "ECONOMY")):
        kept = [(e.space_id, e.layer, e.provider) for e in edges.itertuples() if e.layer != layer or e.evidence_type == kind]
        assert got["evidence", variant] == pytest.approx(brute_paired(kept, lambda s: 1), abs=2e-8), variant
    assert len({v for k, v in got.items() if k[0] == "source_reuse"}) > 1


def brute_shingles(text):
    """The study's normalisation, by its plain patterns."""
    text = re.sub(r"""(?s)(?:"{3}.*?"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')""", " STR ", text or "")
    text = re.sub(r"(?m)(?<!:)//[^\n]*|#[^\n]*", " ", re.sub(r"(?s)/\*.*?\*/|<!--.*?-->", " ", text))
    tokens = ["NUM" if t[0].isdigit() else t.casefold() for t in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*|\d+(?:\.\d+)?|==|!=|<=|>=|=>|->|::|[^\s]", text)]
    return {"\x1f".join(tokens[i : i + 7]) for i in range(len(tokens) - 6)}


def brute_clusters(ids, pairs):
    """The members of each id's single-linkage cluster."""
    group = {i: {i} for i in ids}
    for a, b in pairs:
        if group[a] is not group[b]:
            joined = group[a] | group[b]
            for x in joined:
                group[x] = joined
    return group


def test_source_similarity(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text
    sets = {i: brute_shingles(t) for i, t in docs.items()}
    ids = sorted(i for i, s in sets.items() if len(s) >= 50)
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b}
    pairs = {k: v for k, v in jaccard.items() if v >= 0.85}
    got = {r.space_id: (r.shingles, r.eligible) for r in QUERIES["source_shingle_counts"](spark, DATA).collect()}
    assert got == {i: (len(s), len(s) >= 50) for i, s in sets.items()}
    got = {(r.left_id, r.right_id): r.jaccard for r in QUERIES["source_jaccard_pairs"](spark, DATA).collect()}
    assert pairs and got == pytest.approx(pairs, abs=1e-8)
    got = {(r.threshold, r.space_id): (r.cluster_id, r.cluster_size, r.cluster_weight, r.eligible) for r in QUERIES["source_similarity_clusters"](spark, DATA).collect()}
    assert len(got) == 3 * len(docs)
    summary = {r.threshold: r for r in QUERIES["source_similarity_sensitivity"](spark, DATA).collect()}
    for t in (85, 90, 95):
        group = brute_clusters(docs.index, [k for k, v in pairs.items() if v >= t / 100])
        for i, members in group.items():
            name = hashlib.sha256("\n".join(sorted(map(str, members))).encode()).hexdigest() if len(members) > 1 else f"unique:{i}"
            assert got[t, i] == (name, len(members), pytest.approx(1 / len(members), abs=1e-8), len(sets[i]) >= 50)
        assert summary[t].clustered_projects == sum(len(m) > 1 for m in group.values()) and summary[t].eligible_projects == len(ids)
        assert summary[t].effective_project_clusters == pytest.approx(len({min(m) for m in group.values()}), abs=1e-6)


def test_sources_that_differ_in_literals_only(spark):
    from tessera.functions.source_code import token_shingles

    one = "\n".join(f"Value{i} = call( 'a{i}' , {i} )  # note {i}\n/* block {i} */ if x{i}==1.5: go('https://x/y')" for i in range(20))
    other = "\n".join(f"value{i}=CALL(\"other \\\" {i}\",{i * 7})\nif X{i} == 22: GO('z') // c" for i in range(20))
    rows = spark.createDataFrame([(1, one), (2, other), (3, None), (4, "'" + "x" * 200_000)], "id long, text string").select("id", token_shingles("text").alias("s")).collect()
    sets = {r.id: set(r.s) for r in rows}
    assert sets[1] == sets[2] and len(sets[1]) > 50 and sets[3] == set() and sets[4] == set()


def brute_draw(seed, draw, n):
    return [int(hashlib.md5(f"{seed}|{draw}|{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]


def brute_hhi(sets):
    sums = defaultdict(float)
    for s in sets:
        for x in s:
            sums[x] += 1 / len(s) / len(sets)
    return sum(v * v for v in sums.values())


def test_version_bootstrap(spark):
    from tessera.operators import history as H

    states = [(i, [f"p{i % 3}"], [f"p{i % 2}", "q"][: 1 + i % 2], 100 * i) for i in range(1, 30)]
    versions = spark.createDataFrame([*states, (40, [], ["p1"], 9000), (41, ["p1"], [], 9000)], "project long, initial array<string>, current array<string>, span_days int")
    got = {r.min_days: r for r in H.span_bootstrap(versions, (0, 365, 5000), 200, 7).collect()}
    for days, r in got.items():
        kept = [x for x in states if x[3] >= days]
        assert r.paired_projects == len(kept)
        if not kept:
            assert (r.hhi_change, r.hhi_change_ci_low, r.hhi_change_ci_high, r.fraction_above_zero) == (None,) * 4
            continue
        changes = []
        for d in range(200):
            taken = [kept[i] for i in brute_draw(7 + days, d, len(kept))]
            changes.append(brute_hhi([x[2] for x in taken]) - brute_hhi([x[1] for x in taken]))
        assert r.hhi_change == pytest.approx(brute_hhi([x[2] for x in kept]) - brute_hhi([x[1] for x in kept]))
        assert (r.hhi_change_ci_low, r.hhi_change_ci_high) == pytest.approx(tuple(pd.Series(changes).quantile([0.025, 0.975])))
        assert r.fraction_above_zero == pytest.approx(sum(c > 1e-12 for c in changes) / 200)
    assert got.keys() == {0, 365, 5000}
    assert [r.min_days for r in QUERIES["version_span_sensitivity_full"](spark, DATA).collect()] == [0, 365, 730, 1460]
    assert {"hhi_change_ci_low", "hhi_change_ci_high", "fraction_above_zero"} < set(QUERIES["version_hhi_change_full"](spark, DATA).columns)


def test_permutations(spark, roles):
    from tessera.operators import paired as P
    from tessera.plans.queries import PERMUTATIONS, SEED

    weights = P.matched_weights(roles.edges()).cache()
    got = {r.draw: r.mi for r in P.permutation_table(weights, 5, SEED).collect()}
    observed = got.pop(-1)
    assert observed == pytest.approx(P.mutual_information(P.codeclaration(weights)).first().mi, abs=1e-12)
    assert got == pytest.approx({r.draw: r.mi for r in P.permutation_null(weights, 5, SEED).collect()}, abs=1e-12)
    whole = QUERIES["permutation_p_full"](spark, DATA).first()
    assert whole.permutations == PERMUTATIONS == 10_000 and whole.p_value >= 1 / 10_001
    # both layers' labels always agree: no permutation comes near
    tied = spark.createDataFrame([(i, x, f"p{i % 4}", 1.0) for i in range(80) for x in ("service", "model")], "space_id long, layer string, label string, w double")
    found = P.permutation_test(P.permutation_table(tied, 999, 1)).first()
    assert found.p_value == pytest.approx(1 / 1000)
    # one label only: every permutation equals the observed value
    single = spark.createDataFrame([(i, x, "p", 1.0) for i in range(8) for x in ("service", "model")], "space_id long, layer string, label string, w double")
    assert P.permutation_test(P.permutation_table(single, 20, 1)).first().p_value == 1
    assert P.permutation_table(weights.limit(0), 5, 1).count() == 0


def test_permutations_pass_the_driver_by(spark, roles, monkeypatch):
    """No table of the projects' rows is collected or broadcast; chunks, sets and weights of any kind give the same draws."""
    from pyspark.sql import functions as F

    from tessera.operators import paired as P
    from tessera.plans.queries import SEED

    frame, seen = type(spark.range(0)), []
    weights = P.matched_weights(roles.edges()).cache()
    # a project's own weights, as many as projects
    uneven = weights.withColumn("w", F.col("w") * (1 + F.col("space_id") % 97)).cache()
    drawn = [{r.draw: r.mi for r in P.permutation_null(w, 3, SEED).collect()} for w in (weights, uneven)]
    labels = weights.select("layer", "label", "w").distinct().count()
    assert labels < weights.count() / 5

    def counted(self, f=frame.toPandas):
        rows = f(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "toPandas", counted)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pytest.fail("broadcast from the driver"))
    got = P.permutation_table(weights, 3, SEED)
    assert {r.draw: r.mi for r in got.collect() if r.draw >= 0} == pytest.approx(drawn[0], abs=1e-12)
    assert seen and max(seen) <= labels
    monkeypatch.setattr(P, "CHUNK", 100)
    for cells in (P.CELLS, 0):
        monkeypatch.setattr(P, "CELLS", cells)
        for w, null in zip((weights, uneven), drawn):
            assert {r.draw: r.mi for r in P.permutation_table(w, 3, SEED).collect() if r.draw >= 0} == pytest.approx(null, abs=1e-12)


def test_permutation_p_passes_the_driver_by(spark, roles, monkeypatch):
    """The whole query broadcasts nothing from Python, and counts the table's draws."""
    from tessera.operators import paired as P
    from tessera.plans import queries

    monkeypatch.setattr(queries, "PERMUTATIONS", 19)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pytest.fail("broadcast from the driver"))
    got = QUERIES["permutation_p_full"](spark, DATA).first()
    dealt = {r.draw: round(r.mi, 12) for r in P.permutation_table(P.matched_weights(roles.edges()), 19, queries.SEED).collect()}
    observed = dealt.pop(-1)
    assert (got.observed, got.permutations) == (pytest.approx(observed, abs=1e-8), 19)
    assert got.p_value == pytest.approx((1 + sum(x >= observed for x in dealt.values())) / 20, abs=1e-8)


def test_full_draws(spark, roles):
    from tessera.plans.queries import FULL_DRAWS, SEED

    edges = roles.edges().filter("layer = 'service'").select("space_id", "provider").distinct().toPandas()
    labels = edges.groupby("space_id").provider.agg(set)
    order = sorted(labels.index, key=lambda i: (i % 64, i))
    assert FULL_DRAWS == 2000
    values = pd.Series([brute_hhi([labels[order[i]] for i in brute_draw(SEED, d, len(order))]) for d in range(FULL_DRAWS)])
    got = QUERIES["hhi_bootstrap_ci_full"](spark, DATA).first()
    assert (got.hhi_ci_low, got.hhi_ci_high) == pytest.approx(tuple(values.quantile([0.025, 0.975])), abs=2e-8)


def test_digests_of_numbered_texts():
    from tessera.functions import digests

    for prefix in (b"", b"7|0|", b"20260831|15|", b"20260831|en|155|", b"x" * 50, b"y" * 60):
        for n in (0, 1, 11, 10_001):
            whole = [hashlib.md5(prefix + b"%d" % i).digest() for i in range(n)]
            assert digests.first_words(prefix, n).tolist() == [int.from_bytes(x[:4], "big") for x in whole]
            assert digests.first_longs(prefix, n).tolist() == [int.from_bytes(x[:8], "big") for x in whole]
            assert digests.order(prefix, n).tolist() == sorted(range(n), key=lambda i: (whole[i], i))
    # groups of blocks, up to numbers whose first 32 bits agree
    whole = [hashlib.md5(b"7|1|%d" % i).digest() for i in range(130_001)]
    assert len({x[:4] for x in whole}) < len(whole)
    assert digests.first_words(b"7|1|", len(whole)).tolist() == [int.from_bytes(x[:4], "big") for x in whole]
    assert digests.order(b"7|1|", len(whole)).tolist() == sorted(range(len(whole)), key=whole.__getitem__)


def test_version_draws_are_not_tabulated(spark):
    """A table of draws and projects has 2,000 times their rows; the draws' sums come without one."""
    from tessera.operators import history as H

    versions = spark.createDataFrame([(i, [f"p{i % 3}"], ["q"], 0) for i in range(9)], "project long, initial array<string>, current array<string>, span_days int")
    drawn = H.version_draws(versions, 3, 7)
    assert not re.findall(r"Exchange hashpartitioning\(draw", drawn._jdf.queryExecution().toString()) and drawn.count() == 3


def test_paired_and_stratified_tables(spark, roles):
    """The whole bootstraps' tables are the drawn rows' estimates, of every metric, weighted or not."""
    from pyspark.sql import functions as F

    from tessera.operators import paired as P, validation as V
    from tessera.plans import audits, queries

    items = queries._items(roles)
    quality = V.weighted_quality(V.stratified_draws(items, 5, 3), by=("draw",), weight=F.col("m") / F.col("pi")).select("draw", "precision")
    pairs = [
        (P.paired_table(roles.edges(), 5, 3), P.paired_metric_draws(roles.edges(), 5, 3)),
        (P.paired_table(audits._by_author(roles), 5, 3, "author_weight"), P.paired_metric_draws(audits._by_author(roles), 5, 3, "author_weight")),
        (V.precision_table(items, 5, 3), quality),
    ]
    for whole, drawn in pairs:
        assert whole.columns == drawn.columns and not re.findall(r"Exchange hashpartitioning\(draw", whole._jdf.queryExecution().toString())
        assert sorted(whole.collect())[4] == pytest.approx(sorted(drawn.collect())[4], abs=1e-11) and whole.count() == 5
    assert P.paired_table(roles.edges().limit(0), 5, 3).count() == 0

"""The registered queries in DuckDB SQL, written apart from the operators they are held against."""

from __future__ import annotations

from tessera.functions import rules
from tessera.plans import derived as D
from tessera.plans.roles import SQL

SEED, DRAWS = 20260831, 20


def _by(by: str, then: str = "") -> str:
    return f"{by}, {then}" if by else then


def _over(by: str) -> str:
    return f"PARTITION BY {by}" if by else ""


def weights(source: str, by: str = "", label: str = "provider", base: str = "") -> str:
    columns = _by(by, f"space_id, {label} AS label" + (f", {base} AS base" if base else ""))
    return f"SELECT {_by(by, 'space_id, label')}, {'coalesce(base, 1.0)' if base else '1.0::DOUBLE'} / count(*) OVER (PARTITION BY {_by(by, 'space_id')}) AS w FROM (SELECT DISTINCT {columns} FROM {source} WHERE coalesce({label}, '') <> '')"


def ranked(source: str, by: str = "") -> str:
    return f"SELECT {_by(by, 'label')}, count(*) AS project_count, sum(w) AS weight, sum(w) / sum(sum(w)) OVER ({_over(by)}) AS share FROM ({source}) GROUP BY {_by(by, 'label')}"


def indices(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {_by(by, 'count(*)')} AS providers, sum(share * share) AS hhi, 1 / sum(share * share) AS effective_number, max(share) AS top1_share,
      sum(share) FILTER (WHERE down <= 3) AS top3_share, 2 * sum(up * weight) / (count(*) * sum(weight)) - (count(*) + 1.0) / count(*) AS gini, -sum(share * ln(share)) AS shannon
    FROM (SELECT *, row_number() OVER ({_over(by)} ORDER BY weight DESC, project_count DESC, label) AS down, row_number() OVER ({_over(by)} ORDER BY weight, label) AS up FROM ({ranked(source, by)})) {group}"""


def matched(source: str, by: str = "") -> str:
    return f"SELECT {_by(by, 'space_id')} FROM {source} WHERE layer IN ('service', 'model') AND coalesce(provider, '') <> '' GROUP BY {_by(by, 'space_id')} HAVING count(DISTINCT layer) = 2"


def matched_weights(source: str, by: str = "", base: str = "") -> str:
    on = " AND ".join(f"e.{c.strip()} = k.{c.strip()}" for c in _by(by, "space_id").split(","))
    kept = f"(SELECT e.* FROM {source} e JOIN ({matched(source, by)}) k ON {on} WHERE e.layer IN ('service', 'model'))"
    return weights(kept, _by(by, "layer"), base=base)


def paired(source: str, by: str = "", base: str = "", columns: str = "") -> str:
    of = lambda layer, c: f"max({c}) FILTER (WHERE layer = '{layer}')"
    sides = ", ".join(f"{of(x, c)} AS {x}_{n}" for x in ("service", "model") for c, n in (("providers", "categories"), ("hhi", "hhi"), ("top1_share", "top_share"), ("shannon", "shannon")))
    w = matched_weights(source, by, base)
    join = " AND ".join(f"i.{c.strip()} = n.{c.strip()}" for c in by.split(",")) if by else "true"
    picked = columns or _by(by, "matched_projects, service_categories, service_hhi, service_top_share, service_shannon, model_categories, model_hhi, model_top_share, model_shannon, hhi_difference, hhi_ratio, top_share_difference, entropy_difference")
    digits = 8 if columns else 7
    out = ", ".join(c.strip() if c.strip() in (by.replace(" ", "")).split(",") else f"round({c.strip()}, {digits}) AS {c.strip()}" if any(x in c for x in ("hhi", "share", "shannon", "ratio", "difference")) else f"CAST({c.strip()} AS BIGINT) AS {c.strip()}" for c in picked.split(","))
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {out} FROM (SELECT i.*, n.matched_projects, service_hhi - model_hhi AS hhi_difference, service_hhi / model_hhi AS hhi_ratio,
      service_top_share - model_top_share AS top_share_difference, model_shannon - service_shannon AS entropy_difference
      FROM (SELECT {_by(by, sides)} FROM ({indices(w, _by(by, 'layer'))}) {group}) i
      JOIN (SELECT {_by(by, 'count(DISTINCT space_id)')} AS matched_projects FROM ({w}) {group}) n ON {join})"""


def positions(source: str) -> str:
    return f"SELECT space_id, row_number() OVER (ORDER BY space_id % 64, space_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT space_id FROM ({source}))"


def index(n: str, *parts: str) -> str:
    return f"(CAST('0x' || substr(md5({" || '|' || ".join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 8) AS BIGINT) % {n})"


def drawn(count: int = DRAWS, seed: int = SEED) -> str:
    """draw, space_id, m from the CTE ``placed``."""
    return f"SELECT draw, p.space_id, m FROM (SELECT draw, {index('n', str(seed), 'draw', 'idx')} AS idx, count(*) AS m FROM placed, range({count}) t(draw) GROUP BY 1, 2) d JOIN placed p USING (idx)"


PAIRED_DRAWS = f"""weighted AS ({matched_weights('edges')}), placed AS ({positions('SELECT * FROM weighted')}), drawn AS ({drawn()}), per AS (
  SELECT draw, layer, sum(s * s) AS hhi FROM (SELECT draw, layer, label, sum(w * m) / sum(sum(w * m)) OVER (PARTITION BY draw, layer) AS s
  FROM weighted JOIN drawn USING (space_id) GROUP BY 1, 2, 3) GROUP BY 1, 2
), both_layers AS (SELECT draw, max(hhi) FILTER (WHERE layer = 'service') AS service_hhi, max(hhi) FILTER (WHERE layer = 'model') AS model_hhi FROM per GROUP BY 1)"""

JOINT = f"""weighted AS ({matched_weights('edges')}), joint AS (
  SELECT service, model, mass / sum(mass) OVER () AS joint FROM (SELECT s.label AS service, m.label AS model, sum(s.w * m.w) AS mass
  FROM weighted s JOIN weighted m ON s.space_id = m.space_id WHERE s.layer = 'service' AND m.layer = 'model' GROUP BY 1, 2))"""


def information(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {_by(by, 'h_service, h_model, h_service + h_model - h_joint')} AS mi, (h_service + h_model - h_joint) / sqrt(h_service * h_model) AS nmi FROM (
      SELECT {_by(by, '-sum(joint * ln(ps))')} AS h_service, -sum(joint * ln(pm)) AS h_model, -sum(joint * ln(joint)) AS h_joint
      FROM (SELECT *, sum(joint) OVER (PARTITION BY {_by(by, 'service')}) AS ps, sum(joint) OVER (PARTITION BY {_by(by, 'model')}) AS pm FROM {source}) {group})"""


NULL = f"""placed AS ({positions('SELECT * FROM weighted')}), moved AS (
  SELECT draw, idx, space_id, row_number() OVER (PARTITION BY draw ORDER BY md5('{SEED}|' || CAST(draw AS VARCHAR) || '|' || CAST(idx AS VARCHAR)), idx) - 1 AS t FROM placed, range(5) r(draw)
), null_joint AS (SELECT draw, service, model, mass / sum(mass) OVER (PARTITION BY draw) AS joint FROM (
  SELECT v.draw, s.label AS service, m.label AS model, sum(s.w * m.w) AS mass FROM moved v JOIN weighted m ON m.space_id = v.space_id AND m.layer = 'model'
  JOIN placed p ON p.idx = v.t JOIN weighted s ON s.space_id = p.space_id AND s.layer = 'service' GROUP BY 1, 2, 3))"""

FRAMES = """cutoff_frames AS (SELECT c AS variant, space_id FROM (SELECT space_id, min(rank) AS r FROM rankings GROUP BY 1), (VALUES (25), (50), (75), (100)) t(c) WHERE r <= c),
query_frames AS (SELECT DISTINCT v.query AS variant, r.space_id FROM (SELECT DISTINCT query FROM rankings) v JOIN rankings r ON r.query <> v.query),
cutoff_edges AS (SELECT f.variant, e.* FROM edges e JOIN cutoff_frames f USING (space_id)),
query_edges AS (SELECT f.variant, e.* FROM edges e JOIN query_frames f USING (space_id)),
arm_edges AS (SELECT f.arm AS variant, e.* FROM edges e JOIN (SELECT DISTINCT arm, space_id FROM rankings) f USING (space_id)),
lopo_edges AS (SELECT v.variant, e.* FROM edges e, (SELECT DISTINCT provider AS variant FROM edges WHERE layer = 'service') v
  WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.layer = 'service' AND x.provider = v.variant AND x.space_id = e.space_id)),
namespace_edges AS (
  SELECT 'disaggregated' AS variant, space_id, provider, layer FROM edges
  UNION ALL SELECT 'pooled', space_id, CASE WHEN layer = 'model' AND provider_basis = 'unmapped_public_namespace' THEN 'unmapped_namespaces' ELSE provider END, layer FROM edges
  UNION ALL SELECT 'mapped_only', space_id, provider, layer FROM edges WHERE NOT (layer = 'model' AND provider_basis = 'unmapped_public_namespace')),
evidence_edges AS (
  SELECT 'all_evidence' AS variant, space_id, provider, layer FROM edges
  UNION ALL SELECT 'high_confidence_service', space_id, provider, layer FROM edges WHERE confidence = 'high' OR layer <> 'service'
  UNION ALL SELECT 'high_confidence_model', space_id, provider, layer FROM edges WHERE confidence = 'high' OR layer <> 'model'
  UNION ALL SELECT 'high_confidence_both_layers', space_id, provider, layer FROM edges WHERE confidence = 'high'),
variant_edges AS (
  SELECT 'primary' AS family, 'primary' AS variant, space_id, provider, layer FROM edges
  UNION ALL SELECT 'evidence', variant, space_id, provider, layer FROM evidence_edges
  UNION ALL SELECT 'model_taxonomy', variant, space_id, provider, layer FROM namespace_edges
  UNION ALL SELECT 'rank_cutoff', CAST(variant AS VARCHAR), space_id, provider, layer FROM cutoff_edges
  UNION ALL SELECT 'leave_one_query_out', variant, space_id, provider, layer FROM query_edges
  UNION ALL SELECT 'search_arm', variant, space_id, provider, layer FROM arm_edges
  UNION ALL SELECT 'leave_one_provider_out', variant, space_id, provider, layer FROM lopo_edges)"""

BRIEF = "matched_projects, service_hhi, model_hhi, hhi_difference"
RANKED = "SELECT label, CAST(project_count AS BIGINT) AS project_count, round(weight, 8) AS weight, round(share, 8) AS share FROM ({})"

SHINGLES = """docs7 AS (SELECT doc_id AS space_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT space_id, array_to_string(w[i:i+6], ' ') AS s FROM (SELECT space_id, w, unnest(range(1, len(w) - 5)) AS i FROM docs7 WHERE len(w) >= 7)),
sizes AS (SELECT space_id, count(*) AS n FROM shingles GROUP BY 1 HAVING count(*) >= 50),
pairs AS (SELECT left_id, right_id, i AS intersection, l.n + r.n - i AS union_size, i::DOUBLE / (l.n + r.n - i) AS jaccard FROM (
  SELECT a.space_id AS left_id, b.space_id AS right_id, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.space_id < b.space_id GROUP BY 1, 2)
  JOIN sizes l ON l.space_id = left_id JOIN sizes r ON r.space_id = right_id WHERE i::DOUBLE / (l.n + r.n - i) >= 0.85)"""


def clusters(least: float) -> str:
    """node, component of the pairs at or above a threshold; a recursive reach."""
    return f"""SELECT a AS node, min(b) AS component FROM (WITH RECURSIVE l AS (SELECT left_id AS a, right_id AS b FROM pairs WHERE jaccard >= {least} UNION SELECT right_id, left_id FROM pairs WHERE jaccard >= {least}),
      reach(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b) SELECT * FROM reach) GROUP BY 1"""


def cases(pairs, test, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test(p)} THEN '{n}'" for p, n in pairs) + f" ELSE {default} END"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def license_name(x: str) -> str:
    clean = f"regexp_replace(translate(replace(lower(trim({x})), 'license:', ''), '_ ', '--'), '-+', '-', 'g')"
    aliases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.LICENSE_ALIASES.items())
    return f"(CASE WHEN lower(trim({x})) IN ('', 'none', 'null', 'unknown') THEN 'missing' WHEN lower(trim({x})) = 'other' THEN 'other' ELSE CASE {clean} {aliases} ELSE {clean} END END)"


def license_class(x: str) -> str:
    special = " OR ".join(f"starts_with({x}, '{p}')" for p in rules.MODEL_SPECIFIC)
    return f"(CASE WHEN {x} = 'missing' THEN 'missing' WHEN {x} IN ({quoted(rules.PERMISSIVE)}) THEN 'permissive' WHEN {x} IN ({quoted(rules.COPYLEFT)}) THEN 'copyleft' WHEN {x} IN ({quoted(rules.RESTRICTED)}) OR regexp_matches({x}, '-nc|research-only|non-commercial') THEN 'restricted' WHEN {special} OR contains({x}, 'openrail') THEN 'model_specific' ELSE 'other' END)"


def split(key: str, values) -> str:
    return f"list_filter(string_split({D.sql_pick(key, values)}, '|'), lambda x: x <> '')"


def constructs(x: str, broad: bool) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{n}' END" for n, p in (*rules.STRICT_CONSTRUCTS, *(rules.BROAD_CONSTRUCTS if broad else ())))
    other = " OR ".join(f"regexp_matches({x}, '{p}')" for p in rules.OTHER_ASSESSMENTS)
    names = f"array_to_string(list_sort(list_filter([{found}], lambda y: y IS NOT NULL)), ';')"
    return f"CASE WHEN {names} = 'grading_support' AND ({other}) THEN '' ELSE {names} END"


def oracles() -> dict[str, str]:
    key = "p_partkey"
    phrase = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({D.sql_pick(key, D.PHRASES)} || ' ' || CAST({key} AS VARCHAR), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[_/]', ' ', 'g'), '[^\\pL\\pN_+. -]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    model, bases = D.sql_pick(key, D.MODELS), split(key, D.BASES)
    spaces = "(CASE WHEN contains({0}, '/') THEN trim(split_part({0}, '/', 1)) ELSE 'unscoped' END)"
    joined = f"lower(array_to_string(list_append({bases}, {model}), ' '))"
    chosen = f"regexp_replace(coalesce(({bases})[1], {model}), '^[^/]*/', '')"
    domains = f"list_filter(regexp_extract_all({D.sql_pick('page_id', D.CODE)}, 'https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[^\\s\"''`<>)]*)?'), lambda u: NOT regexp_matches(u, '(?i){'|'.join(f'(?:{p})' for *_, p in rules.SIGNATURES)}'))"
    placeholder = "(lower({0}) IN ('localhost', 'api.example.com', '::1') OR regexp_matches(lower({0}), '\\.example(\\.com|\\.org|\\.net)?$|^127\\.[0-9]+\\.[0-9]+\\.[0-9]+$'))"
    host = "regexp_extract({0}, '^https?://([^/:]+)', 1)"
    api = " OR ".join(f"contains(lower(u), '{m}')" for m in rules.API_MARKERS)
    place = f"' ' || trim(regexp_replace(regexp_replace(translate(lower({D.sql_pick('c_custkey', D.PLACES)}), '._', '  '), '[^\\pL\\pN_ ]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"
    names = [*rules.COUNTRY_ALIASES, *sorted(((n, c) for n, c in rules.COUNTRIES.items() if len(n) >= 4), key=lambda x: (-len(x[0]), x[0]))]
    code = cases(names, lambda n: f"contains(place, ' {n} ')", "''")
    languages = f"list_sort(list_distinct(list_filter(list_transform(list_filter({split(key, D.TAGS)}, lambda t: starts_with(t, 'language:')), lambda t: split_part(lower(split_part(t, ':', 2)), '-', 1)), lambda x: x <> '')))"
    asia = f"[{quoted(rules.ASIA_LANGUAGES)}]"
    repos = f"list_distinct(list_filter(list_transform(regexp_extract_all({D.sql_pick(key, D.PROSE)}, '(?i)https?://github\\.com/([a-z0-9_.-]+/[a-z0-9_.-]+)', 1), lambda x: regexp_replace(regexp_replace(x, '\\.git$', ''), '[.,);\\]}}]+$', '')), lambda x: NOT ends_with(x, '/')))"
    lines = f"list_filter(list_transform(string_split({D.sql_pick(key, D.REQUIREMENTS)}, chr(10)), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(#|-r|--|git\\+|http:|https:|$)'))"
    upstream = f"list_transform({split(key, D.UPSTREAM)}, lambda u: {license_class(license_name('u'))})"
    app = license_class(license_name(D.sql_pick(key, D.LICENSES)))
    items = "items AS (SELECT sample_id, stratum, pi, CAST(r1 = 'yes' AS INT) AS predicted, CAST(r2 = 'yes' AS INT) AS actual FROM reviews)"
    rank = lambda salt, x: f"sha256('{SEED}|{salt}|' || CAST({x} AS VARCHAR))"
    state = "SELECT {0} state, label, w / sum(w) OVER (PARTITION BY {0} state) AS share FROM (SELECT {0} state, label, sum(1.0::DOUBLE / k) AS w FROM (SELECT {0} 'initial' AS state, len(initial) AS k, unnest(initial) AS label FROM paired_rows UNION ALL SELECT {0} 'current', len(current), unnest(current) FROM paired_rows) GROUP BY ALL)"
    hhi = "CAST(n AS BIGINT) AS paired_projects, round(i, 8) AS initial_hhi, round(c, 8) AS current_hhi, round(c - i, 8) AS hhi_change"
    service = "(SELECT * FROM edges WHERE layer = 'service')"
    quality = "sum({w}) FILTER (WHERE predicted = 1 AND actual = 1)"
    agreement = "(" + " + ".join(f"(count(*) FILTER (WHERE r1 = '{x}'))::DOUBLE / count(*) * ((count(*) FILTER (WHERE r2 = '{x}'))::DOUBLE / count(*))" for x in ("yes", "no")) + ")"
    sql = {
        "fractional_ranking_service": RANKED.format(ranked(weights(service))),
        "fractional_ranking_combined": RANKED.format(ranked(weights("edges"))),
        "fractional_ranking_weighted": RANKED.format(ranked(weights("(SELECT e.*, author_weight FROM edges e JOIN spaces USING (space_id) WHERE layer = 'service')", base="author_weight"))),
        "concentration_summary_specs": f"spec_edges AS (SELECT analysis, e.* FROM edges e JOIN specs s ON e.layer = s.layer) SELECT i.analysis, CAST(projects AS BIGINT) AS projects, CAST(providers AS BIGINT) AS providers, round(hhi, 7) AS hhi, round(effective_number, 7) AS effective_number, round(top1_share, 7) AS top1_share, round(top3_share, 7) AS top3_share, round(gini, 7) AS gini, round(shannon, 7) AS shannon FROM ({indices(weights('spec_edges', 'analysis'), 'analysis')}) i JOIN (SELECT analysis, count(DISTINCT space_id) AS projects FROM spec_edges GROUP BY 1) n USING (analysis)",
        "gini_by_layer": f"SELECT layer, round(gini, 7) AS gini FROM ({indices(weights('edges', 'layer'), 'layer')})",
        "shannon_by_layer": f"SELECT layer, round(shannon, 7) AS shannon, round(exp(shannon), 7) AS effective FROM ({indices(weights('edges', 'layer'), 'layer')})",
        "family_ranking": RANKED.format(ranked(weights("(SELECT * FROM edges WHERE layer = 'model')", label="evidence_type"))),
        "hhi_bootstrap_ci": f"weighted AS ({weights(service)}), placed AS ({positions('SELECT * FROM weighted')}), drawn AS ({drawn()}), per AS (SELECT draw, sum(s * s) AS hhi FROM (SELECT draw, label, sum(w * m) / sum(sum(w * m)) OVER (PARTITION BY draw) AS s FROM weighted JOIN drawn USING (space_id) GROUP BY 1, 2) GROUP BY 1) SELECT round(quantile_cont(hhi, 0.025), 8) AS hhi_ci_low, round(quantile_cont(hhi, 0.975), 8) AS hhi_ci_high FROM per",
        "fractional_matrix_long": f"SELECT space_id, label, round(w, 8) AS w FROM ({weights(service)})",
        "matched_projects": matched("edges"),
        "paired_layer_point": paired("edges"),
        "paired_layer_bootstrap_draws": f"{PAIRED_DRAWS} SELECT draw, round(service_hhi, 8) AS service_hhi, round(model_hhi, 8) AS model_hhi, round(service_hhi - model_hhi, 8) AS hhi_difference FROM both_layers",
        "paired_layer_bootstrap_ci": f"{PAIRED_DRAWS} SELECT round(quantile_cont(service_hhi - model_hhi, 0.025), 8) AS hhi_difference_ci_low, round(quantile_cont(service_hhi - model_hhi, 0.975), 8) AS hhi_difference_ci_high, round(avg(CAST(service_hhi - model_hhi > 0 AS DOUBLE)), 8) AS dominance FROM both_layers",
        "paired_weighted_estimate": f"weighted_edges AS (SELECT e.*, author_weight FROM edges e JOIN spaces USING (space_id)) {paired('weighted_edges', base='author_weight')}",
        "codeclaration_joint": f"{JOINT} SELECT service, model, round(joint, 8) AS joint FROM joint",
        "codeclaration_service_diversity": f"{JOINT} SELECT service, round(max(share), 7) AS service_share, round(exp(-sum(p * ln(p))), 7) AS effective_models, max(model) FILTER (WHERE place = 1) AS top_model, round(max(p), 7) AS top_model_share FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY round(p, 12) DESC, model) AS place FROM (SELECT *, sum(joint) OVER (PARTITION BY service) AS share, joint / sum(joint) OVER (PARTITION BY service) AS p FROM joint)) GROUP BY 1",
        "mutual_information": f"{JOINT} SELECT round(h_service, 8) AS h_service, round(h_model, 8) AS h_model, round(mi, 8) AS mi, round(nmi, 8) AS nmi FROM ({information('joint')})",
        "permutation_null": f"{JOINT}, {NULL} SELECT draw, round(mi, 8) AS mi FROM ({information('null_joint', 'draw')})",
        "permutation_p": f"{JOINT}, {NULL}, observed AS ({information('joint')}) SELECT round(max(o.mi), 8) AS observed, round((1.0 + count(*) FILTER (WHERE n.mi >= o.mi)) / (1 + count(*)), 8) AS p_value FROM ({information('null_joint', 'draw')}) n, observed o",
        "matched_composition": f"""flagged AS (SELECT s.*, k.space_id IS NOT NULL AS inn FROM spaces s LEFT JOIN ({matched('edges')}) k ON k.space_id = s.space_id), long AS (
          SELECT inn, 'age_days' AS metric, 'continuous' AS metric_type, date_diff('day', CAST(created_at AS DATE), DATE '1999-01-01')::DOUBLE AS x FROM flagged UNION ALL SELECT inn, 'log_likes', 'continuous', ln(1 + likes) FROM flagged
          UNION ALL SELECT inn, 'liked', 'binary', CAST(likes >= 1 AS INT) FROM flagged UNION ALL SELECT inn, 'running', 'binary', CAST(runtime_stage = 'O' AS INT) FROM flagged UNION ALL SELECT inn, 'urgent', 'binary', CAST(sdk = '1-URGENT' AS INT) FROM flagged),
          g AS (SELECT metric, metric_type, avg(x) FILTER (WHERE inn) AS a, avg(x) FILTER (WHERE NOT inn) AS b, var_samp(x) FILTER (WHERE inn) AS va, var_samp(x) FILTER (WHERE NOT inn) AS vb, count(*) FILTER (WHERE inn) AS na, count(*) FILTER (WHERE NOT inn) AS nb FROM long GROUP BY 1, 2)
          SELECT metric, metric_type, round(a, 7) AS matched_value, round(b, 7) AS nonmatched_value, round(a - b, 7) AS difference, round((a - b) / nullif(CASE WHEN metric_type = 'binary' THEN sqrt((a * (1 - a) + b * (1 - b)) / 2) ELSE sqrt((va + vb) / 2) END, 0), 7) AS standardized_difference, na AS matched_n, nb AS nonmatched_n FROM g""",
        "unknown_boundary": f"""cand AS (SELECT DISTINCT space_id, evidence_type, provider FROM edges WHERE layer = 'runtime' AND provider_basis = 'unmapped_public_namespace'), boundary AS (
          SELECT v AS variant, space_id, provider, layer FROM edges, (VALUES ('known'), ('pooled'), ('identifier'), ('project_unique')) t(v)
          UNION ALL SELECT 'pooled', space_id, 'unmapped_service', 'service' FROM cand UNION ALL SELECT 'identifier', space_id, 'unmapped:' || evidence_type || ':' || provider, 'service' FROM cand
          UNION ALL SELECT 'project_unique', space_id, 'unmapped_project:' || CAST(space_id AS VARCHAR), 'service' FROM cand) {paired('boundary', 'variant', columns='variant, matched_projects, service_categories, service_hhi, model_hhi, hhi_difference')}""",
        "namespace_variants": f"{FRAMES} {paired('namespace_edges', 'variant', columns='variant, matched_projects, model_categories, service_hhi, model_hhi, hhi_difference')}",
        "search_union_cutoffs": f"{FRAMES} SELECT CAST(variant AS BIGINT) AS variant, count(*) AS projects FROM cutoff_frames GROUP BY 1",
        "search_cutoff_concentration": f"{FRAMES} SELECT CAST(i.variant AS BIGINT) AS variant, i.layer, CAST(projects AS BIGINT) AS projects, CAST(providers AS BIGINT) AS providers, round(hhi, 7) AS hhi, round(gini, 7) AS gini FROM ({indices(weights('cutoff_edges', 'variant, layer'), 'variant, layer')}) i JOIN (SELECT variant, layer, count(DISTINCT space_id) AS projects FROM cutoff_edges GROUP BY 1, 2) n ON n.variant = i.variant AND n.layer = i.layer",
        "query_ablation": f"{FRAMES} {paired('query_edges', 'variant', columns='variant, ' + BRIEF)}",
        "arm_overlap": "a AS (SELECT space_id, count(DISTINCT arm) AS k FROM rankings GROUP BY 1) SELECT CAST(count(*) FILTER (WHERE k = 2) AS BIGINT) AS intersection, count(*) AS union_size, round((count(*) FILTER (WHERE k = 2))::DOUBLE / count(*), 8) AS jaccard FROM a",
        "leave_one_provider_out": f"{FRAMES} {paired('lopo_edges', 'variant', columns='variant, ' + BRIEF)}",
        "robustness_matrix": f"{FRAMES} {paired('variant_edges', 'family, variant', columns='family, variant, ' + BRIEF)}",
        "robustness_ranges": f"{FRAMES} SELECT family, count(*) AS variants, round(median(hhi_difference), 8) AS median, round(min(hhi_difference), 8) AS least, round(max(hhi_difference), 8) AS largest FROM ({paired('variant_edges', 'family, variant', columns='family, variant, ' + BRIEF).replace(', 8)', ', 15)')}) GROUP BY 1",
        "exact_bundle_clusters": "b AS (SELECT doc_id AS space_id, list_sort(list(DISTINCT sha256(line))) AS a FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1), c AS (SELECT space_id, len(a) AS file_digests, CASE WHEN len(a) >= 2 THEN sha256(array_to_string(a, chr(10))) ELSE 'unique:' || CAST(space_id AS VARCHAR) END AS cluster_id, CASE WHEN len(a) >= 2 THEN 'exact_bundle' ELSE 'unique' END AS basis FROM b) SELECT cluster_id, space_id, CAST(file_digests AS BIGINT) AS file_digests, basis, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, round(1.0::DOUBLE / count(*) OVER (PARTITION BY cluster_id), 8) AS cluster_weight FROM c",
        "shingle_counts": f"{SHINGLES} SELECT space_id, count(*) AS shingles, count(*) >= 50 AS eligible FROM shingles GROUP BY 1",
        "jaccard_pairs": f"{SHINGLES} SELECT left_id, right_id, CAST(intersection AS BIGINT) AS intersection, CAST(union_size AS BIGINT) AS union_size, round(jaccard, 8) AS jaccard FROM pairs",
        "similarity_clusters": f"{SHINGLES} SELECT CAST(90 AS BIGINT) AS threshold, node, component, count(*) OVER (PARTITION BY component) AS cluster_size FROM ({clusters(0.9)})",
        "similarity_sensitivity": f"{SHINGLES} " + " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS threshold, CAST(sum(k) AS BIGINT) AS clustered, count(*) AS clusters, max(k) AS largest FROM (SELECT component, count(*) AS k FROM ({clusters(t / 100)}) GROUP BY 1)" for t in (85, 90, 95)),
        "signal_intersections": "s AS (SELECT space_id, string_agg(DISTINCT layer, '+' ORDER BY layer) AS signature FROM edges GROUP BY 1) SELECT signature, count(*) AS projects FROM s GROUP BY 1",
        "topk_other_mosaic": f"""{JOINT}, s AS (SELECT service FROM (SELECT service, row_number() OVER (ORDER BY round(sum(joint), 12) DESC, service) AS r FROM joint GROUP BY 1) WHERE r <= 4), m AS (SELECT model FROM (SELECT model, row_number() OVER (ORDER BY round(sum(joint), 12) DESC, model) AS r FROM joint GROUP BY 1) WHERE r <= 6),
          cells AS (SELECT coalesce(s.service, 'Other') AS service, coalesce(m.model, 'Other') AS model, sum(joint) AS joint FROM joint j LEFT JOIN s ON s.service = j.service LEFT JOIN m ON m.model = j.model GROUP BY 1, 2)
          SELECT a.service, b.model, round(coalesce(c.joint, 0), 8) AS joint FROM (SELECT DISTINCT service FROM cells) a CROSS JOIN (SELECT DISTINCT model FROM cells) b LEFT JOIN cells c ON c.service = a.service AND c.model = b.model""",
        "evidence_source_audit": "o AS (SELECT evidence_type, space_id, bool_or(confidence = 'high') AS high FROM edges GROUP BY 1, 2) SELECT evidence_type, count(*) AS projects, count(*) FILTER (WHERE high) AS high_projects, count(*) FILTER (WHERE NOT high) AS medium_only_projects FROM o GROUP BY 1",
        "selection_funnel": f"SELECT 'candidates' AS stage, count(*) AS projects FROM spaces UNION ALL SELECT 'with_edge', count(DISTINCT space_id) FROM edges WHERE space_id IN (SELECT space_id FROM spaces) UNION ALL SELECT 'matched', count(*) FROM ({matched('edges')})",
        "license_summary": f"n AS (SELECT {license_name(D.sql_pick(key, D.LICENSES))} AS c FROM part), l AS (SELECT 'name' AS measure, c AS category FROM n UNION ALL SELECT 'class', {license_class('c')} FROM n) SELECT measure, category, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY measure) AS BIGINT) AS denominator, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY measure), 8) AS share FROM l GROUP BY 1, 2",
        "activity_summary": "a AS (SELECT *, date_diff('day', CAST(created_at AS DATE), DATE '1998-12-31') AS age FROM spaces) SELECT count(*) AS projects, count(*) FILTER (WHERE age <= 180) AS within_180, count(*) FILTER (WHERE age <= 365) AS within_365, count(*) FILTER (WHERE runtime_stage = 'O') AS running, round(median(likes), 8) AS median_likes, round(avg(age), 8) AS mean_age FROM a",
        "coverage_gate": f"l AS (SELECT {code} AS code FROM (SELECT {place} AS place FROM customer)), c AS (SELECT count(*) AS authors, count(*) FILTER (WHERE code <> '') AS located FROM l) SELECT authors, located, round(located::DOUBLE / authors, 8) AS coverage, CASE WHEN located::DOUBLE / authors >= 0.2 THEN 'ESTIMABLE' ELSE 'NOT_ESTIMABLE' END AS status FROM c",
        "location_class": f"l AS (SELECT c_custkey, {D.sql_pick('c_custkey', D.PLACES)} AS raw, {place} AS place FROM customer), c AS (SELECT *, {code} AS code FROM l) SELECT c_custkey, CASE WHEN trim(raw) = '' THEN 'missing' WHEN code = '' THEN 'unresolved' WHEN code IN ({quoted(rules.ASIA_CODES)}) THEN 'asia' ELSE 'outside_asia' END AS region_class, code AS country_code FROM c",
        "version_transitions": "SELECT CASE WHEN len(initial) = 0 AND len(current) = 0 THEN 'no_signal' WHEN len(initial) = 0 THEN 'added' WHEN len(current) = 0 THEN 'removed' WHEN initial = current THEN 'same' ELSE 'changed' END AS transition, count(*) AS projects FROM versions GROUP BY 1",
        "version_hhi_change": f"paired_rows AS (SELECT * FROM versions WHERE len(initial) > 0 AND len(current) > 0) SELECT {hhi} FROM (SELECT sum(share * share) FILTER (WHERE state = 'initial') AS i, sum(share * share) FILTER (WHERE state = 'current') AS c FROM ({state.format('')})), (SELECT count(*) AS n FROM paired_rows)",
        "version_span_sensitivity": f"paired_rows AS (SELECT d AS min_days, v.* FROM versions v, (VALUES (0), (365), (730), (1460)) t(d) WHERE len(initial) > 0 AND len(current) > 0 AND span_days >= d) SELECT CAST(min_days AS BIGINT) AS min_days, {hhi} FROM (SELECT min_days, sum(share * share) FILTER (WHERE state = 'initial') AS i, sum(share * share) FILTER (WHERE state = 'current') AS c FROM ({state.format('min_days, ')}) GROUP BY 1) JOIN (SELECT min_days, count(*) AS n FROM paired_rows GROUP BY 1) USING (min_days)",
        "file_cap_sensitivity": f"capped AS (SELECT cap, e.* FROM (SELECT *, dense_rank() OVER (PARTITION BY space_id ORDER BY source_file) AS place FROM edges) e, (VALUES (1), (2), (3)) t(cap) WHERE place <= cap) SELECT CAST(cap AS BIGINT) AS cap, {BRIEF} FROM ({paired('capped', 'cap', columns='cap, ' + BRIEF)})",
        "construct_match": f"t AS (SELECT p_partkey, {phrase} AS x FROM part) SELECT p_partkey, {constructs('x', False)} AS strict, {constructs('x', True)} AS broad FROM t",
        "model_provider_map": f"""m AS (SELECT p_partkey, {model} AS model, {bases} AS bases FROM part), c AS (SELECT p_partkey, model, unnest(list_append(bases, model)) AS cand, generate_subscripts(list_append(bases, model), 1) AS i FROM m),
          h AS (SELECT *, CASE lower({spaces.format('cand')}) {' '.join(f"WHEN '{n}' THEN '{p}'" for n, p in rules.NAMESPACES.items())} END AS p FROM c), f AS (SELECT p_partkey, arg_min(p, i) AS p, arg_min(cand, i) AS cand FROM h WHERE p IS NOT NULL GROUP BY 1)
          SELECT m.p_partkey, coalesce(f.p, 'namespace:' || {spaces.format('model')}) AS provider, CASE WHEN f.p IS NULL THEN 'unmapped_public_namespace' WHEN f.cand <> model THEN 'base_model_namespace' ELSE 'model_namespace' END AS basis FROM m LEFT JOIN f ON f.p_partkey = m.p_partkey""",
        "model_family_map": f"t AS (SELECT p_partkey, {joined} AS j, {chosen} AS c FROM part) SELECT p_partkey, {cases(rules.FAMILIES, lambda p: f"regexp_matches(j, '{p}')", "coalesce(nullif(regexp_extract(c, '^([^-_]*)', 1), ''), 'unresolved')")} AS family FROM t",
        "license_text_detect": f"t AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS x FROM documents) SELECT doc_id, {cases([(f, n) for n, f in rules.FINGERPRINTS], lambda f: f"contains(x, '{f}')", "'missing'")} AS license FROM t",
        "license_flag": f"""t AS (SELECT p_partkey, {app} AS a, {upstream} AS u FROM part) SELECT p_partkey, a AS app_class, CASE WHEN a = 'missing' THEN 'app_license_missing' WHEN len(u) = 0 THEN 'no_observed_model_dependency' WHEN len(list_filter(u, lambda x: x <> 'missing')) = 0 THEN 'upstream_license_unresolved'
          WHEN a IN ('permissive', 'copyleft') AND list_has_any(u, ['restricted', 'model_specific']) THEN 'review_rights_asymmetry' WHEN a IN ('permissive', 'copyleft') AND list_has_any(u, ['missing', 'other']) THEN 'review_incomplete_upstream_terms'
          WHEN a IN ('permissive', 'copyleft') AND len(list_filter(u, lambda x: x NOT IN ('permissive', 'copyleft'))) = 0 THEN 'no_automated_flag' ELSE 'manual_review' END AS flag FROM t""",
        "url_domain_candidates": f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({domains}, lambda u: NOT {placeholder.format(host.format('u'))} AND (starts_with(lower({host.format('u')}), 'api.') OR {api})), lambda u: lower({host.format('u')})))), ';') AS domains,
          array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({D.sql_pick('page_id', D.CODE)}, '{rules.CREDENTIAL}'), lambda c: NOT regexp_matches(c, '(?i){'|'.join(f'(?:{p})' for *_, p in rules.SIGNATURES)}')))), ';') AS credentials, {placeholder.format(host.format('url'))} AS placeholder FROM pages""",
        "repo_links": f"SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform({repos}, lambda x: {{'k': lower(x), 'v': x}})), lambda s: s.v), ';') AS repositories FROM part",
        "language_orientation": f"t AS (SELECT p_partkey, {languages} AS l FROM part) SELECT p_partkey, CASE WHEN len(l) = 0 THEN 'undeclared' WHEN list_has_all({asia}, l) THEN 'asia_language_only' WHEN list_has_any({asia}, l) THEN 'includes_asia_language' ELSE 'other_declared_language' END AS language_class, array_to_string(l, ';') AS language_codes FROM t",
        "requirements_packages": f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform({lines}, lambda x: regexp_replace(lower(regexp_extract(x, '^([^<>=!~;\\s\\[]*)', 1)), '[_.]+', '-', 'g')), lambda p: p <> ''))), ';') AS packages FROM part",
        "stable_sample": f"t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {rank('relevance', 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, CASE lang WHEN 'en' THEN 40 WHEN 'es' THEN 30 WHEN 'fr' THEN 20 WHEN 'de' THEN 10 END AS k FROM documents) SELECT lang, doc_id, round(least(n, k)::DOUBLE / n, 8) AS inclusion_probability FROM t WHERE r <= k",
        "balanced_sample": f"t AS (SELECT p_partkey, p_brand, {rank('provider', 'p_partkey')} AS h, row_number() OVER (PARTITION BY p_brand ORDER BY {rank('provider', 'p_partkey')}, p_partkey) <= 2 AS must FROM part) SELECT p_partkey, p_brand FROM t ORDER BY must DESC, h, p_partkey LIMIT 60",
        "negative_allocation": "SELECT lang, count(*) AS n, greatest(1, CAST(round_even(80.0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT)) AS allocation FROM documents GROUP BY 1",
        "blind_ids": f"SELECT n_nationkey, 'E' || lpad(CAST(row_number() OVER (ORDER BY {rank('blind', 'n_nationkey')}, n_nationkey) AS VARCHAR), 3, '0') AS blind_id FROM nation",
        "kappa": f"SELECT stratum, count(*) AS items, round((count(*) FILTER (WHERE r1 = r2))::DOUBLE / count(*), 8) AS observed, round({agreement}, 8) AS expected, round(CASE WHEN {agreement} = 1 THEN 1.0 ELSE ((count(*) FILTER (WHERE r1 = r2))::DOUBLE / count(*) - {agreement}) / (1 - {agreement}) END, 8) AS kappa FROM reviews GROUP BY 1",
        "review_resolution": "SELECT sample_id, CASE WHEN r1 = r2 THEN r1 ELSE '' END AS resolved FROM reviews",
        "weighted_precision_recall": f"{items} SELECT round(coalesce({quality.format(w='1 / pi')}, 0) / sum(1 / pi) FILTER (WHERE predicted = 1), 7) AS precision, round(coalesce({quality.format(w='1 / pi')}, 0) / sum(1 / pi) FILTER (WHERE actual = 1), 7) AS recall, round(coalesce(sum(1 / pi) FILTER (WHERE predicted = 0 AND actual = 0), 0) / sum(1 / pi) FILTER (WHERE actual = 0), 7) AS specificity, round(sum(1 / pi), 7) AS weight FROM items",
        "stratified_bootstrap": f"{items}, placed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sample_id) - 1 AS idx, count(*) OVER (PARTITION BY stratum) AS n FROM items), d AS (SELECT stratum, draw, {index('n', str(SEED), 'stratum', 'draw', 'idx')} AS idx, count(*) AS m FROM placed, range({DRAWS}) t(draw) GROUP BY 1, 2, 3), per AS (SELECT draw, coalesce({quality.format(w='m / pi')}, 0) / sum(m / pi) FILTER (WHERE predicted = 1) AS p FROM d JOIN placed p ON p.stratum = d.stratum AND p.idx = d.idx GROUP BY 1) SELECT round(quantile_cont(p, 0.025), 7) AS precision_ci_low, round(quantile_cont(p, 0.975), 7) AS precision_ci_high FROM per",
        "audit_checks": f"t AS (SELECT layer, sum(share) AS total, sum(share * share) AS hhi, count(*) AS k FROM ({ranked(weights('edges', 'layer'), 'layer')}) GROUP BY 1) SELECT * FROM (SELECT 'shares_sum_to_one' AS \"check\", bool_and(abs(total - 1) < 1e-9) AS pass FROM t UNION ALL SELECT 'hhi_at_least_even', bool_and(hhi >= 1.0 / k - 1e-12) FROM t UNION ALL SELECT 'hhi_at_most_one', bool_and(hhi <= 1) FROM t UNION ALL SELECT 'all_layers', count(*) = 3 FROM t)",
    }
    from tessera.plans import audits

    return audits.sql_texts() | {name: f"WITH {SQL.strip()}{'' if text.lstrip().startswith('SELECT') else ','} {text}" for name, text in sql.items()}

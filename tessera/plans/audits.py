"""Queries of sources, relations and gates, each beside the SQL that it equals (``SQL_TEXTS``, over the views of ``roles.SQL``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import concentration as C, paired as P, relations as L, validation as V, variants as X
from tessera.plans import oracle
from tessera.plans.queries import DRAWS, FULL_DRAWS, SEED, query, tidy
from tessera.plans.roles import CUTOFFS, SPECS, Roles
from tessera.sources import tables
from tessera.sources.durable import shared_dir

SQL_TEXTS: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ARMS = ["likes", "createdAt"]
#: The columns of a released review.
RELEASED = ("sample_id", "stratum", "r1", "r2", "pi")


def equals(text: str):
    """Registers a query together with its SQL."""

    def register(f):
        SQL_TEXTS[f.__name__] = text
        return query(f)

    return register


def _folder(df: DataFrame, name: str) -> str:
    import uuid

    return f"{shared_dir(df.sparkSession)}/sources/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> tuple:
    path = _folder(df, name)
    tables.write_csv(df, path)
    return df.sparkSession, path


@equals("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END::BIGINT AS p_size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_retailprice, 2) END AS price,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS p_name, p_size > 25 AS large FROM part""")
def csv_typed(r: Roles):
    """Written as text with the spellings of no value, read back with types."""
    part = r.table("part")
    text = part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 7 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("p_size"),
        F.when(F.col("p_partkey") % 5 == 0, "NaN").otherwise(F.round("p_retailprice", 2).cast("string")).alias("price"),
        F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_name")).alias("p_name"),
        (F.col("p_size") > 25).alias("large"),
    )
    return tables.read_csv(*_written(text, "typed"))


@equals("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'say \"x\", twice' ELSE p_name END AS note FROM part")
def csv_literal(r: Roles):
    """Texts as they are: no value means null, and quotes and commas come back."""
    note = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'say \"x\", twice' ELSE p_name END AS note")
    spark, path = _written(r.table("part").select(F.col("p_partkey").cast("string").alias("p_partkey"), note), "literal")
    return tables.read_csv(spark, path, "p_partkey string, note string", literal=True)


@equals("SELECT c_mktsegment || ':' || CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS value FROM customer")
def json_map_entries(r: Roles):
    """Compressed JSON objects, one a market segment, as key and value rows."""
    rows = r.table("customer").select("c_mktsegment", F.struct(F.concat_ws(":", "c_mktsegment", F.col("c_custkey").cast("string")).alias("k"), F.col("c_nationkey").alias("v")).alias("e"))
    docs = rows.groupBy("c_mktsegment").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    path = _folder(docs, "maps")
    docs.repartition("c_mktsegment").write.option("compression", "gzip").partitionBy("c_mktsegment").text(path)
    return tables.read_map(docs.sparkSession, f"{path}/*")


@equals("SELECT query, arm, rank, CAST(space_id AS VARCHAR) AS space_id FROM rankings WHERE NOT (query = '5-LOW' AND arm = 'likes') UNION ALL SELECT '5-LOW', 'likes', 0, ''")
def ranking_lists(r: Roles):
    """Lists as rows; a list without items keeps a row of rank 0."""
    ranked = r.rankings().withColumn("item", F.when(~((F.col("query") == "5-LOW") & (F.col("arm") == "likes")), F.struct("rank", F.col("space_id").cast("string").alias("id"))))
    lists = ranked.groupBy("query", "arm").agg(F.expr("transform(array_sort(collect_list(item)), x -> x.id) AS items"))
    return tables.flatten_rankings(lists).select("query", "arm", F.col("rank").cast("long").alias("rank"), "space_id")


@equals("SELECT q.query, a.arm FROM (SELECT DISTINCT o_orderpriority AS query FROM orders) q, (VALUES ('likes'), ('createdAt')) a(arm) WHERE NOT EXISTS (SELECT 1 FROM rankings k WHERE k.query = q.query AND k.arm = a.arm AND k.query <> '5-LOW' AND NOT (k.query = '2-HIGH' AND k.arm = 'createdAt'))")
def design_coverage(r: Roles):
    """The lists of the design that a table with gaps lacks."""
    held = r.rankings().filter("query <> '5-LOW' AND NOT (query = '2-HIGH' AND arm = 'createdAt')")
    queries = [x[0] for x in r.table("orders").select("o_orderpriority").distinct().collect()]
    return tables.missing_lists(held, queries, ARMS)


@equals("""SELECT count(*) AS additional, sum(l_orderkey)::BIGINT AS orders FROM (SELECT * FROM lineitem WHERE l_linenumber <= 5) a
  WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber <= 3 AND b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = a.l_linestatus AND b.l_linenumber = a.l_linenumber)""")
def composite_difference(r: Roles):
    """Rows that a larger cap adds, by a key of six columns."""
    line, key = r.table("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    return L.additional_rows(line.filter("l_linenumber <= 5"), line.filter("l_linenumber <= 3"), key).agg(F.count("*").alias("additional"), F.sum("l_orderkey").alias("orders"))


@equals("SELECT coalesce(a.k, b.k) AS id, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def id_symmetric_difference(r: Roles):
    return L.symmetric_difference(r.table("lineitem").select(F.col("l_orderkey").alias("id")), r.table("orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")), "id")


@equals("SELECT provider, CASE WHEN bool_or(confidence = 'high') AND bool_or(confidence = 'medium') THEN 'both' WHEN bool_or(confidence = 'high') THEN 'first' ELSE 'second' END AS occurs FROM edges WHERE layer <> 'runtime' GROUP BY 1")
def evidence_overlap(r: Roles):
    """Labels with strong evidence, with weak evidence, or both."""
    return L.overlap(r.edges().filter("layer <> 'runtime'"), "provider", F.col("confidence") == "high", F.col("confidence") == "medium")


@equals("SELECT 'labelled_are_documents' AS \"check\", NOT EXISTS (SELECT 1 FROM labels l WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS pass UNION ALL SELECT 'orders_have_lines', NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def subset_checks(r: Roles):
    ordered, lines = r.table("orders").select(F.col("o_orderkey").alias("k")), r.table("lineitem").select(F.col("l_orderkey").alias("k"))
    return L.is_subset(r.table("labels"), r.table("documents"), "doc_id", "labelled_are_documents").unionByName(L.is_subset(ordered, lines, "k", "orders_have_lines"))


@equals("SELECT repository_key, min_by(repo, (doc_id, repo)) AS repository, count(DISTINCT doc_id) AS projects, min(doc_id) AS first FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || lang AS repo, lower(source || '/' || lang) AS repository_key FROM documents) WHERE repo IS NOT NULL GROUP BY 1")
def repository_map(r: Roles):
    """Repositories whatever their case, the spelling of the least project, and the projects of each."""
    links = r.table("documents").select("doc_id", F.expr("CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || lang AS repo"))
    return L.repository_projects(links, "repo", "doc_id").select("repository_key", "repository", F.size("projects").cast("long").alias("projects"), F.col("projects")[0].alias("first"))


@equals("SELECT o_custkey, o_orderdate AS at, o_orderkey AS revision FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_totalprice >= 100000) WHERE n = 1")
def first_qualifying_revision(r: Roles):
    return L.first_qualifying(r.table("orders"), "o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice") >= 100000)


@equals("SELECT page_id, path FROM (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/README.md' WHEN 1 THEN '/LICENSE' WHEN 2 THEN '/.gitignore' WHEN 3 THEN '/readme.md.py' WHEN 4 THEN '/License.TXT' ELSE '/app.py' END AS path FROM pages) WHERE lower(split_part(path, '/', -1)) NOT IN ('readme.md', 'license', 'license.txt', '.gitattributes', '.gitignore')")
def source_files(r: Roles):
    """Files under the pages' addresses that count as sources."""
    files = r.table("pages").select("page_id", F.expr("url || CASE page_id % 6 WHEN 0 THEN '/README.md' WHEN 1 THEN '/LICENSE' WHEN 2 THEN '/.gitignore' WHEN 3 THEN '/readme.md.py' WHEN 4 THEN '/License.TXT' ELSE '/app.py' END AS path"))
    return L.counted_files(files, "path")


CANDIDATE = "CASE WHEN p_type = 'PROMO' THEN 'unmapped_credential' WHEN p_type = 'ECONOMY' THEN 'unmapped_api_domain' WHEN p_type = 'STANDARD' THEN 'unmapped_package' END"


@equals(f"SELECT l_orderkey AS space_id, coalesce(bool_or({CANDIDATE} IN ('unmapped_credential', 'unmapped_api_domain', 'openai_compatible_provider_unresolved')), false) AS has_candidate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def machine_service_candidate(r: Roles):
    rows = r.table("lineitem").join(r.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("space_id"), F.expr(f"{CANDIDATE} AS kind"))
    return L.has_service_candidate(rows, "space_id", "kind")


@equals("SELECT status, collection_status, count(*) AS answers FROM (SELECT status, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (400, 401, 403, 404, 410) THEN 'unavailable' WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'retry' ELSE 'failed' END AS collection_status FROM (SELECT CAST(200 + event_id % 320 AS INTEGER) AS status FROM events)) GROUP BY 1, 2")
def answer_status(r: Roles):
    """What stored answers stand for, by their codes."""
    codes = r.table("events").select(F.expr("cast(200 + event_id % 320 AS int) AS status"))
    return L.collection_status(codes, "status").groupBy("status", "collection_status").agg(F.count("*").alias("answers"))


@equals("SELECT sample_id, stratum, r1, r2, round(pi, 8) AS pi FROM reviews")
def released_reviews(r: Roles):
    """Reviews without the columns that could name a project."""
    whole = r.reviews().join(r.table("documents").select(F.col("doc_id").alias("sample_id"), "source", "text"), "sample_id")
    return tidy(L.deidentified(whole, RELEASED))


@equals("SELECT layer, true AS agrees FROM (SELECT DISTINCT layer FROM edges) UNION ALL SELECT 'absent', false")
def reproduced_hhi(r: Roles):
    """The index by layer, computed from the ranking and again from the weights; a value of one side alone doesn't agree."""
    weights = C.fractional_weights(r.edges(), by=("layer",))
    first = C.ranking(weights, ("layer",)).groupBy("layer").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))
    totals = weights.groupBy("layer", "label").agg(F.sum("w").alias("w"))
    again = totals.groupBy("layer").agg((F.sum(F.col("w") * F.col("w")) / (F.sum("w") * F.sum("w"))).alias("hhi"))
    absent = r.table("region").limit(1).select(F.lit("absent").alias("layer"), F.lit(1.0).alias("hhi"))
    return L.reproduced(first.unionByName(absent), again, "layer", "hhi")


@equals("""SELECT 'design_covered' AS "check", (SELECT count(DISTINCT (query, arm)) FROM rankings) = (SELECT 2 * count(DISTINCT o_orderpriority) FROM orders) AS pass
  UNION ALL SELECT 'ranks_within_cap', (SELECT max(rank) <= 100 AND min(rank) >= 1 FROM rankings)
  UNION ALL SELECT 'no_duplicate_keys', (SELECT count(*) = count(DISTINCT (query, arm, space_id)) FROM rankings)
  UNION ALL SELECT 'metadata_present', (SELECT bool_and(author IS NOT NULL AND created_at IS NOT NULL) FROM spaces)
  UNION ALL SELECT 'ids_agree', NOT EXISTS (SELECT 1 FROM rankings WHERE space_id NOT IN (SELECT space_id FROM spaces))
  UNION ALL SELECT 'no_passing_errors', (SELECT count(*) = 0 FROM events WHERE event_type = 'error')""")
def capture_gate(r: Roles):
    """Whether a capture is whole: design, caps, keys, metadata, ids, answers."""
    ranked, spaces = r.rankings(), r.spaces()
    lists = ranked.select("query", "arm").distinct().agg(F.count("*").alias("lists"))
    wanted = r.table("orders").agg((2 * F.countDistinct("o_orderpriority")).alias("wanted"))
    one = lambda df, name, check: V.gate(df, {name: check})
    parts = [
        one(lists.join(F.broadcast(wanted), F.col("lists") == F.col("wanted"), "left"), "design_covered", F.bool_and(F.col("wanted").isNotNull())),
        V.gate(ranked, {"ranks_within_cap": (F.max("rank") <= 100) & (F.min("rank") >= 1), "no_duplicate_keys": F.count("*") == F.countDistinct("query", "arm", "space_id")}),
        one(spaces, "metadata_present", F.bool_and(F.col("author").isNotNull() & F.col("created_at").isNotNull())),
        one(ranked.join(spaces.select("space_id").distinct(), "space_id", "left_anti"), "ids_agree", F.count("*") == 0),
        one(r.table("events").filter("event_type = 'error'"), "no_passing_errors", F.count("*") == 0),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@equals("""SELECT 'sample_large_enough' AS "check", (SELECT count(DISTINCT space_id) >= 100 FROM edges) AS pass
  UNION ALL SELECT 'coverage_high_enough', (SELECT (SELECT count(DISTINCT space_id) FROM edges)::DOUBLE / (SELECT count(*) FROM spaces) >= 0.9)
  UNION ALL SELECT 'leader_stable', (SELECT count(DISTINCT leader) = 1 FROM (SELECT confidence, arg_max(provider, (n, provider)) AS leader FROM (SELECT confidence, provider, count(*) AS n FROM edges WHERE layer = 'service' GROUP BY 1, 2) GROUP BY 1))""")
def decision_gate(r: Roles):
    """Whether the evidence carries the conclusions: size, coverage, and the same leader under either evidence."""
    edges = r.edges()
    observed = edges.select("space_id").distinct()
    covered = r.spaces().select("space_id").join(observed.withColumn("seen", F.lit(1)), "space_id", "left")
    counts = edges.filter("layer = 'service'").groupBy("confidence", "provider").agg(F.count("*").alias("n"))
    leaders = counts.groupBy("confidence").agg(F.max_by("provider", F.struct("n", "provider")).alias("leader"))
    out = V.gate(observed, {"sample_large_enough": F.count("*") >= 100})
    out = out.unionByName(V.gate(covered, {"coverage_high_enough": F.count("seen") / F.count("*") >= 0.9}))
    return out.unionByName(V.gate(leaders, {"leader_stable": F.countDistinct("leader") == 1}))


def _intervals_sql(base: str = "") -> str:
    """Intervals of all paired metrics from the resamples of ``paired_layer_bootstrap_draws``, by weights of ``base``."""
    source = f"(SELECT e.*, s.{base} FROM edges e JOIN spaces s USING (space_id))" if base else "edges"
    sides = ", ".join(f"max({c}) FILTER (WHERE layer = '{x}') AS {x}_{c}" for x in ("service", "model") for c in ("hhi", "top_share", "shannon"))
    values = {m: m for m in P.METRICS} | {
        "hhi_difference": "service_hhi - model_hhi",
        "hhi_ratio": "service_hhi / model_hhi",
        "top_share_difference": "service_top_share - model_top_share",
        "entropy_difference": "model_shannon - service_shannon",
    }
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({x}, 0.025), 7) AS ci_low, round(quantile_cont({x}, 0.975), 7) AS ci_high, round(avg(CAST({x} > 0 AS DOUBLE)), 7) AS above_zero FROM wide" for m, x in values.items())
    return f"""weighted AS ({oracle.matched_weights(source, base=base)}), placed AS ({oracle.positions('SELECT * FROM weighted')}), drawn AS ({oracle.drawn()}),
      per AS (SELECT draw, layer, sum(s * s) AS hhi, max(s) AS top_share, -sum(s * ln(s)) AS shannon FROM (SELECT draw, layer, label, sum(w * m) / sum(sum(w * m)) OVER (PARTITION BY draw, layer) AS s FROM weighted JOIN drawn USING (space_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
      wide AS (SELECT draw, {sides} FROM per GROUP BY 1) {rows}"""


@equals(_intervals_sql())
def paired_layer_intervals(r: Roles):
    """Intervals of both layers' indices, their differences and ratio."""
    return tidy(P.metric_intervals(P.paired_metric_draws(r.edges(), DRAWS, SEED)), 7)


def _by_author(r: Roles) -> DataFrame:
    return r.edges().join(r.spaces().select("space_id", "author_weight"), "space_id")


@equals(_intervals_sql("author_weight"))
def paired_weighted_intervals(r: Roles):
    """The same with an author's projects sharing one weight: rows are drawn with their weights."""
    return tidy(P.metric_intervals(P.paired_metric_draws(_by_author(r), DRAWS, SEED, "author_weight")), 7)


@query
def paired_layer_intervals_full(r: Roles):
    return tidy(P.metric_intervals(P.paired_table(r.edges(), FULL_DRAWS, SEED)), 7)


@query
def paired_weighted_intervals_full(r: Roles):
    return tidy(P.metric_intervals(P.paired_table(_by_author(r), FULL_DRAWS, SEED, "author_weight")), 7)


@equals(f"""{oracle.FRAMES}, design AS (
    SELECT 'rank_cutoff' AS family, CAST(variant AS VARCHAR) AS variant, space_id, provider, layer FROM cutoff_edges
    UNION ALL SELECT 'leave_one_query_out', variant, space_id, provider, layer FROM query_edges
    UNION ALL SELECT 'search_arm', variant, space_id, provider, layer FROM arm_edges),
  spec_edges AS (SELECT d.*, s.analysis FROM design d JOIN specs s ON s.layer = d.layer), w AS ({oracle.weights('spec_edges', 'family, variant, analysis')}),
  i AS ({oracle.indices('SELECT * FROM w', 'family, variant, analysis')}), n AS (SELECT family, variant, analysis, count(DISTINCT space_id) AS projects FROM w GROUP BY 1, 2, 3)
  SELECT family, variant, analysis, projects, round(hhi, 7) AS hhi, NULL::DOUBLE AS hhi_difference FROM i JOIN n USING (family, variant, analysis)
  UNION ALL SELECT family, variant, 'matched_service_minus_model', matched_projects, NULL, round(hhi_difference, 7) FROM ({oracle.paired('design', 'family, variant', columns='family, variant, matched_projects, hhi_difference')})""")
def search_design_contrasts(r: Roles):
    """Every search frame (cutoffs, one query left out, one arm) under every analysis, and the matched projects' difference as a row of its own."""
    rankings, edges = r.rankings(), r.edges()
    frames = {
        "rank_cutoff": X.search_frames(rankings, CUTOFFS),
        "leave_one_query_out": X.without_each(rankings, "query"),
        "search_arm": rankings.select(F.col("arm").alias("variant"), "space_id").distinct(),
    }
    framed = X.union_all([f.select(F.lit(n).alias("family"), F.col("variant").cast("string").alias("variant"), "space_id") for n, f in frames.items()])
    by = ("family", "variant")
    design = edges.join(framed, "space_id").select(*by, "space_id", "provider", "layer")
    single = C.concentration(C.with_specs(design, SPECS), by=(*by, "analysis")).select(*by, "analysis", "projects", "hhi", F.lit(None).cast("double").alias("hhi_difference"))
    both = P.paired_estimate(design, by=by).select(*by, F.lit("matched_service_minus_model").alias("analysis"), F.col("matched_projects").alias("projects"), F.lit(None).cast("double").alias("hhi"), "hhi_difference")
    return tidy(single.unionByName(both), 7)


def sql_texts() -> dict[str, str]:
    from tessera.plans.roles import SQL

    return {name: f"WITH {SQL.strip()}{'' if text.lstrip().startswith('SELECT') else ','} {text}" for name, text in SQL_TEXTS.items()}

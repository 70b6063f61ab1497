"""The roles that the driver's star schema plays: projects, edges, rankings, version states, labels.

``frames`` gives them as DataFrames; ``SQL`` is the same in DuckDB SQL, for the
equivalents in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans import derived

SPECS = {"combined": ["service", "model", "runtime"], "provider_only": ["service", "runtime"], "service": ["service"], "model": ["model"]}
CUTOFFS = (25, 50, 75, 100)
#: The evidence types that stand for the study's, in the whole robustness matrix.
HUB_LINKED, CODE_SIGNATURE, PACKAGE = "PROMO", "STANDARD", "ECONOMY"


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        return self._table(name)

    def edges(self) -> DataFrame:
        """space_id, provider, layer, evidence_type, confidence, source_file, provider_basis, evidence_value (the model's name)."""
        line, part, supplier, nation = (self._table(n) for n in ("lineitem", "part", "supplier", "nation"))
        joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
        flag = F.col("l_returnflag")
        return joined.select(
            F.col("l_orderkey").alias("space_id"),
            F.when(flag == "N", F.col("n_name")).otherwise(F.col("p_brand")).alias("provider"),
            F.when(flag == "N", "service").when(flag == "A", "model").otherwise("runtime").alias("layer"),
            F.col("p_type").alias("evidence_type"),
            F.when(F.col("l_linestatus") == "F", "high").otherwise("medium").alias("confidence"),
            F.col("l_linenumber").alias("source_file"),
            F.when(F.col("p_size") % 5 == 0, "unmapped_public_namespace").otherwise("model_namespace").alias("provider_basis"),
            derived.model(F.col("p_partkey")).alias("evidence_value"),
        )

    def spaces(self) -> DataFrame:
        """space_id, author, sdk, runtime_stage, created_at, likes, author_weight."""
        rows = self._table("orders").select(
            F.col("o_orderkey").alias("space_id"),
            F.col("o_custkey").alias("author"),
            F.col("o_orderpriority").alias("sdk"),
            F.col("o_orderstatus").alias("runtime_stage"),
            F.col("o_orderdate").alias("created_at"),
            F.floor(F.col("o_totalprice") / 10000).cast("long").alias("likes"),
            F.col("o_totalprice").alias("price"),
        )
        return rows.withColumn("author_weight", 1 / F.count("*").over(Window.partitionBy("author")))

    def rankings(self, limit: int = 100) -> DataFrame:
        """query, arm, rank, space_id: the first ``limit`` of each list."""
        rows = self.spaces().withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
        arms = rows.select(F.col("sdk").alias("query"), "space_id", F.explode(F.array(F.struct(F.lit("likes").alias("arm"), F.col("price").alias("k1"), F.lit("").alias("k2")), F.struct(F.lit("createdAt").alias("arm"), F.lit(0.0).alias("k1"), F.col("day").alias("k2")))).alias("a"))
        order = Window.partitionBy("query", "a.arm").orderBy(F.desc("a.k1"), F.desc("a.k2"), "space_id")
        return arms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", F.col("a.arm").alias("arm"), "rank", "space_id")

    def versions(self) -> DataFrame:
        """project, initial and current (sorted provider arrays), span_days."""
        line, orders, supplier, nation, customer = (self._table(n) for n in ("lineitem", "orders", "supplier", "nation", "customer"))
        big = line.filter("l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity >= 40")
        shipped = big.join(orders, big.l_orderkey == orders.o_orderkey).join(supplier, big.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
        late = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
        states = shipped.groupBy(F.col("o_custkey").alias("project")).agg(F.array_sort(F.collect_set(F.when(~late, F.col("n_name")))).alias("initial"), F.array_sort(F.collect_set(F.when(late, F.col("n_name")))).alias("current"))
        span = orders.groupBy(F.col("o_custkey").alias("project")).agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span_days"))
        empty = F.array().cast("array<string>")
        frame = customer.select(F.col("c_custkey").alias("project")).join(states, "project", "left").join(span, "project", "left")
        return frame.select("project", F.coalesce("initial", empty).alias("initial"), F.coalesce("current", empty).alias("current"), F.coalesce("span_days", F.lit(0)).alias("span_days"))

    def reviews(self) -> DataFrame:
        """sample_id, stratum, r1, r2 (yes/no), pi (share of the stratum that is labelled)."""
        docs, labels = self._table("documents").select("doc_id", "lang"), self._table("labels")
        rows = docs.join(labels, "doc_id", "left")
        pi = rows.groupBy("lang").agg((F.count("quality") / F.count("*")).alias("pi"))
        yes = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
        return rows.filter("quality IS NOT NULL").join(F.broadcast(pi), "lang").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("stratum"), yes("quality").alias("r1"), yes("toxic").alias("r2"), "pi")


SQL = """
edges AS (
  SELECT l_orderkey AS space_id, CASE WHEN l_returnflag = 'N' THEN n_name ELSE p_brand END AS provider,
         CASE l_returnflag WHEN 'N' THEN 'service' WHEN 'A' THEN 'model' ELSE 'runtime' END AS layer,
         p_type AS evidence_type, CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS confidence,
         l_linenumber AS source_file, CASE WHEN p_size % 5 = 0 THEN 'unmapped_public_namespace' ELSE 'model_namespace' END AS provider_basis
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), spaces AS (
  SELECT o_orderkey AS space_id, o_custkey AS author, o_orderpriority AS sdk, o_orderstatus AS runtime_stage, o_orderdate AS created_at,
         CAST(floor(o_totalprice / 10000) AS BIGINT) AS likes, o_totalprice AS price,
         1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS author_weight
  FROM orders
), specs AS (
  SELECT * FROM (VALUES ('combined', 'service'), ('combined', 'model'), ('combined', 'runtime'), ('provider_only', 'service'),
    ('provider_only', 'runtime'), ('service', 'service'), ('model', 'model')) AS t(analysis, layer)
), rankings AS (
  SELECT query, arm, rank, space_id FROM (
    SELECT sdk AS query, 'likes' AS arm, row_number() OVER (PARTITION BY sdk ORDER BY price DESC, space_id) AS rank, space_id FROM spaces
    UNION ALL
    SELECT sdk, 'createdAt', row_number() OVER (PARTITION BY sdk ORDER BY strftime(created_at, '%Y-%m-%d') DESC, space_id), space_id FROM spaces)
  WHERE rank <= 100
), versions AS (
  SELECT c_custkey AS project, coalesce(initial, []) AS initial, coalesce(current, []) AS current, coalesce(span_days, 0) AS span_days
  FROM customer LEFT JOIN (
    SELECT o_custkey, coalesce(list_sort(list(DISTINCT n_name) FILTER (WHERE l_shipdate < TIMESTAMP '1998-06-01')), []) AS initial,
           coalesce(list_sort(list(DISTINCT n_name) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-06-01')), []) AS current
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity >= 40 GROUP BY o_custkey) s ON s.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM orders GROUP BY 1) d ON d.o_custkey = c_custkey
), reviews AS (
  SELECT d.doc_id AS sample_id, lang AS stratum, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS r1, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS r2, pi
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  JOIN (SELECT lang AS g, count(quality)::DOUBLE / count(*) AS pi FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) p ON p.g = lang
  WHERE quality IS NOT NULL
)"""

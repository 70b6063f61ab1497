"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are sorted by length, longest first, and cut into buckets.  The
longest bucket gives every query a k-th best score to beat.  From it follows,
for each query and bucket, a local cosine threshold: a vector of the bucket
can only enter the result if its cosine with the query reaches it.  Buckets
whose threshold exceeds 1 are never visited (they are all the shorter ones, so
a query visits a prefix of the buckets).  In a visited bucket, a high threshold
is met by coordinate pruning (the feasible interval of the query's largest
coordinates), a low one by length pruning (a prefix of the sorted lengths);
the survivors' products are computed exactly in integers.

Queries meet buckets in blocks of ``BLOCK`` by ``BUCKET`` rows; what moves
between stages is one row per query and visited bucket, never a pair.

Defined results: vectors that are null, or hold a null or a non-finite
component, take no part; vectors of unlike dimension are never compared; rows
that repeat an id stand for one query and one candidate, with the best score of
their vectors; ties go to the smaller id; rows without an id take no part;
columns other than the id and the vector are left out, so none can clash;
queries without any candidate have no row; an empty table gives an empty result.  Components are
taken as 64-bit integers, so |256 x| must stay below 2**31 and dimensions
below 2**20 for the products to be exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import number_rows, settle

#: Vectors of a bucket, and queries of a block, that meet in one task.
BUCKET, BLOCK = 8192, 2048
#: Coordinates by which a bucket is pruned, and the local threshold from which that pays.
FOCUS, COORDINATE_FROM = 3, 0.5

_HITS = "q_id long, q_row long, v_id long, score long"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null for vectors that take no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of a bucket for each query of a block that can still reach its floor."""
    import numpy as np

    empty = pd.DataFrame({"q_id": [], "q_row": [], "v_id": [], "score": []}).astype("int64")
    if queries.empty or vectors.empty:
        return empty
    out = []
    for dim, of_dim in vectors.groupby(vectors["vec"].map(len)):
        block = queries[queries["vec"].map(len) == dim]
        if block.empty:
            continue
        ids = of_dim["id"].to_numpy("int64")
        v = np.stack(of_dim["vec"].to_numpy()).astype("int64") if dim else np.zeros((len(ids), 0), "int64")
        q = np.stack(block["vec"].to_numpy()).astype("int64") if dim else np.zeros((len(block), 0), "int64")
        length = np.sqrt((v.astype("f8") ** 2).sum(1))
        order = np.lexsort((ids, -length))
        ids, v, length = ids[order], v[order], length[order]
        unit = v / np.maximum(length, 1e-300)[:, None]
        by_coordinate: dict[int, tuple] = {}
        exact_in_double = dim * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) < 2**52
        vf = v.astype("f8") if exact_in_double else None
        q_ids, q_rows, floors = block["id"].to_numpy("int64"), block["pos"].to_numpy("int64"), block["floor"].to_numpy("f8")
        q_length = np.sqrt((q.astype("f8") ** 2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(floors > 0, floors / (q_length * length[0]), -1.0)
        for r in range(len(q_ids)):
            if floors[r] > 0 and local[r] > 1 + 1e-9:
                continue
            rows = None
            if local[r] >= COORDINATE_FROM:
                t, rows = min(local[r], 1.0) - 1e-9, None
                cosines = q[r] / q_length[r]
                for f in np.argsort(-np.abs(cosines))[:FOCUS]:
                    if f not in by_coordinate:
                        at = np.argsort(unit[:, f], kind="stable")
                        by_coordinate[f] = at, unit[at, f]
                    at, values = by_coordinate[f]
                    mid, half = cosines[f] * t, np.sqrt(max(0.0, (1 - t * t) * (1 - cosines[f] ** 2)))
                    low = -2.0 if -cosines[f] >= t else mid - half
                    high = 2.0 if cosines[f] >= t else mid + half
                    feasible = at[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, "right")]
                    rows = feasible if rows is None else np.intersect1d(rows, feasible, assume_unique=True)
            elif floors[r] > 0 and q_length[r] > 0:
                rows = np.arange(np.searchsorted(-length, -(floors[r] / q_length[r]) * (1 - 1e-9), "right"))
            if exact_in_double:
                score = ((vf if rows is None else vf[rows]) @ q[r].astype("f8")).astype("int64")
            else:
                score = (v if rows is None else v[rows]) @ q[r]
            own = ids if rows is None else ids[rows]
            keep = (own != q_ids[r]) & (score >= floors[r])
            own, score = own[keep], score[keep]
            if len(own) > len(set(own.tolist())):  # an id in several rows: its best
                at = np.lexsort((-score, own))
                at = at[np.concatenate([[True], own[at][1:] != own[at][:-1]])]
                own, score = own[at], score[at]
            if len(own) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                own, score = own[score >= cut], score[score >= cut]
            top = np.lexsort((own, -score))[:k]
            out.append((np.full(len(top), q_ids[r]), np.full(len(top), q_rows[r]), own[top], score[top]))
    if not out:
        return empty
    return pd.DataFrame({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(("q_id", "q_row", "v_id", "score"))})


def _meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Queries (block, bucket, pos, id, vec, floor) against vectors (block, bucket, pos, id, vec), each block and bucket in one task."""
    both = queries.withColumn("asks", F.lit(True)).unionByName(vectors.withColumns({"floor": F.lit(0.0), "asks": F.lit(False)}))
    return both.groupBy("block", "bucket").applyInPandas(lambda x: _best(x[x["asks"]], x[~x["asks"]], k), _HITS)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), the id of the found vector, score: each query's k highest integer inner products with other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("vec"), is_query.alias("is_query"))
    rows = rows.filter("id IS NOT NULL AND vec IS NOT NULL").withColumn("length2", F.expr("aggregate(vec, 0D, (a, x) -> a + cast(x as double) * x)"))
    placed = number_rows(rows, [F.col("length2").desc(), F.col("id")], "topk-vectors").withColumn("bucket", F.expr(f"pos div {BUCKET}"))
    n_queries = placed.filter("is_query").count()
    blocks = max(1, -(-n_queries // BLOCK))
    queries = placed.filter("is_query").select("pos", "id", "vec", "length2", F.pmod(F.xxhash64("pos"), F.lit(blocks)).alias("block"))
    probe = placed.select("bucket", "pos", "id", "vec")
    longest_probes = probe.filter("bucket = 0").withColumn("block", F.expr(f"explode(sequence(0L, {blocks - 1}L))"))
    longest = _meet(queries.withColumns({"bucket": F.lit(0).cast("long"), "floor": F.lit(float("-inf"))}).select("block", "bucket", "pos", "id", "vec", "floor"), longest_probes, k)
    longest = settle(longest, "topk-first")
    floors = longest.groupBy("q_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select(F.col("q_row").alias("pos"), F.col("least").cast("double").alias("floor"))
    # one length a bucket; a query visits the buckets up to the last whose longest vector can reach its floor
    ends = placed.groupBy("bucket").agg(F.sqrt(F.max("length2")).alias("longest")).filter("bucket > 0")
    bounds = ends.agg(F.array_sort(F.collect_list(F.struct(F.col("bucket"), F.col("longest")))).alias("bounds"))
    reach = F.expr("filter(bounds, b -> floor <= 0 OR b.longest * sqrt(length2) * (1 + 1e-9) >= floor)")
    visits = queries.join(floors, "pos", "left").fillna(float("-inf"), ["floor"]).join(F.broadcast(bounds), F.lit(True))
    visits = visits.withColumn("bucket", F.explode(F.transform(reach, lambda b: b["bucket"]))).select("block", "bucket", "pos", "id", "vec", "floor")
    # a bucket is sent to the blocks that visit it, and to no other
    visited = visits.groupBy("bucket").agg(F.collect_set("block").alias("blocks"))
    rest = _meet(visits, probe.join(visited, "bucket").withColumn("block", F.explode("blocks")).select("bucket", "pos", "id", "vec", "block"), k)
    # the filter on the row number is also applied before the shuffle: at most k rows leave a task for each query
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "v_id")
    hits = longest.unionByName(rest).groupBy("q_id", "v_id").agg(F.max("score").alias("score"))
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return hits.select(F.col("q_id").alias("query_id"), "rank", F.col("v_id").alias(id_col), "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         max(CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT)) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
  GROUP BY a.vec_id, b.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

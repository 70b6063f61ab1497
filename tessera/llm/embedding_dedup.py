"""Near-duplicates among embeddings with a pivot-permutation index.

Pivots are a bounded sample of the vectors.  A vector is described by its
``NEAREST`` closest pivots in order, and enters the inverted lists of the first
``LISTS`` of them.  Two vectors that meet in a list are candidates if their
descriptions share at least ``SHARED`` pivots, and are verified by their cosine
in double precision.

Lists are worked on in blocks: long lists are cut into chunks and each pair of
chunks is a task of its own, so no task grows with a list.  Inside a block,
shared-pivot counts and cosines are matrix products; a pair that meets in
several lists counts in the one of its least shared pivot.  A block returns a
link count per vector and, for the components, one edge from each vector to
the least it is connected with in the block: rows grow with the vectors, not
with the pairs.

The pivots are a documented bounded sample (one for ``VECTORS_A_PIVOT`` vectors,
at most ``MAX_PIVOTS``, broadcast); every vector is indexed.  The index is
approximate: pairs that share too few pivots are missed, no pair below the
threshold is ever linked.

Equal vectors are one representative with a multiplicity, so copies cost one
row.  Defined results, one row for each row of the table: vectors that are
null, zero, or hold null or non-finite components, link with nothing; vectors
of unlike dimension never link; rows that repeat an id are vectors of their
own, whether their components differ or not; rows whose id is null link like
others, but name no component, so theirs is null if no id is reachable; columns
other than the id and the vector are left out, so none can clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.runtime import settle

#: One pivot for so many vectors; never more than MAX_PIVOTS (at 64 dimensions 16 MB).
VECTORS_A_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 32, 16, 1 << 15
#: Pivots that describe a vector, the lists that it enters, and how many pivots a candidate pair shares.
NEAREST, LISTS, SHARED = 16, 8, 3
#: Products of vectors and pivots that are held at once.
HELD = 1 << 22
#: Rows of a chunk of an inverted list.
CHUNK = 1024


def _describe(sent):
    def run(batches):
        pivots = sent.value
        for batch in batches:
            vectors = batch.column(1)
            flat = np.asarray(vectors.flatten(), "f8")
            out: list = [None] * len(vectors)
            sizes = np.asarray(vectors.value_lengths())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for dim in np.unique(sizes):
                if int(dim) not in pivots:
                    continue
                rows = np.flatnonzero(sizes == dim)
                v = np.stack([flat[s : s + dim] for s in starts[rows]])
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                names, p = pivots[int(dim)]
                m = min(NEAREST, len(p))
                for at in range(0, len(v), max(1, HELD // len(p))):
                    near = v[at : at + max(1, HELD // len(p))] @ p.T
                    top = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                    for r, ids in zip(rows[at:], names[top], strict=False):
                        out[r] = ids
            yield pa.record_batch({"id": batch.column(0), "vec": vectors, "n": batch.column(2), "near": pa.array(out, pa.list_(pa.int32()))})

    return run


def _link_block(threshold: float):
    def run(key, block: pd.DataFrame) -> pd.DataFrame:
        pivot, left, right = (int(x) for x in key)
        ids, times, chunk = block["id"].to_numpy(), block["n"].to_numpy(), block["chunk"].to_numpy()
        v = np.stack(block["vec"].to_numpy()).astype("f8")
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        near = np.stack(block["near"].to_numpy())
        a = np.flatnonzero(chunk == left)
        b = a if left == right else np.flatnonzero(chunk == right)
        seen, at = np.unique(near, return_inverse=True)
        at = at.reshape(near.shape)
        has, listed = np.zeros((len(ids), len(seen)), "f4"), np.zeros((len(ids), len(seen)), "f4")
        has[np.arange(len(ids))[:, None], at] = 1
        listed[np.arange(len(ids))[:, None], at[:, :LISTS]] = 1
        earlier = listed[:, seen < pivot]
        candidate = (has[a] @ has[b].T >= min(SHARED, near.shape[1])) & (earlier[a] @ earlier[b].T == 0)
        linked = candidate & (v[a] @ v[b].T >= threshold)
        if left == right:
            np.fill_diagonal(linked, False)
        count = np.zeros(len(ids), "int64")
        count[a] += linked @ times[b]
        if left != right:
            count[b] += linked.T @ times[a]
        # the least id that each row is connected with in this block
        root = ids.copy()
        i, j = np.nonzero(linked)
        i, j = a[i], b[j]
        while len(i):
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            if (least == root).all():
                break
            root = least
        some = count > 0
        return pd.DataFrame({"id": ids[some], "links": count[some], "root": root[some]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for each id of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = "vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)"
    rows = rows.withColumn("vec", F.expr(f"CASE WHEN {sound} THEN vec END"))
    # a number for each distinct vector, fixed by writing it
    distinct = rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = settle(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    wanted = max(MIN_PIVOTS, min(MAX_PIVOTS, n // VECTORS_A_PIVOT))
    sample = distinct.orderBy(F.xxhash64("vec"), "id").limit(wanted).select("vec").collect()
    by_dim: dict[int, list] = {}
    for x in sample:
        by_dim.setdefault(len(x.vec), []).append(x.vec)
    pivots, start = {}, 0
    for dim, found in sorted(by_dim.items()):
        p = np.array(found, "f8")
        pivots[dim] = np.arange(start, start + len(p), dtype="int32"), p / np.linalg.norm(p, axis=1, keepdims=True)
        start += len(p)
    for (dim,) in distinct.select(F.size("vec")).distinct().collect():
        if dim not in pivots:  # a rare dimension without a sampled vector: one list for all of it
            pivots[dim] = np.array([start], "int32"), np.ones((1, dim))
            start += 1
    described = distinct.select("id", "vec", "n").mapInArrow(_describe(spark.sparkContext.broadcast(pivots)), "id long, vec array<double>, n long, near array<int>")
    described = settle(described, "described")
    first = F.slice("near", 1, LISTS)
    lists = described.select("id", F.explode(first).alias("pivot"))
    chunks = lists.groupBy("pivot").agg(F.expr(f"cast(ceil(count(*) / {CHUNK}) as int)").alias("chunks"))
    entries = described.withColumn("pivot", F.explode(first)).join(F.broadcast(chunks), "pivot")
    entries = entries.withColumn("chunk", F.expr("cast(pmod(xxhash64(id, pivot), chunks) as int)"))
    dealt = entries.withColumn("other", F.expr("explode(sequence(0, chunks - 1))"))
    dealt = dealt.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    found = dealt.groupBy("pivot", "lo", "hi").applyInPandas(_link_block(threshold), "id long, links long, root long")
    found = settle(found, "blocks")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.selectExpr("id AS a", "root AS b"))
    # back to all rows: those of one vector share its links and are links of each other
    rep = distinct.select("vec", "id", "n", "least").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    rep = rep.select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("root"))
    named = rep.join(rep.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("vec", "n_links", "component_id")
    whole = rows.join(named, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    whole = whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return whole.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

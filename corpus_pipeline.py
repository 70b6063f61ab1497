"""A corpus pipeline of training-data operators: toxicity, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``, the last one the packed pieces.

Defined results: rows with a null id or a null text pass every stage (a null
text stays null, and is packed as its closing id alone); rows that repeat an id
are judged each by the first two stages and as one document by the third;
further columns are carried along up to the packing, whatever their names (but
for those that begin with ``_``); texts may be as long as a row can be; an
empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, line_dedup, packing, toxicity
from tessera.llm.runtime import lacking, settle

#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in a struct, so that no name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))


def _back(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns that ``_aside`` put away, some of them changed."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return df.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; null and empty texts and null ids are scored like any other."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(toxicity.score(_aside(docs), model).filter("toxic_score < 0.3"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows."""
    kept = line_dedup.dedup(_aside(docs))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return _back(kept, docs.columns, text=text, n_chars=chars)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates; rows without an id stay."""
    groups = jaccard_join.similar_groups(docs)
    gone = settle(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return lacking(docs, gone, "doc_id").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
